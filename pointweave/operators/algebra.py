"""Map algebra: rasters of one frame joined on (row, col)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.grid import metres
from pointweave.schema import Raster, f32

KEY = ["row", "col"]


def _other(r: Raster, name: str = "o") -> DataFrame:
    return r.cells.withColumnRenamed("v", name)


def _ratio(a: Raster, b: Raster) -> float:
    return float(f32(f32(b.frame.scale) / f32(a.frame.scale)))


def add(a: Raster, b: Raster) -> Raster:
    """a + b in a's scale; offsets add."""
    both = a.cells.join(_other(b), KEY, "full")
    total = F.coalesce("v", F.lit(0)).cast("float") + F.lit(_ratio(a, b)).cast("float") * F.coalesce("o", F.lit(0)).cast("float")
    cells = both.select(*KEY, total.cast("int").bitwiseAND(65535).alias("v")).where("v != 0")
    return Raster(cells, replace(a.frame, offset=float(f32(a.frame.offset + b.frame.offset))))


def subtract(a: Raster, b: Raster) -> Raster:
    """a - b in a's scale, zero (void) where b is as high or higher; offsets subtract."""
    both = a.cells.join(_other(b), KEY, "left")
    rest = F.col("v").cast("float") - F.lit(_ratio(a, b)).cast("float") * F.coalesce("o", F.lit(0)).cast("float")
    cells = both.select(*KEY, F.greatest(rest.cast("int"), F.lit(0)).alias("v")).where("v > 0")
    return Raster(cells, replace(a.frame, offset=float(f32(a.frame.offset - b.frame.offset))))


def void_where_void(a: Raster, by: Raster) -> Raster:
    """a, void where ``by`` is void."""
    return a.with_cells(a.cells.join(by.cells.select(*KEY), KEY, "left_semi"))


def void_under(a: Raster, mask: DataFrame) -> Raster:
    """a, void on the mask's cells."""
    return a.with_cells(a.cells.join(mask.select(*KEY), KEY, "left_anti"))


def at_most(a: Raster, by: Raster) -> Raster:
    """a, lowered to ``by`` where both hold values."""
    both = a.cells.join(_other(by), KEY, "left")
    return a.with_cells(both.select(*KEY, F.least("v", F.coalesce("o", "v")).alias("v")))


def at_least(a: Raster, by: Raster) -> Raster:
    """a, raised to ``by`` where both hold values."""
    both = a.cells.join(_other(by), KEY, "left")
    return a.with_cells(both.select(*KEY, F.greatest("v", F.coalesce("o", "v")).alias("v")))


def rescale(a: Raster, offset: float, scale: float) -> Raster:
    """The same heights in another scale and offset; voids stay."""
    if (offset, scale) == (a.frame.offset, a.frame.scale):
        return a
    z = (metres(F.col("v"), a.frame) - F.lit(offset).cast("float")).cast("double") / F.lit(scale)
    cells = a.cells.select(*KEY, z.cast("float").cast("int").bitwiseAND(65535).alias("v")).where("v != 0")
    return Raster(cells, replace(a.frame, offset=offset, scale=scale))


def common_scale(a: Raster, b: Raster) -> tuple[float, float]:
    """Offset and scale that hold the heights of both rasters."""
    low = min(a.frame.offset, b.frame.offset)
    high = max(f32(f32(r.frame.scale) * f32(65535)) + f32(r.frame.offset) for r in (a, b))
    return float(f32(low)), float(f32((f32(high) - f32(low)) / f32(65535)))


def to_metres(a: Raster, void: float | None = None) -> DataFrame:
    """Heights in metres; with ``void``, every cell of the frame."""
    if void is None:
        return a.cells.select(*KEY, metres(F.col("v"), a.frame).alias("z"))
    full = a.grid().join(a.cells, KEY, "left")
    return full.select(*KEY, F.when(F.col("v").isNull(), F.lit(void).cast("float")).otherwise(metres(F.col("v"), a.frame)).alias("z"))


def upsample(cells: DataFrame, k: int) -> DataFrame:
    """Every cell as k x k cells."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    wide = cells.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return wide.select((F.col("row") * k + F.col("i")).alias("row"), (F.col("col") * k + F.col("j")).alias("col"), "v")
