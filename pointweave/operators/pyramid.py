"""Multigrid void filling. A level's cells are averages of 3x3 windows of the level below; voids are filled downward."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.algebra import KEY
from pointweave.schema import Frame, Raster


def reduce_level(cells: DataFrame, frame: Frame) -> tuple[DataFrame, Frame]:
    """Half the size: each cell is the whole-number mean of the non-void cells around (2row+1, 2col+1)."""
    h, w = frame.height // 2, frame.width // 2
    up = lambda c: F.when(F.col(c) % 2 == 1, F.array(F.floor(F.col(c) / 2).cast("int"))).otherwise(F.array((F.col(c) / 2).cast("int") - 1, (F.col(c) / 2).cast("int")))
    fan = cells.select(F.explode(up("row")).alias("row"), "col", "v").select("row", F.explode(up("col")).alias("col"), "v")
    fan = fan.where(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1))
    out = fan.groupBy(*KEY).agg(F.expr("cast(sum(v) div count(1) as int)").alias("v")).where("v != 0")
    return out, replace(frame, height=h, width=w)


def fill_nearest(cells: DataFrame, frame: Frame, above: DataFrame, upper: Frame) -> DataFrame:
    """Voids take the value of the cell above them. A coarse cell is spread over its children; nothing else is made."""
    spread = lambda c, n, big: F.sequence(2 * F.col(c), F.when(F.col(c) == n - 1, F.lit(big - 1)).otherwise(2 * F.col(c) + 1))
    down = above.select(F.explode(spread("row", upper.height, frame.height)).alias("row"), "col", "v").select("row", F.explode(spread("col", upper.width, frame.width)).alias("col"), F.col("v").alias("o"))
    return cells.join(down, KEY, "full").select(*KEY, F.coalesce("v", "o").alias("v"))


def fill_smooth(cells: DataFrame, frame: Frame, above: DataFrame, upper: Frame) -> DataFrame:
    """Voids take a weighted mean of what is around them: own cells, else the cell above each place (no clamping)."""
    double = lambda c: F.sequence(2 * F.col(c), 2 * F.col(c) + 1)
    down = above.select(F.explode(double("row")).alias("row"), "col", "v").select("row", F.explode(double("col")).alias("col"), F.col("v").alias("o"))
    # a row or column beyond an even edge still finds a cell above it only inside the upper frame
    known = cells.join(down, KEY, "full").select(*KEY, F.coalesce("v", "o").alias("z"))
    around = F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col"), F.lit(2 if 0 in (i, j) else 1).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    fan = known.withColumn("at", around).select("at.row", "at.col", "at.w", "z").where(F.col("row").between(0, frame.height - 1) & F.col("col").between(0, frame.width - 1))
    mean = fan.groupBy(*KEY).agg(F.expr("cast(sum(w * z) div sum(w) as int)").alias("m"))
    return cells.join(mean, KEY, "full").select(*KEY, F.coalesce("v", "m").alias("v"))


def fill(raster: Raster, smooth: bool = False, levels: int | None = None) -> Raster:
    """Fill voids down from ``levels`` coarser levels (default: until a side has one cell)."""
    stack = [(raster.cells, raster.frame)]
    while (levels is None or len(stack) <= levels) and min(stack[-1][1].height, stack[-1][1].width) >= 2:
        stack.append(reduce_level(*stack[-1]))
    for k in range(len(stack) - 2, -1, -1):
        down = fill_smooth if smooth else fill_nearest
        stack[k] = (down(*stack[k], *stack[k + 1]), stack[k][1])
    return raster.with_cells(stack[0][0].where("v != 0"))
