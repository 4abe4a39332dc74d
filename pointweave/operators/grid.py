"""Gridding of points: cell projection, 2x2 splat and the aggregates over it. Order-free aggregates combine before the
shuffle, so a crowded cell costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.schema import CloudMeta, Frame, Raster, SceneParams, f32


def cloud_meta(points: DataFrame, zone: int = 0) -> CloudMeta:
    """Count and bounds in one job. An empty cloud has none: ValueError."""
    r = points.agg(F.count(F.lit(1)), *[f(c) for c in ("x", "y", "z") for f in (F.min, F.max)]).first()
    if not r[0]:
        raise ValueError("the point cloud is empty")
    return CloudMeta(*r, zone)


def bounds_table(points: DataFrame) -> DataFrame:
    cols = [f(c).alias(f"{c}{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))]
    return points.agg(F.count(F.lit(1)).alias("n"), *cols).withColumns({f"{c}off": F.floor(f"{c}min").cast("int") for c in ("x", "y", "z")})


def crop_to_class(points: DataFrame, label: int) -> DataFrame:
    return points.where(F.col("classification") == label)


def translate(points: DataFrame, tx: float, ty: float, tz: float) -> DataFrame:
    return points.withColumns({"x": F.col("x") + F.lit(tx), "y": F.col("y") + F.lit(ty), "z": F.col("z") + F.lit(tz)})


def frame_of(meta: CloudMeta, gsd: float, bounds: tuple[float, float, float, float] | None = None, like: Frame | None = None) -> Frame:
    """Extent from the cloud, from (xmin, xmax, ymin, ymax) or like another raster; scale always from the whole cloud."""
    low, high = f32(meta.zmin - 1), f32(meta.zmax + 1)
    scale, offset, step = float(f32(f32(high - low) / f32(65535))), float(low), float(f32(gsd))
    if like:
        return Frame(like.easting, like.northing, step, like.width, like.height, scale, offset, meta.zone)
    if bounds:
        x0, x1, y0, y1 = bounds
        return Frame(x0, y0, step, int((x1 - x0) / step), int((y1 - y0) / step), scale, offset, meta.zone)
    return Frame(meta.xmin, meta.ymin, step, int((meta.xmax - meta.xmin) / step + 1), int((meta.ymax - meta.ymin) / step + 1), scale, offset, meta.zone)


def projected(points: DataFrame, meta: CloudMeta, frame: Frame) -> DataFrame:
    """Adds r, c, q: the splat's first row and column, and the raw height; all cut toward zero."""
    xo, yo, zo = meta.origin
    m = 1.0 / frame.gsd
    mz = float(f32(1) / f32(frame.scale))
    local = lambda c, o: (F.col(c) - F.lit(float(o))).cast("float").cast("double")
    x = F.lit(m) * local("x", xo) + F.lit(m * (xo - frame.easting) - 0.5)
    y = F.lit(-m) * local("y", yo) + F.lit(frame.height - 1 - m * (yo - frame.northing) + 0.5)
    z = F.lit(mz) * local("z", zo) + F.lit(mz * float(f32(f32(zo) - f32(frame.offset))))
    return points.withColumns({"r": y.cast("int"), "c": x.cast("int"), "q": z.cast("int")})


def splat(points: DataFrame, meta: CloudMeta, frame: Frame) -> DataFrame:
    """Up to four rows (row, col, q, ...) per point: the cells (r..r+1, c..c+1) inside the frame."""
    return _spread(projected(points, meta, frame), frame)


def _spread(based: DataFrame, frame: Frame) -> DataFrame:
    """Rows with r and c to those of the cells (r..r+1, c..c+1) inside the frame."""
    spots = F.explode(F.array(*[F.struct((F.col("r") + i).alias("row"), (F.col("c") + j).alias("col")) for i in (0, 1) for j in (0, 1)]))
    out = based.withColumn("at", spots).select("*", "at.row", "at.col").drop("at", "r", "c")
    return out.where(F.col("row").between(0, frame.height - 1) & F.col("col").between(0, frame.width - 1))


def _window(points: DataFrame, frame: Frame, bounds) -> DataFrame:
    """With bounds, a range predicate (with a margin of two cells) that scans can push down."""
    if not bounds:
        return points
    e = 2 * frame.gsd
    return points.where(F.col("x").between(bounds[0] - e, bounds[1] + e) & F.col("y").between(bounds[2] - e, bounds[3] + e))


def grid(points: DataFrame, meta: CloudMeta, gsd: float, how: str = "max", bounds=None, like: Frame | None = None) -> Raster:
    """Highest or lowest raw height per cell. Points of one first cell combine before they are spread over four."""
    frame = frame_of(meta, gsd, bounds, like)
    best = {"max": F.max, "min": F.min}[how]
    based = projected(_window(points, frame, bounds).select("x", "y", "z"), meta, frame).where("q != 0").groupBy("r", "c").agg(best("q").alias("q"))
    cells = _spread(based, frame).groupBy("row", "col").agg(best("q").alias("v"))
    return Raster(cells, frame)


def intensity(points: DataFrame, meta: CloudMeta, dsm: Raster, params: SceneParams, final_mean: bool = False) -> Raster:
    """Mean intensity of points near the surface, scaled to 16 bits by the highest running mean in point order (or, with
    final_mean, by the highest mean). The running mean sorts each cell's points only."""
    near = splat(points.select("point_id", "x", "y", "z", "intensity"), meta, dsm.frame).join(dsm.cells, ["row", "col"], "left")
    near = near.where(F.abs(F.col("q") - F.coalesce("v", F.lit(0))) < dsm.frame.units(params.dz)).withColumn("i", F.col("intensity").cast("double"))
    means = near.groupBy("row", "col").agg(F.sum("i").alias("s"), F.count(F.lit(1)).alias("k"))
    if final_mean:
        top = means.agg(F.max(F.col("s") / F.col("k"))).first()[0]
    else:
        run = Window.partitionBy("row", "col").orderBy("point_id").rowsBetween(Window.unboundedPreceding, 0)
        top = near.select((F.sum("i").over(run) / F.count(F.lit(1)).over(run)).alias("m")).agg(F.max("m")).first()[0]
    if not top or top <= 0:
        return dsm.with_cells(dsm.cells.where(F.lit(False)))
    v = (F.lit(65535.0 / top) * F.col("s") / F.col("k")).cast("int").bitwiseAND(65535)
    return dsm.with_cells(means.select("row", "col", v.alias("v")).where("v != 0"))


#: Cells of the largest terrain that every executor gets (some 25 MB); a larger one meets the points by a shuffle.
SENT_CELLS = 1 << 19


def lowest_above(points: DataFrame, meta: CloudMeta, dsm: Raster, dtm: Raster, params: SceneParams) -> Raster:
    """Lowest raw height that is over the terrain by more than the above-ground threshold. A point meets its cells' terrain
    first, as the build side of a hash join, so that only cells are grouped."""
    f = dsm.frame
    floor = dtm.cells.select("row", "col", (F.col("v") + f.units(params.agl)).alias("floor"))
    floor = F.broadcast(floor) if f.width * f.height <= SENT_CELLS else floor.hint("shuffle_hash")
    over = splat(points.select("x", "y", "z"), meta, f).withColumn("q", F.col("q").bitwiseAND(65535)).join(floor, ["row", "col"]).where("q > floor")
    return dsm.with_cells(over.groupBy("row", "col").agg(F.min("q").alias("v")))


def lowest_above_raster(dsm: Raster, dtm: Raster, params: SceneParams) -> Raster:
    """The same for raster input: surface cells that are not over the terrain by enough become void."""
    t = dtm.cells.withColumnRenamed("v", "t")
    both = dsm.cells.join(t, ["row", "col"], "left").where(F.col("v") > F.coalesce("t", F.lit(0)) + dsm.frame.units(params.agl))
    return dsm.with_cells(both.select("row", "col", "v"))


def count_voids(raster: Raster) -> DataFrame:
    return raster.cells.agg((F.lit(raster.frame.width * raster.frame.height) - F.count(F.lit(1))).alias("voids"))


def metres(v: Column, frame: Frame) -> Column:
    """Raw units to metres, in 32-bit arithmetic."""
    return v.cast("float") * F.lit(frame.scale).cast("float") + F.lit(frame.offset).cast("float")
