"""Surface models over streams of points. The frame is fixed up front, as extremes of a stream are never final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.grid import splat
from pointweave.schema import CloudMeta, Frame


def incremental_surface(points: DataFrame, meta: CloudMeta, frame: Frame, how: str = "max") -> DataFrame:
    """Cells of a (streaming or batch) point table; state is one row per cell. For update or complete mode."""
    best = {"max": F.max, "min": F.min}[how]
    return splat(points, meta, frame).where("q != 0").groupBy("row", "col").agg(best("q").alias("v"))


def windowed_surface(points: DataFrame, meta: CloudMeta, frame: Frame, time: str, length: str, delay: str) -> DataFrame:
    """One surface per time window; points later than the delay are dropped and closed windows leave the state."""
    late = points.withWatermark(time, delay)
    return splat(late, meta, frame).where("q != 0").groupBy(F.window(time, length), "row", "col").agg(F.max("q").alias("v"))


def align_stream(views, params, out):
    """foreachBatch function: the first non-empty batch becomes the reference; later ones go, aligned, to out(df, result)."""
    from pointweave.operators.grid import translate
    from pointweave.plans.alignment import align_rasters, prepared

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if not views:
            views.append(prepared(batch, params))
            return
        result = align_rasters(views[0], prepared(batch, params, views[0].frame.gsd), params)
        out(translate(batch, result["tx"], result["ty"], result["tz"]), result)

    return each
