"""Cloud aligner: the translation that brings a target cloud or raster onto a reference."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from pointweave.operators import align, focal, grid, pyramid
from pointweave.plans.storage import store
from pointweave.schema import AlignParams, Raster
from pointweave.sources import files


def prepared(data: DataFrame | Raster, params: AlignParams, gsd: float | None = None) -> Raster:
    """Surface with small voids filled and steep cells removed."""
    raw = data if isinstance(data, Raster) else grid.grid(data, grid.cloud_meta(data), gsd or params.gsd, "max")
    filled = raw.with_cells(store(pyramid.fill(raw, levels=2).cells, "surface"))
    return filled.with_cells(store(focal.edges(filled, filled.frame.units(params.edge)).cells, "surface"))


def align_rasters(reference: Raster, target: Raster, params: AlignParams) -> dict:
    scored = align.scores(reference, target, params)
    return align.estimate(scored, min(reference.frame.gsd, target.frame.gsd), params.maxt)


def align_clouds(reference: DataFrame | Raster, target: DataFrame | Raster, params: AlignParams | None = None) -> tuple[dict, DataFrame | Raster]:
    """Offsets, and the target moved by them. The target is gridded with the reference's cell size."""
    params = params or AlignParams()
    ref = prepared(reference, params)
    result = align_rasters(ref, prepared(target, params, ref.frame.gsd), params)
    t = (result["tx"], result["ty"], result["tz"])
    moved = Raster(target.cells, target.frame.moved(*t)) if isinstance(target, Raster) else grid.translate(target, *t)
    return result, moved


def align_files(spark: SparkSession, reference: str, target: str, params: AlignParams | None = None) -> dict:
    """Writes <target>_offsets, and <target>_aligned as points or as a raster."""
    result, moved = align_clouds(files.load(spark, reference), files.load(spark, target), params)
    base = target.rsplit(".", 1)[0] if "." in target.rsplit("/", 1)[-1] else target
    files.write_offsets(spark, result, f"{base}_offsets")
    if isinstance(moved, Raster):
        files.write_raster(moved, f"{base}_aligned_raster")
    else:
        files.write_points(moved, f"{base}_aligned")
    return result


def align_views(views: Iterable[DataFrame], params: AlignParams | None = None) -> Iterator[tuple[dict, DataFrame]]:
    """The first non-empty view is the reference and is not returned; each later one is aligned to it."""
    params, fixed = params or AlignParams(), None
    for view in views:
        if fixed is None:
            if not view.isEmpty():
                fixed = prepared(view, params)
            continue
        result = align_rasters(fixed, prepared(view, params, fixed.frame.gsd), params)
        yield result, grid.translate(view, result["tx"], result["ty"], result["tz"])
