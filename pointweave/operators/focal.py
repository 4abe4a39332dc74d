"""Neighbourhood operators.

The fixed rules work on tiles whose halo is the rule's reach, so one shuffle of about the raster's own size gives exact
results for a raster of any size. User rules are columns: there every cell is sent to the cells whose window it is in (a
fan-out by constant offsets), and windows are grouped. Windows are cut at the raster's edge; void cells are absent.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.algebra import KEY
from pointweave.operators.tiles import around, on_windows
from pointweave.schema import BUILDING, TREE, Frame, Raster, SceneParams, f32


def fan_out(cells: DataFrame, frame: Frame, r: int, rows: bool = True, cols: bool = True) -> DataFrame:
    """(row, col) of each window that a cell is in, with the cell's own place and columns as an ``n`` struct."""
    offsets = [F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i in (range(-r, r + 1) if rows else (0,)) for j in (range(-r, r + 1) if cols else (0,))]
    out = cells.withColumn("n", F.struct(*cells.columns)).withColumn("at", F.explode(F.array(*offsets))).select("at.row", "at.col", "n")
    return out.where(F.col("row").between(0, frame.height - 1) & F.col("col").between(0, frame.width - 1))


def focal(raster: Raster, r: int, rule: Callable[[Column, Column], Column]) -> Raster:
    """User rule over non-void cells: rule(ref, window values as a sorted array) gives the new value; 0 makes a void."""
    lists = fan_out(raster.cells, raster.frame, r).groupBy(*KEY).agg(F.array_sort(F.collect_list("n.v")).alias("window"))
    out = raster.cells.join(lists, KEY).select(*KEY, rule(F.col("v"), F.col("window")).cast("int").alias("v"))
    return raster.with_cells(out.where("v != 0"))


def focal_agg(raster: Raster, r: int, aggregates: dict[str, Column], rule: Column) -> Raster:
    """Like focal, for rules over aggregates of ``x`` (window values) and ``v``; these combine before the shuffle."""
    stats = fan_out(raster.cells, raster.frame, r).select(*KEY, F.col("n.v").alias("x")).groupBy(*KEY).agg(*[c.alias(k) for k, c in aggregates.items()])
    out = raster.cells.join(stats, KEY).select(*KEY, rule.cast("int").alias("v"))
    return raster.with_cells(out.where("v != 0"))


def focal2(a: DataFrame, frame: Frame, r: int, aggregate: Column, name: str) -> DataFrame:
    """Aggregate of ``n`` (struct of a's columns) over each window; for two-source rules."""
    return fan_out(a, frame, r).groupBy(*KEY).agg(aggregate.alias(name))


#: More than any raw value.
_NONE = 1 << 40


def _signed(v: np.ndarray) -> np.ndarray:
    """16-bit signed reading of raw values."""
    return np.where(v > 32767, v - 65536, v)


def quantile(raster: Raster, r: int, q: float, threshold: int) -> Raster:
    """The window's q-quantile where it differs from the cell by more than the threshold (16-bit signed comparison)."""
    threshold &= 65535
    share = f32(q)

    def kernel(z: np.ndarray) -> np.ndarray:
        window = np.sort(np.stack(list(around(np.where(z == 0, _NONE, z), r, _NONE))), axis=0)
        n = (window < _NONE).sum(0)
        k = np.clip(np.minimum(np.floor(share * n.astype(f32)).astype(np.int64), n - 1), 0, None)
        value = np.take_along_axis(window, k[None], 0)[0]
        return np.where(z == 0, 0, np.where(np.abs(_signed(value) - _signed(z)) > threshold, value, z))

    return raster.with_cells(on_windows({"z": raster.cells}, raster.frame, r, kernel))


def median(raster: Raster, r: int, threshold: int) -> Raster:
    return quantile(raster, r, 0.5, threshold)


def _square(z: np.ndarray, r: int, best, outside: int) -> np.ndarray:
    """Extreme of each cell's window: along rows, then along columns."""
    for along in ({"rows": False}, {"cols": False}):
        z = best.reduce(list(around(z, r, outside, **along)))
    return z


def minimum(raster: Raster, r: int, threshold: int) -> Raster:
    """The window's minimum where the cell is higher by more than the threshold."""
    threshold &= 65535

    def kernel(z: np.ndarray) -> np.ndarray:
        m = _square(np.where(z == 0, _NONE, z), r, np.minimum, _NONE)
        return np.where(z > m + threshold, m, z)

    return raster.with_cells(on_windows({"z": raster.cells}, raster.frame, r, kernel))


def maximum(raster: Raster, r: int, threshold: int) -> Raster:
    """The window's maximum where the cell is lower by more than the threshold."""
    threshold &= 65535

    def kernel(z: np.ndarray) -> np.ndarray:
        m = _square(z, r, np.maximum, 0)
        return np.where((z != 0) & (z + threshold < m), m, z)

    return raster.with_cells(on_windows({"z": raster.cells}, raster.frame, r, kernel))


def edges(raster: Raster, threshold: int) -> Raster:
    """Void where some neighbour, voids among them as 0, differs by more than the threshold (16-bit signed)."""
    threshold &= 65535

    def kernel(z: np.ndarray) -> np.ndarray:
        own = _signed(z)
        steps = [np.where(x == -_NONE, 0, np.abs(x - own)) for x in around(own, 1, -_NONE)]
        return np.where(np.maximum.reduce(steps) <= threshold, z, 0)

    return raster.with_cells(on_windows({"z": raster.cells}, raster.frame, 1, kernel))


def wells(raster: Raster, params: SceneParams) -> Raster:
    """Void where at least four neighbours are far above the cell."""
    limit = (params.max_tree_height * params.agl) ** 0.5 / float(f32(raster.frame.scale))

    def kernel(z: np.ndarray) -> np.ndarray:
        return np.where(sum((x > z + limit).astype(np.int64) for x in around(z, 1, 0)) < 4, z, 0)

    return raster.with_cells(on_windows({"z": raster.cells}, raster.frame, 1, kernel))


def tree_voids(dsm: Raster, low: Raster, params: SceneParams) -> Raster:
    """The surface without cells where first and last returns differ in the whole window, unless by more than a tree."""
    ratio = f32(f32(low.frame.scale) / f32(dsm.frame.scale))
    limit = int(params.max_tree_height / float(f32(low.frame.scale)))
    threshold = dsm.frame.units(params.dz) & 65535

    def kernel(z: np.ndarray, o: np.ndarray) -> np.ndarray:
        apart = np.where(z == 0, 0, np.maximum((z.astype(f32) - ratio * o.astype(f32)).astype(np.int64), 0))
        loose = (_square(apart, 1, np.minimum, _NONE) > threshold) & (apart <= limit)
        return np.where(loose, 0, z)

    return dsm.with_cells(on_windows({"z": dsm.cells, "o": low.cells}, dsm.frame, 1, kernel))


def agl_median(raster: Raster, params: SceneParams) -> Raster:
    return quantile(raster, 2, 0.5, raster.frame.units(params.dz))


def steps(raster: Raster, reach: int, threshold: int) -> DataFrame:
    """Cells with a step down to a cell at distance ``reach`` that exceeds the slope beyond it; positions are clamped."""
    f = raster.frame
    clamp = lambda c, d, n: F.greatest(F.lit(0), F.least(F.col(c) + d, F.lit(n - 1)))
    full = raster.grid().join(raster.cells, KEY, "left").select(*KEY, F.coalesce("v", F.lit(0)).alias("v"))
    dirs = F.explode(F.array(*[F.struct(F.lit(i * reach).alias("i"), F.lit(j * reach).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    fan = full.withColumn("d", dirs)
    fan = fan.select("*", clamp("row", F.col("d.i"), f.height).alias("r1"), clamp("col", F.col("d.j"), f.width).alias("c1"), clamp("row", 2 * F.col("d.i"), f.height).alias("r2"), clamp("col", 2 * F.col("d.j"), f.width).alias("c2"))
    one = raster.cells.select(F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("v").alias("z1"))
    two = raster.cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("v").alias("z2"))
    out = fan.join(one, ["r1", "c1"]).join(two, ["r2", "c2"], "left")
    return out.where(F.col("v") - 2 * F.col("z1") + F.coalesce("z2", F.lit(0)) > threshold).select(*KEY).distinct()


def extend(raster: Raster, labelled: DataFrame, rounds: int, threshold: int) -> DataFrame:
    """Grow labelled cells into neighbours that are not much lower and stand above some neighbour of their own."""
    f, half = raster.frame, threshold / 2.0
    full = raster.grid().join(raster.cells, KEY, "left").select(*KEY, F.coalesce("v", F.lit(0)).alias("v"))
    out = labelled.select(*KEY)
    for _ in range(rounds):
        inner = out.where(F.col("row").between(1, f.height - 2) & F.col("col").between(1, f.width - 2)).join(full, KEY)
        near = fan_out(inner, f, 1).select(*KEY, F.col("n.v").alias("x")).groupBy(*KEY).agg(F.min("x").alias("x")).join(full, KEY).where(F.col("x") - F.col("v") < half)
        near = near.select(*KEY, "v").join(out, KEY, "left_anti")
        low = fan_out(full, f, 1).groupBy(*KEY).agg(F.min("n.v").alias("low"))
        out = out.unionAll(near.join(low, KEY).where(F.col("v") - F.col("low") > half).select(*KEY))
    return out


def erode_dilate(frame: Frame, labelled: DataFrame) -> DataFrame:
    """Labelled cells that have, in their window, a labelled cell whose own window is all labelled."""
    rows = F.when((F.col("row") == 0) | (F.col("row") == frame.height - 1), 2 if frame.height > 1 else 1).otherwise(3)
    cols = F.when((F.col("col") == 0) | (F.col("col") == frame.width - 1), 2 if frame.width > 1 else 1).otherwise(3)
    solid = fan_out(labelled.select(*KEY), frame, 1).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == rows * cols).select(*KEY)
    return labelled.select(*KEY).join(fan_out(solid, frame, 1).select(*KEY).distinct(), KEY, "left_semi")


def grow_buildings(classes: DataFrame, dsm: Raster, params: SceneParams, rounds: int = 5) -> DataFrame:
    """Tree cells beside a building cell of about the same height become building, round by round."""
    reach = max(1, int(params.dh / dsm.frame.gsd))
    limit = dsm.frame.units(params.dz)

    def kernel(v: np.ndarray, z: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            houses = around(np.where(v == BUILDING, z, -_NONE), reach, -_NONE)
            v = np.where((v == TREE) & np.logical_or.reduce([np.abs(x - z) < limit for x in houses]), BUILDING, v)
        return v

    return on_windows({"v": classes, "z": dsm.cells}, dsm.frame, rounds * reach, kernel)


def building_majority(classes: DataFrame, frame: Frame) -> DataFrame:
    """Cells whose window is at least half building become building (4 of 9)."""

    def kernel(v: np.ndarray) -> np.ndarray:
        houses = sum(around((v == BUILDING).astype(np.int64), 1, 0))
        cells = sum(around(np.ones_like(v), 1, 0))
        return np.where((v != 0) & (houses >= cells // 2), BUILDING, v)

    return on_windows({"v": classes}, frame, 1, kernel)
