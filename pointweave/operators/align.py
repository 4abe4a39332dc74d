"""Registration of a target raster to a reference one: every translation of a grid is scored on one set of samples.

Translations are a small table on the driver. Samples meet the cells that they may probe on tiles, where array kernels probe
all translations; what leaves a tile is one row of differences a translation, which keeps its first N valid samples.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.twister import uniform_pairs
from pointweave.plans.storage import store
from pointweave.schema import AlignParams, Frame, Raster, f32


def overlap(a: Frame, b: Frame) -> tuple[float, float, float, float]:
    """xmin, xmax, ymin, ymax that both rasters cover. ValueError without overlap."""
    x0, x1 = max(a.easting, b.easting), min(a.easting + a.width * a.gsd, b.easting + b.width * b.gsd)
    y0, y1 = max(a.northing, b.northing), min(a.northing + a.height * a.gsd, b.northing + b.height * b.gsd)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("reference and target do not overlap")
    return x0, x1, y0, y1


def samples(spark: SparkSession, box: tuple[float, float, float, float], params: AlignParams) -> DataFrame:
    """sample_id, x, y inside the box: "hash" spreads a fixed multiplicative sequence (SQL can repeat it), "twister" draws
    from the 64-bit Mersenne twister with seed 0."""
    x0, x1, y0, y1 = map(float, box)
    if params.sampler == "twister":
        xy = uniform_pairs(params.draws)
        rows = [(i, x0 + u * (x1 - x0), y0 + v * (y1 - y0)) for i, (u, v) in enumerate(xy)]
        return spark.createDataFrame(rows, "sample_id long, x double, y double")
    u, v = (F.expr(f"cast((id * {k} + {c}) % 1000003 as double) / 1000003.0D") for k, c in ((618033, 7919), (754877, 104729)))
    return spark.range(params.draws).select(F.col("id").alias("sample_id"), (F.lit(x0) + u * F.lit(x1 - x0)).alias("x"), (F.lit(y0) + v * F.lit(y1 - y0)).alias("y"))


def translations(spark: SparkSession, step: float, maxt: float) -> DataFrame:
    """i, j, dx, dy of the search grid (at most a few thousand rows)."""
    step = f32(step)
    maxt = f32(step * f32(math.ceil(maxt / step)))
    n = int(maxt / step * 2) + 1
    move = [float(f32(-maxt + f32(i) * step)) for i in range(n)]
    return spark.createDataFrame([(i, j, move[i], move[j]) for i in range(n) for j in range(n)], "i int, j int, dx double, dy double")


#: Side of the tiles that samples and cells meet on, in cells of the finer raster.
SIDE = 128
#: Samples of a tile that are probed at a time; probes of one turn, at least.
PROBED, TURN = 400, 20_000_000

_PROBES = "i int, j int, ids binary, d binary"


def _tiled(raster: Raster, kind: int, x0: float, y0: float, side: float, reach: float) -> DataFrame:
    """Cells at every tile whose samples may probe them."""
    f = raster.frame
    x = F.lit(f.easting) + F.col("col") * F.lit(f.gsd)
    y = F.lit(f.northing) + (F.lit(f.height - 1) - F.col("row")) * F.lit(f.gsd)
    far = reach + 2 * f.gsd
    tiles = lambda c, o: F.sequence(F.floor((c - F.lit(o + far)) / F.lit(side)), F.floor((c - F.lit(o - far)) / F.lit(side)))
    cells = raster.cells.withColumn("tx", F.explode(tiles(x, x0))).withColumn("ty", F.explode(tiles(y, y0)))
    return cells.select("tx", "ty", F.lit(kind).alias("kind"), F.col("row").cast("long").alias("p"), F.col("col").cast("long").alias("q"), F.col("v").cast("double").alias("x"), F.lit(0.0).alias("y"))


def _heights(own: pd.DataFrame, frame: Frame) -> tuple[np.ndarray, int, int]:
    """Heights in metres (32-bit) of a tile's cells, voids as NaN, and the first row and column."""
    if not len(own):
        return np.full((1, 1), np.nan, f32), 0, 0
    row, col = own["p"].to_numpy(), own["q"].to_numpy()
    z = np.full((row.max() - row.min() + 1, col.max() - col.min() + 1), np.nan, f32)
    z[row - row.min(), col - col.min()] = own["x"].to_numpy().astype(f32) * f32(frame.scale) + f32(frame.offset)
    return z, int(row.min()), int(col.min())


def _probe(reference: Frame, target: Frame, moves: np.ndarray, wanted: np.ndarray):
    """Height differences of a tile's samples under every wanted translation, where both rasters hold a value. Probes off a
    raster, in its last row or column or on a void are dropped."""

    def at(frame: Frame, heights: tuple[np.ndarray, int, int], x: np.ndarray, y: np.ndarray, sign: float) -> np.ndarray:
        z, r0, c0 = heights
        col = np.trunc((x[:, None] - frame.easting + sign * 0.5 * moves) / frame.gsd).astype(np.int64)
        row = frame.height - 1 - np.trunc((y[:, None] - frame.northing + sign * 0.5 * moves) / frame.gsd).astype(np.int64)
        col = np.where((col >= 0) & (col <= frame.width - 2), col - c0, -1)
        row = np.where((row >= 0) & (row <= frame.height - 2), row - r0, -1)
        wide = np.pad(z, 1, constant_values=np.nan)  # what is beyond the cells is void
        col, row = np.clip(col, -1, z.shape[1]) + 1, np.clip(row, -1, z.shape[0]) + 1
        return wide[row[:, None, :], col[:, :, None]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {k: own for k, own in pdf.groupby("kind")}
        none, out = pdf.iloc[:0], [([], []) for _ in range(wanted.size)]
        there, here = _heights(kinds.get(1, none), reference), _heights(kinds.get(2, none), target)
        own = kinds.get(0, none)
        for lo in range(0, len(own), PROBED):
            part = own.iloc[lo : lo + PROBED]
            x, y, ids = (part[c].to_numpy() for c in ("x", "y", "p"))
            d = at(reference, there, x, y, -1.0) - at(target, here, x, y, 1.0)
            known = ~np.isnan(d)
            for k, (i, j) in enumerate(np.argwhere(wanted)):
                own_ids = known[:, i, j]
                out[k][0].append(ids[own_ids])
                out[k][1].append(d[own_ids, i, j])
        rows = [(i, j, np.concatenate(a).astype("<i8").tobytes(), np.concatenate(b).astype("<f4").tobytes()) for (i, j), (a, b) in zip(np.argwhere(wanted).tolist(), out, strict=False) if a and sum(map(len, a))]
        return pd.DataFrame(rows, columns=["i", "j", "ids", "d"])

    return run


def _scored(moves: np.ndarray, params: AlignParams):
    """Score of one translation from its first valid samples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(b, "<i8") for b in pdf["ids"]])
        d = np.concatenate([np.frombuffer(b, "<f4") for b in pdf["d"]])
        d = np.sort(d[np.argsort(ids, kind="stable")][: params.samples])
        i, j, n = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), len(d)
        names = ["i", "j", "dx", "dy", "n", "tz", "rms", "completeness"]
        if n < params.samples:
            return pd.DataFrame([], columns=names)
        tz = d[n // 2]
        e = np.sort(np.abs(d - tz))
        return pd.DataFrame([(i, j, moves[i], moves[j], n, tz, e[math.floor(n * 0.67)], f32((e < 1.0).sum()) / f32(params.samples))], columns=names)

    return run


def scores(reference: Raster, target: Raster, params: AlignParams) -> DataFrame:
    """Per translation: i, j, dx, dy, n, tz (upper median), rms (67th percentile deviation), completeness.

    Samples and the cells that their probes may reach meet on tiles, so each is shuffled once and no pair of a sample and a
    translation is a row. Samples go in order, some at a time, until every translation has enough valid ones.
    """
    spark = reference.cells.sparkSession
    box = overlap(reference.frame, target.frame)
    gsd = min(reference.frame.gsd, target.frame.gsd)
    table = translations(spark, gsd, params.maxt).orderBy("j", "i").collect()  # the grid's side, squared
    moves = np.array([r["dx"] for r in table if r["j"] == 0])
    reach, side = float(np.abs(moves).max()) / 2, SIDE * gsd
    x0, _, y0, _ = map(float, box)
    cells = _tiled(reference, 1, x0, y0, side, reach).unionAll(_tiled(target, 2, x0, y0, side, reach))
    drawn = samples(spark, box, params)
    wanted, lo, parts, counts = np.ones((len(moves), len(moves)), bool), 0, None, np.zeros((len(moves), len(moves)), np.int64)
    turn = max(4 * params.samples, TURN // counts.size)
    while lo < params.draws and wanted.any():
        own = drawn.where((F.col("sample_id") >= lo) & (F.col("sample_id") < lo + turn))
        tile = lambda c, o: F.floor((F.col(c) - F.lit(o)) / F.lit(side))
        own = own.select(tile("x", x0).alias("tx"), tile("y", y0).alias("ty"), F.lit(0).alias("kind"), F.col("sample_id").alias("p"), F.lit(0).cast("long").alias("q"), "x", "y")
        found = store(own.unionAll(cells).groupBy("tx", "ty").applyInPandas(_probe(reference.frame, target.frame, moves, wanted.copy()), _PROBES), "probes")
        for r in found.groupBy("i", "j").agg(F.sum(F.octet_length("d") / 4).alias("n")).collect():  # one row a translation
            counts[r["i"], r["j"]] += int(r["n"])
        wanted = counts < params.samples
        parts, lo = found if parts is None else parts.unionAll(found), lo + turn
    return parts.groupBy("i", "j").applyInPandas(_scored(moves, params), "i int, j int, dx double, dy double, n int, tz float, rms float, completeness float")


def best(scored: DataFrame) -> DataFrame:
    """The translation of least rms, then of least length, then the first."""
    order = [F.col("rms"), F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.col("i"), F.col("j")]
    return scored.orderBy(*order).limit(1)


def estimate(scored: DataFrame, step: float, maxt: float) -> dict:
    """tx, ty, tz, rms, completeness, ok. The score table has one row per translation, so it is small; the sub-cell peak
    is that of the quadric through the best and its neighbours."""
    rows = {(r["i"], r["j"]): r for r in scored.select("i", "j", "dx", "dy", "tz", "rms", "completeness").collect()}
    step = f32(step)
    maxt = f32(step * f32(math.ceil(maxt / step)))
    n = int(maxt / step * 2) + 1
    if not rows:
        return {"tx": 0.0, "ty": 0.0, "tz": 0.0, "rms": float(np.finfo(f32).max), "completeness": 0.0, "ok": False}
    i, j = min(rows, key=lambda k: (rows[k]["rms"], rows[k]["dx"] ** 2 + rows[k]["dy"] ** 2, k))
    r = rows[i, j]
    dx, dy = f32(r["dx"]), f32(r["dy"])
    if 0 < i < n - 1 and 0 < j < n - 1:
        at = lambda a, b: f32(rows[i + a, j + b]["rms"]) if (i + a, j + b) in rows else f32(0)
        gx, gy = (at(1, 0) - at(-1, 0)) / f32(2), (at(0, 1) - at(0, -1)) / f32(2)
        xx, yy = at(1, 0) + at(-1, 0) - 2 * at(0, 0), at(0, 1) + at(0, -1) - 2 * at(0, 0)
        xy = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / f32(4)
        det = xx * yy - xy * xy
        if det != 0:
            dx, dy = -maxt + f32(i - (yy * gx - xy * gy) / det) * step, -maxt + f32(j - (xx * gy - xy * gx) / det) * step
    return {"tx": float(-dx), "ty": float(-dy), "tz": float(r["tz"]), "rms": float(r["rms"]), "completeness": float(r["completeness"]), "ok": True}
