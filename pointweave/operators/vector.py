"""Rasters to outlines. One group per label: a label's cells are one building (or hole), whose size the world bounds."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.geometry import reduce_ring, simplify, trace, wkt, world_ring
from pointweave.operators.algebra import KEY, upsample
from pointweave.schema import RING, Frame

_RINGS = f"label int, first_row int, first_col int, ring {RING}"


def _points(ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def trace_rings(labels: DataFrame) -> DataFrame:
    """Outline of every label other than 0: foreground by 8 directions, holes (negative) by 4."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = set(zip(pdf["row"].tolist(), pdf["col"].tolist(), strict=True))
        start, label = min(cells), int(pdf["v"].iloc[0])
        return pd.DataFrame([(label, *start, _points(trace(cells, start, label > 0)))], columns=["label", "first_row", "first_col", "ring"])

    return labels.where("v != 0").groupBy("v").applyInPandas(run, _RINGS)


def outlines(labels: DataFrame) -> DataFrame:
    """Polygons of positive labels; a hole goes to the label right above its first cell."""
    rings = trace_rings(labels)
    above = labels.select((F.col("row") + 1).alias("first_row"), F.col("col").alias("first_col"), F.col("v").alias("owner"))
    holes = rings.where("label < 0").join(above, ["first_row", "first_col"]).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct((-F.col("label")).alias("k"), "ring"))).alias("h"))
    holes = holes.select("owner", F.transform("h", lambda x: x["ring"]).alias("inner_rings"))
    none = F.array().cast(f"array<{RING}>")
    return rings.where("label > 0").join(holes, F.col("label") == F.col("owner"), "left").select("label", "ring", F.coalesce("inner_rings", none).alias("inner_rings"))


#: Points of changed rings that are gathered before they are handed on.
GATHERED = 1 << 16


def _unpacked(rings: pa.ListArray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Where each list ends, from 0, and the flat x and y of all its points."""
    ends, points = rings.offsets.to_numpy(), rings.values
    x, y = (points.field(k).to_numpy()[ends[0] : ends[-1]] for k in "xy")
    return (ends - ends[0]).tolist(), x, y


class _Packed:
    """Lists of points, kept as flat arrays."""

    def __init__(self):
        self.ends, self.xy = array("i", [0]), array("d")

    def add(self, ring) -> None:
        self.xy.extend(float(c) for p in ring for c in p)
        self.ends.append(len(self.xy) // 2)

    def arrow(self) -> pa.ListArray:
        xy = np.array(self.xy, float).reshape(-1, 2)
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["x", "y"]))


def _rings_apply(polygons: DataFrame, change) -> DataFrame:
    """Apply a ring function to outer and inner rings; empty ones are dropped. One ring at a time is Python objects."""

    def run(batches):
        for batch in batches:
            ends, x, y = _unpacked(batch.column("ring"))
            inner = batch.column("inner_rings")
            owns = (inner.offsets.to_numpy() - inner.offsets[0].as_py()).tolist()
            inner_ends, ix, iy = _unpacked(inner.flatten())
            ring = lambda e, u, v, k: change(list(zip(u[e[k] : e[k + 1]].tolist(), v[e[k] : e[k + 1]].tolist(), strict=True)))
            labels, outers, holes, held = [], _Packed(), _Packed(), array("i", [0])

            def made():
                return pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), outers.arrow(), pa.ListArray.from_arrays(pa.array(held, pa.int32()), holes.arrow())], ["label", "ring", "inner_rings"])

            for k, label in enumerate(batch.column("label").to_pylist()):
                outer = ring(ends, x, y, k)
                if not len(outer):
                    continue
                labels.append(label)
                outers.add(outer)
                for h in range(owns[k], owns[k + 1]):
                    if len(hole := ring(inner_ends, ix, iy, h)):
                        holes.add(hole)
                held.append(len(holes.ends) - 1)
                if len(outers.xy) + len(holes.xy) >= 2 * GATHERED:
                    yield made()
                    labels, outers, holes, held = [], _Packed(), _Packed(), array("i", [0])
            yield made()

    return polygons.select("label", "ring", "inner_rings").mapInArrow(run, f"label int, ring {RING}, inner_rings array<{RING}>")


def building_simplify(polygons: DataFrame, scale: int = 36) -> DataFrame:
    return _rings_apply(polygons, lambda ring: simplify(ring, scale))


def vw_reduce(polygons: DataFrame, least: float) -> DataFrame:
    return _rings_apply(polygons, lambda ring: reduce_ring(ring, least))


def building_outlines(labels: DataFrame, scale: int = 36) -> DataFrame:
    """Labels to simplified polygons in units of a third of a cell."""
    return building_simplify(outlines(upsample(labels.select(*KEY, "v"), 3)), scale)


def ring_points(polygons: DataFrame) -> DataFrame:
    """One row per vertex of the outer ring: label, i, x, y."""
    return polygons.select("label", F.posexplode("ring").alias("i", "p")).select("label", "i", "p.x", "p.y")


def corner_metric(points: DataFrame, scale: int) -> DataFrame:
    """(pi - angle) * arm * arm at each vertex of rings given by points, with arms of ``scale`` steps that wrap."""
    from pointweave.functions.geometry import vertex_angle

    sized = points.join(points.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n")), "label")
    at = lambda k, s: sized.select("label", F.pmod(F.col("i") + k, F.col("n")).alias("i"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    both = sized.join(at(scale, "a"), ["label", "i"]).join(at(-scale, "c"), ["label", "i"])
    arm = lambda s: F.sqrt((F.col(f"{s}x") - F.col("x")) * (F.col(f"{s}x") - F.col("x")) + (F.col(f"{s}y") - F.col("y")) * (F.col(f"{s}y") - F.col("y")))
    angle = vertex_angle(*map(F.col, ("ax", "ay", "x", "y", "cx", "cy")))
    return both.where((arm("a") > 0) & (arm("c") > 0)).select("label", "i", ((F.lit(3.141592653589793) - angle) * arm("a") * arm("c")).alias("metric"))


def geo_table(polygons: DataFrame, frame: Frame) -> DataFrame:
    """Polygons of labels >= 0 in world coordinates, as WKT. frame: that of the (upsampled) raster they were traced on."""
    world = polygons.where("label >= 0").select("label", world_ring(F.col("ring"), frame).alias("ring"), F.transform("inner_rings", lambda r: world_ring(r, frame)).alias("inner_rings"))
    return world.select("label", "ring", "inner_rings", wkt(F.col("ring"), F.col("inner_rings")).alias("wkt"))
