"""Rings are changed one at a time: a batch of rings is never held as Python objects."""

import sys

from pyspark.sql import functions as F

from pointweave.operators import vector

RINGS = "array<array<struct<x:double,y:double>>>"


def circles(spark, n):
    """n rings of 61 points in one partition."""
    ring = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.struct((F.col("id") + i).cast("double").alias("x"), i.cast("double").alias("y")))
    return spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("label"), ring.alias("ring"), F.array().cast(RINGS).alias("inner_rings"))


def test_memory_does_not_grow_with_the_rings(spark):
    def most(n):
        out = vector._rings_apply(circles(spark, n), lambda ring: [(float(sys.getallocatedblocks()), 0.0)])
        return out.agg(F.max(F.col("ring")[0]["x"])).first()[0]

    few = most(10)
    assert most(10_000) - few < 200_000


def test_inner_rings_and_dropped_rings(spark):
    """Rings that become empty go, an outer one with its holes; the rest stay in their order, over several output batches."""
    p = lambda *xs: [(float(x), float(-x)) for x in xs]
    rows = [(k, p(*range(k % 5 + 1)), [p(*range(j)) for j in range(k % 4)]) for k in range(3000)]
    rows += [(9000 + k, p(*range(30_000)), [p(*range(50_000)), p(1), p(7, 8)]) for k in range(3)]
    got = vector._rings_apply(spark.createDataFrame(rows, f"label int, ring {RINGS[6:-1]}, inner_rings {RINGS}").coalesce(1), lambda r: [(2 * x, y) for x, y in r] if len(r) != 1 else [])
    double = lambda r: [(2 * x, y) for x, y in r]
    want = {k: (double(o), [double(h) for h in i if len(h) > 1]) for k, o, i in rows if len(o) > 1}
    seen = {r.label: ([tuple(q) for q in r.ring], [[tuple(q) for q in h] for h in r.inner_rings]) for r in got.collect()}
    assert seen == want
