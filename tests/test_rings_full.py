"""Ring queries over the whole orders table, against plain models."""

import math
from collections import defaultdict

import pyarrow.parquet as pq

from pointweave.plans import queries as q

SF = "/root/testdata/sf0.001"


def rings():
    out = defaultdict(set)
    for k in pq.read_table(f"{SF}/orders.parquet", columns=["o_orderkey"])["o_orderkey"].to_pylist():
        out[k // 61 + 1].add(k)
    return {label: [(k * 37 % 101, k * 53 % 97) for k in sorted(keys)] for label, keys in out.items()}


def area(a, b, c):
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2


def reduced(ring, least):
    p = [(float(x), float(y)) for x, y in ring]
    p = p[:-1] if len(p) > 1 and p[0] == p[-1] else p
    while len(p) > 3:
        areas = [area(p[i - 1], p[i], p[(i + 1) % len(p)]) for i in range(len(p))]
        if min(areas) > least:
            break
        del p[areas.index(min(areas))]
    return [*p, p[0]]


def metric(ring):
    n, out = len(ring), {}
    for i, (x, y) in enumerate(ring):
        (ax, ay), (cx, cy) = ring[(i - 5) % n], ring[(i + 5) % n]
        la, lc = math.hypot(ax - x, ay - y), math.hypot(cx - x, cy - y)
        if la and lc:
            cos = ((ax - x) * (cx - x) + (ay - y) * (cy - y)) / (la * lc)
            out[i] = (math.pi - math.acos(max(-1, min(1, cos)))) * la * lc
    return out


def test_all_orders_are_used(spark):
    want = rings()
    assert sum(map(len, want.values())) == spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").distinct().count() > 1000
    got = {r.label: r.area for r in q.QUERIES["polygon_area_all"](spark, SF).collect()}
    assert got == {k: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2 for k, r in want.items()}
    got = {(r.label, r.i): r.metric for r in q.QUERIES["ring_corner_metric_all"](spark, SF).collect()}
    expected = {(k, i): m for k, r in want.items() for i, m in metric(r).items()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-4 for k in got)
    first = {r.label: r.area for r in q.QUERIES["polygon_area"](spark, SF).collect()}
    assert first == {1: next(r.area for r in q.QUERIES["polygon_area_all"](spark, SF).where("label = 1").collect())}


def test_reduced_rings(spark):
    want, got = rings(), {r.label: r for r in q.QUERIES["vw_reduce"](spark, SF).collect()}
    assert len(got) > 1 and got.keys() == want.keys()
    for label, ring in want.items():
        assert [(p.x, p.y) for p in got[label].ring] == reduced(ring, 400.0)
