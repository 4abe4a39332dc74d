"""Points combine in their first cell before they are spread over four, and are numbered only for who asks."""

import random

import pytest

from pointweave.operators import grid
from pointweave.plans.queries import Bench


@pytest.mark.parametrize("how,best,bounds", [("max", max, None), ("min", min, (2.0, 9.0, 1.0, 7.0))])
def test_points_combine_before_they_are_spread(spark, how, best, bounds):
    rng = random.Random(5)
    points = spark.createDataFrame([(rng.uniform(0, 12), rng.uniform(0, 9), rng.uniform(0, 40)) for _ in range(2000)], "x double, y double, z double")
    meta = grid.cloud_meta(points)
    made = grid.grid(points, meta, 1.0, how, bounds)
    want = {}
    for r in grid.splat(points, meta, made.frame).collect():
        if r.q:
            k = (r.row, r.col)
            want[k] = best(r.q, want.get(k, r.q))
    assert {(r.row, r.col): r.v for r in made.cells.collect()} == want and want
    plan = made.cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate") :]


def test_points_are_numbered_on_demand(spark):
    sf = "/root/testdata/sf0.001"
    assert "point_id" not in Bench(spark, sf).points.columns
    assert "point_id" in Bench(spark, sf, numbered=True).points.columns
