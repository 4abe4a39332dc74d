"""The lowest height above the terrain groups cells only: no row for each height that a cell's points have."""

import random
import re

import pytest

from pointweave.operators import grid
from pointweave.schema import Raster, SceneParams

P = SceneParams()


@pytest.mark.parametrize("sent", [1 << 19, 0])
def test_only_cells_are_grouped(spark, monkeypatch, sent):
    monkeypatch.setattr(grid, "SENT_CELLS", sent, raising=False)
    rng = random.Random(3)
    points = spark.createDataFrame([(rng.uniform(0, 12), rng.uniform(0, 9), rng.uniform(0, 40)) for _ in range(3000)], "x double, y double, z double")
    meta = grid.cloud_meta(points)
    frame = grid.frame_of(meta, 1.0)
    terrain = {(r, c): rng.choice([30_000, 64_000, 500]) for r in range(frame.height) for c in range(frame.width) if rng.random() < 0.8}
    dtm = Raster(spark.createDataFrame([(*k, v) for k, v in terrain.items()], "row int, col int, v int"), frame)
    found = grid.lowest_above(points, meta, dtm, dtm, P).cells
    want = {}
    for r in grid.splat(points, meta, frame).collect():
        k, q = (r.row, r.col), r.q & 65535
        if k in terrain and q > terrain[k] + frame.units(P.agl):
            want[k] = min(q, want.get(k, q))
    assert {(r.row, r.col): r.v for r in found.collect()} == want and 0 < len(want) < len(terrain)
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("q#" in k for k in keys)
