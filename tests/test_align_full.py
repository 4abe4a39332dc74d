"""The registration queries that run the aligner's whole job, against a plain model on the prepared surfaces."""

import math

import numpy as np

from pointweave.plans import queries as q
from pointweave.plans.alignment import prepared
from pointweave.schema import AlignParams, f32

SF = "/root/testdata/sf0.001"


def dense(r):
    z = np.full((r.frame.height, r.frame.width), np.nan, np.float32)
    for c in r.cells.collect():
        z[c.row, c.col] = f32(f32(c.v) * f32(r.frame.scale)) + f32(r.frame.offset)
    return z


def model(a, za, b, zb, move, params):
    """n, tz and rms of one translation by its definition, all draws at once."""
    x0, x1 = max(a.easting, b.easting), min(a.easting + a.width, b.easting + b.width)
    y0, y1 = max(a.northing, b.northing), min(a.northing + a.height, b.northing + b.height)
    k = np.arange(params.draws)
    x, y = x0 + (k * 618033 + 7919) % 1000003 / 1000003 * (x1 - x0), y0 + (k * 754877 + 104729) % 1000003 / 1000003 * (y1 - y0)

    def heights(f, z, sign):
        col = np.trunc(x - f.easting + sign * 0.5 * move[0]).astype(int)
        row = f.height - 1 - np.trunc(y - f.northing + sign * 0.5 * move[1]).astype(int)
        ok = (row >= 0) & (row <= f.height - 2) & (col >= 0) & (col <= f.width - 2)
        return np.where(ok, z[np.clip(row, 0, f.height - 1), np.clip(col, 0, f.width - 1)], np.nan)

    d = (heights(a, za, -1) - heights(b, zb, 1)).astype(np.float32)
    d = np.sort(d[~np.isnan(d)][: params.samples])
    tz = d[len(d) // 2]
    return len(d), tz, np.sort(np.abs(d - tz))[math.floor(len(d) * 0.67)]


def test_whole_job(spark):
    rows = {(r.dx, r.dy): r for r in q.QUERIES["align_full_scores"](spark, SF).collect()}
    params = AlignParams()
    assert len(rows) == 441 and {r.n for r in rows.values()} == {params.samples}
    assert {x for x, _ in rows} == {y for _, y in rows} == {float(k) for k in range(-10, 11)}
    (a, b), at = (prepared(p, params) for p in q._full_target(spark, SF)), [(2.0, -3.0), (0.0, 0.0), (-10.0, 10.0), (7.0, 9.0)]
    za, zb = dense(a), dense(b)
    for move in at:
        n, tz, rms = model(a.frame, za, b.frame, zb, move, params)
        assert (rows[move].n, f32(rows[move].tz), f32(rows[move].rms)) == (n, f32(tz), f32(rms))
    peak = q.QUERIES["align_peak"](spark, SF).first()
    assert peak.ok and abs(peak.tx + 2) < 0.5 and abs(peak.ty - 3) < 0.5 and abs(peak.tz + 1.5) < 1e-3
