"""Buildings grow over all five rounds."""

from pointweave.plans import queries as q

SF = "/root/testdata/sf0.001"


def test_five_rounds(spark, monkeypatch):
    made, bench = [], q.Bench
    monkeypatch.setattr(q, "Bench", lambda *a: made.append(bench(*a)) or made[-1])
    got = {(r.row, r.col): r.v for r in q.QUERIES["class_edge_growth_full"](spark, SF).collect()}
    b = made[0]
    v, z = ({(r.row, r.col): r.v for r in cells.collect()} for cells in (b.base, b.dsm.cells))
    limit, changed = b.frame.units(q.P.dz), []
    for _ in range(5):
        beside = lambda r, c: ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1))
        hit = [k for k in v if v[k] == 200 and any(v.get(n) == 240 and abs(z.get(n, 0) - z.get(k, 0)) < limit for n in beside(*k))]
        v |= dict.fromkeys(hit, 240)
        changed.append(len(hit))
    print("cells that grow, by round:", changed)
    assert changed[1] > 0 and got == v
