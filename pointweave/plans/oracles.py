"""DuckDB SQL for the queries that SQL can express, put together from shared steps (common table expressions)."""

from __future__ import annotations

import re

#: Fixed parameters of the registered queries: dz 1, agl 2, area 50, tree height 40 (metres), gsd 1.
STEPS: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql.strip()


def query(select: str) -> str:
    """The select with every step it needs, in order."""
    need: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for name in STEPS:
            if name != own and name not in need and re.search(rf"\b{name}\b", sql):
                visit(STEPS[name], name)
                need.append(name)

    visit(select)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in need) + "\n" if need else "") + select


def trunc(x: str) -> str:
    return f"CAST(trunc({x}) AS INTEGER)"


def s16(x: str) -> str:
    return f"(CASE WHEN {x} > 32767 THEN {x} - 65536 ELSE {x} END)"


step("scene_w", "SELECT CASE WHEN count(*) < 20000 THEN 64 WHEN count(*) < 200000 THEN 200 ELSE 640 END AS w FROM lineitem")
step("scene_xy", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % (100 * w) AS DOUBLE) / 100e0 AS x,
  CAST((l_partkey * 6151 + l_suppkey * 3571 + l_orderkey * 17) % (100 * w) AS DOUBLE) / 100e0 AS y
FROM lineitem, scene_w""")
step("pts", """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS point_id, x, y,
  100e0 + 0.05e0 * x + 0.03e0 * y + CASE WHEN house THEN 12e0 ELSE 0e0 END + CASE WHEN tree THEN 6e0 ELSE 0e0 END AS z,
  CAST(l_quantity AS REAL) AS intensity, CAST(CASE WHEN house OR tree THEN 1 ELSE 2 END AS INTEGER) AS classification
FROM (SELECT *, CAST(floor(x / 20e0) AS BIGINT) % 2 = 1 AND CAST(floor(y / 16e0) AS BIGINT) % 2 = 1 AS house,
  CAST(floor(x / 20e0) AS BIGINT) % 2 = 0 AND l_linenumber % 3 = 0 AND CAST(floor(x / 7e0) AS BIGINT) % 3 = 1 AS tree FROM scene_xy)
WHERE (x - 40e0) * (x - 40e0) + (y - 22e0) * (y - 22e0) >= 9e0""")
step("cloud", """
SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1,
  floor(min(x)) AS xo, floor(min(y)) AS yo, floor(min(z)) AS zo FROM pts""")
step("fr", """
SELECT *, CAST(trunc(x1 - x0 + 1) AS INTEGER) AS wd, CAST(trunc(y1 - y0 + 1) AS INTEGER) AS ht, x0 AS ea, y0 AS no, lo AS off,
  CAST(CAST(hi - lo AS DOUBLE) / 65535e0 AS REAL) AS sc FROM (SELECT *, CAST(z0 - 1 AS REAL) AS lo, CAST(z1 + 1 AS REAL) AS hi FROM cloud)""")
#: with bounds: (10, 50, 8, 40)
step("frb", "SELECT * REPLACE (10e0 AS ea, 8e0 AS no, 40 AS wd, 32 AS ht) FROM fr")


def splat(points: str, frame: str, extra: str = "") -> str:
    return f"""
SELECT r + dr AS "row", c + dc AS col, q{extra} FROM (
  SELECT {trunc("CAST(CAST(x - xo AS REAL) AS DOUBLE) + ((xo - ea) - 0.5e0)")} AS c,
    {trunc("-1e0 * CAST(CAST(y - yo AS REAL) AS DOUBLE) + (ht - 1 - (yo - no) + 0.5e0)")} AS r,
    {trunc("CAST(CAST(1e0 / CAST(sc AS DOUBLE) AS REAL) AS DOUBLE) * CAST(CAST(z - zo AS REAL) AS DOUBLE) + CAST(CAST(1e0 / CAST(sc AS DOUBLE) AS REAL) AS DOUBLE) * CAST(CAST(zo AS REAL) - off AS DOUBLE)")} AS q, wd, ht{extra}
  FROM {points}, {frame}), (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)
WHERE r + dr BETWEEN 0 AND ht - 1 AND c + dc BETWEEN 0 AND wd - 1"""


step("spl", splat("pts", "fr", ", point_id, intensity"))
step("splb", splat("pts", "frb"))
step("top_raw", 'SELECT "row", col, max(q) AS v FROM spl WHERE q <> 0 GROUP BY 1, 2')
step("low_raw", 'SELECT "row", col, min(q) AS v FROM spl WHERE q <> 0 GROUP BY 1, 2')
step("off1", "SELECT a.i, b.j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)")
step("off2", "SELECT a.i, b.j FROM (VALUES (-2), (-1), (0), (1), (2)) a(i), (VALUES (-2), (-1), (0), (1), (2)) b(j)")
step("off4", "SELECT a.i, b.j FROM range(-4, 5) a(i), range(-4, 5) b(j)")
step("whole", 'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM fr, range(0, ht) a(r), range(0, wd) b(c)')


def units(metres: float) -> str:
    return f"(SELECT CAST(trunc({metres}e0 / CAST(sc AS DOUBLE)) AS INTEGER) FROM fr)"


def wide(cells: str, r: int, columns: str = "n.v AS x") -> str:
    """Cells sent to all places whose window they are in."""
    return f'SELECT n."row" + i AS "row", n.col + j AS col, {columns} FROM {cells} n, off{r}'


def quantile(cells: str, r: int, q: float, limit: str) -> str:
    pick = f"xs[least(CAST(floor(CAST({q} AS REAL) * CAST(len(xs) AS REAL)) AS INTEGER), len(xs) - 1) + 1]"
    return f"""
SELECT "row", col, CASE WHEN abs({s16("m")} - {s16("v")}) > {limit} % 65536 THEN m ELSE v END AS v FROM (
  SELECT c."row", c.col, c.v, {pick} AS m FROM {cells} c JOIN (SELECT "row", col, list_sort(list(x)) AS xs FROM ({wide(cells, r)}) GROUP BY 1, 2) w ON c."row" = w."row" AND c.col = w.col)"""


step("top_q", quantile("top_raw", 1, 0.4, units(2)))
step("low_q", quantile("low_raw", 2, 0.33, units(2)))
step("top_w", f"""
SELECT c."row", c.col, any_value(c.v) AS v FROM top_q c JOIN ({wide("top_q", 1)}) n ON c."row" = n."row" AND c.col = n.col, fr
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE x > c.v + sqrt(80e0) / CAST(sc AS DOUBLE)) < 4""")


def level(cells: str, shape: str) -> str:
    """shape gives h, w of the level below."""
    return f"""
SELECT r AS "row", k AS col, CAST(sum(v) // count(*) AS INTEGER) AS v FROM (
  SELECT unnest(CASE WHEN "row" % 2 = 1 THEN [("row" - 1) // 2] ELSE ["row" // 2 - 1, "row" // 2] END) AS r, col, v FROM {cells}) a,
  LATERAL (SELECT unnest(CASE WHEN a.col % 2 = 1 THEN [(a.col - 1) // 2] ELSE [a.col // 2 - 1, a.col // 2] END) AS k) b, {shape}
WHERE r BETWEEN 0 AND h // 2 - 1 AND k BETWEEN 0 AND w // 2 - 1 GROUP BY 1, 2"""


step("sh0", "SELECT ht AS h, wd AS w FROM fr")
step("sh1", "SELECT h // 2 AS h, w // 2 AS w FROM sh0")
step("sh2", "SELECT h // 2 AS h, w // 2 AS w FROM sh1")


def nearest(cells: str, grid: str, above: str, upper: str) -> str:
    return f"""
SELECT g."row", g.col, coalesce(c.v, p.v) AS v FROM {grid} g JOIN {upper} u ON true LEFT JOIN {cells} c ON c."row" = g."row" AND c.col = g.col
LEFT JOIN {above} p ON p."row" = least(g."row" // 2, u.h - 1) AND p.col = least(g.col // 2, u.w - 1) WHERE coalesce(c.v, p.v) IS NOT NULL"""


step("grid1", 'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM sh1, range(0, h) a(r), range(0, w) b(c)')


def fill2(name: str, cells: str) -> None:
    """name: cells filled from two coarser levels."""
    step(f"{name}_l1", level(cells, "sh0"))
    step(f"{name}_l2", level(f"{name}_l1", "sh1"))
    step(f"{name}_f1", nearest(f"{name}_l1", "grid1", f"{name}_l2", "sh2"))
    step(name, nearest(cells, "whole", f"{name}_f1", "sh1"))


fill2("dsm", "top_w")
fill2("lowest", "low_q")
step("varr", 'SELECT d."row", d.col, greatest(d.v - coalesce(m.v, 0), 0) AS v FROM dsm d LEFT JOIN lowest m ON d."row" = m."row" AND d.col = m.col')
step("loose", f"""
SELECT q."row", q.col FROM (
  SELECT g."row", g.col FROM whole g LEFT JOIN varr o ON o."row" = g."row" AND o.col = g.col, fr WHERE coalesce(o.v, 0) <= CAST(trunc(40e0 / CAST(sc AS DOUBLE)) AS INTEGER)) q
ANTI JOIN (
  SELECT DISTINCT n."row" + i AS "row", n.col + j AS col
  FROM (SELECT g2."row", g2.col FROM whole g2 LEFT JOIN varr w ON w."row" = g2."row" AND w.col = g2.col WHERE coalesce(w.v, 0) <= {units(1)}) n, off1) b
ON q."row" = b."row" AND q.col = b.col""")
step("dsm2", 'SELECT d.* FROM dsm d ANTI JOIN loose l ON d."row" = l."row" AND d.col = l.col')
#: terrain from points of class 2, gridded like the surface, in the surface's scale
step("ground", "SELECT * FROM pts WHERE classification = 2")
step("gcloud", "SELECT floor(min(x)) AS xo, floor(min(y)) AS yo, floor(min(z)) AS zo, CAST(min(z) - 1 AS REAL) AS lo, CAST(max(z) + 1 AS REAL) AS hi FROM ground")
step("gfr", "SELECT g.xo, g.yo, g.zo, g.lo AS off, CAST(CAST(g.hi - g.lo AS DOUBLE) / 65535e0 AS REAL) AS sc, wd, ht, ea, no FROM gcloud g, fr")
step("gspl", splat("ground", "gfr"))
step("graw", 'SELECT "row", col, max(q) AS v FROM gspl WHERE q <> 0 GROUP BY 1, 2')
step("gscaled", f"""
SELECT "row", col, {trunc("CAST(CAST(CAST(v AS REAL) * g.sc + g.off - fr.off AS DOUBLE) / CAST(fr.sc AS DOUBLE) AS REAL)")} & 65535 AS v FROM graw, gfr g, fr""")
step("gterrain", "SELECT * FROM gscaled WHERE v <> 0")

step("near_i", f"""
SELECT s."row", s.col, point_id, CAST(intensity AS DOUBLE) AS i FROM spl s LEFT JOIN dsm d ON s."row" = d."row" AND s.col = d.col WHERE abs(q - coalesce(d.v, 0)) < {units(1)}""")
step("top_i", 'SELECT max(m) AS top FROM (SELECT sum(i) OVER w / count(*) OVER w AS m FROM near_i WINDOW w AS (PARTITION BY "row", col ORDER BY point_id ROWS UNBOUNDED PRECEDING))')
step("mean_i", f"""SELECT "row", col, {trunc("65535e0 / any_value(top) * sum(i) / count(*)")} & 65535 AS v FROM near_i, top_i GROUP BY 1, 2""")
step("int_raw", "SELECT * FROM mean_i WHERE v <> 0")
fill2("inten", "int_raw")
step("above_t", f"""
SELECT s."row", s.col, min(q & 65535) AS v FROM spl s JOIN gterrain t ON s."row" = t."row" AND s.col = t.col WHERE (q & 65535) > t.v + {units(2)} GROUP BY 1, 2""")
step("agl", quantile("above_t", 2, 0.5, units(1)))
#: classes with the class-2 terrain and no labels
step("base", f"""
SELECT "row", col, CAST(CASE WHEN s = 0 OR abs(s2 - t) < {units(1)} THEN 80 WHEN s > t + CAST(trunc(9e0 / CAST(sc AS DOUBLE)) AS INTEGER) THEN 240 WHEN s2 = 0 OR abs(s2 - t) > {units(2)} THEN 200 ELSE 40 END AS INTEGER) AS v
FROM (SELECT g."row", g.col, coalesce(d.v, 0) AS s, coalesce(e.v, 0) AS s2, coalesce(t.v, 0) AS t FROM whole g LEFT JOIN dsm d ON g."row" = d."row" AND g.col = d.col
  LEFT JOIN dsm2 e ON g."row" = e."row" AND g.col = e.col LEFT JOIN gterrain t ON g."row" = t."row" AND g.col = t.col), fr""")
step("grown", f"""
SELECT b."row", b.col, CAST(CASE WHEN h."row" IS NOT NULL THEN 240 ELSE b.v END AS INTEGER) AS v FROM base b LEFT JOIN (
  SELECT DISTINCT b."row", b.col FROM base b LEFT JOIN dsm d ON b."row" = d."row" AND b.col = d.col JOIN (
    SELECT n."row" + i AS "row", n.col + j AS col, coalesce(e.v, 0) AS x FROM base n LEFT JOIN dsm e ON n."row" = e."row" AND n.col = e.col, off1 WHERE n.v = 240) n ON n."row" = b."row" AND n.col = b.col
  WHERE b.v = 200 AND abs(x - coalesce(d.v, 0)) < {units(1)}) h ON b."row" = h."row" AND b.col = h.col""")
for _k in range(2, 6):  # each round starts from the one before
    step(f"grown{_k}", re.sub(r"\bbase\b", "grown" if _k == 2 else f"grown{_k - 1}", STEPS["grown"]))
step("major", """
SELECT b."row", b.col, CAST(CASE WHEN coalesce(k, 0) >= ((CASE WHEN b."row" IN (0, ht - 1) THEN 2 ELSE 3 END) * (CASE WHEN b.col IN (0, wd - 1) THEN 2 ELSE 3 END)) // 2 THEN 240 ELSE b.v END AS INTEGER) AS v
FROM base b LEFT JOIN (SELECT n."row" + i AS "row", n.col + j AS col, count(*) AS k FROM base n, off1 WHERE n.v = 240 GROUP BY 1, 2) n ON n."row" = b."row" AND n.col = b.col, fr""")
#: components: least reachable cell id
step("houses", 'SELECT b."row", b.col, b."row" * wd + b.col AS id FROM base b, fr WHERE b.v = 240')
step("reach_h", """
SELECT id AS a, id AS b FROM houses UNION
SELECT r.a, n.id FROM reach_h r JOIN houses c ON c.id = r.b JOIN houses n ON n."row" BETWEEN c."row" - 1 AND c."row" + 1 AND n.col BETWEEN c.col - 1 AND c.col + 1""")
step("comp_h", "SELECT a AS id, min(b) AS first FROM reach_h GROUP BY 1")
step("num_h", "SELECT id, first, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS k FROM comp_h")
step("open_bg", 'SELECT g."row", g.col, g."row" * wd + g.col AS id FROM whole g ANTI JOIN houses h ON g."row" = h."row" AND g.col = h.col, fr')
step("outside", """
SELECT f.id FROM open_bg f, fr WHERE f."row" IN (0, ht - 1) OR f.col IN (0, wd - 1) UNION
SELECT n.id FROM outside o JOIN open_bg c ON c.id = o.id JOIN open_bg n ON abs(n."row" - c."row") + abs(n.col - c.col) = 1""")
step("inner_bg", "SELECT f.* FROM open_bg f ANTI JOIN outside o ON f.id = o.id")
step("reach_i", """
SELECT id AS a, id AS b FROM inner_bg UNION
SELECT r.a, n.id FROM reach_i r JOIN inner_bg c ON c.id = r.b JOIN inner_bg n ON abs(n."row" - c."row") + abs(n.col - c.col) = 1""")
step("num_i", "SELECT id, first, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS k FROM (SELECT a AS id, min(b) AS first FROM reach_i GROUP BY 1)")
step("woods", 'SELECT b."row", b.col, b."row" * wd + b.col AS id FROM base b, fr WHERE b.v = 200')
step("reach_w", """
SELECT id AS a, id AS b FROM woods UNION
SELECT r.a, n.id FROM reach_w r JOIN woods c ON c.id = r.b JOIN woods n ON n."row" BETWEEN c."row" - 1 AND c."row" + 1 AND n.col BETWEEN c.col - 1 AND c.col + 1""")
step("comp_w", "SELECT a AS id, min(b) AS first FROM reach_w GROUP BY 1")
step("open_w", """
SELECT DISTINCT c.first FROM comp_w c JOIN woods t ON t.id = c.id JOIN (
  SELECT n."row" + i AS "row", n.col + j AS col FROM base n, off1 WHERE n.v NOT IN (200, 240)) n ON n."row" = t."row" AND n.col = t.col""")
step("full_s", 'SELECT g."row", g.col, coalesce(d.v, 0) AS v FROM whole g LEFT JOIN dsm d ON g."row" = d."row" AND g.col = d.col')
step("beside_s", """
SELECT a."row", a.col, a.v, greatest(0, least(a."row" + i, ht - 1)) AS r1, greatest(0, least(a.col + j, wd - 1)) AS c1, greatest(0, least(a."row" + 2 * i, ht - 1)) AS r2, greatest(0, least(a.col + 2 * j, wd - 1)) AS c2
FROM full_s a, off1, fr""")
step("steps_s", f"""
SELECT DISTINCT a."row", a.col FROM beside_s a JOIN full_s b ON b."row" = a.r1 AND b.col = a.c1 JOIN full_s c ON c."row" = a.r2 AND c.col = a.c2
WHERE b.v <> 0 AND a.v - 2 * b.v + c.v > {units(1)}""")
step("grow_s", f"""
SELECT "row", col FROM steps_s UNION
SELECT a."row", a.col FROM full_s a JOIN (
  SELECT DISTINCT n."row" + i AS "row", n.col + j AS col, f.v AS x FROM steps_s n JOIN full_s f ON f."row" = n."row" AND f.col = n.col, off1, fr WHERE n."row" BETWEEN 1 AND ht - 2 AND n.col BETWEEN 1 AND wd - 2) n
  ON n."row" = a."row" AND n.col = a.col AND 2 * (x - a.v) < {units(1)}
JOIN (SELECT n."row" + i AS "row", n.col + j AS col, min(n.v) AS low FROM full_s n, off1 GROUP BY 1, 2) l ON l."row" = a."row" AND l.col = a.col AND 2 * (a.v - low) > {units(1)}""")
step("solid_h", """
SELECT n."row" + i AS "row", n.col + j AS col FROM houses n, off1, fr GROUP BY 1, 2
HAVING count(*) = any_value((CASE WHEN n."row" + i IN (0, ht - 1) THEN 2 ELSE 3 END) * (CASE WHEN n.col + j IN (0, wd - 1) THEN 2 ELSE 3 END))""")
fill2("rfill", "top_raw")


def edge(cells: str, grid: str) -> str:
    return f"""
SELECT c."row", c.col, any_value(c.v) AS v FROM {cells} c JOIN (SELECT g."row" + i AS "row", g.col + j AS col, coalesce(k.v, 0) AS x FROM {grid} g LEFT JOIN {cells} k ON k."row" = g."row" AND k.col = g.col, off1) n
  ON c."row" = n."row" AND c.col = n.col GROUP BY 1, 2 HAVING max(abs({s16("x")} - {s16("c.v")})) <= {units(2)} % 65536"""


step("redge", edge("rfill", "whole"))
#: target: the scene moved by (2, -3, 1.5), without points of odd order keys
step("tpts", "SELECT point_id, x + 2e0 AS x, y - 3e0 AS y, z + 1.5e0 AS z FROM pts WHERE (point_id // 1000) % 2 = 0")
step("tfr", """
SELECT *, CAST(trunc(x1 - x0 + 1) AS INTEGER) AS wd, CAST(trunc(y1 - y0 + 1) AS INTEGER) AS ht, x0 AS ea, y0 AS no, lo AS off, CAST(CAST(hi - lo AS DOUBLE) / 65535e0 AS REAL) AS sc FROM (
  SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, floor(min(x)) AS xo, floor(min(y)) AS yo, floor(min(z)) AS zo, CAST(min(z) - 1 AS REAL) AS lo, CAST(max(z) + 1 AS REAL) AS hi FROM tpts)""")
step("tspl", splat("tpts", "tfr"))
step("traw", 'SELECT "row", col, max(q) AS v FROM tspl WHERE q <> 0 GROUP BY 1, 2')
step("tsh0", "SELECT ht AS h, wd AS w FROM tfr")
step("tsh1", "SELECT h // 2 AS h, w // 2 AS w FROM tsh0")
step("tsh2", "SELECT h // 2 AS h, w // 2 AS w FROM tsh1")
step("twhole", 'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM tsh0, range(0, h) a(r), range(0, w) b(c)')
step("tgrid1", 'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM tsh1, range(0, h) a(r), range(0, w) b(c)')
step("tl1", level("traw", "tsh0"))
step("tl2", level("tl1", "tsh1"))
step("tf1", nearest("tl1", "tgrid1", "tl2", "tsh2"))
step("tfill", nearest("traw", "twhole", "tf1", "tsh1"))
step("tedge", edge("tfill", "twhole").replace("FROM fr)", "FROM tfr)"))
step("box", "SELECT greatest(r.ea, t.ea) AS x0, least(r.ea + r.wd, t.ea + t.wd) AS x1, greatest(r.no, t.no) AS y0, least(r.no + r.ht, t.no + t.ht) AS y1 FROM fr r, tfr t")
step("smp", "SELECT id, x0 + CAST((id * 618033 + 7919) % 1000003 AS DOUBLE) / 1000003e0 * (x1 - x0) AS x, y0 + CAST((id * 754877 + 104729) % 1000003 AS DOUBLE) / 1000003e0 * (y1 - y0) AS y FROM box, range(0, 2000) t(id)")
step("mov", "SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, CAST(a.i - 4 AS DOUBLE) AS dx, CAST(b.j - 4 AS DOUBLE) AS dy FROM range(0, 9) a(i), range(0, 9) b(j)")
step("probe", """
SELECT i, j, dx, dy, id, CAST(trunc(x - t.ea + 0.5e0 * dx) AS BIGINT) AS tc, t.ht - 1 - CAST(trunc(y - t.no + 0.5e0 * dy) AS BIGINT) AS tr, t.sc AS ts, t.off AS tof, t.wd AS tw, t.ht AS th,
  CAST(trunc(x - r.ea - 0.5e0 * dx) AS BIGINT) AS rc, r.ht - 1 - CAST(trunc(y - r.no - 0.5e0 * dy) AS BIGINT) AS rr, r.sc AS rs, r.off AS rof, r.wd AS rw, r.ht AS rh FROM smp, mov, fr r, tfr t""")
step("diff", """
SELECT i, j, dx, dy, id, (CAST(b.v AS REAL) * rs + rof) - (CAST(a.v AS REAL) * ts + tof) AS d FROM probe JOIN tedge a ON a."row" = tr AND a.col = tc JOIN redge b ON b."row" = rr AND b.col = rc
WHERE tc BETWEEN 0 AND tw - 2 AND tr BETWEEN 0 AND th - 2 AND rc BETWEEN 0 AND rw - 2 AND rr BETWEEN 0 AND rh - 2""")
step("firsts", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY id) AS k FROM diff) WHERE k <= 400")
step("meds", "SELECT i, j, dx, dy, list_sort(list(d)) AS ds FROM firsts GROUP BY 1, 2, 3, 4 HAVING count(*) >= 400")
step("scored", """
SELECT i, j, dx, dy, n, tz, es[CAST(floor(n * 0.67e0) AS INTEGER) + 1] AS rms, CAST(CAST(len(list_filter(es, lambda e: e < 1)) AS REAL) / CAST(400 AS REAL) AS REAL) AS completeness
FROM (SELECT i, j, dx, dy, CAST(len(ds) AS INTEGER) AS n, tz, list_sort(list_transform(ds, lambda e: abs(e - tz))) AS es FROM (SELECT *, ds[len(ds) // 2 + 1] AS tz FROM meds))""")
step("ranked", "SELECT * FROM scored ORDER BY rms, dx * dx + dy * dy, i, j LIMIT 1")

#: the same chain for the aligner's defaults: the whole target, 100,000 draws, 10,000 valid samples, 10 m each way
_JOB = ["tpts", "tfr", "tspl", "traw", "tsh0", "tsh1", "tsh2", "twhole", "tgrid1", "tl1", "tl2", "tf1", "tfill", "tedge", "box", "smp", "mov", "probe", "diff", "meds", "scored", "ranked"]
for _name in _JOB:
    step(f"all_{_name}", re.sub(rf"\b({'|'.join(_JOB)})\b", r"all_\1", STEPS[_name]))
step("all_tpts", STEPS["all_tpts"].replace(" WHERE (point_id // 1000) % 2 = 0", ""))
step("all_smp", STEPS["all_smp"].replace("range(0, 2000)", "range(0, 100000)"))
step("all_mov", STEPS["all_mov"].replace("- 4", "- 10").replace("range(0, 9)", "range(0, 21)"))
step("all_meds", "SELECT i, j, dx, dy, list_sort(arg_min(d, id, 10000)) AS ds FROM all_diff GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10000")
step("all_scored", STEPS["all_scored"].replace("400", "10000"))
step("around_best", """
SELECT b.i, b.j, b.dx, b.dy, b.tz, b.rms AS c, b.completeness, coalesce(max(s.rms) FILTER (WHERE s.i = b.i + 1 AND s.j = b.j), 0) AS e, coalesce(max(s.rms) FILTER (WHERE s.i = b.i - 1 AND s.j = b.j), 0) AS w,
  coalesce(max(s.rms) FILTER (WHERE s.i = b.i AND s.j = b.j + 1), 0) AS n, coalesce(max(s.rms) FILTER (WHERE s.i = b.i AND s.j = b.j - 1), 0) AS o,
  coalesce(max(s.rms) FILTER (WHERE s.i = b.i + 1 AND s.j = b.j + 1), 0) AS en, coalesce(max(s.rms) FILTER (WHERE s.i = b.i + 1 AND s.j = b.j - 1), 0) AS eo,
  coalesce(max(s.rms) FILTER (WHERE s.i = b.i - 1 AND s.j = b.j + 1), 0) AS wn, coalesce(max(s.rms) FILTER (WHERE s.i = b.i - 1 AND s.j = b.j - 1), 0) AS wo
FROM all_ranked b, all_scored s GROUP BY 1, 2, 3, 4, 5, 6, 7""")
step("quadric", """
SELECT *, CAST((e - w) / CAST(2 AS REAL) AS REAL) AS gx, CAST((n - o) / CAST(2 AS REAL) AS REAL) AS gy, CAST(CAST(e + w AS REAL) - CAST(2 * c AS REAL) AS REAL) AS xx, CAST(CAST(n + o AS REAL) - CAST(2 * c AS REAL) AS REAL) AS yy,
  CAST(CAST(CAST(CAST(en - eo AS REAL) - wn AS REAL) + wo AS REAL) / CAST(4 AS REAL) AS REAL) AS xy FROM around_best""")
step("peak", """
SELECT *, CASE WHEN inside THEN CAST(CAST(-10 AS REAL) + CAST(i - CAST(CAST(CAST(yy * gx AS REAL) - CAST(xy * gy AS REAL) AS REAL) / det AS REAL) AS REAL) AS REAL) ELSE CAST(dx AS REAL) END AS px,
  CASE WHEN inside THEN CAST(CAST(-10 AS REAL) + CAST(j - CAST(CAST(CAST(xx * gy AS REAL) - CAST(xy * gx AS REAL) AS REAL) / det AS REAL) AS REAL) AS REAL) ELSE CAST(dy AS REAL) END AS py
FROM (SELECT *, det <> 0 AND i BETWEEN 1 AND 19 AND j BETWEEN 1 AND 19 AS inside FROM (SELECT *, CAST(CAST(xx * yy AS REAL) - CAST(xy * xy AS REAL) AS REAL) AS det FROM quadric))""")


def smooth(cells: str, grid: str, above: str) -> str:
    return f"""
SELECT g."row", g.col, CAST(coalesce(c.v, m.v) AS INTEGER) AS v FROM {grid} g LEFT JOIN {cells} c ON c."row" = g."row" AND c.col = g.col LEFT JOIN (
  SELECT k."row" + i AS "row", k.col + j AS col, sum(CASE WHEN i = 0 OR j = 0 THEN 2 ELSE 1 END * z) // sum(CASE WHEN i = 0 OR j = 0 THEN 2 ELSE 1 END) AS v FROM (
    SELECT coalesce(c."row", p."row") AS "row", coalesce(c.col, p.col) AS col, coalesce(c.v, p.v) AS z FROM {cells} c FULL JOIN (
      SELECT 2 * "row" + a.i AS "row", 2 * col + b.j AS col, v FROM {above}, range(0, 2) a(i), range(0, 2) b(j)) p ON c."row" = p."row" AND c.col = p.col) k, off1 GROUP BY 1, 2) m
  ON m."row" = g."row" AND m.col = g.col WHERE coalesce(c.v, m.v) IS NOT NULL"""


#: halvings after which a side of up to 1023 cells has one cell; further levels are empty
DEPTH = 9
for _k in range(3, DEPTH + 2):
    step(f"sh{_k}", f"SELECT h // 2 AS h, w // 2 AS w FROM sh{_k - 1}")
for _k in range(2, DEPTH + 1):
    step(f"grid{_k}", f'SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM sh{_k}, range(0, h) a(r), range(0, w) b(c)')


def fill_all(name: str, cells: str, kind: str) -> None:
    """name: square cells filled from every coarser level, "smooth" or "nearest"."""
    for k in range(1, DEPTH + 1):
        step(f"{name}_a{k}", level(cells if k == 1 else f"{name}_a{k - 1}", f"sh{k - 1}"))
    for k in range(DEPTH - 1, -1, -1):
        own, above, grid = f"{name}_a{k}" if k else cells, f"{name}_a{k + 1}" if k + 1 == DEPTH else f"{name}_b{k + 1}", f"grid{k}" if k else "whole"
        step(f"{name}_b{k}" if k else name, smooth(own, grid, above) if kind == "smooth" else nearest(own, grid, above, f"sh{k + 1}"))


fill_all("top_smooth", "top_raw", "smooth")
fill_all("top_near", "top_raw", "nearest")
fill_all("ground_smooth", "gterrain", "smooth")
