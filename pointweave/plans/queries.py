"""Registered queries over the test scene, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import geometry
from pointweave.operators import align, algebra, classify, components, focal, grid, pyramid, vector
from pointweave.plans import oracles as o
from pointweave.plans.alignment import prepared
from pointweave.plans.scene import Scene
from pointweave.plans.storage import store
from pointweave.schema import AlignParams, CloudMeta, Raster, SceneParams
from pointweave.sources.fixture import scene_points
from pointweave.streaming.surface import incremental_surface

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
P = SceneParams()
#: The class queries have no labels: what is over 9 m counts as building there.
LOW = replace(P, max_tree_height=9.0)
WINDOW = (10.0, 50.0, 8.0, 40.0)
#: The job of the registration queries that SQL holds; the align_full_ queries and align_peak run the aligner's defaults.
ALIGN = AlignParams(maxt=4.0, samples=400, draws=2000)
FULL_ALIGN = AlignParams()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = o.query(sql)
        return f

    return register


class Bench:
    """The scene's points and the rasters of its chain, made on demand. Numbering the points sorts them all, so they have a
    point_id only where it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, numbered: bool = False):
        points = scene_points(spark, sf_dir)
        self.points = store(points if numbered else points.drop("point_id"), "points")

    def __getattr__(self, name: str):
        made = {
            "meta": lambda: grid.cloud_meta(self.points),
            "top": lambda: grid.grid(self.points, self.meta, 1.0),
            "low_raw": lambda: grid.grid(self.points, self.meta, 1.0, "min"),
            "frame": lambda: self.top.frame,
            "smooth": lambda: focal.quantile(self.top, 1, 0.4, self.frame.units(P.agl)),
            "dsm": lambda: self._kept(pyramid.fill(focal.wells(self.smooth, P), levels=2)),
            "low": lambda: self._kept(pyramid.fill(focal.quantile(self.low_raw, 2, 0.33, self.frame.units(P.agl)), levels=2)),
            "dsm2": lambda: focal.tree_voids(self.dsm, self.low, P),
            "ground": lambda: grid.crop_to_class(self.points, 2),
            "ground_raw": lambda: grid.grid(self.ground, grid.cloud_meta(self.ground), 1.0, like=self.frame),
            "terrain": lambda: self._kept(algebra.rescale(self.ground_raw, self.frame.offset, self.frame.scale)),
            "base": lambda: store(classify.base_classes(self.dsm, self.dsm2, self.terrain, self.points.sparkSession.createDataFrame([], "row int, col int, v int"), LOW), "classes"),
            "houses": lambda: self.base.where("v = 240"),
        }.get(name)
        if made is None:
            raise AttributeError(name)
        value = made()
        setattr(self, name, value)
        return value

    @staticmethod
    def _kept(r: Raster) -> Raster:
        return r.with_cells(store(r.cells.select("row", "col", "v"), "raster"))


CELLS = 'SELECT "row", col, CAST(v AS INTEGER) AS v FROM {}'


# Points and gridding


@query("SELECT n, x0 AS xmin, x1 AS xmax, y0 AS ymin, y1 AS ymax, z0 AS zmin, z1 AS zmax, CAST(xo AS INTEGER) AS xoff, CAST(yo AS INTEGER) AS yoff, CAST(zo AS INTEGER) AS zoff FROM cloud")
def cloud_bounds(spark, sf_dir):
    return grid.bounds_table(scene_points(spark, sf_dir))


@query("SELECT point_id, x, y, z, intensity, classification FROM pts WHERE classification = 2")
def cloud_crop_class(spark, sf_dir):
    return grid.crop_to_class(scene_points(spark, sf_dir), 2)


@query("SELECT point_id, x + 3e0 AS x, y + 4e0 AS y, z + 5e0 AS z, intensity, classification FROM pts")
def cloud_translate(spark, sf_dir):
    return grid.translate(scene_points(spark, sf_dir), 3.0, 4.0, 5.0)


@query(CELLS.format("top_raw"))
def grid_dsm_raw(spark, sf_dir):
    return Bench(spark, sf_dir).top.cells


@query(CELLS.format("low_raw"))
def grid_min_raw(spark, sf_dir):
    return Bench(spark, sf_dir).low_raw.cells


@query('SELECT "row", col, CAST(max(q) AS INTEGER) AS v FROM splb WHERE q <> 0 GROUP BY 1, 2')
def grid_dsm_bounds(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return grid.grid(b.points, b.meta, 1.0, "max", WINDOW).cells


@query('SELECT "row", col, CAST(v AS REAL) * sc + off AS z FROM top_raw, fr')
def grid_dsm_metres(spark, sf_dir):
    return algebra.to_metres(Bench(spark, sf_dir).top)


@query('SELECT g."row", g.col, CASE WHEN v IS NULL THEN CAST(-10000 AS REAL) ELSE CAST(v AS REAL) * sc + off END AS z FROM whole g LEFT JOIN top_raw t ON g."row" = t."row" AND g.col = t.col, fr')
def raster_write_metres(spark, sf_dir):
    return algebra.to_metres(Bench(spark, sf_dir).top, void=-10000.0)


@query("SELECT CAST(ht AS BIGINT) * wd - (SELECT count(*) FROM top_raw) AS voids FROM fr")
def grid_void_count(spark, sf_dir):
    return grid.count_voids(Bench(spark, sf_dir).top)


@query('SELECT t."row", t.col, t.v - l.v AS v FROM top_raw t JOIN low_raw l ON t."row" = l."row" AND t.col = l.col WHERE t.v > l.v')
def grid_var(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return algebra.subtract(b.top, b.low_raw).cells


@query('SELECT t."row", t.col, CAST(trunc(CAST(t.v AS REAL) + CAST(l.v AS REAL)) AS INTEGER) & 65535 AS v FROM top_raw t JOIN low_raw l ON t."row" = l."row" AND t.col = l.col WHERE (t.v + l.v) & 65535 <> 0')
def raster_add(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return algebra.add(b.top, b.low_raw).cells


@query('SELECT l."row", l.col, greatest(l.v, coalesce(t.v, l.v)) AS v FROM low_raw l LEFT JOIN gterrain t ON l."row" = t."row" AND l.col = t.col')
def raster_clamp_min(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return algebra.at_least(b.low_raw, b.terrain).cells


@query('SELECT t."row", t.col, least(t.v, coalesce(d.v, t.v)) AS v FROM gterrain t LEFT JOIN low_raw d ON t."row" = d."row" AND t.col = d.col')
def raster_clamp_max(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return algebra.at_most(b.terrain, b.low_raw).cells


@query('SELECT t.* FROM gterrain t SEMI JOIN top_raw d ON t."row" = d."row" AND t.col = d.col')
def dsm_void_propagate(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return algebra.void_where_void(b.terrain, b.top).cells


@query('SELECT t.* FROM top_raw t ANTI JOIN steps_s s ON t."row" = s."row" AND t.col = s.col')
def raster_void_mask(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return algebra.void_under(b.top, focal.steps(b.dsm, 1, b.frame.units(P.dz))).cells


@query(CELLS.format("gterrain"))
def raster_rescale(spark, sf_dir):
    return Bench(spark, sf_dir).terrain.cells


@query('SELECT CAST(t."row" * 3 + a.i AS INTEGER) AS "row", CAST(t.col * 3 + b.j AS INTEGER) AS col, v FROM top_raw t, range(0, 3) a(i), range(0, 3) b(j)')
def upsample3(spark, sf_dir):
    return algebra.upsample(Bench(spark, sf_dir).top.cells, 3)


# Neighbourhoods


@query(CELLS.format("top_q"))
def focal_quantile_dsm(spark, sf_dir):
    return Bench(spark, sf_dir).smooth.cells


@query(CELLS.format("low_q"))
def focal_quantile_min(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.quantile(b.low_raw, 2, 0.33, b.frame.units(P.agl)).cells


@query(CELLS.format(f"({o.quantile('top_raw', 1, 0.5, o.units(1))})"))
def focal_median(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.median(b.top, 1, b.frame.units(P.dz)).cells


_BEST = 'SELECT c."row", c.col, CASE WHEN {} THEN m ELSE v END AS v FROM top_raw c JOIN (SELECT "row", col, {}(x) AS m FROM ({}) GROUP BY 1, 2) w ON c."row" = w."row" AND c.col = w.col'


@query(_BEST.format(f"v > m + {o.units(2)} % 65536", "min", o.wide("top_raw", 4)))
def focal_min(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.minimum(b.top, 4, b.frame.units(P.agl)).cells


@query(_BEST.format(f"v + {o.units(2)} % 65536 < m", "max", o.wide("top_raw", 2)))
def focal_max(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.maximum(b.top, 2, b.frame.units(P.agl)).cells


@query(o.edge("top_raw", "whole"))
def focal_edge(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.edges(b.top, b.frame.units(2.0)).cells


@query(CELLS.format("top_w"))
def focal_wells(spark, sf_dir):
    return focal.wells(Bench(spark, sf_dir).smooth, P).cells


@query(CELLS.format("dsm2"))
def focal_tree_void(spark, sf_dir):
    return Bench(spark, sf_dir).dsm2.cells


@query(f"""SELECT c."row", c.col, CAST(max(x) - min(x) AS INTEGER) AS v FROM top_raw c JOIN ({o.wide("top_raw", 1)}) n ON c."row" = n."row" AND c.col = n.col GROUP BY 1, 2 HAVING max(x) > min(x)""")
def focal_user_rule(spark, sf_dir):
    return focal.focal(Bench(spark, sf_dir).top, 1, lambda ref, window: F.array_max(window) - F.array_min(window)).cells


@query(f"""SELECT c."row", c.col, CAST(count(*) FILTER (WHERE x > c.v) AS INTEGER) AS higher FROM top_raw c JOIN ({o.wide("low_raw", 1)}) n ON c."row" = n."row" AND c.col = n.col GROUP BY 1, 2""")
def focal_two_sources(spark, sf_dir):
    b = Bench(spark, sf_dir)
    seen = focal.fan_out(b.low_raw.cells, b.frame, 1).select("row", "col", F.col("n.v").alias("x")).join(b.top.cells, ["row", "col"])
    return seen.groupBy("row", "col").agg(F.count_if(F.col("x") > F.col("v")).cast("int").alias("higher"))


@query('SELECT "row", col FROM steps_s')
def step_labels(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.steps(b.dsm, 1, b.frame.units(P.dz))


@query('SELECT "row", col FROM grow_s')
def extend_labels(spark, sf_dir):
    b = Bench(spark, sf_dir)
    marked = store(focal.steps(b.dsm, 1, b.frame.units(P.dz)), "steps")
    return focal.extend(b.dsm, marked, 1, b.frame.units(P.dz))


@query('SELECT h."row", h.col FROM houses h SEMI JOIN (SELECT n."row" + i AS "row", n.col + j AS col FROM solid_h n, off1) s ON h."row" = s."row" AND h.col = s.col')
def erode_dilate(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.erode_dilate(b.frame, b.houses)


# Multigrid and surfaces


@query('SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, v FROM dsm_l1')
def pyramid_level1(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return pyramid.reduce_level(focal.wells(b.smooth, P).cells, b.frame)[0]


@query('SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, v FROM dsm_l2')
def pyramid_level2(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return pyramid.reduce_level(*pyramid.reduce_level(focal.wells(b.smooth, P).cells, b.frame))[0]


@query('SELECT "row", col, CAST(v AS INTEGER) AS v FROM rfill')
def fill_nearest2(spark, sf_dir):
    return pyramid.fill(Bench(spark, sf_dir).top, levels=2).cells


_SMOOTH = """
SELECT g."row", g.col, CAST(coalesce(c.v, m.v) AS INTEGER) AS v FROM whole g LEFT JOIN top_raw c ON c."row" = g."row" AND c.col = g.col LEFT JOIN (
  SELECT k."row" + i AS "row", k.col + j AS col, sum(CASE WHEN i = 0 OR j = 0 THEN 2 ELSE 1 END * z) // sum(CASE WHEN i = 0 OR j = 0 THEN 2 ELSE 1 END) AS v FROM (
    SELECT coalesce(c."row", p."row") AS "row", coalesce(c.col, p.col) AS col, coalesce(c.v, p.v) AS z FROM top_raw c FULL JOIN (
      SELECT 2 * "row" + a.i AS "row", 2 * col + b.j AS col, v FROM rfill_l1, range(0, 2) a(i), range(0, 2) b(j)) p ON c."row" = p."row" AND c.col = p.col) k, off1 GROUP BY 1, 2) m
  ON m."row" = g."row" AND m.col = g.col WHERE coalesce(c.v, m.v) IS NOT NULL"""


@query(_SMOOTH)
def fill_smooth_1level(spark, sf_dir):
    return pyramid.fill(Bench(spark, sf_dir).top, smooth=True, levels=1).cells


@query(CELLS.format("top_smooth"))
def fill_smooth_all(spark, sf_dir):
    return pyramid.fill(Bench(spark, sf_dir).top, smooth=True).cells


@query(CELLS.format("top_near"))
def fill_nearest_all(spark, sf_dir):
    return pyramid.fill(Bench(spark, sf_dir).top).cells


@query(CELLS.format("dsm"))
def dsm(spark, sf_dir):
    return Bench(spark, sf_dir).dsm.cells


@query(CELLS.format("lowest"))
def min_surface(spark, sf_dir):
    return Bench(spark, sf_dir).low.cells


@query(CELLS.format("dsm2"))
def dsm2(spark, sf_dir):
    return Bench(spark, sf_dir).dsm2.cells


@query(CELLS.format("inten"))
def intensity(spark, sf_dir):
    b = Bench(spark, sf_dir, numbered=True)
    return pyramid.fill(grid.intensity(b.points, b.meta, b.dsm, P), levels=2).cells


@query(CELLS.format("agl"))
def min_agl(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.agl_median(grid.lowest_above(b.points, b.meta, b.dsm, b.terrain, P), P).cells


@query(f'SELECT d.* FROM dsm d LEFT JOIN gterrain t ON d."row" = t."row" AND d.col = t.col WHERE d.v > coalesce(t.v, 0) + {o.units(2)}')
def min_agl_raster(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return grid.lowest_above_raster(b.dsm, b.terrain, P).cells


@query('SELECT t.* FROM gterrain t SEMI JOIN dsm d ON t."row" = d."row" AND t.col = d.col')
def dtm_from_ground_label(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return algebra.void_where_void(b.terrain, b.dsm).cells


@query('SELECT t."row", t.col, CAST(t.v AS INTEGER) AS v FROM ground_smooth t SEMI JOIN dsm d ON t."row" = d."row" AND t.col = d.col')
def dtm_smooth_from_ground_label(spark, sf_dir):
    """The whole operator: terrain from points of class 2, voids filled smoothly from all levels."""
    return Scene(scene_points(spark, sf_dir), replace(P, ground_label=2)).dtm0.cells


# Components and classes


@query('SELECT h."row", h.col, k AS v FROM houses h JOIN num_h n ON n.id = h.id')
def components_fg(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return components.numbered(components.components(b.houses, b.frame)).select("row", "col", F.col("id").alias("v"))


@query('SELECT h."row", h.col, k AS v FROM houses h JOIN num_h n ON n.id = h.id UNION ALL SELECT f."row", f.col, -k FROM inner_bg f JOIN num_i n ON n.id = f.id')
def components_bg_holes(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return components.labelled_with_holes(b.houses, b.frame)


@query('SELECT k AS label, min(col) AS xmin, max(col) AS xmax, min("row") AS ymin, max("row") AS ymax, count(*) AS cnt FROM houses h JOIN num_h n ON n.id = h.id GROUP BY 1')
def object_stats(spark, sf_dir):
    return components.object_stats(components_fg(spark, sf_dir))


@query('SELECT h."row", h.col, CAST(240 AS INTEGER) AS v FROM houses h JOIN comp_h c ON c.id = h.id WHERE c.first IN (SELECT first FROM comp_h GROUP BY 1 HAVING count(*) >= 50)')
def drop_small_objects(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return components.drop_small(b.houses, b.frame, P.area)


@query('SELECT b."row", b.col, CAST(CASE WHEN c.first IS NOT NULL AND c.first NOT IN (SELECT first FROM open_w) THEN 240 ELSE b.v END AS INTEGER) AS v FROM base b LEFT JOIN woods w ON w."row" = b."row" AND w.col = b.col LEFT JOIN comp_w c ON c.id = w.id')
def fill_inside_buildings(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return components.fill_inside_buildings(b.base, b.frame)


@query('SELECT "row", col, v FROM base')
def class_base(spark, sf_dir):
    return Bench(spark, sf_dir).base


@query('SELECT "row", col, v FROM grown')
def class_edge_growth(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.grow_buildings(b.base, b.dsm, P, rounds=1)


@query('SELECT "row", col, v FROM grown5')
def class_edge_growth_full(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.grow_buildings(b.base, b.dsm, P)


@query('SELECT "row", col, v FROM major')
def class_majority(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return focal.building_majority(b.base, b.frame)


@query('SELECT "row", col, v FROM base WHERE v = 240')
def building_mask(spark, sf_dir):
    return classify.building_mask(Bench(spark, sf_dir).base)


# Outlines: rings of the classified scene have no SQL form; metrics over given rings do


#: A ring from the orders table: the first 60 keys on a wobbling circle. The queries held by SQL take this one ring.
_RING_SQL = "SELECT CAST(1 AS INTEGER) AS label, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS i, CAST(o_orderkey * 37 % 101 AS DOUBLE) AS x, CAST(o_orderkey * 53 % 97 AS DOUBLE) AS y FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey <= 60)"


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey <= 60").select("o_orderkey").distinct().orderBy("o_orderkey")
    points = keys.agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct((k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"))).alias("ring"))
    return points.select(F.lit(1).alias("label"), "ring", F.array().cast("array<array<struct<x:double,y:double>>>").alias("inner_rings"))


@query(f"""WITH r AS ({_RING_SQL}), n AS (SELECT count(*) AS n FROM r) SELECT label, i, round((3.141592653589793e0 - acos(greatest(-1e0, least(1e0, dot / (la * lc))))) * la * lc, 6) AS metric FROM (
  SELECT b.label, b.i, (a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y) AS dot, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS la, sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) AS lc
  FROM r b, n, r a, r c WHERE a.i = (b.i - 5 + n.n) % n.n AND c.i = (b.i + 5) % n.n) WHERE la > 0 AND lc > 0""")
def ring_corner_metric(spark, sf_dir):
    out = vector.corner_metric(vector.ring_points(_ring(spark, sf_dir)), 5)
    return out.select("label", "i", F.round("metric", 6).alias("metric"))


@query(f"WITH r AS ({_RING_SQL}), n AS (SELECT count(*) AS n FROM r) SELECT a.label, abs(sum(a.x * b.y - b.x * a.y)) / 2e0 AS area FROM r a, r b, n WHERE b.i = (a.i + 1) % n.n GROUP BY 1")
def polygon_area(spark, sf_dir):
    return _ring(spark, sf_dir).select("label", geometry.ring_area(F.col("ring")).alias("area"))


_RINGS_SQL = "SELECT CAST(k // 61 + 1 AS INTEGER) AS label, CAST(row_number() OVER (PARTITION BY k // 61 ORDER BY k) - 1 AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY k // 61) AS INTEGER) AS n, CAST(k * 37 % 101 AS DOUBLE) AS x, CAST(k * 53 % 97 AS DOUBLE) AS y FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey IS NOT NULL)"


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings from the whole orders table: keys 0 to 60 are the ring above with label 1, the next 61 label 2, and so on."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey IS NOT NULL").select("o_orderkey", F.expr("cast(o_orderkey div 61 + 1 as int)").alias("label")).distinct()
    points = keys.groupBy("label").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct((k * 37 % 101).cast("double").alias("x"), (k * 53 % 97).cast("double").alias("y"))).alias("ring"))
    return points.select("label", "ring", F.array().cast("array<array<struct<x:double,y:double>>>").alias("inner_rings"))


@query(f"""WITH r AS ({_RINGS_SQL}) SELECT label, i, round((3.141592653589793e0 - acos(greatest(-1e0, least(1e0, dot / (la * lc))))) * la * lc, 6) AS metric FROM (
  SELECT b.label, b.i, (a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y) AS dot, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS la, sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) AS lc
  FROM r b JOIN r a ON a.label = b.label AND a.i = ((b.i - 5) % b.n + b.n) % b.n JOIN r c ON c.label = b.label AND c.i = (b.i + 5) % b.n) WHERE la > 0 AND lc > 0""")
def ring_corner_metric_all(spark, sf_dir):
    out = vector.corner_metric(vector.ring_points(_rings(spark, sf_dir)), 5)
    return out.select("label", "i", F.round("metric", 6).alias("metric"))


@query(f"WITH r AS ({_RINGS_SQL}) SELECT a.label, abs(sum(a.x * b.y - b.x * a.y)) / 2e0 AS area FROM r a JOIN r b ON b.label = a.label AND b.i = (a.i + 1) % a.n GROUP BY 1")
def polygon_area_all(spark, sf_dir):
    return _rings(spark, sf_dir).select("label", geometry.ring_area(F.col("ring")).alias("area"))


@query()
def vw_reduce(spark, sf_dir):
    return vector.vw_reduce(_rings(spark, sf_dir), 400.0)


@query()
def ground_dtm(spark, sf_dir):
    return Scene(scene_points(spark, sf_dir)).dtm.cells


@query()
def labels_refined(spark, sf_dir):
    return Scene(scene_points(spark, sf_dir)).labels


@query()
def class_raster(spark, sf_dir):
    return Scene(scene_points(spark, sf_dir)).classes


@query()
def building_outlines(spark, sf_dir):
    return Scene(scene_points(spark, sf_dir)).outlines


@query()
def outlines_traced(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return vector.outlines(algebra.upsample(store(components.labelled_with_holes(b.houses, b.frame), "labels"), 3))


@query()
def outlines_world(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return vector.geo_table(vector.outlines(store(components.labelled_with_holes(b.houses, b.frame), "labels")), b.frame)


# Registration


def _pair(spark: SparkSession, sf_dir: str) -> tuple[Raster, Raster]:
    p = scene_points(spark, sf_dir)
    target = grid.translate(p.where(F.expr("(point_id div 1000) % 2 = 0")), 2.0, -3.0, 1.5)
    return prepared(p, ALIGN), prepared(target, ALIGN)


@query("SELECT x0 AS xmin, x1 AS xmax, y0 AS ymin, y1 AS ymax FROM box")
def align_overlap(spark, sf_dir):
    p = scene_points(spark, sf_dir)
    target = grid.translate(p.where(F.expr("(point_id div 1000) % 2 = 0")), 2.0, -3.0, 1.5)
    a, b = (grid.frame_of(grid.cloud_meta(q), 1.0) for q in (p, target))
    return spark.createDataFrame([align.overlap(a, b)], "xmin double, xmax double, ymin double, ymax double")


@query("SELECT * FROM scored")
def align_scores(spark, sf_dir):
    return align.scores(*_pair(spark, sf_dir), ALIGN)


@query("SELECT * FROM ranked")
def align_best(spark, sf_dir):
    return align.best(align.scores(*_pair(spark, sf_dir), ALIGN))


def _full_target(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scene, and every point of it moved."""
    p = scene_points(spark, sf_dir)
    return p, grid.translate(p, 2.0, -3.0, 1.5)


def _full_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.scores(*(prepared(q, FULL_ALIGN) for q in _full_target(spark, sf_dir)), FULL_ALIGN)


@query("SELECT x0 AS xmin, x1 AS xmax, y0 AS ymin, y1 AS ymax FROM all_box")
def align_full_overlap(spark, sf_dir):
    a, b = (grid.frame_of(grid.cloud_meta(q), FULL_ALIGN.gsd) for q in _full_target(spark, sf_dir))
    return spark.createDataFrame([align.overlap(a, b)], "xmin double, xmax double, ymin double, ymax double")


@query("SELECT * FROM all_scored")
def align_full_scores(spark, sf_dir):
    return _full_scores(spark, sf_dir)


@query("SELECT * FROM all_ranked")
def align_full_best(spark, sf_dir):
    return align.best(_full_scores(spark, sf_dir))


@query("SELECT CAST(-px AS DOUBLE) AS tx, CAST(-py AS DOUBLE) AS ty, CAST(tz AS DOUBLE) AS tz, CAST(c AS DOUBLE) AS rms, CAST(completeness AS DOUBLE) AS completeness, true AS ok FROM peak")
def align_peak(spark, sf_dir):
    r = align.estimate(_full_scores(spark, sf_dir), FULL_ALIGN.gsd, FULL_ALIGN.maxt)
    return spark.createDataFrame([(r["tx"], r["ty"], r["tz"], r["rms"], r["completeness"], r["ok"])], "tx double, ty double, tz double, rms double, completeness double, ok boolean")


@query("SELECT printf('%08.3f %08.3f %08.3f %08.3f', -dx, -dy, tz, rms) AS value FROM all_ranked")
def align_full_report(spark, sf_dir):
    return _report(align.best(_full_scores(spark, sf_dir)))


def _report(b: DataFrame) -> DataFrame:
    return b.select(F.format_string("%08.3f %08.3f %08.3f %08.3f", -F.col("dx"), -F.col("dy"), F.col("tz").cast("double"), F.col("rms").cast("double")).alias("value"))


@query("SELECT printf('%08.3f %08.3f %08.3f %08.3f', -dx, -dy, tz, rms) AS value FROM ranked")
def align_report(spark, sf_dir):
    return _report(align.best(align.scores(*_pair(spark, sf_dir), ALIGN)))


# Stream extension, on the events table in batch


@query("""SELECT r + dr AS "row", c + dc AS col, CAST(max(q) AS INTEGER) AS v FROM (
  SELECT CAST(trunc(CAST(CAST(x AS REAL) AS DOUBLE) + (0e0 - 0.5e0)) AS INTEGER) AS c, CAST(trunc(-1e0 * CAST(CAST(y AS REAL) AS DOUBLE) + (64 - 1 - 0e0 + 0.5e0)) AS INTEGER) AS r,
    CAST(trunc(CAST(CAST(10e0 AS REAL) AS DOUBLE) * CAST(CAST(z AS REAL) AS DOUBLE) + 10e0) AS INTEGER) AS q
  FROM (SELECT CAST(event_id % 64 AS DOUBLE) AS x, CAST(user_id % 64 AS DOUBLE) AS y, value AS z FROM events)), (VALUES (0), (1)) a(dr), (VALUES (0), (1)) b(dc)
WHERE r + dr BETWEEN 0 AND 63 AND c + dc BETWEEN 0 AND 63 AND q <> 0 GROUP BY 1, 2""")
def stream_surface_batch(spark, sf_dir):
    points, meta, frame = stream_inputs(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return incremental_surface(points, meta, frame)


def stream_inputs(events: DataFrame):
    """Events as points in a fixed frame of 64 x 64 cells, a tenth of a metre per unit."""
    points = events.select(F.col("event_id").alias("point_id"), F.expr("cast(event_id % 64 as double)").alias("x"), F.expr("cast(user_id % 64 as double)").alias("y"), F.col("value").alias("z"))
    meta = CloudMeta(0, 0.0, 63.0, 0.0, 63.0, 0.0, 1.0)
    from pointweave.schema import Frame

    return points, meta, Frame(0.0, 0.0, 1.0, 64, 64, 0.1, -1.0)
