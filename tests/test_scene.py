import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.operators import components, focal, grid
from pointweave.plans.alignment import align_clouds, align_views
from pointweave.plans.queries import stream_inputs
from pointweave.plans.scene import Scene, output_paths, parse_bounds
from pointweave.schema import AlignParams, Frame, Raster, SceneParams
from pointweave.sources import files
from pointweave.sources.fixture import scene_points
from pointweave.streaming.surface import incremental_surface

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    return scene_points(spark, SF).cache()


@pytest.fixture(scope="module")
def scene(points):
    return Scene(points)


def cells(df):
    return {(r.row, r.col): r.v for r in df.collect()}


def test_products(scene, tmp_path):
    low, top = cells(scene.dtm0.cells), cells(scene.dsm.cells)
    assert len(top) == 4096 and {r.v for r in scene.classes.select("v").distinct().collect()} <= {40, 80, 200, 240}
    assert sum(low[k] <= top[k] for k in low if k in top) > 0.95 * len(low)
    rings = scene.outlines.collect()
    assert rings and all(r.ring[0] == r.ring[-1] and len({(p.x, p.y) for p in r.ring}) >= 3 for r in rings)
    done = scene.run({"DSM": f"{tmp_path}/a_DSM", "CLASS": f"{tmp_path}/a_class", "OUTLINES": f"{tmp_path}/a_out", "INT": ""})
    assert done == {"DSM": True, "CLASS": True, "OUTLINES": True}
    spark = scene.points.sparkSession
    back = files.read_raster(spark, f"{tmp_path}/a_DSM")
    assert back.frame == scene.dsm.frame and cells(back.cells) == top
    assert len(files.read_outlines(spark, f"{tmp_path}/a_out")) == len(rings)
    with pytest.raises(ValueError):
        scene.run({"NOPE": "x"})


def test_terrain_given_and_ground_label(scene, points):
    by_label = Scene(points, SceneParams(ground_label=2))
    assert by_label.dtm.cells.count() == 4096 and by_label.classes.count() == 4096
    given = Scene(points, terrain=scene.dtm)
    low, floor = cells(given.low.cells), cells(given._given_terrain.cells)
    assert all(v >= floor.get(k, 0) for k, v in low.items())
    with pytest.raises(ValueError):
        Scene(points, SceneParams(bounds=(10, 50, 8, 40)), terrain=scene.dtm).dtm0


def test_raster_input(scene):
    other = Scene(surface=scene.dsm)
    assert all(v <= cells(scene.dsm.cells)[k] for k, v in cells(other.low.cells).items())
    with pytest.raises(ValueError):
        _ = other.intensity


def test_names_and_bounds():
    assert parse_bounds("([1, 2.5],[-3,4e1])") == (1.0, 2.5, -3.0, 40.0)
    assert output_paths("x", ("DSM",)) == {"DSM": "x"} and "DSM" not in output_paths("x", from_points=False)
    with pytest.raises(ValueError):
        SceneParams(dz=0)


def test_empty_cloud(points):
    with pytest.raises(ValueError):
        grid.cloud_meta(points.limit(0))


def test_components_do_not_depend_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    mask = rng.random((40, 37)) < 0.55
    df = spark.createDataFrame([(int(r), int(c), int(rng.integers(1, 9))) for r, c in zip(*np.nonzero(mask))], "row int, col int, v int")
    frame = Frame(0, 0, 1, 37, 40)
    for diagonal, dz in ((True, None), (False, None), (True, 3)):
        results = []
        for tile in (512, 7):
            monkeypatch.setattr(components, "TILE", tile)
            results.append({(r.row, r.col): r.first for r in components.components(df, frame, diagonal, dz).collect()})
        assert results[0] == results[1]


def test_small_rasters(spark):
    for shape in ((1, 1), (1, 9), (9, 1), (5, 7)):
        h, w = shape
        df = spark.createDataFrame([(r, c, 32760 + 3 * r + c) for r in range(h) for c in range(w)], "row int, col int, v int")
        raster = Raster(df, Frame(0, 0, 1, w, h))
        assert focal.edges(raster, 40000).cells.count() >= 0 and focal.minimum(raster, 4, 0).cells.count() == h * w
        assert {r.v for r in focal.maximum(raster, 9, 0).cells.collect()} == {32760 + 3 * (h - 1) + w - 1}


def test_alignment(points):
    target = grid.translate(points, 2.0, -3.0, 1.5)
    params = AlignParams(maxt=4, samples=400, draws=2000)
    result, moved = align_clouds(points, target, params)
    assert result["ok"] and abs(result["tx"] + 2) < 1 and abs(result["ty"] - 3) < 1 and abs(result["tz"] + 1.5) < 0.01 and moved.count() == points.count()
    twisted, _ = align_clouds(points, target, AlignParams(maxt=4, samples=400, draws=2000, sampler="twister"))
    assert abs(twisted["tz"] + 1.5) < 0.01
    out = list(align_views([points.limit(0), points, target], params))
    assert len(out) == 1 and out[0][0] == result
    with pytest.raises(ValueError):
        align_clouds(points, grid.translate(points, 1000.0, 0.0, 0.0), params)
    assert files.offsets_report(result)[1].split()[2] == f"{result['tz']:08.3f}"


def test_files(spark, points, tmp_path):
    own = points.orderBy("point_id").limit(200).toPandas()
    (tmp_path / "a.las").write_bytes(files.encode_las(own))
    back = files.load(spark, str(tmp_path / "a.las")).toPandas().sort_values("point_id")
    for c in "xyz":
        assert np.allclose(back[c], own[c], atol=0.001)
    assert back["classification"].tolist() == own["classification"].tolist()
    frame = Frame(100.0, 200.0, 2.0, 5, 4)
    z = np.arange(20, dtype="f4").reshape(4, 5) + 7
    z[1, 2] = -10000
    (tmp_path / "r.tif").write_bytes(files.encode_geotiff(z, frame, -10000))
    raster = files.load(spark, str(tmp_path / "r.tif"))
    assert (raster.frame.easting, raster.frame.northing, raster.frame.gsd, raster.frame.width) == (100.0, 200.0, 2.0, 5)
    metres = {(r.row, r.col): r.v * raster.frame.scale + raster.frame.offset for r in raster.cells.collect()}
    assert len(metres) == 19 and all(abs(v - z[k]) < 0.01 for k, v in metres.items())
    raw = files.geotiff_bytes(raster).first()[0]
    again, head = files.decode_geotiff(bytes(raw))
    assert again[1, 2] == -10000 and head["northing"] == 200.0
    with pytest.raises(ValueError):
        files.decode_las(b"nothing")


def test_rings():
    box = [(x, 0) for x in range(120)] + [(119, y) for y in range(1, 90)] + [(x, 89) for x in range(118, -1, -1)] + [(0, y) for y in range(88, 0, -1)]
    out = g.simplify(box)
    assert out[0] == out[-1] and len(out) == 5
    assert {(round(x), round(y)) for x, y in out} == {(0, 0), (119, 0), (119, 89), (0, 89)}
    assert g.simplify([(0, 0)]) == [] and g.simplify(box[:10]) == []
    square = [(0, 0), (10, 0), (10, 0.1), (10, 10), (0, 10)]
    assert g.reduce_ring(square, 1.0) == [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)] or len(g.reduce_ring(square, 1.0)) == 5
    block = {(r, c) for r in range(3) for c in range(4)}
    assert g.trace(block, (0, 0), True)[0] == (0, 0) and len(g.trace(block, (0, 0), True)) == 10 and g.trace({(5, 5)}, (5, 5), True) == [(5, 5)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    points, meta, frame = stream_inputs(events)
    batch = cells(incremental_surface(points, meta, frame))
    source = tmp_path / "in"
    points.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = incremental_surface(stream, meta, frame).writeStream.format("memory").queryName("surface").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert cells(spark.table("surface").select("row", "col", F.col("v"))) == batch
