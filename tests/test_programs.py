"""The command line over files, and the reference system on write and read."""

import json

import numpy as np

from pointweave.__main__ import main, options, SCENE_OPTIONS
from pointweave.schema import Frame
from pointweave.sources import files
from pointweave.sources.fixture import scene_points

SF = "/root/testdata/sf0.001"


def test_options():
    found, other = options(["DH=0.5", "dz=2", "EGM96", "BOUNDS=1,2,3,4", "GND_LABEL=2", "DTM=/x.tif", "CONVERT"], SCENE_OPTIONS)
    assert found == {"dh": 0.5, "dz": 2.0, "bounds": (1.0, 2.0, 3.0, 4.0), "ground_label": 2}
    assert other == {"egm96": True, "dtm": "/x.tif", "convert": True}


def test_wrong_arguments(spark):
    assert main([], spark) == 2 and main(["scene", "x"], spark) == 2 and main(["align", "x"], spark) == 2 and main(["paint", "x", "y", "z", "u"], spark) == 2


def test_scene_and_align(spark, tmp_path):
    points = scene_points(spark, SF)
    here, there = f"{tmp_path}/here", f"{tmp_path}/there"
    files.write_points(points, here)
    files.write_points(points.selectExpr("point_id", "x + 2 x", "y - 3 y", "z + 1.5 z", "intensity", "classification"), there)
    assert main(["scene", here, "DH=1", "DZ=1", "AGL=2", "GND_LABEL=2"], spark) == 0
    dsm = files.read_raster(spark, f"{here}_DSM")
    assert dsm.frame.width == 64 and dsm.cells.count() == 64 * 64
    assert files.read_raster(spark, f"{here}_class").cells.where("v = 240").count() > 0
    assert main(["align", here, there, "maxt=4"], spark) == 0
    report = spark.read.text(f"{there}_offsets").toPandas()["value"].tolist()
    assert report[-1].split()[:3] == ["-002.000", "0003.000", "-001.500"]


def test_zone_is_kept(spark, tmp_path):
    pixels = np.arange(1, 13, dtype="f4").reshape(3, 4)
    for zone, code in ((17, 32617), (-33, 32733), (0, 0)):
        path = f"{tmp_path}/z{zone}.tif"
        with open(path, "wb") as f:
            f.write(files.encode_geotiff(pixels, Frame(500000.0, 4000000.0, 1.0, 4, 3, zone=zone), 0.0, egm96=zone > 0))
        back = files.read_geotiff(spark, path)
        assert back.frame.zone == zone and files.zone_code(zone) == code and files.code_zone(code) == zone
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]]
    rows = spark.createDataFrame([(1, square[0], [])], "label int, ring array<struct<x:double,y:double>>, inner_rings array<array<struct<x:double,y:double>>>")
    assert files.write_outlines(rows, Frame(0.0, 0.0, 1.0, 4, 4, zone=17), f"{tmp_path}/out")
    (feature,) = files.read_outlines(spark, f"{tmp_path}/out")
    assert feature["crs"]["properties"]["name"].endswith("::32617") and json.dumps(feature["properties"]) == '{"Label": 1}'
