"""Files in and out: point tables and LAS files, rasters as Parquet cells or GeoTIFF, outlines, reports.

Binary files are read with Spark's own reader (any store it knows) and decoded in Python by whole files; one file is one
task, so large clouds should come as many files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.algebra import to_metres
from pointweave.operators.vector import geo_table
from pointweave.schema import CELLS, POINTS, Frame, Raster, f32

# Points


def read_points(spark: SparkSession, *paths: str) -> DataFrame:
    """Point tables (Parquet with x, y, z and optional point_id, intensity, classification) and LAS files, in union."""
    out = None
    for path in paths:
        one = read_las(spark, path) if path.lower().rstrip("/").endswith(".las") else _complete(spark.read.parquet(path))
        out = one if out is None else out.unionByName(one)
    return out


def _complete(df: DataFrame) -> DataFrame:
    extra = {"point_id": F.monotonically_increasing_id(), "intensity": F.lit(0.0), "classification": F.lit(0)}
    for name, value in extra.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in POINTS])


#: Fixed values of the LAS layout: header bytes, and per point format the bytes before its class.
LAS_HEADER, LAS_CLASS_AT = 227, {0: 15, 1: 15, 2: 15, 3: 15, 6: 16, 7: 16, 8: 16}


def decode_las(raw: bytes) -> pd.DataFrame:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, kind, size, n = struct.unpack_from("<I", raw, 96)[0], raw[104] & 63, *struct.unpack_from("<HI", raw, 105)
    if not n and raw[25] >= 4:
        n = struct.unpack_from("<Q", raw, 247)[0]
    if kind not in LAS_CLASS_AT:
        raise ValueError(f"point format {kind} is not supported")
    scale, offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    rows = np.frombuffer(raw, np.dtype((np.void, size)), n, start)
    table = np.frombuffer(rows.tobytes(), np.uint8).reshape(n, size)
    xyz = np.ascontiguousarray(table[:, :12]).view("<i4")
    out = {c: xyz[:, k] * scale[k] + offset[k] for k, c in enumerate("xyz")}
    mask = 31 if kind < 6 else 255
    return pd.DataFrame({"point_id": np.arange(n), **out, "intensity": np.ascontiguousarray(table[:, 12:14]).view("<u2")[:, 0].astype("f4"), "classification": (table[:, LAS_CLASS_AT[kind]] & mask).astype("i4")})


def encode_las(points: pd.DataFrame, scale: float = 0.001) -> bytes:
    """LAS 1.2, point format 0."""
    low = [float(points[c].min()) if len(points) else 0.0 for c in "xyz"]
    high = [float(points[c].max()) if len(points) else 0.0 for c in "xyz"]
    head = bytearray(LAS_HEADER)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 2, 0
    struct.pack_into("<HII", head, 94, LAS_HEADER, LAS_HEADER, 0)
    struct.pack_into("<HI", head, 105, 20, len(points))
    struct.pack_into("<3d3d", head, 131, *[scale] * 3, *low)
    struct.pack_into("<6d", head, 179, *[v for k in range(3) for v in (high[k], low[k])])
    body = np.zeros(len(points), np.dtype([("xyz", "<i4", 3), ("i", "<u2"), ("bits", "u1"), ("cls", "u1"), ("rest", "u1", 4)]))
    body["xyz"] = np.stack([np.round((points[c].to_numpy() - low[k]) / scale) for k, c in enumerate("xyz")], axis=1) if len(points) else body["xyz"]
    body["i"], body["cls"] = np.clip(points["intensity"], 0, 65535), points["classification"]
    return bytes(head) + body.tobytes()


def read_las(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for place, raw in zip(files["path"], files["content"], strict=True):
                own = decode_las(raw)
                own["point_id"] += zlib.crc32(place.encode()) << 31
                yield own

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, POINTS)


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").parquet(path)


# Rasters


def write_raster(raster: Raster, path: str) -> None:
    """Cells, with the frame as a one-row table beside them."""
    raster.cells.write.mode("overwrite").parquet(f"{path}/cells")
    raster.cells.sparkSession.createDataFrame([tuple(vars(raster.frame).values())], ", ".join(f"{k} {'int' if k in ('width', 'height', 'zone') else 'double'}" for k in vars(raster.frame))).coalesce(1).write.mode("overwrite").parquet(f"{path}/frame")


def read_raster(spark: SparkSession, path: str) -> Raster:
    if path.lower().endswith((".tif", ".tiff")):
        return read_geotiff(spark, path)
    return Raster(spark.read.schema(CELLS).parquet(f"{path}/cells"), Frame(**spark.read.parquet(f"{path}/frame").first().asDict()))


def load(spark: SparkSession, path: str):
    """A raster for .tif and raster folders, else points."""
    if path.lower().endswith((".tif", ".tiff")) or path.rstrip("/").endswith("_raster"):
        return read_raster(spark, path)
    return read_points(spark, path)


#: Fixed values of the TIFF format: pixel types by (sample format, bits), field sizes, and the tags used.
PIXELS = {(1, 8): "u1", (1, 16): "<u2", (3, 32): "<f4", (2, 16): "<i2", (1, 32): "<u4", (2, 32): "<i4", (3, 64): "<f8"}
READABLE = ("u1", "<u2", "<f4")
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, FORMAT, SCALE, TIE, KEYS, NODATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339, 33550, 33922, 34735, 42113
#: Fixed values of the geographic keys: projected model, area pixels, and the codes of UTM zones on WGS84 and of the heights.
MODEL, PIXEL, PROJECTED, VERTICAL = 1024, 1025, 3072, 4096
NORTH, SOUTH, ELLIPSOID, GEOID = 32600, 32700, 5030, 5773


def zone_code(zone: int) -> int:
    """EPSG code of a UTM zone on WGS84; zones of the south are negative. 0: none."""
    return 0 if not zone else NORTH + zone if zone > 0 else SOUTH - zone


def code_zone(code: int) -> int:
    return code - NORTH if NORTH < code <= NORTH + 60 else SOUTH - code if SOUTH < code <= SOUTH + 60 else 0


def decode_geotiff(raw: bytes) -> tuple[np.ndarray, dict]:
    """Uncompressed single-band strips. Returns pixels and easting, northing (lower left), gsd, nodata."""
    if raw[:4] != b"II*\0":
        raise ValueError("only little-endian TIFF files are read")
    at = struct.unpack_from("<I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag, kind, n, value = struct.unpack_from("<HHII", raw, at + 2 + 12 * k)
        if kind in FIELD:
            code, size = FIELD[kind]
            place = value if n * size > 4 else at + 2 + 12 * k + 8
            tags[tag] = struct.unpack_from(f"<{n}{code}", raw, place)
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("only uncompressed single-band files are read")
    kind = PIXELS[tags.get(FORMAT, (1,))[0], tags[BITS][0]]
    if kind not in READABLE:
        raise ValueError(f"pixel type {kind} is not read")
    h, w = tags[HEIGHT][0], tags[WIDTH][0]
    data = b"".join(raw[a : a + n] for a, n in zip(tags[STRIPS], tags[COUNTS], strict=True))
    sx, sy = tags.get(SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIE, (0.0, 0.0, 0.0, 0.0, h * sy, 0.0))
    nodata, keys = tags.get(NODATA), tags.get(KEYS, ())
    code = next((v for k, place, _, v in zip(*(iter(keys[4:]),) * 4, strict=False) if k == PROJECTED and place == 0), 0)
    return np.frombuffer(data, kind, h * w).reshape(h, w), {"easting": tie[3], "northing": tie[4] - h * sy, "gsd": (sx + sy) / 2, "nodata": float(nodata[0].split(b"\0")[0]) if nodata else 0.0, "zone": code_zone(code)}


def encode_geotiff(pixels: np.ndarray, frame: Frame, nodata: float | None = None, egm96: bool = False) -> bytes:
    kind = pixels.dtype.newbyteorder("<").str.replace("|", "")
    form, bits = next(k for k, v in PIXELS.items() if v == kind)
    h, w = pixels.shape
    fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, [8]), (SAMPLES, 3, [1]), (ROWS, 4, [h]), (COUNTS, 4, [pixels.nbytes]), (FORMAT, 3, [form])]
    fields += [(SCALE, 12, [frame.gsd, frame.gsd, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, frame.easting, frame.northing + h * frame.gsd, 0.0])]
    if frame.zone:
        keys = [(MODEL, 1), (PIXEL, 1), (PROJECTED, zone_code(frame.zone)), (VERTICAL, GEOID if egm96 else ELLIPSOID)]
        fields.append((KEYS, 3, [1, 1, 0, len(keys), *(x for k, v in keys for x in (k, 0, 1, v))]))
    if nodata is not None:
        text = f"{nodata:g}".encode() + b"\0"
        fields.append((NODATA, 2, [text]))
    at = 8 + pixels.nbytes
    table, more = b"", b""
    after = at + 2 + 12 * len(fields) + 4
    for tag, type_, values in fields:
        code, _ = FIELD[type_]
        body = values[0] if type_ == 2 else struct.pack(f"<{len(values)}{code}", *values)
        n = len(body) if type_ == 2 else len(values)
        place = body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", after + len(more))
        more += body if len(body) > 4 else b""
        table += struct.pack("<HHI", tag, type_, n) + place
    return b"II*\0" + struct.pack("<I", at) + pixels.astype(kind).tobytes() + struct.pack("<H", len(fields)) + table + b"\0\0\0\0" + more


def read_geotiff(spark: SparkSession, path: str) -> Raster:
    """Raw units from the file's values: offset one below the least, scale to 16 bits, no-data void. The header pass and
    the pixel pass are both tasks; the driver sees the frame only."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def facts(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                z, head = decode_geotiff(raw)
                good = z[z != head["nodata"]].astype("f4")
                yield pd.DataFrame([(head["easting"], head["northing"], head["gsd"], z.shape[1], z.shape[0], float(good.min()) if good.size else 0.0, float(good.max()) if good.size else 0.0, head["zone"])])

    r = files.mapInPandas(facts, "e double, n double, g double, w int, h int, lo double, hi double, z int").first()
    low, high = f32(r.lo) - f32(1), f32(r.hi) + f32(1)
    frame = Frame(r.e, r.n, r.g, r.w, r.h, float((high - low) / f32(65535)), float(low), r.z)

    def cells(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                z, head = decode_geotiff(raw)
                row, col = np.nonzero(z != head["nodata"])
                v = ((z[row, col].astype("f4") - f32(frame.offset)) / f32(frame.scale)).astype("i4")
                yield pd.DataFrame({"row": row, "col": col, "v": v})

    return Raster(files.mapInPandas(cells, CELLS).where("v != 0"), frame)


def geotiff_bytes(raster: Raster, void: float = -10000.0, egm96: bool = False) -> DataFrame:
    """The raster as one binary value of metres; for rasters that fit a task."""
    z, f = to_metres(raster), raster.frame

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.full((f.height, f.width), void, "f4")
        dense[pdf["row"], pdf["col"]] = pdf["z"]
        return pd.DataFrame({"content": [encode_geotiff(dense, f, void, egm96)]})

    return z.withColumn("whole", F.lit(True)).groupBy("whole").applyInPandas(run, "content binary")


# Outlines and reports


def write_outlines(polygons: DataFrame, frame: Frame, path: str) -> bool:
    """GeoJSON features, one per line, with an integer Label and the zone's reference system. Without polygons nothing is
    written: False."""
    table = geo_table(polygons, frame)
    if table.isEmpty():
        return False
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.concat(F.array(ring(F.col("ring"))), F.transform("inner_rings", ring)).alias("coordinates"))
    parts = [F.lit("Feature").alias("type"), F.struct(F.col("label").alias("Label")).alias("properties"), geometry.alias("geometry")]
    if frame.zone:
        name = F.struct(F.lit(f"urn:ogc:def:crs:EPSG::{zone_code(frame.zone)}").alias("name"))
        parts.append(F.struct(F.lit("name").alias("type"), name.alias("properties")).alias("crs"))
    feature = F.to_json(F.struct(*parts))
    table.select(feature.alias("value")).write.mode("overwrite").text(path)
    return True


def read_outlines(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r.value) for r in spark.read.text(path).toLocalIterator()]


def offsets_report(result: dict) -> list[str]:
    return ["X Offset  Y Offset  Z Offset  Z RMS", " ".join(f"{result[k]:08.3f}" for k in ("tx", "ty", "tz", "rms"))]


def write_offsets(spark: SparkSession, result: dict, path: str) -> None:
    spark.createDataFrame([("\n".join(offsets_report(result)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
