"""Tables, raster frames and parameters.

A raster is a table of cells (row, col, v) in raw units; a void cell has no row in it. Row 0 is north. What is known once
per raster (origin, cell size, extent, scale) is a ``Frame`` on the driver and enters plans as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("point_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
    T.StructField("intensity", T.FloatType()), T.StructField("classification", T.IntegerType()),
])
CELLS = "row int, col int, v int"
RING = "array<struct<x:double,y:double>>"
POLYGONS = f"label int, ring {RING}, inner_rings array<{RING}>"

#: Class codes of the class raster (point-class number times 40), and label sentinels.
UNCLASSIFIED, GROUND_CLASS, TREE, BUILDING = 40, 80, 200, 240
OBJECT, GROUND, IN_ONE, ACCEPTED, TEMP = 1, 2**32 - 1, 2**32 - 2, 2**32 - 3, 2**32 - 4

f32 = np.float32


@dataclass(frozen=True)
class CloudMeta:
    """Bounds and local origin of a point cloud."""

    n: int
    xmin: float
    xmax: float
    ymin: float
    ymax: float
    zmin: float
    zmax: float
    zone: int = 0

    @property
    def origin(self) -> tuple[int, int, int]:
        return math.floor(self.xmin), math.floor(self.ymin), math.floor(self.zmin)


@dataclass(frozen=True)
class Frame:
    """Geo-reference of a raster: lower-left corner, cell size in metres, extent in cells, metres = raw * scale + offset."""

    easting: float
    northing: float
    gsd: float
    width: int
    height: int
    scale: float = 1.0
    offset: float = 0.0
    zone: int = 0

    def geotransform(self) -> tuple[float, ...]:
        return (self.easting, self.gsd, 0.0, self.northing + self.height * self.gsd, 0.0, -self.gsd)

    def units(self, metres: float) -> int:
        """Metres as raw units, cut toward zero."""
        return int(metres / float(f32(self.scale)))

    def moved(self, tx: float, ty: float, tz: float) -> Frame:
        return replace(self, easting=self.easting + tx, northing=self.northing + ty, offset=float(f32(self.offset + tz)))


@dataclass(frozen=True)
class Raster:
    cells: DataFrame
    frame: Frame

    def with_cells(self, cells: DataFrame) -> Raster:
        return Raster(cells, self.frame)

    def grid(self) -> DataFrame:
        """Every (row, col) of the frame."""
        ids = self.cells.sparkSession.range(self.frame.width * self.frame.height)
        w = self.frame.width
        return ids.select(F.expr(f"cast(id div {w} as int)").alias("row"), F.expr(f"cast(id % {w} as int)").alias("col"))


@dataclass(frozen=True)
class SceneParams:
    """Defaults of the scene classifier (metres, square metres)."""

    dh: float = 1.0
    dz: float = 1.0
    agl: float = 2.0
    area: float = 50.0
    max_tree_height: float = 40.0
    ground_label: int = -1
    bounds: tuple[float, float, float, float] | None = None
    egm96: bool = False

    def __post_init__(self):
        if not (self.dh and self.dz and self.agl):
            raise ValueError("dh, dz and agl have to be given and non-zero")


@dataclass(frozen=True)
class AlignParams:
    """Defaults of the aligner (metres)."""

    gsd: float = 1.0
    maxt: float = 10.0
    maxdz: float = 0.0
    samples: int = 10_000
    draws: int = 100_000
    sampler: str = "hash"

    @property
    def edge(self) -> float:
        return self.maxdz or 2 * self.gsd


def s16(v):
    """Signed reading of a 16-bit value (values over 32767 look negative)."""
    return F.when(v > 32767, v - 65536).otherwise(v)
