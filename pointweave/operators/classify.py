"""Class raster and building mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.algebra import KEY
from pointweave.schema import BUILDING, GROUND_CLASS, OBJECT, TREE, UNCLASSIFIED, Raster, SceneParams


def base_classes(dsm: Raster, dsm2: Raster, dtm: Raster, labels: DataFrame, params: SceneParams) -> DataFrame:
    """Class of every cell of the frame. labels: cells with v = 1 for object candidates. Later rules win over earlier ones:
    tree, building, ground."""
    f = dsm.frame
    layers = {"s": dsm.cells, "s2": dsm2.cells, "t": dtm.cells, "label": labels}
    # one shuffle: each raster's cells carry their own column
    both = dsm.grid().select(*KEY, *[F.lit(0).alias(n) for n in layers])
    for name, cells in layers.items():
        both = both.unionAll(cells.select(*KEY, *[(F.col("v").cast("int") if n == name else F.lit(0)).alias(n) for n in layers]))
    both = both.groupBy(*KEY).agg(*[F.max(n).alias(n) for n in layers])
    apart = F.abs(F.col("s2") - F.col("t"))
    limit = int(params.max_tree_height / dtm.frame.scale)
    v = (
        F.when((F.col("s") == 0) | (apart < f.units(params.dz)), GROUND_CLASS)
        .when((F.col("label") == OBJECT) | (F.col("s") > F.col("t") + limit), BUILDING)
        .when((F.col("s2") == 0) | (apart > f.units(params.agl)), TREE)
        .otherwise(UNCLASSIFIED)
    )
    return both.select(*KEY, v.alias("v"))


def building_mask(classes: DataFrame) -> DataFrame:
    return classes.where(F.col("v") == BUILDING)
