"""Connected components of rasters: union-find inside tiles, then components of the (small) graph between tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.dense import neighbour_pairs, unite
from pointweave.operators.algebra import KEY
from pointweave.operators.focal import fan_out
from pointweave.plans.storage import store
from pointweave.schema import BUILDING, TREE, Frame

TILE = 512
#: Cells whose component numbers one task gives out.
NUMBERED = 1 << 20


def _inside_tiles(cells: DataFrame, width: int, diagonal: bool, dz: float | None) -> DataFrame:
    """Adds ``root``: the least cell id (row * width + col) that is connected inside the cell's tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = row.min(), col.min()
        shape = (int(row.max() - r0) + 1, int(col.max() - c0) + 1)
        mask, z = np.zeros(shape, bool), np.zeros(shape, np.int64)
        mask[row - r0, col - c0] = True
        z[row - r0, col - c0] = pdf["v"].to_numpy()
        a, b = neighbour_pairs(mask, diagonal)
        if dz is not None:
            near = np.abs(z.ravel()[a] - z.ravel()[b]) <= dz
            a, b = a[near], b[near]
        root = unite(mask.size, a, b).reshape(shape)[row - r0, col - c0]
        return pdf.assign(root=(root // shape[1] + r0) * width + root % shape[1] + c0)

    tile = lambda c: F.floor(F.col(c) / TILE)
    return cells.select(*KEY, "v").groupBy(tile("row"), tile("col")).applyInPandas(run, "row int, col int, v int, root long")


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, least) for a graph a-b of longs: alternate joins to least neighbours until nothing moves."""
    now = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        facts = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"), F.sum(F.col("a").cast("decimal(38,0)")).alias("t")).first()
        if not facts.n or facts == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("least"))
        before = facts
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        down = now.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        down = down.distinct()
        low = down.unionAll(down.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        up = down.join(low.withColumnRenamed("a", "b"), "b").select("a", F.least("b", "m").alias("b"))
        now = store(up.where("a != b").distinct(), "edges")


def components(cells: DataFrame, frame: Frame, diagonal: bool = True, dz: float | None = None) -> DataFrame:
    """Adds ``first``: the id of the component's first cell in raster order. With dz, only cells of similar v connect."""
    local = store(_inside_tiles(cells, frame.width, diagonal, dz), "tiles")
    rim = local.where((F.col("row") % TILE).isin(0, TILE - 1) | (F.col("col") % TILE).isin(0, TILE - 1))
    near = fan_out(rim.select(*KEY, "v", "root"), frame, 1).select(*KEY, F.col("n.row").alias("nr"), F.col("n.col").alias("nc"), F.col("n.v").alias("nv"), F.col("n.root").alias("a"))
    pairs = near.join(rim, KEY).where("a != root")
    if not diagonal:
        pairs = pairs.where("nr = row or nc = col")
    if dz is not None:
        pairs = pairs.where(F.abs(F.col("nv") - F.col("v")) <= dz)
    merged = least_labels(pairs.select("a", F.col("root").alias("b")))
    return local.join(merged, F.col("root") == F.col("node"), "left").select(*KEY, "v", F.coalesce("least", "root").alias("first"))


def numbered(found: DataFrame) -> DataFrame:
    """Adds ``id``: 1 for the component whose first cell comes first, and so on. Counted by blocks of cell ids."""
    firsts = found.select("first").distinct().withColumn("block", F.floor(F.col("first") / NUMBERED))
    blocks = firsts.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ids = firsts.join(before, "block").select("first", (F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("first"))).cast("int").alias("id"))
    return found.join(ids, "first")


def labelled_with_holes(foreground: DataFrame, frame: Frame) -> DataFrame:
    """8-connected foreground as 1..n; 4-connected background that does not reach the edge as -1..-m; the rest is left out."""
    on = numbered(components(foreground, frame)).select(*KEY, F.col("id").alias("v"))
    ids = foreground.sparkSession.range(frame.width * frame.height)
    grid = ids.select(F.expr(f"cast(id div {frame.width} as int)").alias("row"), F.expr(f"cast(id % {frame.width} as int)").alias("col"), F.lit(0).alias("v"))
    off = components(grid.join(foreground.select(*KEY), KEY, "left_anti"), frame, diagonal=False)
    edge = off.where((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == frame.height - 1) | (F.col("col") == frame.width - 1)).select("first").distinct()
    holes = numbered(off.join(edge, "first", "left_anti")).select(*KEY, (-F.col("id")).alias("v"))
    return on.unionAll(holes)


def object_stats(labels: DataFrame) -> DataFrame:
    """Bounding box and cell count per label."""
    return labels.groupBy("v").agg(F.min("col").alias("xmin"), F.max("col").alias("xmax"), F.min("row").alias("ymin"), F.max("row").alias("ymax"), F.count(F.lit(1)).alias("cnt")).withColumnRenamed("v", "label")


def drop_small(cells: DataFrame, frame: Frame, area: float) -> DataFrame:
    """Cells of 8-connected groups of at least area / gsd^2 cells."""
    found = components(cells, frame)
    large = found.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= int(area / frame.gsd**2)).select("first")
    return found.join(large, "first", "left_semi").select(*KEY, "v")


def fill_inside_buildings(classes: DataFrame, frame: Frame) -> DataFrame:
    """Tree groups all of whose outside neighbours are building become building."""
    trees = components(classes.where(F.col("v") == TREE), frame).select(*KEY, "first")
    other = classes.where(~F.col("v").isin(TREE, BUILDING))
    touched = fan_out(other, frame, 1).select(*KEY).distinct()
    open_ = trees.join(touched, KEY, "left_semi").select("first").distinct()
    inside = trees.join(open_, "first", "left_anti").select(*KEY, F.lit(True).alias("inside"))
    return classes.join(inside, KEY, "left").select(*KEY, F.when(F.col("inside"), BUILDING).otherwise(F.col("v")).alias("v"))
