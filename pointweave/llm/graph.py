"""Connected components by large-star / small-star rounds; every round is written to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import materialize, small

#: Bytes of a row of two nodes, as estimated for a broadcast.
PAIR_BYTES = 96


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one orderable type. Returns (node, root) for every node of an edge; the root is the least node.

    Least neighbours are counted before they are joined back: few are broadcast, more are shuffled.
    """
    current = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, n = None, current.count()
    while n:
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(small(least, PAIR_BYTES, 2 * n), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small(least, PAIR_BYTES, 2 * n), "a")
        moved = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        current = materialize(moved.where("a != b").distinct(), "edges")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
