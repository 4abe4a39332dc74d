"""Point scenes derived from the shared test tables: ground plane with buildings, trees and a lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scene_width(items: DataFrame) -> int:
    n = items.count()
    return 64 if n < 20_000 else 200 if n < 200_000 else 640


def scene_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, intensity, classification."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = scene_width(items)
    at = items.withColumns({
        "x": F.expr(f"cast((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % {100 * w} as double) / 100.0D"),
        "y": F.expr(f"cast((l_partkey * 6151 + l_suppkey * 3571 + l_orderkey * 17) % {100 * w} as double) / 100.0D"),
    })
    at = at.withColumns({
        "house": F.expr("floor(x / 20.0D) % 2 = 1 and floor(y / 16.0D) % 2 = 1"),
        "tree": F.expr("floor(x / 20.0D) % 2 = 0 and l_linenumber % 3 = 0 and floor(x / 7.0D) % 3 = 1"),
    })
    at = at.where(F.expr("(x - 40.0D) * (x - 40.0D) + (y - 22.0D) * (y - 22.0D) >= 9.0D"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return at.select(
        (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("point_id"),
        "x", "y", F.expr("100.0D + 0.05D * x + 0.03D * y + if(house, 12.0D, 0.0D) + if(tree, 6.0D, 0.0D)").alias("z"),
        F.col("l_quantity").cast("float").alias("intensity"), F.expr("if(house or tree, 1, 2)").alias("classification"),
    )
