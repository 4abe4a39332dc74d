"""Cutting lineage: tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back. A folder of our own is set only on one machine and where none is named."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/pointweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
