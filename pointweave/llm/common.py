"""Helpers shared by the corpus operators: shared scratch space, checked broadcasts, array binding."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that an operator may broadcast. Anything above is joined by a shuffle.
BROADCAST_BYTES = 32 << 20

#: A word is a run of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session of one machine that names none (tests) gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared scratch folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/pointweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Mark a (materialized) frame for broadcast if its measured size is under the bound; else leave it to a shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside a higher-order expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_batches(spark: SparkSession) -> None:
    """Rows of texts go to Python workers in batches of at most a thousand, which bounds the memory of either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) not in range(1, 1001):
        spark.conf.set(name, "1000")


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Hand memory that arrays have left back to the system; workers live on after their tasks."""
    libc = _libc()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
