"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table up to which a join may broadcast it.
BROADCAST_ROWS = 50_000
#: Bytes that a task sorts about, and those below which a further task doesn't pay.
TASK_BYTES, LEAST_BYTES = 1 << 24, 1 << 20
#: Spark's setting that shuffles are deleted when an execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="undulo-")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session takes a temporary folder; on a cluster there is none, and it raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir(spark.conf.get("spark.app.id", ""))


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/undulo/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffles when it ends; else they stay until the driver collects garbage."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, however often it is read."""
    path = fresh(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows, known beforehand, within the bound; else for a sort-merge join, whose hot keys Spark splits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def tasks_for(spark: SparkSession, size: int) -> int:
    """Tasks for so many bytes: each takes ``TASK_BYTES`` at most about, however many there are; few bytes are dealt to the cores."""
    return max(1, -(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
