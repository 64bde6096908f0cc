"""Forcing and holding tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def force(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` computed and held by the executors, in memory and beyond it on disk, and its number of rows; ``unpersist`` frees it."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    return held, held.count()


def scanned_twice(df: DataFrame) -> tuple[int, int]:
    """Rows that a forced scan and a second pass over what it holds have found."""
    held, n = force(df)
    again = held.count()
    held.unpersist()
    return n, again
