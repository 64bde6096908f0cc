"""Shared helpers: the shared folder, written intermediate tables, size-checked joins, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table (16 to 40 bytes a row) up to which a join may broadcast it.
BROADCAST_ROWS = 50_000
#: The same where the other side carries texts, which a shuffle would move: 6 to 16 MB.
TEXT_BROADCAST_ROWS = 400_000


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="undulo-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session takes a temporary
    one, in which driver and executors are one process; on a cluster there is none, and it raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir(spark.conf.get("spark.app.id", ""))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/undulo/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one job, by name, in a folder of their own below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.names = spark, scratch(spark, name), set()

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        name = f"{name}-{len(self.names)}" if name in self.names else name
        self.names.add(name)
        return stored(df, name, f"{self.path}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which a result still reads."""
        for name in self.names - set(names):
            remove(self.spark, f"{self.path}/{name}")
        self.names &= set(names)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, megabytes: int = 4):
    """Bounds an Arrow batch by rows and bytes for what runs inside, so that Python workers hold little text at once."""
    options = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{megabytes}m"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def pieces_of(batch: pa.RecordBatch, rows: int = 500):
    """A batch in pieces of a few rows, for plans that run after their options are gone."""
    for k in range(0, len(batch), rows):
        yield batch.slice(k, rows)


@contextmanager
def without_gc():
    """Large caches without cycles make Python's collector slow; it rests meanwhile."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def give_back() -> None:
    """Returns to the system what this process has freed. A Python worker goes on to other stages, or rests while others work, and would hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over batches that gives memory back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows, counted beforehand, within the bound; else for a sort-merge join, whose
    hot keys Spark splits."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def hold(df: DataFrame, **columns: Column | str) -> DataFrame:
    """``df`` with its columns packed into one, ``held``, beside the given ones, so that no names can clash."""
    every = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct(F.lit(1))
    return df.select(every.alias("held"), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """The held columns with new ones that no filter is pushed below: there, array functions that share their input
    would be computed again for each place that names it. A generator of one row each stands between."""
    return df.select("held", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def release(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The held columns again with new ones, which take the place of those of the same name."""
    new = {name.lower() for name in columns}
    kept = [F.col("held").getField(c).alias(c) for c in df.schema["held"].dataType.names if c.lower() not in new]
    return df.select(*kept, *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


# --- words and shingles ----------------------------------------------------------------------------------

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()  # these are the bytes that split at, too


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word shingles; fewer words: the whole sequence as one; none: empty."""
    if not len(words):
        return _EMPTY
    n = max(1, len(words) - width + 1)
    total = np.full(n, np.uint64(min(width, len(words))))
    for k in range(min(width, len(words))):
        total = (total ^ words[k : k + n]) * _BASE
        total ^= total >> np.uint64(32)
    return np.unique(mix64(total))
