"""Sharding by a two-pass external shuffle.

The first pass deals whole records uniformly to buckets that fit in memory, by a seeded hash of all their
columns. The second brings each bucket into the order of the hash, so that nothing depends on how it
arrived, shuffles it by the Fisher-Yates method with a generator seeded by the bucket, and numbers it from where the bucket before
ended. Shard s of n takes the places from floor(s N / n) on: row counts differ by at most one, and nearly every bucket
goes to one shard or two, so shards can be written straight from the second pass.

The number of buckets follows from the bytes of the records, at every size. Their counts are summed up in two steps, in spans of ``SPAN`` buckets, and broadcast
only where they are few.

Records with equal texts are dealt on their own, and so are records that repeat in every column more than ``COPIES`` times: those are told by a cryptographic
digest of the record, counted, and made again from one of them, each with a number of its own in its hash, so that no bucket holds many. Fewer copies share a
bucket, among which nothing can tell. Nulls are
values like others; maps are hashed by their JSON. An empty table gives no rows. Columns named shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undulo.llm.common import Tables, hold, release, small_side

SHARDS, SEED = 40, 20_240_229
#: Bytes of records that a bucket holds about, and a task at most about; cells of the hash in which records are counted first, two to the power of; buckets whose counts are summed
#: together; copies of a record that may share a bucket.
BUCKET_BYTES, TASK_BYTES, CELL_BITS, SPAN, COPIES = 4 << 20, 64 << 20, 16, 4096, 1000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniformly random order of 0 to n - 1: each place from the last on swaps with one not after it."""
    order = np.arange(n)
    other = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else order
    for k, j in zip(range(n - 1, 0, -1), other.tolist(), strict=False):
        order[k], order[j] = order[j], order[k]
    return order


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def _dealt(df: DataFrame, tables: Tables, seed: int) -> DataFrame:
    """held, deal (64 pseudorandom bits) and bytes of each record."""
    one = lambda f: F.to_json(F.struct(f"`{f.name}`"), {"ignoreNullFields": "false"}) if _has_map(f.dataType) else F.col(f"`{f.name}`")
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    dealt = hold(df, deal=F.xxhash64(F.lit(seed), *map(one, df.schema)), bytes=sum(texts, F.lit(16 * len(df.columns))))
    cells = dealt.groupBy(F.shiftrightunsigned("deal", 64 - CELL_BITS).alias("cell")).agg(F.count("*").alias("n"))
    cells = tables.stored(cells, "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    full = [r.cell for r in cells.filter(F.col("n") > 2 * (total >> CELL_BITS) + COPIES).collect()]  # 2^CELL_BITS rows at most
    if not full:
        return dealt
    in_full = F.shiftrightunsigned("deal", 64 - CELL_BITS).isin(full)
    often = dealt.filter(in_full).groupBy("deal").agg(F.count("*").alias("n")).filter(F.col("n") > COPIES).select("deal")
    often = tables.stored(often, "often")
    n_often = often.count()
    if not n_often:
        return dealt
    digest = F.sha2(F.to_json("held", {"ignoreNullFields": "false"}), 256)
    copies = dealt.filter(in_full).join(small_side(often, n_often), "deal", "left_semi")
    copies = copies.groupBy(digest.alias("digest")).agg(F.first("held").alias("held"), F.first("bytes").alias("bytes"), F.count("*").alias("n"))
    copies = tables.stored(copies, "copies")
    runs = copies.select("held", "bytes", "digest", "n", F.explode(F.expr("sequence(0L, n - 1, 4096L)")).alias("at"))
    runs = runs.repartition(F.xxhash64("digest", "at"))
    again = runs.select("held", "bytes", "digest", F.explode(F.expr("sequence(at, least(at + 4096L, n) - 1)")).alias("number"))
    again = again.select("held", F.xxhash64(F.lit(seed), "digest", "number").alias("deal"), "bytes")
    return dealt.join(small_side(often, n_often), "deal", "left_anti").select("held", "deal", "bytes").unionByName(again)


def with_places(df: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """The rows of ``df``, each in the column ``held``, in shuffled order with ``place`` from 0; and their number."""
    tables = Tables(df.sparkSession, "shards")
    dealt = _dealt(df, tables, seed)
    cells = dealt.groupBy(F.shiftrightunsigned("deal", 64 - CELL_BITS).alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    cells = tables.stored(cells, "dealt-cells")
    total, size = cells.agg(F.sum("n"), F.sum("bytes")).first()
    bits = max(0, ((size or 0) // bucket_bytes).bit_length())

    def bucket(value, of: int):  # the first bits of the hash
        return (F.shiftrightunsigned(value, of - bits) if bits else F.lit(0)).cast("long")

    if bits <= CELL_BITS:
        counts = cells.groupBy(bucket(F.col("cell"), CELL_BITS).alias("bucket")).agg(F.sum("n").alias("n"))
    else:
        counts = dealt.groupBy(bucket(F.col("deal"), 64).alias("bucket")).agg(F.count("*").alias("n"))
    counts = tables.stored(counts.withColumn("span", F.expr(f"bucket div {SPAN}")), "counts")
    sums = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy("span").agg(F.sum("n").alias("n")).select("span", sums(Window.orderBy("span")).alias("before"))
    start = counts.select("span", "bucket", sums(Window.partitionBy("span").orderBy("bucket")).alias("inside")).join(spans, "span")
    start = tables.stored(start.select("bucket", (F.col("before") + F.col("inside")).alias("place")), "starts")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // TASK_BYTES)
    rows = dealt.withColumn("bucket", bucket(F.col("deal"), 64)).repartition(parts, "bucket").join(small_side(start, start.count()), "bucket")
    rows = rows.select("held", "place", "deal", "bucket")
    tables.keep("starts", "often", "copies")

    def shuffle(table: pa.Table) -> pa.Table:
        number = table["bucket"][0].as_py()
        order = table["deal"].to_numpy().argsort(kind="stable")
        order = order[fisher_yates(len(order), seed * 1_000_003 + number)]
        places = table["place"][0].as_py() + np.arange(len(order), dtype=np.int64)
        return pa.table({"held": table["held"].take(pa.array(order)), "place": pa.array(places)})

    return rows.groupBy("bucket").applyInArrow(shuffle, T.StructType([rows.schema["held"], rows.schema["place"]])), total or 0


def with_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` in shuffled order with ``shard`` and ``slot``, its place in the shard."""
    placed, total = with_places(df, seed, bucket_bytes)
    rows = max(total, 1)
    placed = placed.withColumn("shard", F.expr(f"((place + 1) * {shards}L - 1) div {rows}L").cast("int"))
    return release(placed, shard="shard", slot=F.col("place") - F.expr(f"(shard * {rows}L) div {shards}L"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes the shards as Parquet folders ``shard=<s>``; rows carry their slot."""
    with_shards(df, shards, seed).write.mode("overwrite").partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    return with_shards(docs).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
