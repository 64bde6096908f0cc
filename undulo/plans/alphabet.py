"""Histogram, effective alphabet, C array, and the shape of the tree over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undulo.functions.bits import bitrev
from undulo.functions.running import running_sum, with_positions
from undulo.sources.scratch import small_side, stored
from undulo.sources.text import COUNTED, unpack

#: Symbols of an alphabet that the driver holds; one with more is a table.
LARGEST = COUNTED


def histogram(text: DataFrame) -> DataFrame:
    """(raw, occ) of the symbols that occur."""
    return text.groupBy("raw").agg(F.count("*").alias("occ"))


def part_counts(chunks: DataFrame) -> DataFrame:
    """(part, raw, n) from the last chunk of each part."""
    last = chunks.groupBy("part").agg(F.max_by(F.struct("seen", "upto"), "inside").alias("all"))
    return last.select("part", F.explode(F.arrays_zip("all.seen", "all.upto")).alias("x")).select("part", F.col("x.seen").alias("raw"), F.col("x.upto").alias("n"))


def carries_counts(chunks: DataFrame) -> bool:
    return chunks.filter("seen is null").isEmpty()


def packed_histogram(chunks: DataFrame) -> DataFrame:
    """(raw, occ) of chunks, from what they carry where they do."""
    if carries_counts(chunks):
        return part_counts(chunks).groupBy("raw").agg(F.sum("n").alias("occ"))
    return histogram(unpack(chunks))


def height_of(sigma: int) -> int:
    """Levels that tell so many codes apart; none for one."""
    return max(0, sigma - 1).bit_length()


def max_nodes(height: int) -> int:
    """Inner nodes of a tree of so many levels."""
    return (1 << height) - 1


@dataclass(frozen=True)
class Alphabet:
    """table: (raw, code, occ), symbols numbered by their order. counts and symbols: the same on the driver, or None for more than ``LARGEST``.
    coded: the chunks that it is for hold codes."""

    table: DataFrame
    n: int
    sigma: int
    counts: np.ndarray | None = None
    symbols: list | None = None
    coded: bool = False

    @property
    def height(self) -> int:
        return height_of(self.sigma)

    def sizes(self, level: int) -> np.ndarray:
        """Sizes of all nodes of a level, empty ones included."""
        whole = np.zeros(1 << self.height, np.int64)
        whole[: self.sigma] = self.counts
        return whole.reshape(1 << level, -1).sum(1)

    def starts(self, level: int, matrix: bool) -> np.ndarray:
        """Where each node of a level starts; a matrix orders nodes by their prefix with its bits reversed."""
        sizes = self.sizes(level)
        order = reversed_prefixes(level) if matrix else np.arange(len(sizes))
        starts = np.empty_like(sizes)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return starts


def reversed_prefixes(level: int) -> np.ndarray:
    """All numbers of ``level`` bits with their bits reversed."""
    out = np.zeros(1, np.int64)
    for _ in range(level):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def effective_alphabet(hist: DataFrame) -> Alphabet:
    """Numbers the symbols of a histogram: a small one on the driver, else by ranges."""
    rows = hist.select("raw", "occ").limit(LARGEST + 1).collect()
    if len(rows) <= LARGEST:
        rows.sort(key=lambda r: (r.raw is not None, r.raw))
        kind = hist.schema["raw"].dataType.simpleString()
        table = hist.sparkSession.createDataFrame([(r.raw, k, r.occ) for k, r in enumerate(rows)], f"raw {kind}, code long, occ long")
        return Alphabet(table, sum(r.occ for r in rows), len(rows), np.array([r.occ for r in rows], np.int64), [r.raw for r in rows])
    table = stored(with_positions(hist, ["raw"], "code").select("raw", "code", "occ"), "alphabet")
    sigma, n = table.agg(F.count("*"), F.sum("occ")).first()
    return Alphabet(table, n, sigma)


def effective_text(text: DataFrame, alphabet: Alphabet, *others: str) -> DataFrame:
    """(pos, code), or other columns beside the code. The alphabet is broadcast where it is small."""
    names = small_side(alphabet.table.select(F.col("raw").alias("_raw"), "code"), alphabet.sigma)
    return text.join(names, text["raw"].eqNullSafe(names["_raw"])).select(*(others or ["pos"]), "code")


def inverse_text(codes: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(pos, raw)."""
    return codes.join(small_side(alphabet.table.select("raw", "code"), alphabet.sigma), "code").select("pos", "raw")


def c_array(alphabet: Alphabet) -> DataFrame:
    """(code, c): for each code the number of smaller symbols, and for the number after the last one that of all."""
    spark = alphabet.table.sparkSession
    rows = alphabet.table.select("code", "occ").unionByName(spark.range(1).select(F.lit(alphabet.sigma).cast("long").alias("code"), F.lit(0).cast("long").alias("occ")))
    if alphabet.counts is None:
        return running_sum(rows, [], "code", "occ", "c").select("code", "c")
    before = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("code", F.coalesce(F.sum("occ").over(before), F.lit(0)).cast("long").alias("c"))


def node_sizes(alphabet: Alphabet) -> DataFrame:
    """(level, node_id, size) of all inner nodes, empty ones too; ids run level by level from 1."""
    height, spark = alphabet.height, alphabet.table.sparkSession
    levels = alphabet.table.select("code", "occ", F.explode(F.sequence(F.lit(0), F.lit(max(height - 1, 0)))).alias("level")).filter(F.col("level") < height)
    node = F.call_function("shiftright", F.col("code"), (F.lit(height) - F.col("level")).cast("int")) + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    sizes = levels.groupBy(node.alias("node_id")).agg(F.sum("occ").alias("size"))
    every = spark.range(1, max_nodes(height) + 1).select(F.col("id").alias("node_id"), (F.length(F.bin("id")) - 1).alias("level"))
    return every.join(sizes, "node_id", "left").select("level", "node_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def node_starts(sizes: DataFrame, matrix: bool = False) -> DataFrame:
    """(level, node_id, size, start) from node sizes."""
    prefix = F.col("node_id") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    order = bitrev(prefix, F.col("level")) if matrix else prefix
    before = Window.partitionBy("level").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_order", order).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    return rows.select("level", "node_id", "size", "start")
