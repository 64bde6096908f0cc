"""Mixing sources to target weights.

Each source's words, its documents in a seeded order, are packed into blocks of ``BLOCK`` words; a block may begin and end
inside documents, and a source's last one may be short. Each source gets a quota of block draws that meets its target; output shard by output
shard, a multinomial draw in proportion to what is left of the quotas says how many blocks of each source
the shard holds, so the draws are random but end on the quotas. A source's n-th draw goes through a pseudorandom
permutation of its block numbers, a new one each time all blocks have been drawn, and is joined to the block's
pieces of documents by number. No block is drawn more often than twice where no target is above twice a source's words.

Positions come from sums in two steps, over parts of a source and inside each part, so that a source with most of the
rows is spread over tasks. Sources are a table, however many: they are numbered by ranges, the level to which all targets rise is found by sums over the
table, and the draws are made in two steps, for groups of sources and, inside each group, for its sources. The driver holds ``MAX_GROUPS`` counts a shard at most.

A null text has no words; documents without words are in no block and are taken 0 times. Null keys are values like
others. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undulo.llm.common import Tables, mix64, small_side

BLOCK, SEED = 128, 11
#: Share of all words that the mix takes, how often a source may be used up, and the weights of sources in turn.
BUDGET, REPEAT, WEIGHTS = 1.5, 2.0, (5, 2, 1)
#: Block draws in an output shard about, and the most shards.
SHARD_DRAWS, MAX_SHARDS = 32_768, 4096
#: Sources in a group at least, and groups at most.
GROUP_SOURCES, MAX_GROUPS = 256, 1024


def n_words(text: str) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def numbered(per_source: DataFrame, tables: Tables) -> DataFrame:
    """Sources numbered by code point, null last."""
    order = [F.col("source").isNull().alias("none"), "source"]
    parts = int(per_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = per_source.repartitionByRange(parts, *[o if isinstance(o, str) else F.col("source").isNull() for o in order]).withColumn("part", F.spark_partition_id())
    ranged = tables.stored(ranged, "ranged-sources")
    before = F.coalesce(F.sum("n_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n_part")).select("part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranged.withColumn("rank", rank).join(F.broadcast(parts), "part")  # a row for each shuffle partition
    return ranked.withColumn("number", F.col("before") + F.col("rank") - 1).drop("part", "before", "rank")


def with_targets(sources: DataFrame, budget: float = BUDGET, repeat: float = REPEAT, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds ``target``, the words to take from each source: in proportion to its weight, at most ``repeat`` times its size, the rest shared again. All open
    sources take the same multiple of their weight; each round finds those that it would put above their most."""
    most = F.col("source_size") * repeat
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    left, total, closed = 0.0, 1.0, -1
    while True:
        share = weight * F.lit(left) / F.lit(total)
        over = most < share
        row = sources.agg(F.sum("source_size"), F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(weight)), F.count_if(over)).first()
        if not row[2] or row[3] == closed:
            return sources.withColumn("target", F.when(over, most).otherwise(share).cast("double"))
        left, total, closed = float(budget * row[0] - row[1]), float(row[2]), row[3]


def draw_counts(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source for each shard: multinomial by what is left of the quotas, which they use up exactly."""
    left, rng = quotas.astype(np.int64).copy(), np.random.default_rng(seed)
    out = np.zeros((shards, len(left)), np.int64)
    for s in range(shards):
        want = int(left.sum()) // (shards - s)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[s] += got
            left -= got
            want -= int(got.sum())
    return out


def draws_of(quotas: np.ndarray, counts: list[int], seed: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Shard, source, its draws before and in the shard, where the shards have so many draws of the group."""
    left, rng = quotas.copy(), np.random.default_rng(seed)
    for s, want in enumerate(counts):
        got = np.zeros(len(left), np.int64)
        while want:
            more = np.minimum(rng.multinomial(want, left / left.sum()), left)
            got += more
            left -= more
            want -= int(more.sum())
        for k in np.flatnonzero(got).tolist():
            yield s, k, int(quotas[k] - left[k] - got[k]), int(got[k])


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each index below its size under the permutation that the key names: a Feistel network, walked until it is below the size."""
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in np.unique(size)], np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    mask, value, todo = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.arange(len(index))
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = value[todo] >> h, value[todo] & m
        for turn in range(6):
            left, right = right, left ^ (mix64(right ^ mix64(key[todo] + np.uint64(turn))) & m)
        value[todo] = left << h | right
        todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)


@dataclass
class Mix:
    """rows: the input's key with source, size, number (of the source), offset, source_size, target.
    pieces: shard, number, draw, block, and the piece of a document in it: offset (of the document), start, words."""

    rows: DataFrame
    pieces: DataFrame


def mix(df: DataFrame, key: str, source: str = "source", text: str = "text", seed: int = SEED, block: int = BLOCK) -> Mix:
    spark = df.sparkSession
    tables = Tables(spark, "mix")
    sized = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"))
    sized = tables.stored(sized.withColumn("deal", F.xxhash64(F.lit(seed), "key", "source", "size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = tables.stored(with_targets(tables.stored(numbered(per_source, tables), "numbered-sources")), "sources")
    n_sources, rows = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    table = sources.select(F.col("source").alias("of"), "number", "source_size", "target")
    sized = sized.join(small_side(table, n_sources), sized["source"].eqNullSafe(table["of"])).drop("of")

    parts = 1
    while parts < 1 << 16 and parts * 256 < rows:
        parts *= 2
    part = F.pmod("deal", F.lit(parts)).cast("int")
    of_part = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("number", part.alias("part")).agg(F.sum("size").alias("size"))
    sums = sums.select("number", "part", F.coalesce(F.sum("size").over(of_part), F.lit(0)).alias("before"))
    inside = Window.partitionBy("number", "part").orderBy("deal", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("part", part).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, ["number", "part"]).withColumn("offset", F.col("before") + F.col("inside"))
    placed = tables.stored(placed.select("key", "source", "size", "number", "offset", "source_size", "target"), "rows")

    blocks = F.ceil(F.col("source_size") / block)
    quota = F.least(F.ceil(blocks * REPEAT), F.rint(F.col("target") * blocks / F.col("source_size"))).cast("long")
    of_group = max(GROUP_SOURCES, math.ceil(n_sources / MAX_GROUPS))
    drawn = sources.filter("source_size > 0").select("number", blocks.alias("blocks"), quota.alias("quota"), F.expr(f"number div {of_group}").alias("group"))
    quotas = sorted(map(tuple, drawn.groupBy("group").agg(F.sum("quota")).collect()))  # MAX_GROUPS rows at most
    shards = max(1, min(MAX_SHARDS, sum(q for _, q in quotas) // SHARD_DRAWS))
    counts = draw_counts(np.array([q for _, q in quotas], np.int64), shards, seed) if quotas else np.zeros((0, 0), np.int64)
    counts = spark.createDataFrame([(g, c.tolist()) for (g, _), c in zip(quotas, counts.T, strict=False)], "group long, counts array<long>")

    def of_sources(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("number", ignore_index=True)
        every = draws_of(table["quota"].to_numpy(np.int64), table["counts"][0].tolist(), [seed, int(table["group"][0])])
        found = [(s, k, first, n) for s, k, first, n in every]
        shard, k, first, n = np.array(found, np.int64).reshape(-1, 4).T
        return pd.DataFrame({"shard": shard.astype(np.int32), "number": table["number"].to_numpy()[k], "first": first, "n": n, "blocks": table["blocks"].to_numpy()[k]})

    plan = drawn.join(F.broadcast(counts), "group").groupBy("group").applyInPandas(of_sources, "shard int, number long, first long, n long, blocks long")
    plan = tables.stored(plan, "plan")
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = plan.select("shard", "number", "blocks", "first", "n", F.explode(F.expr("sequence(0L, n - 1, 4096L)")).alias("at")).repartition(many, "number", "shard", "at")
    draws = plan.select("shard", "number", "blocks", F.explode(F.expr("sequence(first + at, first + least(at + 4096L, n) - 1)")).alias("draw"))

    @F.pandas_udf("long")
    def block_of(draw: pd.Series, blocks: pd.Series, number: pd.Series) -> pd.Series:
        n, d = blocks.to_numpy(np.int64), draw.to_numpy(np.int64)
        keys = mix64((d // n).astype(np.uint64) * np.uint64(1_000_003) + mix64(number.to_numpy(np.uint64) + np.uint64(seed << 20)))
        return pd.Series(permuted(d % n, n, keys))

    draws = draws.select("shard", "number", "draw", block_of("draw", "blocks", "number").alias("block"))
    pieces = placed.filter("size > 0").select("number", "offset", "size", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")).alias("block"))
    start = F.greatest("offset", F.col("block") * block)
    pieces = pieces.select("number", "block", "offset", start.alias("start"), (F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - start).alias("words"))
    tables.keep("rows", "plan")
    return Mix(placed, draws.join(pieces.hint("merge"), ["number", "block"]))  # Spark takes draws for as small as the plan they unfold from


def with_taken(mixed: Mix) -> DataFrame:
    """The rows of a mix with ``taken``, the words that it takes of each, repeats counted."""
    taken = mixed.pieces.groupBy("number", "offset").agg(F.sum("words").alias("taken"))
    rows = mixed.rows.join(taken, ["number", "offset"], "left")
    return rows.withColumn("taken", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long"))


def with_blocks(mixed: Mix) -> DataFrame:
    """The rows of a mix that it draws from: key, ``lead`` (the words of the row's first block before it), and ``drawn``: for each
    drawn piece, the number of its block counted from the row's first, in order."""
    nth = (F.expr(f"start div {BLOCK}") - F.expr(f"offset div {BLOCK}")).cast("int")
    drawn = mixed.pieces.groupBy("number", "offset").agg(F.sort_array(F.collect_list(nth)).alias("drawn"))
    rows = mixed.rows.filter("size > 0").join(drawn, ["number", "offset"])
    return rows.select("key", (F.col("offset") % BLOCK).cast("int").alias("lead"), "drawn")


def cut(text: Column, lead: Column) -> Column:
    """The text in pieces that end where blocks do, after ``lead`` words of its first block. The space after a word stays with it, so
    the pieces make up the text."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    filled = F.concat(F.repeat(F.lit("x "), lead), text)
    pieces = F.regexp_extract_all(filled, F.lit(f"{space}*+(?:{word}++{space}*+){{1,{BLOCK}}}+"), F.lit(0))
    return F.transform(pieces, lambda piece, k: F.when(k == 0, F.substring(piece, lead * 2 + 1, F.length(piece))).otherwise(piece))


def copies(cuts: Column, drawn: Column) -> Column:
    """The texts that the drawn pieces make: the first of all drawn pieces in their order, the next of those drawn once more; '' if none."""

    def one(n: int) -> Column:
        more = F.filter(drawn, lambda k, j: F.get(drawn, j - n).eqNullSafe(k))
        return F.array_join(F.transform(F.array_distinct(more), lambda k: F.get(cuts, k)), "")

    return F.array(*[one(n) for n in range(math.ceil(REPEAT))])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return with_taken(mixed).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")
