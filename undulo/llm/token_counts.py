"""Token counts through a cache of digests.

A text's key is the SHA-256 of its normalised content (the tokenizer's own normalisation, applied where it
has one) with the SHA-256 of the tokenizer file. Keys are joined to stored counts; of the keys without
one, each distinct text is encoded once and its count appended to the cache, a folder of Parquet files
in the shared folder or at a path given, a subfolder for each tokenizer version, of which a run reads its own alone. Two runs that append the same key at once leave two equal rows, which reading merges.
The registered query takes a fresh cache, so that each of its runs encodes every distinct text.

Texts go through no shuffle as long as the keys that need no encoding in a row (cached ones, and repeated
ones outside their first row) fit a broadcast; their number is checked, and beyond ``TEXT_BROADCAST_ROWS`` texts are shuffled once, by content and
key, so that copies of a text don't meet. A null text counts as empty: no tokens. Very long texts are encoded whole.
Repeated rows keep their number. Only the key is passed on, so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import TEXT_BROADCAST_ROWS, Tables, scratch, small_batches, without_gc

#: Distinct parts of texts whose counts a Python worker keeps.
CACHE_PARTS = 200_000
LIMIT = 512

_CUT, _RUN, _FIRST, _NEXT = re.compile(r"(?<=\S) "), re.compile(r"\s "), "\0", "\1"


def _cut(text: str) -> list[str]:
    """The parts of a text without the space before each; the first, and others that would be mistaken, are marked."""
    first, *parts = text.split(" ") if not _RUN.search(text) else _CUT.split(text)
    if _FIRST in text or _NEXT in text or " " in text[:1] or "  " in text or text[-1:] == " ":
        parts = [_NEXT + p for p in parts]
    return [_FIRST + first, *parts]


_FIELDS = "content binary, version string, n_tokens long"


class Counter:
    """Counts tokens as the tokenizers library gives them, without added special tokens.

    Byte-level tokenizers that split by their standard pattern never join a space to what stands before
    it, so a text is cut in front of each space that follows another character than white space and the
    counts of its parts, which are kept, add up. Special tokens have no space inside. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        pre, added = repr(self.lib.pre_tokenizer), self.lib.get_added_tokens_decoder().values()
        plain = pre.startswith("ByteLevel(") and "use_regex=True" in pre and "add_prefix_space=False" in pre
        self.by_part = plain and self.lib.normalizer is None and not any(re.search(r"\s", a.content) or a.lstrip or a.rstrip or a.single_word for a in added)
        self.parts: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_part:
            return [len(e) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [_cut(t) for t in texts]
        every = set(chain.from_iterable(cut))
        missing = [p for p in every if p not in self.parts]
        if len(self.parts) + len(missing) > CACHE_PARTS:
            self.parts.clear()
            missing = list(every)
        # a part carries no leading space; but for the first one of a text, marked by a NUL, it had one
        whole = [p[1:] if p[0] == _FIRST else f" {p[1:]}" if p[0] == _NEXT else f" {p}" for p in missing]
        self.parts.update(zip(missing, map(len, self.lib.encode_batch_fast(whole, add_special_tokens=False)), strict=True))
        return [sum(map(self.parts.__getitem__, parts)) for parts in cut]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def version(path: str) -> str:
    """The digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _content(path: str, text):
    """The digest of the normalised text; a tokenizer without a normaliser takes texts as they are."""
    from tokenizers import Tokenizer

    whole = F.coalesce(F.col(text), F.lit(""))
    if Tokenizer.from_file(path).normalizer is not None:

        @F.pandas_udf("string")
        def normalised(texts: pd.Series) -> pd.Series:
            change = counter(path).lib.normalizer.normalize_str
            return texts.map(change)

        whole = normalised(whole)
    return F.unhex(F.sha2(whole, 256))


def with_token_counts(df: DataFrame, path: str, key: str, text: str = "text", cache: str | None = None) -> DataFrame:
    """``key``, n_bytes and n_tokens of every row of ``df``; ``key`` helps to find the first row of a repeated text.

    cache: the folder of stored counts, made if it isn't there. Without it the counts go to a fresh one.
    """
    with small_batches(df.sparkSession, rows=2000, megabytes=8):
        return _with_token_counts(df, path, key, text, cache)


def _with_token_counts(df: DataFrame, path: str, key: str, text: str, cache: str | None) -> DataFrame:
    spark = df.sparkSession
    tables = Tables(spark, "token-counts")
    cache = cache or scratch(spark, "token-cache")
    tag = version(path)
    keyed = df.select(F.col(key).alias("row_key"), F.col(text).alias("whole")).withColumn("content", _content(path, "whole"))
    rows = tables.stored(keyed.select("row_key", "content", F.coalesce(F.octet_length("whole"), F.lit(0)).cast("long").alias("n_bytes")), "rows")
    spark.createDataFrame([], _FIELDS).write.mode("append").partitionBy("version").parquet(cache)  # the folder, if it isn't there

    def counts() -> DataFrame:
        kept = spark.read.schema(_FIELDS).parquet(cache).filter(F.col("version") == tag)
        return kept.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    groups = rows.groupBy("content").agg(F.min("row_key").alias("first_key"), F.count("*").alias("n"))
    state = tables.stored(groups.join(counts().withColumnRenamed("n_tokens", "known"), "content", "left"), "state")
    skip = state.filter("n > 1 or known is not null")
    n_skip = skip.count()
    if n_skip <= TEXT_BROADCAST_ROWS:
        todo = keyed.join(F.broadcast(skip.select("content", "first_key", "known")), "content", "left")
        todo = todo.filter("known is null and (first_key is null or first_key <=> row_key)").select("content", "whole")
    else:
        wanted = state.filter("known is null").select(F.col("content").alias("wanted"), "first_key").hint("merge")
        todo = keyed.join(wanted, (F.col("content") == F.col("wanted")) & F.col("row_key").eqNullSafe(F.col("first_key")), "left_semi").select("content", "whole")
    if not rows.groupBy("content", "row_key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        todo = todo.dropDuplicates(["content"])  # equal texts whose keys are equal too

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for b in batches:
            fresh = [k not in done and not done.add(k) for k in b["content"]]
            b = b[fresh]
            with without_gc():
                counted = counter(path).counts([t or "" for t in b["whole"]])
            yield pd.DataFrame({"content": b["content"], "version": tag, "n_tokens": counted})

    todo.mapInPandas(encode, _FIELDS).write.mode("append").partitionBy("version").parquet(cache)
    known = tables.stored(counts(), "known")  # a table of its own, so that Spark can split a text with very many rows
    tables.keep("rows", "known")
    return rows.join(known, "content").select(F.col("row_key").alias(key), "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), "doc_id")
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
