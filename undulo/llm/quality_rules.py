"""Quality rules: hashed n-gram log-likelihood ratios beside plain counts, in DataFrame functions only.

All words and pairs of neighbouring words of the corpus fall into ``BUCKETS`` buckets by hash. Two
multinomials over them are counted: one over all documents, one over a trusted target, and each bucket gets the log of the
ratio of its smoothed shares. A document's verdict is the mean over its own n-grams, so length doesn't count, held against
a fixed threshold. The table has a fixed number of rows and goes to the executors as one value.

Counts over words ``[^\\x20\\x09-\\x0D]+`` that a rule uses: code points in words, symbols, lines that repeat an earlier one, and words
in eight-word windows that the text has twice or more (windows are told apart by 64-bit hashes).

Null and empty texts have no words and fail the base rules. Without trusted documents all ratios are 0 and the base rules decide alone.
Texts are counted whole. Rows, their order, repeats and other columns stay; columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import TEXT_BROADCAST_ROWS, hold, release, settle, small_side, stored

BUCKETS, SMOOTH, WINDOW = 16_384, 1.0, 8
#: A document whose mean log ratio is below is rejected.
THRESHOLD = -0.1
SPACE, WORD, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+", r"[^#*$%&|<>]+"


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _hashes(text: str) -> Column:
    """A hash of each word."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _buckets(hashes: Column) -> Column:
    """The buckets of all words, then of all neighbouring pairs."""
    pair = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))
    both = F.concat(hashes, F.slice(pair, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))))
    return F.transform(both, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def ratios(docs: DataFrame, trusted: DataFrame, key: str, text: str = "text") -> DataFrame:
    """bucket and its log ratio, for every bucket. trusted: a column ``key`` that names the target's documents."""
    spark = docs.sparkSession
    trusted = trusted.select(F.col(key).alias("trusted_key")).filter("trusted_key is not null").distinct()
    rows = docs.select(F.col(key).alias("trusted_key"), F.col(text).alias("text"))
    rows = rows.join(small_side(trusted.withColumn("hit", F.lit(1)), trusted.count(), TEXT_BROADCAST_ROWS), "trusted_key", "left")
    grams = rows.select(F.coalesce("hit", F.lit(0)).alias("hit"), _hashes("text").alias("hashes"))
    grams = grams.select("hit", F.explode(_buckets(F.col("hashes"))).alias("bucket"))
    counts = stored(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("hit").alias("target")), "ratios")
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    share = [F.log((F.coalesce(c, F.lit(0)) + SMOOTH) / (float(n) + SMOOTH * BUCKETS)) for c, n in zip(("target", "raw"), (sums[1], sums[0]), strict=True)]
    ratio = share[0] - share[1] if sums[1] else F.lit(0.0)
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", ratio.alias("ratio"))


def _counted(df: DataFrame, text: str) -> DataFrame:
    """``df`` held, with its word hashes and the struct of counts."""
    hashes, whole = F.col("word_hashes"), F.col("whole")
    df = hold(df, whole=_text(text)).withColumn("word_hashes", _hashes("whole"))
    windows = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("rule_windows", F.slice(windows, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))))
    windows = F.col("rule_windows")
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn("rule_ranked", F.when(some, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    ranked = F.col("rule_ranked")
    twice = F.transform(ranked, lambda x, k: F.when((F.get(ranked, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(ranked, k + 1)["h"].eqNullSafe(x["h"])), x["i"]))
    df = df.withColumn("rule_twice", F.when(ranked.isNotNull(), F.sort_array(F.array_compact(twice))))
    twice = F.col("rule_twice")
    steps = F.transform(twice, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(twice, k + 1) - p, F.lit(WINDOW))))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    df = df.withColumn("rule_lines", lines)
    fields = [
        F.size(hashes).cast("long").alias("n_words"),
        F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("rule_lines") - F.size(F.array_distinct("rule_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    ]
    return df.select("held", "word_hashes", F.struct(*fields).alias("rules"))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return release(_counted(df, text), rules="rules")


def with_verdict(df: DataFrame, ratio: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``rules`` (the counts), ``log_ratio`` (the mean), base_failed and kept."""
    table = ratio.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"])).scalar()
    df = _counted(df, text).withColumn("rule_buckets", _buckets(F.col("word_hashes"))).withColumn("rule_table", table)
    total = F.aggregate("rule_buckets", F.lit(0.0), lambda s, b: s + F.get("rule_table", b))
    mean = F.when(F.size("rule_buckets") > 0, total / F.size("rule_buckets")).otherwise(F.lit(0.0))
    df = settle(df, rules=F.col("rules"), log_ratio=mean)
    n = F.col("rules.n_words")
    failed = (n < 20) | (100 * F.col("rules.n_repeat_words") > 30 * n)
    return release(df, rules="rules", log_ratio="log_ratio", base_failed=failed, kept=~failed & (F.col("log_ratio") >= threshold))


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the labels call good, without those that they also call bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return labels.filter("quality = 1").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = with_verdict(docs, ratios(docs, trusted_documents(spark, sf_dir), "doc_id"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[f"rules.{n}" for n in names], "base_failed", "kept", "log_ratio")
