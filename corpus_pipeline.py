"""A corpus pipeline over ``documents``: quality classifier, quality rules, near-duplicates, source mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return rows with the columns of
``docs``. Null and empty texts are rejected by the rules at the latest; extra columns pass through, whatever
their names, up to the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm import minhash_dedup, mixing, quality_classifier, quality_rules, sentencepiece_codec
from undulo.llm.common import TEXT_BROADCAST_ROWS, hold, release, small_batches, small_side, stored


def _with_row_ids(docs: DataFrame) -> DataFrame:
    """``docs`` held, with row_id: the doc_id where it tells rows apart; else a number that a written table fixes."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if ids.isEmpty():
        return hold(docs, row_id="doc_id", text="text", source="source")
    return stored(hold(docs, row_id=F.monotonically_increasing_id(), text="text", source="source"), "row-ids")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of at least the classifier's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality_classifier.held_out("doc_id"))
    model = quality_classifier.fit(docs, labels, "doc_id", "quality")
    scored = quality_classifier.with_score(hold(docs, text="text"), model)
    with small_batches(spark):
        return stored(scored.filter(F.col("score") >= quality_classifier.THRESHOLD).select("held.*"), "scored")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and whose mean log ratio reaches the threshold, both taken over this stage's input."""
    ratio = quality_rules.ratios(docs, quality_rules.trusted_documents(spark, sf_dir), "doc_id")
    return quality_rules.with_verdict(hold(docs, text="text"), ratio).filter("kept").select("held.*")


def minhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest doc_id, or the first row where ids don't tell rows apart."""
    rows = _with_row_ids(docs)
    found = minhash_dedup.near_duplicates(rows, "row_id")
    gone = stored(found.filter("not kept").select("row_id"), "duplicates")
    return rows.join(small_side(gone, gone.count(), TEXT_BROADCAST_ROWS), "row_id", "left_anti").select("held.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix draws: a row has those of one document as ``text``, in their order, beside its other
    columns; pieces drawn once more make another row. A source has exactly the words that the mix takes of it."""
    rows = _with_row_ids(docs)
    drawn = mixing.with_blocks(mixing.mix(rows, "row_id")).withColumnRenamed("key", "row_id")
    drawn = stored(drawn, "drawn")
    n = drawn.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("drawn")), F.lit(0)).alias("pieces")).first()
    rows = rows.join(small_side(drawn, n.rows + n.pieces // 8, TEXT_BROADCAST_ROWS), "row_id")
    rows = rows.select(F.col("held").dropFields("text").alias("held"), "drawn", "text", "lead")
    rows = rows.select("held", F.inline(F.array(F.struct("drawn", mixing.cut(F.col("text"), F.col("lead")).alias("cuts")))))
    rows = rows.select("held", F.explode(mixing.copies(F.col("cuts"), F.col("drawn"))).alias("piece")).filter("piece != ''")
    return release(rows, text="piece").select(*[F.col(f"`{c}`") for c in docs.columns])


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every row: doc_id and the digests of op4_sentencepiece."""
    import public_tokenizers

    pieces = sentencepiece_codec.with_pieces(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), digests_only=True)
    with small_batches(spark):
        return stored(pieces.select("doc_id", "pieces.*"), "pieces")


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("MinHash near-dedup", minhash_dedup_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", sentencepiece_stage),
]

#: No stage but the last is expressible in DuckDB's SQL: they fit models, hash with Spark's functions and draw pseudorandom numbers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.lower().replace(" ", "-"))
    return docs
