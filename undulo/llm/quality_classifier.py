"""A quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Features are the distinct byte n-grams of one to four bytes of a whole text, hashed to 2^18 places, and two
indicators of how far its n-grams and words repeat. Each is scaled by the log of the ratio of its smoothed shares in the two classes, the vector is divided by its
length, and dual coordinate descent fits the weights; logistic scaling of margins on a part of the sample that the
weights did not see turns margins into scores between 0 and 1.

It is fitted in one task on at most ``SAMPLE`` labelled rows, those whose keys have the smallest hashes, of rows that share a key the one with the
smallest text. Their n-grams are found where the rows are; the fit gets places, by their gaps or for long texts as a bitmap, so it holds 33 KB a row at most,
however long texts are. Every row is scored, on its executor, from the weights, whose size is fixed.

Null and empty texts have no features and get the score of the model's constant term. Labels other than 0
and 1, null labels, and keys with both labels are not used. Without any label every score is 0.5;
with one class it is that class's smoothed share. Rows, their order, repeats and other columns stay; a column
with the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import giving_back, small_batches, stored, words_of

#: Labelled rows that a fit uses at most.
SAMPLE = 6000
#: A score from here on counts as good.
THRESHOLD = 0.7

BITS, ORDERS, CHUNK = 18, 4, 1 << 20
PLACES = 1 << BITS
SHORT = 100.0
#: The n-gram places and 64 more for the shares of new n-grams and of doubled words.
WIDTH = PLACES + 64
_FIT = "weights binary, squares binary, bias double, slope double, shift double"


class Grams:
    """Finds the places of a text's n-grams; reuses one bitmap."""

    def __init__(self):
        self.seen = np.zeros(PLACES, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        for start in range(0, len(raw), CHUNK):
            data = raw[start : start + CHUNK + ORDERS - 1].astype(np.uint32)
            value = np.zeros(len(data), np.uint32)
            for n in range(min(ORDERS, len(data))):
                value = value[: len(data) - n] * np.uint32(257) + data[n:] + np.uint32(1)
                code = (value ^ (value >> np.uint32(15)) ^ np.uint32(0x51ED270B * n & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                self.seen[code >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        if len(raw):  # two more indicators: how many n-grams are new, and how many words repeat the one before
            share = int(31 * min(1.0, len(found) / (ORDERS * len(raw))))
            words = words_of(text)
            again = 31 * sum(a == b for a, b in zip(words, words[1:], strict=False)) // (len(words) - 1) if len(words) > 1 else 0
            found = np.append(found, [PLACES + share, PLACES + 32 + again])
        return found.astype(np.int32)


def packed(places: np.ndarray) -> bytes:
    """Places by their gaps, or as a bitmap where that is shorter, behind a byte that says which."""
    gaps = np.diff(places, prepend=0)
    if len(places) * 2 < WIDTH // 8 and (not len(gaps) or gaps.max() < 1 << 16):
        return b"g" + gaps.astype("<u2").tobytes()
    seen = np.zeros(WIDTH, bool)
    seen[places] = True
    return b"b" + np.packbits(seen).tobytes()


def unpacked(row: bytes) -> np.ndarray:
    if row[:1] == b"g":
        return np.cumsum(np.frombuffer(row, "<u2", offset=1), dtype=np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8, offset=1)))


def _length(square: float) -> float:
    """What a vector is divided by: nearly its length, but short texts, which say little, stay near zero."""
    return float(square + SHORT) ** 0.5


def log_count_ratio(rows: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Log of the ratio of the classes' shares of each place, each count raised by one."""
    counts = np.ones((2, WIDTH))
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), unpacked(row)] += 1
    shares = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    return (shares[1] - shares[0]).astype(np.float32)


def dual_descent(rows: list[bytes], labels: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and constant term that minimise half their square plus ``cost`` times the hinge losses."""
    weights, bias, sign = np.zeros(WIDTH, np.float32), 0.0, np.where(labels > 0, 1.0, -1.0)
    square = np.array([float(ratio[p] @ ratio[p]) for p in map(unpacked, rows)])
    scale = np.array([1 / _length(x) for x in square], np.float32)
    square = square * scale**2 + 1
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            p = unpacked(rows[i])
            v = ratio[p] * scale[i]
            slope = sign[i] * (float(weights[p] @ v) + bias) - 1
            moved = min(max(alpha[i] - slope / square[i], 0.0), cost) - alpha[i]
            if moved:
                alpha[i] += moved
                weights[p] += np.float32(moved * sign[i]) * v
                bias += moved * sign[i]
                most = max(most, abs(moved))
        if most < 1e-3 * cost:
            break
    return weights, bias


def logistic_scaling(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic function that fits labels to margins, with smoothed targets, by Newton's method."""
    good = int((labels > 0).sum())
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    slope, shift = 1.0, float(np.log((good + 1) / (len(labels) - good + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        q, d = p * (1 - p) + 1e-9, p - target
        a, b, c = float(q @ margins**2) + 1e-6, float(q @ margins), float(q.sum()) + 1e-6
        g, h = float(d @ margins), float(d.sum())
        step = ((c * g - b * h) / (a * c - b * b + 1e-12), (a * h - b * g) / (a * c - b * b + 1e-12))
        scale = min(1.0, 5 / max(abs(step[0]), abs(step[1]), 1e-9))
        slope, shift = slope - scale * step[0], shift - scale * step[1]
        if max(map(abs, step)) < 1e-7:
            break
    return max(slope, 1e-3), shift


def _margin(places: np.ndarray, scaled: np.ndarray, squares: np.ndarray, bias: float) -> float:
    return float(scaled[places].sum(dtype=np.float64)) / _length(squares[places].sum(dtype=np.float64)) + bias


def fit_arrays(rows: list[bytes], labels: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7) -> tuple:
    """The fields of a model, fitted on the packed places of rows."""
    n, good = len(labels), int((labels > 0).sum())
    flat = np.zeros(WIDTH, np.float32).tobytes()
    if not 0 < good < n:
        share = (good + 1) / (n + 2) if n else 0.5
        return flat, flat, 0.0, 1.0, float(np.log(share / (1 - share)))
    kept = np.arange(n) % 5 > 0  # the rows come in the order of a hash
    if not 0 < (labels[kept] > 0).sum() < kept.sum() or len(set(labels[~kept])) < 2:
        kept = np.ones(n, bool)
    fit, rest = np.flatnonzero(kept), np.flatnonzero(~kept) if not kept.all() else np.arange(n)
    ratio = log_count_ratio([rows[i] for i in fit], labels[fit])
    weights, bias = dual_descent([rows[i] for i in fit], labels[fit], ratio, cost, rounds, seed)
    scaled, squares = weights * ratio, ratio**2
    margins = np.array([_margin(unpacked(rows[i]), scaled, squares, bias) for i in rest])
    slope, shift = logistic_scaling(margins, labels[rest])
    return scaled.tobytes(), squares.tobytes(), bias, slope, shift


def fit(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str = "text", sample: int = SAMPLE) -> tuple:
    """A model fitted on at most ``sample`` rows of ``labels`` (key, label), with the texts that ``docs`` has for them."""
    clean = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    clean = clean.agg(F.min(label).alias("label"), F.max(label).alias("most")).filter("label = most")
    chosen = clean.select("key", "label", F.xxhash64(F.col("key").cast("string")).alias("place")).orderBy("place", "key").limit(sample)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.groupBy("place", "key", "label").agg(F.min("text").alias("text")).select("place", F.col("label").cast("int").alias("label"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            found = pa.array([packed(grams(t)) for t in b["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b["place"], b["label"], found], ["place", "label", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for b in batches for row in zip(*(b[c].to_pylist() for c in ("place", "row", "label")), strict=True)]
        found.sort()  # two keys may share a hash
        model = fit_arrays([row for _, row, _ in found], np.array([label for _, _, label in found], np.int64))
        yield pa.RecordBatch.from_pylist([dict(zip(("weights", "squares", "bias", "slope", "shift"), model, strict=True))])

    with small_batches(docs.sparkSession):
        rows = rows.mapInArrow(giving_back(features), "place long, label int, row binary")
        found = rows.repartition(1).mapInArrow(giving_back(run), _FIT).first()
    return tuple(found) if found else fit_arrays([], np.zeros(0))  # without rows there may be no partition to run in


def with_score(df: DataFrame, model: tuple, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every whole text, where the result is evaluated; inside ``small_batches`` workers hold few texts at once."""
    sent = df.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, squares, bias, slope, shift = sent.value
        weights, squares, grams = np.frombuffer(weights, np.float32), np.frombuffer(squares, np.float32), Grams()
        margins = np.array([_margin(grams(t), weights, squares, bias) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30))))

    return df.withColumn(out, score(F.col(text)))


def held_out(key: str) -> Column:
    """Whether a key's label is kept from the fit; a null key's is."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id"))
    scored = with_score(docs, fit(docs, labels, "doc_id", "quality"))
    scored = scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    with small_batches(spark):
        return stored(scored, "quality")
