"""Decoding wavelet trees, matrices and trees by nodes.

The text is decoded in chunks of positions. On every level, the bits of a chunk's symbols in a node are a run of places; a run's two
ends, looked up by rank, give its children's runs on the next level. So the levels' words are met by a few ends of runs for each chunk, not by
positions. Then each chunk gets the words of its runs, and a pass over them in numpy gives its codes. Levels are written once before they are read. Joins with words
are sort-merge joins: Spark takes rows that come of a few ends for small, and would send them to the driver to broadcast.

Levels in files are decoded where the text is that they are held against: a task reads on in each node from its place, and only the places of some positions are looked up
before. Nothing but those is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.functions.running import running_sum
from undulo.operators.build import BLOCK, MATRIX, MOST_COUNTS, NODES, TREE, differences, z_from_words
from undulo.plans.alphabet import Alphabet, effective_text
from undulo.sources.scratch import stored, tasks_for
from undulo.sources.store import LevelFiles, read_words
from undulo.sources.text import symbols_of, unpack, with_starts

CHUNK = 1 << 18
#: Positions between those whose places are looked up, at least.
STEP = 1 << 21
#: Nodes of a level that are read side by side at most; bits of one that are read ahead at least, and how many times as many as asked for.
MOST_NODES = 1 << 12
AHEAD, TIMES = 1 << 12, 16


def ranked(words: DataFrame, key: str) -> DataFrame:
    """(key, word_idx, word, before): words, written, with the set bits before each, by key."""
    rows = running_sum(words.withColumn("ones", F.bit_count("word")), [key], "word_idx", "ones", "before")
    return stored(rows.select(key, "word_idx", "word", "before"), "ranked")


def _with_ranks(runs: DataFrame, words: DataFrame, key: str, points: list[str]) -> DataFrame:
    """Adds rank_<point>, the set bits before a place of the run's key, for each point."""
    ids = ["chunk", "node"]
    looked = runs.select(*ids, key, F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).alias("at")) for p in points])).alias("x")).select(*ids, key, "x.*")
    # the end of a key may lie behind its last word: the rank there is that of the last bit, and the bit
    looked = looked.withColumn("word_idx", F.greatest(F.expr("(at - 1) div 64"), F.lit(0))).withColumn("bits", (F.col("at") - F.col("word_idx") * 64).cast("int"))
    looked = looked.join(words.hint("merge"), [key, "word_idx"])
    part = F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.bit_count(F.call_function("shiftrightunsigned", F.col("word"), (F.lit(64) - F.col("bits")).cast("int"))))
    looked = looked.groupBy(*ids).agg(*[F.max(F.when(F.col("name") == p, F.col("before") + part)).alias(f"rank_{p}") for p in points])
    return runs.join(looked.hint("merge"), ids)


def _runs(words: DataFrame, n: int, height: int, kind: str) -> list[DataFrame]:
    """For each level (chunk: its first position, node, key, p, e): the places from p to e of the key's words that a chunk's symbols of a node take."""
    spark = words.sparkSession
    runs = spark.range((n + CHUNK - 1) // CHUNK).select((F.col("id") * CHUNK).alias("chunk"), F.lit(0).cast("long").alias("node"), (F.col("id") * CHUNK).alias("p"), F.least((F.col("id") + 1) * CHUNK, F.lit(n)).alias("e"))
    runs = runs.withColumn("s", F.lit(0).cast("long")).withColumn("t", F.lit(n).cast("long"))  # where the whole node starts and ends
    z = {r.level: r.z for r in z_from_words(words, n).collect()} if kind == MATRIX else {}  # a row a level
    out = []
    for level in range(height):
        if kind == NODES:
            key, runs = "node_id", runs.withColumn("node_id", F.col("node") + (1 << level))
        else:
            key, runs = "level", runs.withColumn("level", F.lit(level))
        out.append(runs.select("chunk", "node", key, "p", "e"))
        if level + 1 == height:
            break
        rank = lambda c: F.col(f"rank_{c}")
        if kind == TREE:
            runs = _with_ranks(runs, words, key, ["p", "e", "s", "t"])
            mid = F.col("t") - (rank("t") - rank("s"))  # where the node's ones start on the next level
            zero = [F.col(c) - (rank(c) - rank("s")) for c in "pe"] + [F.col("s"), mid]
            one = [mid + rank(c) - rank("s") for c in "pe"] + [mid, F.col("t")]
        else:
            runs = _with_ranks(runs, words, key, ["p", "e"])
            zero = [F.col(c) - rank(c) for c in "pe"] + [F.col(c) for c in "st"]
            one = [F.lit(z.get(level, 0)) + rank(c) for c in "pe"] + [F.col(c) for c in "st"]
        child = lambda bit, of: F.struct((F.col("node") * 2 + bit).alias("node"), *[x.cast("long").alias(c) for x, c in zip(of, "pest", strict=True)])
        runs = runs.select("chunk", F.explode(F.array(child(0, zero), child(1, one))).alias("x")).select("chunk", "x.*").filter("p < e")
        runs = stored(runs, "runs")
    return out


def _codes(table: pa.Table) -> np.ndarray:
    """The codes of one chunk from the words of its runs."""
    level, node, p, e, word_idx, word = (table[c].to_numpy() for c in ("depth", "node", "p", "e", "word_idx", "word"))
    matrix = table["matrix"][0].as_py()
    order = codes = None
    for depth in range(int(level.max()) + 1):
        own = np.flatnonzero(level == depth)
        if matrix:
            own = own[np.lexsort((word_idx[own], p[own]))]
        else:
            own = own[np.lexsort((word_idx[own], node[own]))]
        bits = np.unpackbits(word[own].astype(">i8").view(np.uint8)).reshape(-1, 64)
        place = word_idx[own, None] * 64 + np.arange(64)
        bits = bits[(place >= p[own, None]) & (place < e[own, None])].astype(np.int64)
        if order is None:
            order, codes = np.arange(len(bits)), np.zeros(len(bits), np.int64)
        codes[order] = codes[order] * 2 + bits
        order = np.concatenate([order[bits == 0], order[bits == 1]]) if matrix else np.argsort(codes, kind="stable")
    return codes


def _assemble(table: pa.Table) -> pa.Table:
    codes = _codes(table)
    return pa.table({"pos": table["chunk"][0].as_py() + np.arange(len(codes)), "code": codes})


def decode(words: DataFrame, n: int, height: int, kind: str = TREE) -> DataFrame:
    """(pos, code) from (level, word_idx, word), or from (node_id, word_idx, word) of a tree by nodes."""
    spark = words.sparkSession
    if not height or not n:
        return spark.range(n).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("code"))
    return _words_by_chunk(words, n, height, kind).applyInArrow(_assemble, "pos long, code long")


def _words_by_chunk(words: DataFrame, n: int, height: int, kind: str):
    """The words of all runs, grouped by chunk."""
    key = "node_id" if kind == NODES else "level"
    words = ranked(words, key)
    whole = None
    for depth, runs in enumerate(_runs(words, n, height, kind)):
        runs = runs.withColumn("depth", F.lit(depth))
        whole = runs if whole is None else whole.unionByName(runs)
    whole = whole.withColumn("word_idx", F.explode(F.expr("sequence(p div 64, (e - 1) div 64)")))
    whole = whole.join(words.select(key, "word_idx", "word").hint("merge"), [key, "word_idx"]).withColumn("matrix", F.lit(kind == MATRIX))
    whole = whole.select("chunk", "depth", "node", "p", "e", "word_idx", "word", "matrix")
    return whole.repartition(tasks_for(words.sparkSession, n * height), "chunk").groupBy("chunk")  # a row a word, 64 bytes


def verify(words: DataFrame, codes: DataFrame, n: int, height: int, kind: str = TREE) -> DataFrame:
    """(differences) between a text and what its index decodes to; any difference fails the query where it is evaluated."""
    return _failing(differences(codes, decode(words, n, height, kind), "code"))


def _failing(found: DataFrame) -> DataFrame:
    message = F.concat(F.col("differences").cast("string"), F.lit(" symbols differ"))
    return found.select(F.when(F.col("differences") > 0, F.raise_error(message).cast("long")).otherwise(F.col("differences")).alias("differences"))


def _coded(raw: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The codes of symbols; one that the alphabet lacks differs from all."""
    code = np.minimum(np.searchsorted(symbols, raw), len(symbols) - 1)
    return np.where(symbols[code] == raw, code, -2)


def verify_chunks(words: DataFrame, chunks: DataFrame, alphabet: Alphabet, kind: str = TREE) -> DataFrame:
    """``verify`` of chunks of raw symbols: they meet what is decoded as packed codes, cut where its chunks are, not symbol by symbol."""
    n, height, size = alphabet.n, alphabet.height, CHUNK
    if not n or not height or alphabet.symbols is None:
        return verify(words, effective_text(unpack(chunks), alphabet), n, height, kind)
    symbols, form = np.array(alphabet.symbols, np.int64), "<i2" if height < 15 else "<i4"

    def decoded(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table["chunk"].slice(0, 1), "codes": pa.array([_codes(table).astype(form).tobytes()], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, width, data in zip(b["start"].to_pylist(), b["width"].to_pylist(), b["symbols"], strict=True):
                raw = symbols_of(data.as_buffer(), width).astype(np.int64)
                code = _coded(raw, symbols).astype(form)
                ends = np.r_[0, np.arange(size - start % size, len(raw), size), len(raw)]
                at = start + ends[:-1]
                pieces = pa.array([code[p:e].tobytes() for p, e in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at // size * size), pa.array(at % size), pieces], ["chunk", "at", "codes"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        both = np.full((2, size), -1, np.int64)
        for row, table in enumerate((left, right)):
            for k, codes in enumerate(table["codes"]):
                codes, at = np.frombuffer(codes.as_buffer(), form), right["at"][k].as_py() if row else 0
                both[row, at : at + len(codes)] = codes
        return pa.table({"differences": [int((both[0] != both[1]).sum())]})

    found = _words_by_chunk(words, n, height, kind).applyInArrow(decoded, "chunk long, codes binary")
    own = with_starts(chunks).select("start", "width", "symbols").mapInArrow(cut, "chunk long, at long, codes binary")
    tasks = tasks_for(words.sparkSession, 4 * n)
    found, own = (x.repartition(tasks, "chunk").groupBy("chunk") for x in (found, own))
    found = found.cogroup(own).applyInArrow(compare, "differences long")
    return _failing(found.agg(F.coalesce(F.sum("differences"), F.lit(0)).alias("differences")))


def _ranks(spark: SparkSession, files: LevelFiles, level: int, n: int, places: np.ndarray) -> tuple[np.ndarray, int]:
    """The set bits before each of some places of a level, and those of all of it. A task takes whole blocks of words; the driver gets a row a block."""
    size = -(-n // 64)
    block = max(BLOCK, -(-size // MOST_COUNTS))
    n_blocks = -(-size // block)
    points, which = np.unique(places, return_inverse=True)
    of = np.minimum(points // (64 * block), n_blocks - 1)
    ends = np.searchsorted(of, np.arange(n_blocks + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                words = files.read(level, k * block, min((k + 1) * block, size)).view(np.uint64)
                before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
                at = points[ends[k] : ends[k + 1]] - 64 * block * k
                bits = (at % 64).astype(np.uint64)
                part = np.where(bits > 0, np.bitwise_count(np.r_[words, np.uint64(0)][at // 64] >> ((np.uint64(64) - bits) % np.uint64(64))), 0)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([before[-1]]), pa.array([before[at // 64] + part], pa.list_(pa.int64()))], ["block", "ones", "ranks"])

    rows = spark.range(0, n_blocks, 1, tasks_for(spark, 8 * size)).mapInArrow(run, "block long, ones long, ranks array<long>")
    found = rows.toArrow().sort_by("block")
    ones = found["ones"].to_numpy()
    before = np.cumsum(ones) - ones
    ranks = before[of] + found["ranks"].combine_chunks().flatten().to_numpy()
    return ranks[which].reshape(places.shape), int(ones.sum())


def places_of(spark: SparkSession, files: LevelFiles, positions: np.ndarray, n: int, height: int, kind: str) -> list[np.ndarray]:
    """For each level (position, node): where on it the node's symbols from a position on stand. The positions go from 0 to ``n``."""
    out = [positions[:, None]]
    for level in range(height - 1):
        at = out[-1]
        ranks, ones = _ranks(spark, files, level, n, at)
        if kind == MATRIX:
            zero, one = at - ranks, n - ones + ranks
        else:  # a node starts at the place of position 0, and ends at that of position n
            zero = at - (ranks - ranks[0])
            one = zero[-1] + (ranks - ranks[0])
        out.append(np.stack([zero, one], 2).reshape(len(positions), -1))
    return out


class Reader:
    """Decodes a text from a position on: the bits of a node are read on from its place, on every level."""

    def __init__(self, files: LevelFiles, places: list[np.ndarray]):
        self.files, self.places = files, [p.copy() for p in places]
        self.held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def _bits(self, level: int, node: int, n: int) -> np.ndarray:
        at = int(self.places[level][node])
        first, words = self.held.get((level, node), (0, np.empty(0, np.int64)))
        if at < 64 * first or at + n > 64 * (first + len(words)):
            first = at // 64
            words = self.files.read(level, first, -(-(at + max(AHEAD, TIMES * n)) // 64))
            self.held[level, node] = first, words
        self.places[level][node] += n
        own = words[at // 64 - first : (at + n + 63) // 64 - first]
        return np.unpackbits(own.astype(">i8").view(np.uint8))[at % 64 : at % 64 + n]

    def take(self, n: int) -> np.ndarray:
        """The codes of the next ``n`` symbols."""
        order, codes = np.arange(n), np.zeros(n, np.uint16)  # by node, inside of it by position
        for level in range(len(self.places)):
            if level:
                by_node = np.argsort(codes, kind="stable")
                order, codes = order[by_node], codes[by_node]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            sizes = np.diff(np.r_[first, n])
            codes = codes * np.uint16(2) + np.concatenate([self._bits(level, node, size) for node, size in zip(codes[first].tolist(), sizes.tolist(), strict=True)])
        out = np.empty_like(codes)
        out[order] = codes
        return out


def verify_files(path: str, chunks: DataFrame, alphabet: Alphabet, kind: str = TREE) -> DataFrame:
    """``verify_chunks`` of the levels in the files that ``export_blocks`` wrote. Neither words nor symbols are shuffled or written: a task decodes what its chunks are held against, reading
    words from the files. Nodes, and alphabets of more than ``MOST_NODES`` symbols, go by ``verify_chunks``."""
    spark, n, height = chunks.sparkSession, alphabet.n, alphabet.height
    if not n or not height:  # there are no files
        return verify(chunks, effective_text(unpack(chunks), alphabet), n, height, kind)
    if kind == NODES or alphabet.symbols is None or 1 << height > MOST_NODES:
        return verify_chunks(read_words(spark, path, "node_id" if kind == NODES else "level"), chunks, alphabet, kind)
    files, symbols = LevelFiles(spark, path), np.array(alphabet.symbols, np.int64)
    for level in range(height):
        if files.size(level) != -(-n // 64):
            raise ValueError(f"level {level} of {path} has {files.size(level)} words, not {-(-n // 64)}")
    positions = np.r_[np.arange(0, n, max(STEP, -(-(n << height) // MOST_COUNTS))), n]
    places = places_of(spark, files, positions, n, height, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = None, -1
        for b in batches:
            for start, width, data in zip(b["start"].to_pylist(), b["width"].to_pylist(), b["symbols"], strict=True):
                code = _coded(symbols_of(data.as_buffer(), width).astype(np.int64), symbols)
                both = max(0, min(len(code), n - start))  # what lies behind the index's end differs
                if both and start != at:
                    k = int(np.searchsorted(positions, start, "right")) - 1
                    reader, at = Reader(files, [p[k] for p in places]), int(positions[k])
                    while at < start:
                        at += len(reader.take(min(CHUNK, start - at)))
                wrong = int((reader.take(both) != code[:both]).sum()) if both else 0
                at = start + both
                yield pa.RecordBatch.from_arrays([pa.array([wrong + len(code) - both]), pa.array([both])], ["differences", "held"])

    found = with_starts(chunks).select("start", "width", "symbols").mapInArrow(run, "differences long, held long")
    found = found.agg(F.coalesce(F.sum("differences"), F.lit(0)).alias("differences"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))
    return _failing(found.select((F.col("differences") + n - F.col("held")).alias("differences")))
