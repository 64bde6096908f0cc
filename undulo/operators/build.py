"""Wavelet trees and matrices.

On level l of h, a tree orders symbols by their first l bits, then by position, a matrix by those bits in reverse; the bit stored
is the next one. So each level follows from (pos, code) alone, and where a chunk's symbols go in every node from how often each code stood before the chunk. Chunks
carry that for their range, a row for each range has it for the ranges before, and one pass over the chunks, which move nowhere, emits words of 64 bits: level by level, a chunk's
codes are parted by node, stably, and the bits of each node packed from where they start. Words travel in runs, a row a run, to their block of ``BLOCK`` words, and are put together there by OR:
those at the edges of runs come from several chunks.

Alphabets of more than ``LARGEST`` symbols go another way: (level, node, position, bit) of all symbols are sorted by ranges, whose number
follows theirs, and words packed in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undulo.functions.bits import bitrev, level_bit, node_of
from undulo.plans.alphabet import Alphabet, carries_counts, effective_text, node_sizes, node_starts, part_counts, reversed_prefixes
from undulo.sources.scratch import small_side, stored, tasks_for
from undulo.sources.text import counted, symbols_of, unpack, with_starts

TREE, MATRIX, NODES = "tree", "matrix", "nodes"
#: Counts of symbols before ranges that are broadcast at most.
MOST_COUNTS = 2_000_000
#: Words that are put together at once.
BLOCK = 1 << 13
#: Bytes of words that a pass over the chunks makes about, where levels are exported.
PASS_BYTES = 1 << 27
#: Bytes of a bit, and of a word, that are sorted or put together one by one, about.
BIT_BYTES, WORD_BYTES = 32, 64


def _key(kind: str) -> tuple[str, str, pa.DataType]:
    return ("node_id", "long", pa.int64()) if kind == NODES else ("level", "int", pa.int32())


def _coder(symbols: np.ndarray):
    """From symbols to codes."""
    if symbols[0] < 0 or symbols[-1] >= 1 << 21:
        return lambda raw: np.searchsorted(symbols, raw)
    table = np.zeros(int(symbols[-1]) + 1, np.uint32)
    table[symbols] = np.arange(len(symbols))
    return lambda raw: table[raw]


def counts_before(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(part, raws, earlier): how often each symbol stands in the parts before; and the number of parts."""
    counts = stored(part_counts(chunks), "part-counts")
    n_parts = (counts.agg(F.max("part")).first()[0] or 0) + 1

    def run(table: pa.Table) -> pa.Table:  # one symbol
        n = np.zeros(n_parts, np.int64)
        n[table["part"].to_numpy()] = table["n"].to_numpy()
        upto = np.cumsum(n) - n
        part = np.flatnonzero(upto)
        return pa.table({"part": part, "raw": np.full(len(part), table["raw"][0].as_py()), "earlier": upto[part]})

    earlier = counts.groupBy("raw").applyInArrow(run, "part long, raw long, earlier long")
    return earlier.groupBy("part").agg(F.collect_list("raw").alias("raws"), F.collect_list("earlier").alias("earlier")), n_parts


def _pack_runs(bits: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of runs of bits, each run packed from its place on: the run of each word, its index, the word."""
    first = places % 64
    words = (first + sizes + 63) // 64
    slots = np.cumsum(words) - words
    buffer = np.zeros(int(words.sum()) * 64, np.uint8)
    starts = np.cumsum(sizes) - sizes
    buffer[np.repeat(slots * 64 + first - starts, sizes) + np.arange(len(bits))] = bits
    run = np.repeat(np.arange(len(sizes)), words)
    index = places[run] // 64 + np.arange(len(run)) - slots[run]
    return run, index, np.packbits(buffer).view(">u8").astype(np.uint64).view(np.int64)


def levels_of(code: np.ndarray, height: int, matrix: bool, levels: range | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level, or some one after another: its nodes that occur, in its order, their sizes, and their bits one after another."""
    order = code.astype(np.uint16 if height <= 16 else np.uint64)
    levels = range(height) if levels is None else levels
    if levels.start:
        before = order >> order.dtype.type(height - levels.start)
        order = order[np.argsort(reversed_prefixes(levels.start).astype(order.dtype)[before] if matrix else before, kind="stable")]
    for level in levels:
        prefix = order >> order.dtype.type(height - level)
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        bit = ((order >> order.dtype.type(height - 1 - level)) & order.dtype.type(1)).astype(np.uint8)
        yield level, prefix[first].astype(np.int64), np.diff(np.r_[first, len(order)]), bit
        one = bit.astype(bool)
        if matrix:
            order = np.concatenate([order[~one], order[one]])
        elif level + 1 < height:  # stable inside each node: by the node and the bit
            key = order >> order.dtype.type(height - 1 - level)
            order = order[np.argsort(key.astype(np.uint8) if level < 8 else key, kind="stable")]


def in_runs(keys: np.ndarray, index: np.ndarray, word: np.ndarray, key: str, key_type: pa.DataType, block: int) -> pa.RecordBatch:
    """(key, block, at, words): words in the order of their key and index as rows of their runs, which end with their block."""
    new = (keys[1:] != keys[:-1]) | (index[1:] != index[:-1] + 1) | (index[1:] % block == 0)
    first = np.flatnonzero(np.r_[True, new])
    ends = np.r_[first * 8, len(word) * 8].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(word.astype("<i8"))])
    return pa.RecordBatch.from_arrays([pa.array(keys[first], key_type), pa.array(index[first] // block), pa.array((index[first] % block).astype(np.int32)), words], [key, "block", "at", "words"])


def put_together(table: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block, and where in it they stand, from its runs in any order."""
    runs = table["words"].combine_chunks().cast(pa.binary())
    _, offsets, data = runs.buffers()
    ends = np.frombuffer(offsets, np.int32)[runs.offset : runs.offset + len(runs) + 1] // 8
    words, sizes = np.frombuffer(data, "<i8", int(ends[-1]))[ends[0] :], np.diff(ends)
    place = np.repeat(table["at"].to_numpy() - (ends[:-1] - ends[0]), sizes) + np.arange(len(words))
    out, filled = np.zeros(block, np.int64), np.zeros(block, bool)
    np.bitwise_or.at(out, place, words)
    filled[place] = True
    return out[filled], np.flatnonzero(filled)


def build(chunks: DataFrame, alphabet: Alphabet, kind: str = TREE) -> DataFrame:
    """(level, word_idx, word) of a tree or matrix, or (node_id, word_idx, word) of a tree by nodes; bits after the end are 0."""
    height = alphabet.height
    key, key_kind, key_type = _key(kind)
    if not height or not alphabet.n:
        return alphabet.table.sparkSession.createDataFrame([], f"{key} {key_kind}, word_idx long, word long")
    if alphabet.counts is None or not carries_counts(chunks):
        codes = unpack(chunks).withColumnRenamed("raw", "code") if alphabet.coded else effective_text(unpack(chunks), alphabet)
        return build_sorted(codes, height, kind, alphabet.n)
    block = BLOCK

    def run(table: pa.Table) -> pa.Table:  # one block of a key
        word, place = put_together(table, block)
        own = pa.array(np.full(len(word), table[key][0].as_py()), key_type)
        return pa.table({key: own, "word_idx": table["block"][0].as_py() * block + place, "word": word})

    return _runs_by_block(chunks, alphabet, kind).applyInArrow(run, f"{key} {key_kind}, word_idx long, word long")


def build_blocks(chunks: DataFrame, alphabet: Alphabet, kind: str = TREE) -> DataFrame:
    """(key, block, words): ``build`` with a row for each block of ``BLOCK`` words, which has the words of its place from its first on in little-endian bytes."""
    key, key_kind, key_type = _key(kind)
    schema, block = f"{key} {key_kind}, block long, words binary", BLOCK
    if not alphabet.height or not alphabet.n:
        return alphabet.table.sparkSession.createDataFrame([], schema)
    if alphabet.counts is None or not carries_counts(chunks):
        words = build(chunks, alphabet, kind)
        parts = words.groupBy(key, F.expr(f"word_idx div {block}").alias("block"))

        def join(table: pa.Table) -> pa.Table:  # one block of a key
            word = table["word"].to_numpy()[np.argsort(table["word_idx"].to_numpy())]
            return pa.table({key: table[key].slice(0, 1), "block": [table["word_idx"][0].as_py() // block], "words": [word.astype("<i8").tobytes()]})

        return parts.applyInArrow(join, schema)

    def run(table: pa.Table) -> pa.Table:
        word, _ = put_together(table, block)
        return pa.table({key: table[key].slice(0, 1), "block": table["block"].slice(0, 1), "words": pa.array([word.astype("<i8").tobytes()], pa.binary())})

    return _runs_by_block(chunks, alphabet, kind).applyInArrow(run, schema)


def blocks_in_passes(chunks: DataFrame, alphabet: Alphabet, kind: str = TREE) -> Iterator[DataFrame]:
    """``build_blocks`` with ``part``: ranges of (key, block), each a task's, and in their order there; a table for each pass over the chunks, which makes as many levels
    as ``PASS_BYTES`` of words are, one at least. If each is written before the next one, shuffles are those of a pass, not of all levels. Alphabets that have no counts are
    left to ``build_blocks``, without ``part``."""
    if not alphabet.height or not alphabet.n or alphabet.counts is None or not carries_counts(chunks):
        yield build_blocks(chunks, alphabet, kind)
        return
    before = counts_before(chunks)
    step = max(1, PASS_BYTES * 8 // alphabet.n)
    for first in range(0, alphabet.height, step):
        yield _blocks_in_ranges(chunks, alphabet, kind, range(first, min(alphabet.height, first + step)), before)


def _blocks_in_ranges(chunks: DataFrame, alphabet: Alphabet, kind: str, levels: range, before: tuple[DataFrame, int]) -> DataFrame:
    """(part, key, block, words) of some levels. How many blocks a key has is known, so runs of words go to the range of their block at once, and blocks are not moved again."""
    key, key_kind, key_type = _key(kind)
    block, height, n = BLOCK, alphabet.height, alphabet.n
    if kind == NODES:  # by id, from 1
        sizes = np.concatenate([[0], *[alphabet.sizes(level) * (level in levels) for level in range(height)]])
    else:
        sizes = np.array([n * (level in levels) for level in range(height)])
    blocks = -(-sizes // (64 * block))
    first, total, tasks = np.cumsum(blocks) - blocks, int(blocks.sum()), tasks_for(chunks.sparkSession, n * len(levels) // 8)

    def part_of(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return ((first[keys] + numbers) * tasks // total).astype(np.int32)

    def whole(runs: list[pa.RecordBatch]) -> pa.RecordBatch:  # one block
        word, _ = put_together(pa.Table.from_batches(runs), block)
        own = [runs[0][c].slice(0, 1) for c in ("part", key, "block")]
        return pa.RecordBatch.from_arrays([*own, pa.array([word.astype("<i8").tobytes()], pa.binary())], ["part", key, "block", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for b in batches:
            keys, numbers = b[key].to_numpy(), b["block"].to_numpy()
            ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1])) + 1).tolist(), len(keys)]
            for start, end in zip(ends, ends[1:]):
                if start == end:
                    continue
                if held and of != (keys[start], numbers[start]):
                    yield whole(held)
                    held = []
                held.append(b.slice(start, end - start))
                of = keys[start], numbers[start]
        if held:
            yield whole(held)

    runs = _runs(chunks, alphabet, kind, before, levels, part_of).repartitionById(tasks, "part").sortWithinPartitions("part", key, "block")
    return runs.mapInArrow(run, f"part int, {key} {key_kind}, block long, words binary")


def _runs_by_block(chunks: DataFrame, alphabet: Alphabet, kind: str):
    """The runs of words of all chunks, grouped by key and block."""
    key = _key(kind)[0]
    tasks = tasks_for(chunks.sparkSession, alphabet.n * alphabet.height // 8)
    return _runs(chunks, alphabet, kind, counts_before(chunks)).repartition(tasks, key, "block").groupBy(key, "block")


def _runs(chunks: DataFrame, alphabet: Alphabet, kind: str, counts: tuple[DataFrame, int], levels: range | None = None, part_of: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(key, block, at, words): the runs of words of all chunks, and the part that ``part_of`` gives their keys and blocks. counts: ``counts_before`` of the chunks."""
    height, matrix, block = alphabet.height, kind == MATRIX, BLOCK
    key, key_kind, key_type = _key(kind)
    symbols = np.array(alphabet.symbols, np.int64)
    code_of = _coder(symbols)
    starts = [np.zeros(1 << level, np.int64) if kind == NODES else alphabet.starts(level, matrix) for level in range(height)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, data, seen, upto, raws, earlier in zip(*(b[c] for c in ("width", "symbols", "seen", "upto", "raws", "earlier")), strict=True):
                code = code_of(symbols_of(data.as_py(), width.as_py()))
                before = np.zeros(1 << height, np.int64)
                before[np.searchsorted(symbols, seen.values.to_numpy())] = upto.values.to_numpy()
                own, n = counted(code)
                before[own] -= n
                if raws.is_valid:
                    before[np.searchsorted(symbols, raws.values.to_numpy())] += earlier.values.to_numpy()
                keys, words, values = [], [], []
                for level, nodes, sizes, bit in levels_of(code, height, matrix, levels):
                    places = starts[level][nodes] + before.reshape(1 << level, -1).sum(1)[nodes]
                    which, index, word = _pack_runs(bit, sizes, places)
                    keys.append((1 << level) + nodes[which] if kind == NODES else np.full(len(which), level))
                    words.append(index)
                    values.append(word)
                out = in_runs(np.concatenate(keys), np.concatenate(words), np.concatenate(values), key, key_type, block)
                yield out.append_column("part", pa.array(part_of(out[key].to_numpy(), out["block"].to_numpy()))) if part_of else out

    earlier, n_parts = counts
    earlier = F.broadcast(earlier) if n_parts * alphabet.sigma <= MOST_COUNTS else earlier.hint("merge")
    rows = chunks.join(earlier, "part", "left").select("width", "symbols", "seen", "upto", "raws", "earlier")
    return rows.mapInArrow(run, f"{key} {key_kind}, block long, at int, words binary" + (", part int" if part_of else ""))


def shifted(words: DataFrame, key: str, places: Column, n: int) -> DataFrame:
    """(key, word_idx, word) of words moved on by a number of places each, put together by OR; ``_end`` is the place after a word's last bit, or a later one.
    ``n`` words about are dealt to tasks of a bounded size."""
    rows = words.withColumn("_at", places + F.col("word_idx") * 64)
    shift = (F.col("_at") % 64).cast("int")
    first = F.struct(F.expr("_at div 64").alias("word_idx"), F.call_function("shiftrightunsigned", "word", shift).alias("word"))
    rest = F.call_function("shiftleft", F.col("word"), (F.lit(64) - shift).cast("int"))
    second = F.struct((F.expr("_at div 64") + 1).alias("word_idx"), F.when(shift > 0, rest).otherwise(F.lit(0).cast("long")).alias("word"))
    rows = rows.select(key, F.explode(F.when(shift > 0, F.array(first, second)).otherwise(F.array(first))).alias("w"), "_end")
    rows = rows.select(key, "w.*", "_end").filter("word_idx * 64 < _end")
    rows = rows.repartition(tasks_for(rows.sparkSession, WORD_BYTES * n), key, "word_idx")
    return rows.groupBy(key, "word_idx").agg(F.bit_or("word").alias("word"))


def words_in_order(rows: DataFrame, key: str, order: list[str], n: int | None = None) -> DataFrame:
    """(key, word_idx, word) of the bits of each key in an order; ``n``: their number, where it is known. Ranges of the order, as many as the bits take, are packed on
    their own; a key that goes over the end of a range is moved on by what the ranges before hold of it."""
    n = rows.count() if n is None else n
    kind = rows.schema[key].dataType.simpleString()

    names = ["part", key, "word_idx", "word", "filled"]
    key_type = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail_key, tail, index = 0, None, np.empty(0, np.uint8), 0  # the open run: its bits that fill no word yet, and the number of its next word

        def rest() -> pa.RecordBatch:
            word = np.packbits(np.r_[tail, np.zeros(64 - len(tail), np.uint8)]).view(">u8").astype(np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([tail_key], key_type), pa.array([index]), pa.array(word), pa.array([len(tail)])], names)

        for b in batches:
            if not len(b):
                continue
            part, keys, bits = b["part"][0].as_py(), b[key].to_numpy(), b["bit"].to_numpy().astype(np.uint8)
            if tail_key != keys[0]:
                if len(tail):
                    yield rest()
                tail, index = tail[:0], 0
            bits, keys = np.r_[tail, bits], np.r_[np.full(len(tail), keys[0]), keys]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[first, len(keys)])
            which, word_idx, word = _pack_runs(bits, sizes, np.zeros(len(sizes), np.int64))
            filled = np.minimum(sizes[which] - word_idx * 64, 64)
            word_idx[which == 0] += index
            left = int(sizes[-1] % 64)
            kept = len(word) - (left > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(kept, part)), pa.array(keys[first][which][:kept], key_type), pa.array(word_idx[:kept]), pa.array(word[:kept]), pa.array(filled[:kept])], names)
            index = (index if len(sizes) == 1 else 0) + int(sizes[-1] // 64)
            tail_key, tail = int(keys[-1]), bits[len(bits) - left :]
        if len(tail):
            yield rest()

    packed = rows.repartitionByRange(tasks_for(rows.sparkSession, BIT_BYTES * n), key, *order).sortWithinPartitions(key, *order).select(F.spark_partition_id().cast("long").alias("part"), key, "bit")
    packed = stored(packed.mapInArrow(run, f"part long, {key} {kind}, word_idx long, word long, filled long"), "packed-ranges")
    runs = packed.groupBy("part", key).agg(F.sum("filled").alias("n"))
    ends = stored(runs.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("n", key).alias("n")), "range-ends")
    held = ends.select(F.col("last").alias(key), "part", "n").unionByName(ends.select(F.col("first").alias(key), "part", F.lit(0).cast("long").alias("n")).filter("part > 0"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rangeBetween(Window.unboundedPreceding, -1))
    carried = held.select(key, "part", before.alias("carried")).filter("carried > 0").distinct()
    rows = packed.join(F.broadcast(carried), ["part", key], "left")  # a row for each range at most
    places = F.coalesce("carried", F.lit(0))
    return shifted(rows.withColumn("_end", places + F.col("word_idx") * 64 + F.col("filled")), key, places, n // 64)


def build_sorted(codes: DataFrame, height: int, kind: str, n: int) -> DataFrame:
    """A tree or matrix from ``n`` rows (pos, code), for alphabets of any size."""
    key, key_kind, _ = _key(kind)
    rows = stored(codes, "codes")  # ranges look at rows twice
    rows = rows.select("pos", "code", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("level"))
    node = node_of(F.col("code"), F.col("level"), height)
    rows = rows.select("level", node.alias("node"), "pos", level_bit(F.col("code"), F.col("level"), height).alias("bit"))
    if kind == NODES:
        rows = rows.select((F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) + F.col("node")).alias(key), "pos", "bit")
        return words_in_order(rows, key, ["pos"], n * height)
    if kind == MATRIX:
        rows = rows.withColumn("node", bitrev(F.col("node"), F.col("level")))
    return words_in_order(rows, key, ["node", "pos"], n * height)


def merge_nodes(nodes: DataFrame, alphabet: Alphabet, matrix: bool = False) -> DataFrame:
    """(level, word_idx, word) from the words of nodes: a node's words are moved on to where it starts."""
    starts = node_starts(node_sizes(alphabet), matrix).filter("size > 0")
    rows = nodes.join(small_side(starts, 2 * alphabet.sigma), "node_id").withColumn("_end", F.lit(alphabet.n))
    return shifted(rows, "level", F.col("start"), -(-alphabet.n * alphabet.height // 64))


def z_from_words(levels: DataFrame, n: int) -> DataFrame:
    """(level, z): positions less set bits."""
    return levels.groupBy("level").agg((F.lit(n) - F.sum(F.bit_count("word"))).cast("long").alias("z"))


def z_from_histogram(alphabet: Alphabet) -> DataFrame:
    """(level, z): occurrences of codes with a 0 at the level's bit."""
    height = alphabet.height
    rows = alphabet.table.select("code", "occ", F.explode(F.sequence(F.lit(0), F.lit(max(height - 1, 0)))).alias("level")).filter(F.col("level") < height)
    bit = F.call_function("shiftright", F.col("code"), (F.lit(height - 1) - F.col("level")).cast("int")).bitwiseAND(F.lit(1))
    return rows.groupBy("level").agg(F.sum(F.when(bit == 0, F.col("occ")).otherwise(F.lit(0))).cast("long").alias("z"))


def differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(differences): positions at which two texts differ, or that only one has."""
    both = left.select("pos", F.col(column).alias("x")).join(right.select("pos", F.col(column).alias("y")), "pos", "full")
    return both.agg(F.coalesce(F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), 0).otherwise(1)), F.lit(0)).cast("long").alias("differences"))
