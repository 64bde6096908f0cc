"""Texts: sequences of unsigned symbols, from columns, strings and binary files.

A text is a DataFrame (pos BIGINT, raw), or, packed, a table of chunks: runs of ``CHUNK`` symbols about, as little-endian numbers of ``width`` bytes each.
Packing reads a text once. Rows are brought into their order by ranges, and each task packs its range: a chunk carries its place in the range (``part``, ``inside``)
and how often each symbol has stood in the range up to its end (``seen``, ``upto``), so that histograms and offsets follow from a row a range. Ranges
with more than ``COUNTED`` symbols don't carry counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undulo.functions.running import with_positions
from undulo.sources.scratch import stored, tasks_for

WIDTHS = (1, 2, 4, 5)
CHUNK, COUNTED = 1 << 18, 1 << 16
#: Bytes of a file that a task reads about, and bytes of strings that are turned into symbols at once.
RANGE, PIECE = 1 << 26, 1 << 20
#: Symbols of a batch that a chunk is unpacked to.
ROWS = 1 << 16
#: Characters of strings that the driver is sent about to find ranges, and rows that Spark samples for a range.
SAMPLE, SAMPLED = 1 << 25, 300
CHUNKS = "part long, inside long, width int, symbols binary, seen array<long>, upto array<long>"


class Packer:
    """Cuts the symbols of one range into chunks."""

    def __init__(self, part: int, chunk: int):
        self.chunk, self.part, self.inside, self.held, self.size = chunk, part, 0, [], 0
        self.seen: np.ndarray | None = np.empty(0, np.int64)
        self.upto = np.empty(0, np.int64)

    def add(self, symbols: np.ndarray, last: bool = False) -> Iterator[tuple]:
        self.held.append(symbols)
        self.size += len(symbols)
        if self.size < self.chunk and not last:
            return
        whole = np.concatenate(self.held)
        end = len(whole) if last else len(whole) // self.chunk * self.chunk
        for k in range(0, end, self.chunk):
            yield self._chunk(whole[k : min(k + self.chunk, end)])
        self.held, self.size = [whole[end:]], len(whole) - end

    def _chunk(self, symbols: np.ndarray) -> tuple:
        if self.seen is not None:
            raw, n = counted(symbols)
            seen = np.union1d(self.seen, raw)
            upto = np.zeros(len(seen), np.int64)
            upto[np.searchsorted(seen, self.seen)] += self.upto
            upto[np.searchsorted(seen, raw)] += n
            self.seen, self.upto = (seen, upto) if len(seen) <= COUNTED else (None, None)
        most = int(symbols.max())
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 and symbols.min() >= 0 else 8
        row = (self.part, self.inside, width, symbols.astype(f"<u{width}").tobytes(), self.seen, self.upto)
        self.inside += len(symbols)
        return row


def counted(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, in order, and how often."""
    if symbols.dtype.itemsize < 8 and len(symbols) and int(symbols.max()) < 1 << 21:
        n = np.bincount(symbols)
        return np.flatnonzero(n), n[n > 0]
    raw, n = np.unique(symbols, return_counts=True)
    return raw.astype(np.int64), n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["part", "inside", "width", "symbols", "seen", "upto"])


def _joined(column: pa.Array) -> Iterator[bytes]:
    """The strings of an Arrow column in a row, in pieces of ``PIECE`` bytes about, cut between strings."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    at = 0
    while data is not None and at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + PIECE, "right")) - 1)
        yield data[int(ends[at]) : int(ends[upto])].to_pybytes()
        at = upto


def _tasks(rows: DataFrame, value: str, unit: str) -> int:
    """Tasks that pack rows: by their number for symbols, which takes no reading where the source knows it, by the bytes of strings."""
    spark = rows.sparkSession
    if unit == "int":
        return tasks_for(spark, 32 * rows.count())
    return tasks_for(spark, rows.agg(F.sum(F.octet_length(value) + 32)).first()[0] or 0)


def _told_apart(rows: DataFrame, order: list[str], value: str, unit: str, tasks: int) -> list[Column]:
    """What ranges of an order are cut by. Spark sends the driver that of a sample, which grows with the ranges: of strings, only beginnings, which stand in
    the order of the strings, and are the shorter the more ranges there are. A collation may order beginnings otherwise."""
    plain = unit != "int" and rows.schema[value].dataType.simpleString() == "string"
    return [F.substring(c, 1, max(1, SAMPLE // (SAMPLED * tasks))) if plain and c == value else F.col(c) for c in order]


def in_order(rows: DataFrame, order: list[str], value: str, unit: str) -> DataFrame:
    """(part, value): a column in an order, by ranges, each a task's."""
    tasks = _tasks(rows, value, unit)
    rows = rows.repartitionByRange(tasks, *_told_apart(rows, order, value, unit, tasks)).sortWithinPartitions(*order)
    return rows.select(F.spark_partition_id().cast("long").alias("part"), F.col(value).alias("value"))


def pack(rows: DataFrame, order: list[str], value: str, unit: str) -> DataFrame:
    """Chunks of a column in an order. unit: char or byte of its strings, or int for symbols."""

    size = CHUNK

    def coded(data: bytes) -> np.ndarray:
        return np.frombuffer(data.decode().encode("utf-32-le"), "<u4") if unit == "char" else np.frombuffer(data, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for b in batches:
            if not len(b):
                continue
            packer = packer or Packer(b["part"][0].as_py(), size)
            for symbols in [b["value"].to_numpy()] if unit == "int" else map(coded, _joined(b["value"])):
                for chunk in packer.add(symbols):
                    yield _batch([chunk])
        if packer and packer.size:
            yield _batch(list(packer.add(np.empty(0, np.uint8) if unit == "byte" else np.empty(0, np.uint32) if unit == "char" else np.empty(0, np.int64), True)))

    return stored(in_order(rows, order, value, unit).mapInArrow(run, CHUNKS), "chunks")


def size_of(symbols: str = "symbols") -> Column:
    return F.expr(f"octet_length({symbols}) div width")


def with_starts(chunks: DataFrame) -> DataFrame:
    """Adds ``start``, the position of a chunk's first symbol. There is a part for each task that packed."""
    parts = chunks.groupBy("part").agg(F.sum(size_of()).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("start", F.col("before") + F.col("inside")).drop("before")


def from_column(df: DataFrame, column: str, key: str) -> DataFrame:
    """(pos, raw): a column in the order of a key; rows with equal keys in the order of their symbols."""
    return with_positions(df.select(F.col(key).alias("_key"), F.col(column).alias("raw")), ["_key", "raw"]).select("pos", "raw")


def keyed(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.coalesce(column, F.lit("")).alias("text"))


def from_strings(df: DataFrame, column: str, key: str, unit: str = "char") -> DataFrame:
    """Chunks of the characters or UTF-8 bytes of strings joined in the order of a key of any type. Nulls come first; strings with equal
    keys are joined in their own order, each as often as it occurs; a null string is empty."""
    return pack(keyed(df, column, key), ["_key", "text"], "text", unit)


def file_system(path: str) -> tuple:
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    at = urlparse(path)
    return fs.FileSystem.from_uri(f"file://{at.path}" if at.scheme in ("", "file") else path)


def _reads_ranges(path: str) -> bool:
    try:
        file_system(path)
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


def from_binary(spark: SparkSession, path: str, width: int = 1, prefix: int | None = None, buffer: int = RANGE, signed: bool = False) -> DataFrame:
    """Chunks of headerless files of unsigned little-endian symbols of 1, 2, 4 or 5 bytes, joined in the order of their paths; ``signed`` also takes 8.
    ``prefix`` bytes of each file at most are taken, and bytes at a file's end that fill no symbol dropped. Tasks read ranges of ``buffer`` bytes about, of files of any size;
    in a store that Arrow doesn't know, Spark reads files as a whole, each of 2 GiB at most."""
    if width not in WIDTHS and not (signed and width == 8):
        raise ValueError(f"symbols have {WIDTHS} bytes, not {width}")
    files = spark.read.format("binaryFile").load(path)
    size = F.col("length") if prefix is None else F.least("length", F.lit(prefix))
    step = max(1, buffer // width) * width
    ranges = files.select("path", F.floor(size / width).alias("n")).filter("n > 0").select("path", (F.col("n") * width).alias("n"))
    ranges = ranges.select("path", F.explode(F.expr(f"sequence(0L, n - 1, {step}L)")).alias("at"), "n")
    ranges = ranges.select("path", "at", F.least(F.lit(step), F.col("n") - F.col("at")).alias("bytes"))
    ranges = with_positions(ranges, ["path", "at"], "part")
    first = files.select("path").limit(1).collect()
    by_range = bool(first) and _reads_ranges(first[0].path)
    if by_range:
        tasks = tasks_for(spark, ranges.agg(F.sum("bytes")).first()[0] or 0)
        ranges = ranges.select("part", "path", "at", "bytes").repartitionByRange(tasks, "part")
    else:
        data = F.expr("substring(content, cast(at + 1 as int), cast(bytes as int))").alias("data")
        ranges = ranges.join(files.select("path", "content"), "path").select("part", "bytes", data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                packer, left = Packer(row["part"], CHUNK), row["bytes"]
                if by_range:
                    store, name = file_system(row["path"])
                    file = store.open_input_file(name)
                    file.seek(row["at"])
                else:
                    file = pa.BufferReader(row["data"])
                while left:
                    data = file.read(min(left, CHUNK * width))
                    left -= len(data)
                    if width == 5:
                        wide = np.zeros((len(data) // 5, 8), np.uint8)
                        wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
                        symbols = wide.view("<i8").ravel()
                    else:
                        symbols = np.frombuffer(data, f"<i{width}" if signed else f"<u{width}")
                    for chunk in packer.add(symbols, not left):
                        yield _batch([chunk])
                file.close()

    return stored(ranges.mapInArrow(run, CHUNKS), "chunks")


def prefix(text: DataFrame, n: int) -> DataFrame:
    """The first ``n`` symbols of a text, or of chunks, of which only those that it needs are unpacked."""
    if "symbols" not in text.columns:
        return text.filter(F.col("pos") < n)
    return unpack(with_starts(text).filter(F.col("start") < n)).filter(F.col("pos") < n)


def symbols_of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{width}" if width < 8 else "<i8")


def unpack(chunks: DataFrame) -> DataFrame:
    """(pos, raw) of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, width, data in zip(*(b[c] for c in ("start", "width", "symbols")), strict=True):  # one chunk at a time, not copied
                raw = symbols_of(data.as_buffer(), width.as_py()).astype(np.int64)
                for k in range(0, len(raw), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(start.as_py() + np.arange(k, min(k + ROWS, len(raw)))), pa.array(raw[k : k + ROWS])], ["pos", "raw"])

    chunks = chunks if "start" in chunks.columns else with_starts(chunks)
    return chunks.select("start", "width", "symbols").mapInArrow(run, "pos long, raw long")


def in_words(chunks: DataFrame) -> DataFrame:
    """(word_idx, word): eight symbols of one byte in a word, the first in its lowest byte. Words that lie in a chunk are made where it is; only
    the first and last bytes of chunks, whose words others share, are brought together."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b["start"].to_pylist(), b["symbols"], strict=True):
                data, skip = data.as_buffer(), -start % 8
                words = np.frombuffer(data, "<i8", max(0, len(data) - skip) // 8, min(skip, len(data)))
                yield pa.RecordBatch.from_arrays([pa.array((start + skip) // 8 + np.arange(len(words))), pa.array(words)], ["word_idx", "word"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for start, n, head, tail in zip(*(b[c].to_pylist() for c in ("start", "n", "head", "tail")), strict=True):
                if start % 8:
                    out.append((start // 8, head[: 8 - start % 8].rjust(start % 8 + min(len(head), 8 - start % 8), b"\0")))
                if (start + n) % 8 and (start + n) // 8 * 8 >= start:
                    out.append(((start + n) // 8, tail[len(tail) - (start + n) % 8 :]))
            words = [int.from_bytes(w.ljust(8, b"\0"), "little", signed=True) for _, w in out]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array(words, pa.int64())], ["word_idx", "word"])

    chunks = with_starts(chunks)
    edges = chunks.select("start", size_of().alias("n"), F.substring("symbols", 1, 8).alias("head"), F.substring("symbols", -8, 8).alias("tail"))
    edges = edges.mapInArrow(shared, "word_idx long, word long").groupBy("word_idx").agg(F.bit_or("word").alias("word"))
    return chunks.select("start", "symbols").mapInArrow(whole, "word_idx long, word long").unionByName(edges)
