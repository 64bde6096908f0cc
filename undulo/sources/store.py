"""Stored indexes: Parquet folders, and headerless binary files of unsigned little-endian numbers.

Binary files are written and read where the rows are, a file a range: ``<path><range:04>.<extension>``, ranges in order, so the names' order joins them. Symbols have their
width, words and counts eight bytes. The extensions are fixed values.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undulo.sources.scratch import shuffles_dropped, stored, tasks_for
from undulo.sources.text import RANGE, file_system, in_order, keyed, symbols_of, with_starts

LEVEL, NODE, HISTOGRAM, ZEROS, TEXT = "lv_{}", "node_{}", "hist", "z", "txt"
#: Words that are read at once.
WORDS = 1 << 16


def write_index(path: str, words: DataFrame, hist: DataFrame, z: DataFrame | None = None) -> None:
    """Words of levels (or nodes) by partition, histogram, and for a matrix its zero counts, as Parquet."""
    words.write.mode("overwrite").partitionBy("node_id" if "node_id" in words.columns else "level").parquet(f"{path}/levels")
    hist.write.mode("overwrite").parquet(f"{path}/{HISTOGRAM}")
    if z is not None:
        z.write.mode("overwrite").parquet(f"{path}/{ZEROS}")


def read_levels(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """(level, word_idx, word), or by node_id; of one level, only its folder."""
    words = spark.read.parquet(f"{path}/levels")
    key = "node_id" if "node_id" in words.columns else "level"
    words = words.select(F.col(key).cast("long" if key == "node_id" else "int").alias(key), "word_idx", "word")
    return words if level is None else words.filter(F.col(key) == level)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{HISTOGRAM}")


def read_zeros(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{ZEROS}")


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


class Files:
    """Files of a task, one after another. A file is written beside its place and then moved there, so that a task may run again."""

    def __init__(self) -> None:
        self.token, self.path, self.done = uuid.uuid4().hex, None, []

    def open(self, path: str) -> None:
        self.close()
        self.path = path
        self.store, self.name = file_system(path)
        self.out = self.store.open_output_stream(f"{self.name}.{self.token}")

    def close(self) -> None:
        if self.path:
            self.out.close()
            self.store.move(f"{self.name}.{self.token}", self.name)
            self.done.append(self.name)
        self.path = None

    def rows(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array(self.done, pa.string())], ["file"])


def _create_folder_of(path: str) -> None:
    store, folder = file_system(path.rsplit("/", 1)[0])
    store.create_dir(folder)


def _written(files: DataFrame) -> int:
    """The number of files that tasks write."""
    with shuffles_dropped(files.sparkSession):
        return files.count()


def export(rows: DataFrame, order: list[str], value: str, width: int, path: str, extension: str, key: str | None = None) -> int:
    """Writes a column in an order as binary files, for each value of ``key`` its own, whose number takes the place of {} in the extension. Returns the number of files."""
    keys = [key] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for b in batches:
            values = b["value"].to_numpy()
            of = b["key"].to_numpy()
            for rows_ in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1):
                if not len(rows_):
                    continue
                name = f"{path}{b['part'][0].as_py():04}.{extension.format(of[rows_[0]])}"
                if name != files.path:
                    files.open(name)
                files.out.write(_packed(values[rows_], width))
        yield files.rows()

    _create_folder_of(path)
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    number = F.col(key).cast("long") if key else F.lit(0).cast("long")
    return _written(rows.select(F.spark_partition_id().alias("part"), number.alias("key"), F.col(value).cast("long").alias("value")).mapInArrow(run, "file string"))


def export_chunks(chunks: DataFrame, width: int, path: str, extension: str) -> int:
    """Writes the symbols of chunks as binary files where the chunks are: a file for those that a task finds one after another, ``<path><position>.<extension>``. Returns
    the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, end = Files(), None
        for b in batches:
            for start, own, data in zip(b["start"].to_pylist(), b["width"].to_pylist(), b["symbols"], strict=True):
                data = data.as_buffer()
                if start != end:
                    files.open(f"{path}{start:015}.{extension}")
                files.out.write(data if own == width else _packed(symbols_of(data, own), width))
                end = start + len(data) // own
        yield files.rows()

    _create_folder_of(path)
    return _written(with_starts(chunks).select("start", "width", "symbols").mapInArrow(run, "file string"))


def export_strings(df: DataFrame, column: str, key: str, path: str, extension: str) -> int:
    """Writes the UTF-8 bytes of strings, joined as ``from_strings`` joins them, as binary files where they are brought into their order: a file a range, ``<path><range>.<extension>``.
    Returns the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for b in batches:
            if not len(b):
                continue
            name = f"{path}{b['part'][0].as_py():015}.{extension}"
            if name != files.path:
                files.open(name)
            strings = b["value"].cast(pa.string())
            _, offsets, data = strings.buffers()
            ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1]
            if data is not None:
                files.out.write(data[int(ends[0]) : int(ends[-1])])
        yield files.rows()

    _create_folder_of(path)
    return _written(in_order(keyed(df, column, key), ["_key", "text"], "text", "byte").mapInArrow(run, "file string"))


def export_blocks(blocks: DataFrame, path: str) -> int:
    """The words of levels or nodes from (key, block, words), in the files of ``export_words``. Blocks that have a ``part`` are in their ranges, and written where they are."""
    key = "node_id" if "node_id" in blocks.columns else "level"
    extension, first = (LEVEL, 1) if key == "level" else (NODE, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        for b in batches:
            for part, of, words in zip(b["part"].to_pylist(), b[key].to_pylist(), b["words"], strict=True):
                name = f"{path}{part:04}.{extension.format(of + first)}"
                if name != files.path:
                    files.open(name)
                files.out.write(words.as_buffer())
        yield files.rows()

    _create_folder_of(path)
    if "part" not in blocks.columns:
        blocks = stored(blocks, "blocks")  # ranges look at rows twice
        size = blocks.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        blocks = blocks.repartitionByRange(tasks_for(blocks.sparkSession, size), key, "block").sortWithinPartitions(key, "block").withColumn("part", F.spark_partition_id())
    return _written(blocks.select("part", key, "words").mapInArrow(run, "file string"))


def _files_of_words(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, n, key): how many words a file has, and the number in its extension."""
    extension = (LEVEL if key == "level" else NODE).format("")
    files = spark.read.format("binaryFile").load(f"{path}*.{extension}*").select("path", "length")
    return files.select("path", F.expr("length div 8").alias("n"), F.regexp_extract("path", f"\\.{extension}([0-9]+)$", 1).cast("long").alias("key"))


def export_passes(passes: Iterator[DataFrame], path: str) -> int:
    """``export_blocks`` of the levels or nodes of each pass, one after another. Returns the number of files."""
    return sum(export_blocks(blocks, path) for blocks in passes)


class LevelFiles:
    """The words of levels, read by their places from the files that ``export_blocks`` or ``export_words`` wrote. Tasks have copies, each with ``OPEN`` files open at most."""

    OPEN = 64

    def __init__(self, spark: SparkSession, path: str):
        self.paths: dict[int, list[str]] = {}
        self.first: dict[int, list[int]] = {}  # the number of each file's first word, and of all words
        for r in sorted(_files_of_words(spark, path, "level").collect(), key=lambda r: (r.key, r.path)):  # a row for each 16 MB about
            self.paths.setdefault(r.key - 1, []).append(r.path)
            first = self.first.setdefault(r.key - 1, [0])
            first.append(first[-1] + r.n)
        self.opened: dict = {}

    def size(self, level: int) -> int:
        return self.first.get(level, [0])[-1]

    def read(self, level: int, start: int, end: int) -> np.ndarray:
        """The words from one to another; those that are not there are 0."""
        first, out = self.first[level], np.zeros(end - start, np.int64)
        k = max(0, bisect_right(first, start) - 1)
        while k + 1 < len(first) and first[k] < end:
            at, upto = max(start, first[k]), min(end, first[k + 1])
            if at < upto:
                out[at - start : upto - start] = np.frombuffer(self._file(self.paths[level][k]).read_at(8 * (upto - at), 8 * (at - first[k])), "<i8")
            k += 1
        return out

    def _file(self, path: str) -> pa.NativeFile:
        file = self.opened.pop(path, None)
        if file is None:
            if len(self.opened) >= self.OPEN:
                self.opened.pop(next(iter(self.opened))).close()  # the one not used for the longest time
            store, name = file_system(path)
            file = store.open_input_file(name)
        self.opened[path] = file
        return file


def read_words(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, word_idx, word) of the files that ``export`` wrote for all values of a key: level or node_id."""
    files = _files_of_words(spark, path, key)
    first = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = files.select("path", "key", "n", first.alias("first")).select("*", F.explode(F.expr(f"sequence(0L, n - 1, {RANGE // 8}L)")).alias("at"))
    kind = "long" if key == "node_id" else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, name = file_system(r["path"])
                with store.open_input_file(name) as f:
                    f.seek(8 * r["at"])
                    end = min(r["at"] + RANGE // 8, r["n"])
                    for at in range(r["at"], end, WORDS):
                        words = np.frombuffer(f.read(8 * min(WORDS, end - at)), "<i8")
                        own = np.full(len(words), r["key"] - (key == "level"))  # files count levels from 1
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64() if kind == "long" else pa.int32()), pa.array(r["first"] + at + np.arange(len(words))), pa.array(words)], [key, "word_idx", "word"])

    tasks = tasks_for(spark, 8 * (files.agg(F.sum("n")).first()[0] or 0))
    return ranges.repartitionByRange(tasks, "path", "at").mapInArrow(run, f"{key} {kind}, word_idx long, word long")


def export_words(words: DataFrame, path: str) -> int:
    """The words of levels or nodes, ``<path><range>.lv_<level + 1>`` or ``.node_<id>``."""
    key = "node_id" if "node_id" in words.columns else "level"
    if key == "level":
        words = words.withColumn("level", F.col("level") + 1)
    return export(words, ["word_idx"], "word", 8, path, LEVEL if key == "level" else NODE, key)


def histogram_bytes(rows: list[tuple[int, int]], width: int) -> bytes:
    """The number of symbols, then each symbol in ``width`` bytes with its count in eight."""
    out = np.uint64(len(rows)).astype("<u8").tobytes()
    return out + b"".join(s.to_bytes(width, "little") + n.to_bytes(8, "little") for s, n in sorted(rows))


def parse_histogram(data: bytes, width: int) -> list[tuple[int, int]]:
    n, step = int.from_bytes(data[:8], "little"), width + 8
    rows = (data[8 + k * step : 8 + (k + 1) * step] for k in range(n))
    return [(int.from_bytes(r[:width], "little"), int.from_bytes(r[width:], "little")) for r in rows]


def export_small(data: bytes, path: str) -> None:
    """A file of a small part: the histogram of an alphabet that the driver holds, or zero counts."""
    store, name = file_system(path)
    store.create_dir(name.rsplit("/", 1)[0])
    with store.open_output_stream(name) as f:
        f.write(data)


def import_small(path: str) -> bytes:
    store, name = file_system(path)
    with store.open_input_stream(name) as f:
        return f.read()


def export_histogram(rows: list[tuple[int, int]], width: int, path: str) -> None:
    export_small(histogram_bytes(rows, width), f"{path}.{HISTOGRAM}")


def import_histogram(spark: SparkSession, width: int, path: str) -> DataFrame:
    return spark.createDataFrame(parse_histogram(import_small(f"{path}.{HISTOGRAM}"), width), "raw long, occ long")


def export_zeros(z: dict[int, int], path: str) -> None:
    export_small(np.array([z[k] for k in sorted(z)], "<i8").tobytes(), f"{path}.{ZEROS}")


def import_zeros(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(np.frombuffer(import_small(f"{path}.{ZEROS}"), "<i8").tolist())), "level int, z long")
