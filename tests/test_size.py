"""What must not grow with the input: the work of a task, what a worker holds, what is shuffled."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from test_plans import exchanges, plan_of
from undulo.operators import build as B
from undulo.operators import decode as D
from undulo.plans import alphabet as A
from undulo.plans.queries import QUERIES, Text
from undulo.sources import scratch, store
from undulo.sources import text as T


def test_a_build_holds_no_word_in_a_hash_map(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 14)
    t = Text(spark, sf_dir, "chars")
    plan = plan_of(t.build(B.TREE))
    assert "keys=[level" not in plan and "word_idx" not in "".join(exchanges(plan))
    tasks = -(-t.alphabet.n * t.alphabet.height // 8 // (1 << 14))
    assert f", {tasks})" in plan and tasks > 4  # more for more words, not as many as shuffle partitions are set


def test_blocks_are_words_together(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 2)
    monkeypatch.setattr(T, "CHUNK", 50)
    from test_wavelet import CASES, text_of

    text, names = text_of(spark, CASES["nine"])
    chunks = T.pack(text, ["pos"], "raw", "int")
    for kind in (B.TREE, B.MATRIX, B.NODES):
        key = "node_id" if kind == B.NODES else "level"
        words = {}
        for r in B.build_blocks(chunks, names, kind).collect():
            for k, w in enumerate(np.frombuffer(r.words, "<i8").tolist()):
                words[r[key], r.block * 2 + k] = w
        assert words == {(r[key], r.word_idx): r.word for r in B.build(chunks, names, kind).collect()}


def test_strings_are_turned_into_symbols_in_pieces(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 10)
    column = pa.array(["left out", "abc", "", "defghi", "é" * 9, "x", "y"]).slice(1)
    pieces = list(T._joined(column))
    assert b"".join(pieces).decode() == "abcdefghi" + "é" * 9 + "xy"
    assert len(pieces) == 3  # a string that is longer is a piece of its own


def test_packing_takes_more_tasks_for_more_text(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 14)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = docs.selectExpr("sum(octet_length(text) + 32)").first()[0]
    assert T._tasks(docs, "text", "char") == -(-size // (1 << 14)) > 4
    chunks = T.from_strings(docs, "text", "doc_id")
    assert chunks.select("part").distinct().count() > 4


def test_ranges_of_strings_are_found_by_beginnings_of_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 10)
    monkeypatch.setattr(T, "SAMPLE", 1 << 14)
    plans = {}
    monkeypatch.setattr(T, "stored", lambda df, name: plans.setdefault(name, plan_of(df)) and scratch.stored(df, name))
    rng = np.random.default_rng(8)
    keys = [None, 1, 2]
    rows = [(keys[k], "é𝄞"[: int(a)] * int(b) + "".join(map(chr, tail))) for k, a, b, tail in zip(rng.integers(0, 3, 400), rng.integers(0, 3, 400), rng.integers(0, 9, 400), rng.integers(97, 99, (400, 3)), strict=True)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    size = sum(len(t.encode()) + 32 for _, t in rows)
    chunks = T.from_strings(df, "text", "id")
    tasks = -(-size // (1 << 10))
    width = int(re.search(r"rangepartitioning\(_key#\w+ ASC NULLS FIRST, substring\(text#\w+, 1, (\d+)\)", plans["chunks"])[1])  # not whole texts
    assert 1 <= width and width * T.SAMPLED * tasks <= 1 << 14
    assert chunks.select("part").distinct().count() > 4
    whole = "".join(t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())))
    assert "".join(chr(r.raw) for r in T.unpack(chunks).orderBy("pos").collect()) == whole


def test_words_of_chunks_share_their_edges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for size in (3, 13, 64):
        monkeypatch.setattr(T, "CHUNK", size)
        raw = rng.integers(0, 256, 301)
        text = spark.createDataFrame([(k, int(r)) for k, r in enumerate(raw)], "pos long, raw long")
        chunks = T.pack(text, ["pos"], "raw", "int")
        df = T.in_words(chunks)
        got = {r.word_idx: r.word for r in df.collect()}
        padded = np.r_[raw, np.zeros(3, np.int64)].astype(np.uint8)
        assert got == dict(enumerate(padded.view("<i8").tolist())) and df.count() == len(got)
        assert all(keys.startswith(("word_idx", "part")) for keys in exchanges(plan_of(df)))


def test_chunks_are_written_without_a_shuffle_of_symbols(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    raw = [int(x) for x in np.random.default_rng(6).integers(0, 70_000, 500)]
    text = spark.createDataFrame(list(enumerate(raw)), "pos long, raw long")
    chunks = T.pack(text, ["pos"], "raw", "int")
    n = store.export_chunks(chunks, 4, str(tmp_path / "out" / "text"), "txt")
    files = sorted((tmp_path / "out").glob("text*.txt"))
    assert len(files) == n and b"".join(f.read_bytes() for f in files) == np.array(raw, "<u4").tobytes()


def test_exported_blocks_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 2)
    monkeypatch.setattr(scratch, "TASK_BYTES", 200)
    from test_wavelet import CASES, text_of

    text, names = text_of(spark, CASES["nine"])
    chunks = T.pack(text, ["pos"], "raw", "int")
    for kind, key in ((B.MATRIX, "level"), (B.NODES, "node_id")):
        path = str(tmp_path / kind / "index")
        assert store.export_blocks(B.build_blocks(chunks, names, kind), path) > 1
        read = store.read_words(spark, path, key)
        assert read.rdd.getNumPartitions() > 1
        assert sorted(read.collect()) == sorted(B.build(chunks, names, kind).collect())


def test_chunks_are_verified_without_a_broadcast_of_words(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 50)
    monkeypatch.setattr(D, "CHUNK", 64)
    from test_wavelet import CASES, text_of

    raw = CASES["five"]
    text, names = text_of(spark, raw)
    chunks = T.pack(text, ["pos"], "raw", "int")
    built = B.build(chunks, names)
    right = D.verify_chunks(built, chunks, names)
    assert "BroadcastHashJoin [level" not in plan_of(right) and plan_of(right).count("SortMergeJoin") >= 1
    assert right.first().differences == 0
    wrong = list(raw)
    wrong[7], wrong[700], wrong[701] = (raw[7] + 1) % 5, 9, 9  # one symbol for another, and two that the alphabet lacks
    other, _ = text_of(spark, wrong)
    with pytest.raises(Exception, match="3 symbols differ"):
        D.verify_chunks(built, T.pack(other, ["pos"], "raw", "int"), names).collect()


@pytest.mark.parametrize("kind", [B.TREE, B.MATRIX, B.NODES])
def test_a_large_alphabet_is_sorted_by_more_tasks_for_more_bits(spark, sf_dir, monkeypatch, kind):
    small = sorted(Text(spark, sf_dir, "users").build(kind).collect())
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 11)
    monkeypatch.setattr(A, "LARGEST", 0)
    plans = {}
    monkeypatch.setattr(B, "stored", lambda df, name: plans.setdefault(name, plan_of(df)) and scratch.stored(df, name))
    t = Text(spark, sf_dir, "users")
    built = t.build(kind)
    bits = t.alphabet.n * t.alphabet.height
    assert f", {-(-32 * bits // (1 << 11))}), REPARTITION_BY_NUM" in plans["packed-ranges"]  # not as few as shuffle partitions are set
    assert "_raw" not in plans["codes"]  # chunks hold codes, which meet no alphabet again
    assert re.search(r"hashpartitioning\((level|node_id)#\w+, word_idx#\w+, \d+\), REPARTITION_BY_NUM", plan_of(built))
    assert sorted(built.collect()) == small


@pytest.mark.parametrize("kind", [B.TREE, B.MATRIX, B.NODES])
def test_blocks_are_written_by_the_tasks_that_put_them_together(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(B, "BLOCK", 2)
    monkeypatch.setattr(T, "CHUNK", 50)
    monkeypatch.setattr(scratch, "TASK_BYTES", 50)
    monkeypatch.setattr(B, "PASS_BYTES", 200)
    written = []
    monkeypatch.setattr(store, "stored", lambda df, name: written.append(name) or scratch.stored(df, name))
    from test_wavelet import CASES, text_of

    text, names = text_of(spark, CASES["nine"])
    chunks = T.pack(text, ["pos"], "raw", "int")
    passes = list(B.blocks_in_passes(chunks, names, kind))
    key = "node_id" if kind == B.NODES else "level"
    path, n, seen = str(tmp_path / kind / "index"), 0, []
    for blocks in passes:
        assert not [e for e in exchanges(plan_of(blocks)) if key in e or "block" in e] and plan_of(blocks).count("REPARTITION_BY_NUM") == 1
        rows = [(r.part, r[key], r.block) for r in blocks.collect()]
        assert rows == sorted(rows) and len(set(rows)) == len(rows) and len({r[0] for r in rows}) > 1
        seen.append({k.bit_length() - 1 if kind == B.NODES else k for _, k, _ in rows})
        n += store.export_blocks(blocks, path)
    assert seen == [{0, 1}, {2, 3}]  # no more levels in a pass than its bytes
    assert n > 2 and not written  # nor are blocks kept on the way
    assert sorted(store.read_words(spark, path, key).collect()) == sorted(B.build(chunks, names, kind).collect())


def test_strings_are_written_without_chunks(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 10)
    rows = [(5, "aé"), (2, None), (1, "😀" * 300), (9, ""), (1, "b" * 700), (1, "b" * 700), (None, "nul" * 400), (-3, "neg")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    monkeypatch.setattr(T, "stored", None)
    n = store.export_strings(docs, "text", "id", str(tmp_path / "out" / "text"), "txt")
    files = sorted((tmp_path / "out").glob("text*.txt"))
    assert len(files) == n > 2
    assert b"".join(f.read_bytes() for f in files).decode() == "nul" * 400 + "neg" + "b" * 1400 + "😀" * 300 + "aé"
    monkeypatch.undo()
    made = []
    monkeypatch.setattr(T, "stored", lambda df, name: made.append(name) or scratch.stored(df, name))
    assert QUERIES["verify_stored_bytes"](spark, sf_dir).first().differences == 0
    assert made == ["chunks"]  # of the text that is read back


@pytest.mark.parametrize("kind", [B.TREE, B.MATRIX])
@pytest.mark.parametrize("case", ["one", "65", "five", "nine"])
def test_files_are_verified_without_a_shuffle(spark, tmp_path, monkeypatch, case, kind):
    from test_wavelet import CASES, text_of

    for module, name, value in ((B, "BLOCK", 2), (B, "PASS_BYTES", 150), (D, "BLOCK", 3), (T, "CHUNK", 50), (D, "STEP", 170), (D, "AHEAD", 64), (D, "TIMES", 2), (D, "CHUNK", 64), (scratch, "TASK_BYTES", 200), (store.LevelFiles, "OPEN", 2)):
        monkeypatch.setattr(module, name, value)
    raw = CASES[case]
    text, names = text_of(spark, raw)
    chunks = T.pack(text, ["pos"], "raw", "int")
    path = str(tmp_path / "index")
    store.export_passes(B.blocks_in_passes(chunks, names, kind), path)
    made = []
    monkeypatch.setattr(scratch, "fresh", lambda spark, name: made.append(name))
    right = D.verify_files(path, chunks, names, kind)
    assert right.first().differences == 0 and not made
    assert names.height == 0 or all(keys.startswith("part") for keys in exchanges(plan_of(right))) and "SortMergeJoin" not in plan_of(right)
    monkeypatch.undo()
    if len(raw) < 800:
        return
    wrong = list(raw)
    wrong[7], wrong[700], wrong[701] = (raw[7] + 1) % 5, 9, 9  # one symbol for another, and two that the alphabet may lack
    differ = sum(a != b for a, b in zip(raw, wrong, strict=True))
    for other, n in ((wrong, differ), (raw[:-5], 5), ([*raw, 1, 1], 2)):
        with pytest.raises(Exception, match=f"{n} symbols differ"):
            D.verify_files(path, T.pack(text_of(spark, other)[0], ["pos"], "raw", "int"), names, kind).collect()
    whole = B.build(chunks, names, kind)
    if kind == B.TREE:  # one bit of one word
        damaged = whole.withColumn("word", F.when((F.col("level") == names.height - 1) & (F.col("word_idx") == 3), F.col("word").bitwiseXOR(F.lit(1 << 20))).otherwise(F.col("word")))
        store.export_words(damaged, str(tmp_path / "damaged"))
        with pytest.raises(Exception, match="1 symbols differ"):
            D.verify_files(str(tmp_path / "damaged"), chunks, names, kind).collect()
    store.export_words(whole.filter("level > 0 or word_idx > 0"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="level 0 of .* words"):
        D.verify_files(str(tmp_path / "short"), chunks, names, kind)


def test_shuffles_of_tables_in_between_are_deleted_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 50)
    seen = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, real=DataFrameWriter.parquet: seen.append(self._spark.conf.get(scratch.CLEANUP)) or real(self, path))
    before = spark.conf.get(scratch.CLEANUP)
    text = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("raw"))
    chunks = T.pack(text, ["pos"], "raw", "int")
    assert seen and set(seen) == {"true"} and spark.conf.get(scratch.CLEANUP) == before
    with pytest.raises(ValueError), scratch.shuffles_dropped(spark):
        raise ValueError
    assert spark.conf.get(scratch.CLEANUP) == before
    assert T.unpack(chunks).count() == 500
