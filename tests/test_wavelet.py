"""Builds against the step-by-step definition in plain Python, and edge cases."""

import numpy as np
import pytest

from undulo.functions.running import running_sum, with_positions
from undulo.operators import build as B
from undulo.operators import decode as D
from undulo.operators.split import split_plan, split_targets
from undulo.plans import alphabet as A
from undulo.sources import store
from undulo.sources import text as T


def levels_by_steps(codes, height, matrix):
    """Bits of each level: the text is stably reordered by the bit, within its node for a tree."""
    out, seq = [], list(codes)
    for level in range(height):
        shift = height - 1 - level
        out.append([c >> shift & 1 for c in seq])
        if matrix:
            seq = [c for c in seq if not c >> shift & 1] + [c for c in seq if c >> shift & 1]
        else:
            seq.sort(key=lambda c: c >> shift)
    return out


def words(bits):
    padded = bits + [0] * (-len(bits) % 64)
    values = [int("".join(map(str, padded[k : k + 64])), 2) for k in range(0, len(padded), 64)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


CASES = {
    "empty": [],
    "one": [7],
    "equal": [3] * 65,
    "63": [k % 5 for k in range(63)],
    "64": [k % 3 for k in range(64)],
    "65": [k % 2 for k in range(65)],
    "rising": list(range(130)),
    "nine": [int(x) for x in np.random.default_rng(1).integers(0, 9, 700)],
    "five": [int(x) for x in np.random.default_rng(2).integers(0, 5, 1000)],
}


def text_of(spark, raw):
    text = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "pos long, raw long")
    return text, A.effective_alphabet(A.histogram(text))


#: Cases that are also decoded, and built by nodes.
WHOLE = {("empty", "chunks"), ("one", "chunks"), ("65", "chunks"), ("nine", "chunks"), ("nine", "sorted")}


@pytest.mark.parametrize(("name", "way"), [*((name, "chunks") for name in CASES), ("empty", "sorted"), ("nine", "sorted"), ("rising", "sorted")])
def test_tree_and_matrix(spark, name, way, monkeypatch):
    raw = CASES[name]
    monkeypatch.setattr(T, "CHUNK", 50)
    monkeypatch.setattr(D, "CHUNK", 40)
    text, names = text_of(spark, raw)
    chunks = T.pack(text, ["pos"], "raw", "int")
    if way == "sorted":
        monkeypatch.setattr(A, "LARGEST", 0)
        names = A.effective_alphabet(A.histogram(text))
    rank = {r: k for k, r in enumerate(sorted(set(raw)))}
    want_codes = [rank[r] for r in raw]
    assert names.height == max(0, len(rank) - 1).bit_length() and (names.n, names.sigma) == (len(raw), len(rank))
    codes = A.effective_text(text, names)
    for kind, matrix in ((B.TREE, False), (B.MATRIX, True)):
        built = B.build(chunks, names, kind)
        got = {(r.level, r.word_idx): r.word for r in built.collect()}
        want = levels_by_steps(want_codes, names.height, matrix)
        assert got == {(level, k): w for level, bits in enumerate(want) for k, w in enumerate(words(bits))}
        if (name, way) not in WHOLE:
            continue
        decoded = D.decode(built, len(raw), names.height, kind)
        assert [r.code for r in decoded.orderBy("pos").collect()] == want_codes
        assert D.verify(built, codes, len(raw), names.height, kind).first().differences == 0
        if matrix and names.height:
            z = {level: bits.count(0) for level, bits in enumerate(want)}
            for df in (B.z_from_words(built, len(raw)), B.z_from_histogram(names)):
                assert z == {r.level: r.z for r in df.collect()}
    if names.height and (name, way) in WHOLE:
        nodes = B.build(chunks, names, B.NODES)
        assert [r.code for r in D.decode(nodes, len(raw), names.height, B.NODES).orderBy("pos").collect()] == want_codes
        for matrix, kind in ((False, B.TREE), (True, B.MATRIX)):
            merged = B.merge_nodes(nodes, names, matrix)
            assert sorted(merged.collect()) == sorted(B.build(chunks, names, kind).collect())
        sizes = A.node_sizes(names).collect()
        assert len(sizes) == A.max_nodes(names.height)
        assert {r.level: 0 for r in sizes}.keys() == set(range(names.height))
        assert all(sum(r.size for r in sizes if r.level == level) == len(raw) for level in range(names.height))


def test_words_in_order_over_ranges(spark):
    """Keys that go over the ends of ranges and batches."""
    rng = np.random.default_rng(4)
    rows = [(int(k), i, int(rng.integers(2))) for i, k in enumerate(np.sort(rng.integers(0, 4, 3000)))]
    df = spark.createDataFrame(rows, "level int, pos long, bit int").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.level, r.word_idx): r.word for r in B.words_in_order(df, "level", ["pos"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, i): w for k in range(4) for i, w in enumerate(words([b for key, _, b in rows if key == k]))}


def test_verify_fails_on_a_difference(spark):
    text, names = text_of(spark, CASES["five"])
    built = B.build(T.pack(text, ["pos"], "raw", "int"), names)
    wrong = A.effective_text(text, names).selectExpr("pos", "if(pos = 7, 4 - code, code) as code")
    with pytest.raises(Exception, match="1 symbols differ"):
        D.verify(built, wrong, names.n, names.height).collect()


@pytest.mark.parametrize("width", T.WIDTHS)
def test_binary_text(spark, tmp_path, width, monkeypatch):
    values = [1, 0, 255, 2 ** (8 * width) - 1, 77]
    data = b"".join(v.to_bytes(width, "little") for v in values) + b"\1" * (width - 1)
    for name in ("text.0", "text.1"):
        (tmp_path / name).write_bytes(data)
    path = str(tmp_path / "text.*")
    for buffer in (1, 2 * width, 1 << 20):
        rows = T.unpack(T.from_binary(spark, path, width, buffer=buffer)).orderBy("pos").collect()
        assert [(r.pos, r.raw) for r in rows] == list(enumerate(values * 2))
    assert T.unpack(T.from_binary(spark, str(tmp_path / "text.0"), width, prefix=3 * width)).count() == 3
    monkeypatch.setattr(T, "_reads_ranges", lambda path: False)
    rows = T.unpack(T.from_binary(spark, path, width, buffer=2 * width)).orderBy("pos").collect()
    assert [(r.pos, r.raw) for r in rows] == list(enumerate(values * 2))
    with pytest.raises(ValueError):
        T.from_binary(spark, path, 3)


def test_strings_with_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 2)
    docs = spark.createDataFrame([(5, "aé"), (2, None), (1, "😀"), (9, ""), (1, "b"), (1, "b"), (None, "nul"), (-3, "neg")], "id long, text string")
    for unit, joined in (("char", list(map(ord, "nulnegbb😀aé"))), ("byte", list("nulnegbb😀aé".encode()))):
        chunks = T.from_strings(docs.repartition(3), "text", "id", unit)
        rows = T.unpack(chunks).orderBy("pos").collect()
        assert [(r.pos, r.raw) for r in rows] == list(enumerate(joined))
        assert {r.raw: r.occ for r in A.packed_histogram(chunks).collect()} == {c: joined.count(c) for c in set(joined)}
        assert [r.raw for r in T.prefix(chunks, 5).orderBy("pos").collect()] == joined[:5]
    assert T.unpack(T.from_strings(docs.limit(0), "text", "id")).count() == 0


def test_running_sums_and_positions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 3), int(x), int(k)) for k, x in enumerate(rng.permutation(np.r_[rng.integers(-(2**62), 2**62, 300), np.arange(300)]))]
    df = spark.createDataFrame(rows, "k int, x long, v long")
    for inclusive in (False, True):
        got = {(r.k, r.x): r.s for r in running_sum(df, ["k"], "x", "v", "s", inclusive).collect()}
        assert got == {(k, x): sum(v2 for k2, x2, v2 in rows if k2 == k and (x2 < x or (inclusive and x2 == x))) for k, x, _ in rows}
    assert [r.x for r in with_positions(df, ["x"]).orderBy("pos").collect()] == sorted(x for _, x, _ in rows)


def test_store_round_trip(spark, tmp_path):
    text, names = text_of(spark, [k * k % 5 for k in range(1000)])
    chunks = T.pack(text, ["pos"], "raw", "int")
    for kind, key in ((B.MATRIX, "level"), (B.NODES, "node_id")):
        built = B.build(chunks, names, kind)
        path = str(tmp_path / f"index-{kind}")
        store.write_index(path, built, names.table, B.z_from_words(built, 1000) if kind == B.MATRIX else None)
        assert sorted(store.read_levels(spark, path).collect()) == sorted(built.collect())
        assert store.export_words(built, f"{path}/binary") > 0
        assert sorted(store.read_words(spark, f"{path}/binary", key).collect()) == sorted(built.collect())
    path = str(tmp_path / "index-matrix")
    assert store.read_levels(spark, path, 0).count() == 16
    assert store.read_histogram(spark, path).count() == names.sigma and store.read_zeros(spark, path).count() == names.height
    built = B.build(chunks, names, B.MATRIX)
    first = [r.word for r in built.filter("level = 0").orderBy("word_idx").collect()]
    files = sorted((tmp_path / "index-matrix").glob("binary*.lv_1"))
    assert b"".join(f.read_bytes() for f in files) == np.array(first, "<i8").tobytes()
    z = {r.level: r.z for r in B.z_from_words(built, 1000).collect()}
    store.export_zeros(z, f"{path}/small")
    assert {r.level: r.z for r in store.import_zeros(spark, f"{path}/small").collect()} == z
    rows = [(65, 3), (66, 1 << 40)]
    assert store.parse_histogram(store.histogram_bytes(rows, 5), 5) == rows
    store.export_histogram(rows, 2, f"{path}/small")
    assert sorted(map(tuple, store.import_histogram(spark, 2, f"{path}/small").collect())) == rows
    store.export(text, ["pos"], "raw", 5, f"{path}/text", store.TEXT)
    assert sorted(T.unpack(T.from_binary(spark, f"{path}/text*.txt", 5)).collect()) == sorted(text.collect())


def test_split_of_one_kind(spark):
    bits = spark.createDataFrame([(k, 0) for k in range(10)], "pos long, bit int")
    p = split_plan(bits, 4).first()
    assert (p.targets0, p.targets1, p.per0, p.per1) == (4, 0, 3, 0)
    assert [r.target for r in split_targets(bits, 4).orderBy("pos").collect()] == [k // 3 for k in range(10)]
