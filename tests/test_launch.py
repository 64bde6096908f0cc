"""The launcher: a file in, index files and a record out."""

import numpy as np
import pytest

from undulo import launch
from undulo.operators import build as B
from undulo.operators import decode as D
from undulo.operators import report
from undulo.sources import store


@pytest.mark.parametrize(("kind", "effective"), [("matrix", False), ("tree", True), ("nodes", False)])
def test_launch(spark, tmp_path, kind, effective):
    values = np.random.default_rng(3).choice([0, 1, 4, 9, 300], 500)
    (tmp_path / "text").write_bytes(values.astype("<u2").tobytes())
    out = f"{tmp_path}/out/index"
    record = launch.run(spark, ["-k", kind, "-w", "2", "-o", out, *(["-e"] if effective else []), str(tmp_path / "text")])
    row = record.first()
    sigma = 301 if effective else 5
    assert (row.algo, row.size, row.bps, row.alphabet, row.nodes) == (kind, 500, 2, sigma, 1)
    assert row.time_input > 0 and row.time_hist > 0 and row.time_construct > 0 and row.traffic > 0
    assert report.result_line(record).first().line.startswith(f"RESULT algo={kind} nodes=1 ")
    assert report.summary(record).count() == 1
    words = store.read_words(spark, out, "node_id" if kind == B.NODES else "level")
    rank = {v: v if effective else k for k, v in enumerate(sorted(set(values.tolist())))}
    height = (sigma - 1).bit_length()
    assert [r.code for r in D.decode(words, 500, height, kind).orderBy("pos").collect()] == [rank[v] for v in values.tolist()]
    hist = {r.raw: r.occ for r in store.import_histogram(spark, 2, out).collect()}
    assert {k: n for k, n in hist.items() if n} == {int(v): int((values == v).sum()) for v in set(values.tolist())} and len(hist) == sigma
    if kind == B.MATRIX:
        z = {r.level: r.z for r in store.import_zeros(spark, out).collect()}
        assert z == {r.level: r.z for r in B.z_from_words(words, 500).collect()}


def test_measured_tells_its_steps(spark):
    told = []
    row = report.measured(spark, "none", "-", 1, 1, 1, {"input": lambda: spark.range(10).count(), "merge": lambda: None}, lambda name, s: told.append((name, s))).first()
    assert [t[0] for t in told] == ["input", "merge"] and row.time_input == told[0][1]
