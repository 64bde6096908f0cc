"""The operators against brute force, round trips and held-out labels, with nulls, empty and long texts, repeats, empty tables and
clashing names."""

import hashlib
import re
import re._parser as sre
import struct
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from undulo.llm import chat_format as chat  # noqa: E402
from undulo.llm import embedding_dedup as emb  # noqa: E402
from undulo.llm import license_scan as lic  # noqa: E402
from undulo.llm import minhash_dedup as mh  # noqa: E402
from undulo.llm import mixing, queries, sharding  # noqa: E402
from undulo.llm import quality_classifier as qc  # noqa: E402
from undulo.llm import quality_rules as qr  # noqa: E402
from undulo.llm import sentencepiece_codec as sp  # noqa: E402
from undulo.llm import token_counts as tc  # noqa: E402
from undulo.llm.common import shingle_set, word_hashes, words_of  # noqa: E402
from undulo.llm.components import components  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "a", " a", "a ", "a  b", "  ", "a▁ b", "▁▁a b  ", "é ü 你好 😀 x", "\x00a b", "\x01 a", "a\nb \n c", "a　 b", "<s> </s> x<unk>", " ", "a<|endoftext|> b", "a  <|endoftext|>  b", "it's '  s", "a \t b", "w " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeats, ties, a long text, and columns that operators use themselves."""
    base = " ".join(f"word{k}" for k in range(60))
    texts = [None, "", " \n", "Tiny text", base, base, base.upper(), base + " more", "x " * 20000, *HARD]
    rows = [(k, t, None if k % 3 else "en", None if k == 1 else f"s{k % 4}", None) for k, t in enumerate(texts)]
    rows += [(None, base, "en", "s1", 3), (None, None, None, None, None), rows[4], rows[4]]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["held", "place", "shard", "slot", "bucket", "kept", "score", "pieces", "licenses", "rules", "key", "node", "size", "number"]
    return df.selectExpr("*", *[f"doc_id as {n}" for n in names]), rows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_duckdb(spark, sf_dir, name):
    import oracle

    assert not oracle.difference(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name])


# 1


def test_classifier_on_held_out_labels(spark, sf_dir):
    found = by_id(queries.QUERIES["op1_quality_classifier"](spark, sf_dir))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in found)
    assert np.mean([found[k].predicted == labels[k] for k in held]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())


def test_classifier_odd_rows(spark, odd):
    df, rows = odd
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 0), (5, 1), (5, 0), (None, 1), (3, None), (99, 1), (7, 7)], "doc_id long, quality int")
    scored = qc.with_score(df, qc.fit(df, labels, "doc_id", "quality"))
    assert scored.count() == len(rows) and scored.filter("score is null or score not between 0 and 1").count() == 0
    none = qc.fit(df, labels.limit(0), "doc_id", "quality")
    assert {r.score for r in qc.with_score(df, none).select("score").collect()} == {0.5}


def test_dual_descent_separates():
    places = [np.array([1, 2]), np.array([1, 3]), np.array([2, 4]), np.array([3, 4])]
    rows = [qc.packed(p.astype(np.int32)) for p in places]
    assert all((qc.unpacked(r) == p).all() for r, p in zip(rows, places, strict=True))
    long = np.arange(0, qc.WIDTH, 3, dtype=np.int32)
    assert len(qc.packed(long)) == qc.WIDTH // 8 + 1 and (qc.unpacked(qc.packed(long[::30000])) == long[::30000]).all() and (qc.unpacked(qc.packed(long)) == long).all()
    labels = np.array([1, 1, 0, 0])
    ratio = qc.log_count_ratio(rows, labels)
    w, b = qc.dual_descent(rows, labels, ratio, 1.0, 50, 1)
    assert [float(w[p] @ ratio[p]) + b > 0 for p in places] == [True, True, False, False]


# 2


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(k, label) for k in range(len(words)) for p, label in lic.BASE.items() if words[k : k + len(p.split())] == p.split()]
    norm, hits = f" {' '.join(words)} ", []
    for _, pattern, label, level, place, sure in lic.rules():  # all of them, none behind a gate
        for m in re.finditer(pattern, norm):
            start = norm[: m.start()].count(" ") - 1
            hits.append((start, start + m[0].count(" ") + 1, level, place, label, sure))
    rank = lambda h: (h[2], h[0] - h[1], h[3])
    kept = [h for h in hits if not any(o is not h and o[0] <= h[0] and o[1] >= h[1] and rank(o) < rank(h) for o in hits)]
    base = {label for _, label in at}
    sure = max([h[5] for h in kept] + [0.75] * bool(at), default=0.0)
    return (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | {h[4] for h in kept})), sure, sorted((h[0], h[1], h[4]) for h in kept))


def found_licenses(spark, said):
    """Labels of texts, checked against brute force."""
    out = {}
    for r in lic.with_licenses(spark.createDataFrame(list(enumerate(said)), "id long, text string")).collect():
        x = r.licenses
        got = (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score, sorted((d.start, d.end, d.label) for d in x.detections))
        assert got == brute_licenses(r.text), r.text
        out[r.text] = x.labels.split(",") if x.labels else []
    return out


def test_licenses(spark, docs, odd):
    said = [
        "SPDX-License-Identifier: GPL-3.0-only; licensed under the Apache License, Version 2.0. mit MIT License cc by sa cc by the BSD 3-clause license",
        "Released under the terms of the GNU Lesser General Public License v3 or the GNU General Public License version 2",
        "CC-BY " * 50 + "mit licence MIT LICENSE apache license apache",
    ]
    found_licenses(spark, [*said, *(r[1] for r in odd[1]), *docs[1].values()])
    assert lic.with_licenses(odd[0]).filter("licenses.n_base > 0").count() == 0
    assert 200 < len(lic.NAMES) + len(lic.SENTENCES)


def wordings(pattern):
    """The texts that a pattern matches: each alternative, options with and without, one member of a set."""
    def one(op, value):
        if op is sre.LITERAL:
            return [chr(value)]
        if op is sre.IN:
            kind, first = value[0]
            return [chr(first if kind is sre.LITERAL else first[0])]
        if op is sre.MAX_REPEAT:
            low, high, part = value
            return {text * n for n in {low, max(low, 1)} for text in every(part)}
        if op is sre.SUBPATTERN:
            return every(value[3])
        assert op is sre.BRANCH, op
        return [text for part in value[1] for text in every(part)]

    def every(part):
        return ["".join(texts) for texts in product(*[one(*step) for step in part])]

    return every(sre.parse(pattern))


def test_license_keywords():
    for keyword, pattern, _, level, _, _ in lic.rules():
        assert lic.need(keyword, pattern) in (pattern if "spdx" in pattern else keyword) and level in lic.LEVELS
        for text in wordings(pattern[6:-5]):
            assert keyword in f" {text} ", (keyword, text)


def test_licenses_by_identifier_and_text(spark):
    said = {f"// SPDX-License-Identifier: {name}": label for name, label in {
        "EPL-2.0": "epl", "OFL-1.1": "ofl", "BSL-1.0": "boost", "AFL-3.0": "afl", "PSF-2.0": "psf", "MS-PL": "ms-pl", "ODbL-1.0": "odbl", "GFDL-1.3": "gfdl", "GPL-2.0-or-later": "gpl", "MIT": "mit", "CC-BY-NC-SA-4.0": "cc-by-nc-sa",
    }.items()} | {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\")": "mit",
        "Permission is hereby granted, free of charge ...": "mit",
        "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "boost",
        "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    }
    sentences = [text for _, _, sentence, _, _ in lic.SENTENCES for text in wordings(sentence)[-1:]]
    found = found_licenses(spark, [*said, *sentences])
    for text, label in said.items():
        assert label in found[text], text
    assert not [text for text in sentences if not found[text]]


def test_licenses_by_name(spark):
    said = {
        "Distributed under the Apache 2.0": "apache",
        "available under the MIT": "mit",
        "Released under the terms of the BSD 3-clause": "bsd",
        "Distributed under BSD 3-clause terms": "bsd",
        "Published under Creative Commons Attribution 4.0 International": "cc-by",
        "Mozilla Public 2.0": "mpl",
        "MPL 2.0": "mpl",
        "Released under Mozilla Public v2": "mpl",
        "Distributed under the Expat License": "mit",
        "GNU Affero General Public License v3": "agpl",
        "GNU Lesser General Public License version 2.1 or later": "lgpl",
        "This is LGPLv3": "lgpl",
        "GPLv2+ or newer": "gpl",
        "two clause BSD": "bsd",
        "under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa",
        "CC BY-NC-ND 3.0": "cc-by-nc-nd",
    }
    found = found_licenses(spark, said)
    for text, label in said.items():
        assert set(found[text]) - {"cc-by"} <= {label} and label in found[text], (text, found[text])


def test_licenses_not_meant(spark):
    said = [
        "licensed to the general public",
        "Python 3 is required. See license.",
        "PHP 7 and Ruby 2, driver's license",
        "MIT 2019 admission license",
        "Apache helicopters, version 2, need a licence",
        "boost 2 your sales. fishing license 3",
        "Vim 8 and zlib 1.2.11; licence plate 12",
        "the artistic 2 dancers, open font 12, postgresql 14, openssl 3",
    ]
    assert not any(found_licenses(spark, said).values())


def test_licenses_of_a_text_with_very_many(spark):
    """Hits in a row, nested and repeated: suppression holds each against all before."""
    rng = np.random.default_rng(4)
    said = ["MIT License", "CC BY-SA 4.0", "GNU Lesser General Public License v3", "licensed under the BSD", "general public licence 2", "word", "spdx license identifier mit"]
    texts = [" ".join(rng.choice(said, n)) for n in (1, 2, 3, 60)]
    found_licenses(spark, texts)
    many = lic.with_licenses(spark.createDataFrame([("MIT License or else. " * 20_000,)], "text string")).first().licenses
    assert (many.n_base, len(many.detections), many.labels) == (20_000, 20_000, "mit")


# 3


def test_sharding(spark, docs, odd):
    for df, n, shards in ((docs[0], len(docs[1]), 40), (odd[0], len(odd[1]), 7), (odd[0].limit(0), 0, 40)):
        rows = sharding.with_shards(df, shards, bucket_bytes=20_000).collect()
        assert len(rows) == n
        sizes = Counter(r.shard for r in rows)
        assert max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    again = sharding.with_shards(docs[0].repartition(5), bucket_bytes=20_000)
    assert sorted(again.select("doc_id", "shard", "slot").collect()) == sorted(sharding.with_shards(docs[0], bucket_bytes=20_000).select("doc_id", "shard", "slot").collect())
    assert sorted(sharding.fisher_yates(100, 3)) == list(range(100))


def test_sharding_of_copies_and_maps(spark, monkeypatch):
    """A third of all rows equal in every column, a map among them: no bucket grows, and no row is lost."""
    monkeypatch.setattr(sharding, "COPIES", 50)
    monkeypatch.setattr(sharding, "SPAN", 4)
    df = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text", "map('k', if(id % 3 = 0, null, id)) as m")
    places, total = sharding.with_places(df, bucket_bytes=2000)
    assert total == 3000 and sorted(r.place for r in places.collect()) == list(range(3000))
    rows = sharding.with_shards(df, 7, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text, r.m["k"]) for r in rows) == Counter((r.doc_id, r.text, r.m["k"]) for r in df.collect())
    by_shard = Counter(r.shard for r in rows if r.doc_id == -1)
    assert max(by_shard.values()) < 200 and max(Counter(r.shard for r in rows).values()) == 429
    again = sharding.with_shards(df.repartition(5), 7, bucket_bytes=2000).collect()
    of = lambda rows: sorted((r.shard, r.slot, r.doc_id) for r in rows)
    assert of(again) == of(rows)
    monkeypatch.setattr(sharding, "CELL_BITS", 3)
    assert sorted(r.place for r in sharding.with_places(df, bucket_bytes=2000)[0].collect()) == list(range(3000))


def brute_places(rows, deals, seed, bits):
    """Places by the definition: buckets in order, each in the order of the hash, then swapped from the last place on."""
    buckets = {}
    for row, deal in zip(rows, deals, strict=True):
        buckets.setdefault((deal % 2**64) >> (64 - bits) if bits else 0, []).append((deal, row))
    out = []
    for number in sorted(buckets):
        own = [row for _, row in sorted(buckets[number])]
        other = np.random.default_rng(seed * 1_000_003 + number).integers(0, np.arange(len(own), 0, -1)).tolist()
        for k in range(len(own) - 1, 0, -1):
            j = other[len(own) - 1 - k]
            own[k], own[j] = own[j], own[k]
        out += own
    return out


def test_places_by_definition(spark, docs):
    df = docs[0].select("doc_id", "text")
    dealt = {r.doc_id: r.deal for r in df.select("doc_id", F.xxhash64(F.lit(sharding.SEED), "doc_id", "text").alias("deal")).collect()}
    size = sum(32 + len((t or "").encode()) for t in docs[1].values())
    places, _ = sharding.with_places(df, bucket_bytes=50_000)
    got = [r.held.doc_id for r in sorted(places.collect(), key=lambda r: r.place)]
    assert got == brute_places(list(dealt), list(dealt.values()), sharding.SEED, (size // 50_000).bit_length())


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs[0], str(tmp_path / "shards"))
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.doc_id: r.text for r in read.collect()} == docs[1]


# 4


def spans(lib, text):
    """Ids and bounds as the library gives them."""
    found = lib.encode(text, return_type="proto").pieces
    return [p.id for p in found], [p.begin for p in found] + [p.end for p in found[-1:]]


def test_pieces(spark, docs, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*HARD, *list(docs[1].values())[:60]]
    model = sp.codec(PIECES)
    assert model.by_part
    for t, (ids, bounds) in zip(texts, model.encode(texts), strict=True):
        want, at = spans(lib, t)
        assert (ids, bounds.tolist() if ids else []) == (want, at), t
        assert ids == lib.encode(t) and model.decode(ids) == lib.decode(ids)
    for r in sp.with_pieces(odd[0], PIECES).collect():
        ids = lib.encode(r.text) if r.text else []
        assert (r.pieces.ids, r.pieces.decoded) == (ids, lib.decode(ids) if ids else "")
        assert r.pieces.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def character_map(keys):
    """A double array by hand for keys that begin with different bytes or extend one another: texts to texts."""
    units, texts, free = [0] * (1 << 14), b"", 1
    nodes = {}  # prefix -> offset of its children
    prefixes = sorted({k[:n] for k in keys for n in range(len(k) + 1)}, key=lambda p: (len(p), p))
    for k in prefixes:
        nodes[k] = free << 8
        free += 1
    at = {b"": 0}
    for p in prefixes[1:]:
        at[p] = nodes[p[:-1]] ^ p[-1]
    for p in prefixes:
        leaf = p in keys
        units[at[p]] = (p[-1] if p else 0) | leaf << 8 | (nodes[p] ^ at[p]) << 10
        if leaf:
            units[nodes[p]] = 1 << 31 | len(texts)
            texts += keys[p] + b"\0"
    trie = np.array(units, np.uint32).astype("<u4").tobytes()
    return len(trie).to_bytes(4, "little") + trie + texts


@pytest.mark.parametrize("options", [{}, {"dummy_prefix": 0}, {"squeeze": 0}, {"squeeze": 0, "dummy_prefix": 0}])
def test_pieces_by_character_map(options):
    """Another normaliser, a user-defined symbol, no bytes to fall back to: ids and spans are the library's."""
    import sentencepiece

    keys = {b"a": b"x", b"ab": b"yz", "é".encode(): b"e", "　".encode(): b" ", b"\t": b" ", "…".encode(): b" . . ", b"q": b"", "ﬁ".encode(): b"fi"}
    with open(PIECES, "rb") as f:
        model = f.read()
    symbol = sp._field(1, sp._field(1, b"abba") + b"\x15" + struct.pack("<f", 0.0) + sp._field(3, 4))
    kept = []
    for number, value in sp._fields(model):  # without the pieces for bytes, and so without the option that asks for them
        piece = dict(sp._fields(value)) if number == 1 else {}
        if number == 1 and piece.get(3) != 6:
            kept.append(sp._field(1, value))
        elif number == 2:
            kept.append(sp._field(2, b"".join(sp._field(k, v) for k, v in sp._fields(value) if k in (3, 4, 40, 41, 42, 43))))
    model = sp.with_normalizer(b"".join([*kept, symbol]), charsmap=character_map(keys), **{"dummy_prefix": 1, "squeeze": 1} | options)
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Codec(model)
    assert codec.normalize.map and codec.normalize.symbols
    texts = [*HARD, "  ab  aca ", "abbab abba", "é…é  ﬁ q qq", "x　　y\t\tz", "你好吗 ab 你", "… a …", "q", " q ", "日本 日本語 ☃☃ a☃"]
    for t, (ids, bounds) in zip(texts, codec.encode(texts), strict=True):
        want, at = spans(lib, t)
        assert (ids, bounds.tolist() if ids else []) == (want, at), t


# 5


def brute_targets(sizes):
    """By the definition: weights in the order of code points, what is above twice a size shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, found = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in found]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return found | share
        for s in over:
            found[s] = 2 * sizes[s]
            left -= 2 * sizes[s]


def test_mixing_of_many_sources(spark, monkeypatch):
    """Sources in several groups, and against the definition: what is taken of each row is what its blocks' draws say."""
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 7)
    rows = [(k, f"s{k % 60:02d}" if k % 61 else None, " ".join(f"w{i}" for i in range(k * 7 % 50))) for k in range(600)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", block=8)
    taken = mixing.with_taken(mixed).collect()
    sizes, got = Counter(), Counter()
    for r in taken:
        sizes[r.source] += r.size
        got[r.source] += r.taken
    goal = brute_targets(sizes)
    assert {r.source: r.target for r in taken} == {s: pytest.approx(g) for s, g in goal.items()}
    assert all(abs(got[s] - goal[s]) <= 16 for s in goal) and len(goal) == 61
    draws = Counter((r.number, r.block) for r in mixed.pieces.select("number", "block", "draw").distinct().collect())
    for r in taken:
        at = range(r.offset // 8, (r.offset + r.size - 1) // 8 + 1) if r.size else []
        words = {b: min(r.offset + r.size, 8 * b + 8) - max(r.offset, 8 * b) for b in at}
        assert r.taken == sum(n * draws[r.number, b] for b, n in words.items())
    per_shard = Counter(r.shard for r in mixed.pieces.select("shard", "number", "draw").distinct().collect())
    assert max(per_shard.values()) - min(per_shard.values()) <= len(goal)


def test_mixing(spark, docs, odd):
    for df in (docs[0], odd[0], odd[0].limit(0)):
        rows = mixing.with_taken(mixing.mix(df, "doc_id", block=8)).collect()
        assert len(rows) == df.count()
        sizes, taken, goal = Counter(), Counter(), {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            goal[r.source] = r.target
        for s in sizes:
            assert abs(taken[s] - goal[s]) <= 16 and goal[s] <= 2 * sizes[s] + 1e-9
        assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert {s: pytest.approx(g) for s, g in brute_targets(sizes).items()} == goal
    again = mixing.with_taken(mixing.mix(docs[0].repartition(3), "doc_id", block=8)).select("key", "taken")
    assert sorted(again.collect()) == sorted(mixing.with_taken(mixing.mix(docs[0], "doc_id", block=8)).select("key", "taken").collect())


def test_draws_and_permutations():
    quotas = np.array([100, 0, 7, 350])
    counts = mixing.draw_counts(quotas, 9, 4)
    assert counts.sum(0).tolist() == quotas.tolist() and (counts >= 0).all()
    assert counts.sum(1).max() - counts.sum(1).min() <= 1
    for n in (1, 2, 3, 100, 1000):
        for key in (0, 9):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))


# 6


def brute_classes(texts):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {k: (len(sets[k]), top(k)) for k in sets}


def test_near_duplicates(spark, docs):
    texts = dict(docs[1]) | {10_000 + k: t for k, t in enumerate(near_copies(120))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {k: (r.n_shingles, r.component_id) for k, r in by_id(mh.near_duplicates(df, "doc_id")).items()}
    assert got == brute_classes(texts)


def test_near_duplicates_of_like_words(spark):
    """Words that polynomial hashes modulo 2^64 can't tell apart, by themselves and inside texts."""
    turns = [bin(k).count("1") % 2 for k in range(1024)]
    words = ["".join("ab"[t] for t in turns), "".join("ba"[t] for t in turns)]
    texts = {0: words[0], 1: words[1], 2: f"x y {words[0]} z", 3: f"x y {words[1]} z", 4: " ".join(words), 5: words[0].upper()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {k: (r.n_shingles, r.component_id) for k, r in by_id(mh.near_duplicates(df, "doc_id")).items()}
    assert got == brute_classes(texts) == {k: (1, 0 if k == 5 else k) for k in texts}


def near_copies(n, words=80, seed=3):
    """Near copies of one text, many pairs of which are below the limit."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        own = [f"w{k}" for k in range(words)]
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(words))] = f"v{int(rng.integers(10**6))}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_in_cut_blocks(spark, monkeypatch):
    """Blocks of few classes and few shingles, and the exact mode."""
    texts = dict(enumerate(near_copies(150, seed=5) + near_copies(20, 20, seed=6)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    assert {k: (r.n_shingles, r.component_id) for k, r in by_id(mh.near_duplicates(df, "doc_id", exact=True)).items()} == want
    for name, value in {"SIDE": 16, "SIDE_SHINGLES": 700, "GROUP": 64, "GROUP_SHINGLES": 2000}.items():
        monkeypatch.setattr(mh, name, value)
    assert {k: (r.n_shingles, r.component_id) for k, r in by_id(mh.near_duplicates(df, "doc_id")).items()} == want


def test_near_duplicates_odd_rows(spark, odd):
    rows = mh.near_duplicates(odd[0], "doc_id").collect()
    assert len(rows) == len(odd[1])
    ids = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert ids[4].kept and not ids[5].kept and not ids[6].kept and ids[7].component_id == 4
    assert ids[0].kept and ids[0].n_shingles == 0 and ids[3].n_shingles == 1
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.doc_id is None and r.n_shingles) == [(56, 4)]
    assert mh.near_duplicates(odd[0].limit(0), "doc_id").count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1150, dtype=np.uint64)
    for share in (0.95, 0.85, 0.75):
        n = int(1000 * share)
        a, b = x[:1000], np.concatenate([x[1000 - n : 1000], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])
        bits = np.bitwise_count((mh.odd_sketch(mh.samples(a)) ^ mh.odd_sketch(mh.samples(b))).view(np.uint64)).sum()
        assert abs(mh.similarity(bits) - n / (2000 - n)) < 0.15


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 3), (3, 9), (5, 5), (-4, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 100 for k in range(100, 141)} | {7: -4, 3: -4, 9: -4, -4: -4}


def test_shingles():
    words = word_hashes(words_of("A b\tC a B c d"))
    assert words[0] == words[3] and words[1] == words[4] and len(set(words.tolist())) == 4
    assert len(shingle_set(words)) == 3 and len(shingle_set(words[:4])) == 1 and len(shingle_set(words[:0])) == 0


# 7


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], [0, 1, None]
    for k in range(400):
        v = rng.standard_normal(64)
        rows.append((k, v, labels[k % 3]))
        if k % 5 == 0:
            rows += [(1000 + 10 * k + j, v + 0.02 * j * rng.standard_normal(64), labels[k % 3]) for j in range(4)]
    rows += [(9000, np.zeros(64), 0), (9001, np.full(64, np.nan), 0), (9002, np.full(64, np.inf), 0), (9003, rows[0][1] * 3, 0), (9004, rng.standard_normal(8), 0)]
    data = [(k, [float(np.float32(x)) for x in v], label) for k, v, label in rows] + [(9005, None, 0), (9006, [], 0), (9007, [None, 1.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    links, root = Counter(), {r[0]: r[0] for r in data}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    good = [(k, np.array(v), label) for k, v, label in data if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[i + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb.near_vectors(df, "vec_id").collect()}
    assert got == {k: (links[k], top(k), top(k) == k) for k in root}
    assert emb.near_vectors(df.limit(0), "vec_id").count() == 0


def test_near_vectors_in_cut_blocks(spark, monkeypatch):
    """A large group of near vectors in blocks of few classes, labels of any type, counted over a sample, and the exact mode."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(32)
    near = [centre + 0.12 * rng.standard_normal(32) for _ in range(300)] + [rng.standard_normal(32) for _ in range(200)]
    data = [(k, [float(np.float32(x)) for x in v], "ab"[k % 2]) for k, v in enumerate(near)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string")
    m = np.array([v for _, v, _ in data])
    m = m / np.sqrt((m * m).sum(1, keepdims=True))
    linked = (m @ m.T >= 0.98) & (np.arange(500)[:, None] % 2 == np.arange(500) % 2) & ~np.eye(500, dtype=bool)
    want = linked.sum(1).tolist()
    assert sum(want) > 1000
    links = lambda found: [r.n_links for r in sorted(found.collect(), key=lambda r: r.vec_id)]
    assert links(emb.near_vectors(df, "vec_id", exact=True)) == want
    for name, value in {"CHUNK": 16, "COUNTED": 200, "GROUP": 64, "BUCKET": 8}.items():
        monkeypatch.setattr(emb, name, value)
    assert sum(links(emb.near_vectors(df, "vec_id"))) >= 0.999 * sum(want)
    assert links(emb.near_vectors(df, "vec_id", exact=True)) == want


# 8


def test_quality_counts(spark, docs, odd):
    rows = [(k, t) for k, t in enumerate([*(r[1] for r in odd[1]), *docs[1].values(), "a b c d e f g h i a b c d e f g h", "l\nl\n \n \nl m"])]
    for r in qr.with_counts(spark.createDataFrame(rows, "id long, text string")).collect():
        t = r.text or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often, cover, seen, again = Counter(windows), set(), set(), 0
        for k, x in enumerate(windows):
            if often[x] > 1:
                cover.update(range(k, k + 8))
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        assert tuple(r.rules) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover)), t


def test_quality_verdict(spark, odd):
    good = [(k, " ".join(f"g{(k * j) % 37}" for j in range(1, 40))) for k in range(1, 30)]
    bad = [(100 + k, " ".join(f"b{(k * j) % 41}" for j in range(1, 40))) for k in range(1, 20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    ratio = qr.ratios(df, df.filter("doc_id < 100").select("doc_id"), "doc_id")
    found = by_id(qr.with_verdict(df, ratio).filter("kept or not kept"))
    table = {r.bucket: r.ratio for r in ratio.collect()}
    hashed = by_id(df.selectExpr("doc_id", "transform(split(text, ' '), w -> xxhash64(w)) as h").selectExpr("doc_id", "transform(h, x -> pmod(x, 16384)) as u", "transform(slice(h, 1, size(h) - 1), (x, i) -> pmod(xxhash64(x, h[i + 1]), 16384)) as v"))
    raw, target = Counter(), Counter()
    for k in found:
        raw.update([*hashed[k].u, *hashed[k].v])
        target.update([*hashed[k].u, *hashed[k].v] if k < 100 else [])
    assert len(table) == qr.BUCKETS
    share = lambda counts, b: np.log((counts[b] + 1) / (counts.total() + qr.BUCKETS))
    assert all(table[b] == pytest.approx(share(target, b) - share(raw, b)) for b in table)
    for k, r in found.items():
        grams = [*hashed[k].u, *hashed[k].v]
        assert r.log_ratio == pytest.approx(sum(table[g] for g in grams) / len(grams))
        assert r.kept == (not r.base_failed and r.log_ratio >= qr.THRESHOLD)
    assert all(found[k].log_ratio > found[100 + 1].log_ratio for k in range(1, 30))
    judged = qr.with_verdict(odd[0], qr.ratios(odd[0], df.limit(0), "doc_id"))
    assert judged.count() == len(odd[1]) and judged.filter("log_ratio != 0").count() == 0
    assert judged.filter("text is null and kept").count() == 0


# 9


def test_chat(spark, sf_dir):
    hard = "</s>[INST] \\a <|end|><|turn|> \\ok [/INST]"
    rows = [(1, k, ["system", "user", "assistant"][min(k, 1 + k % 2)], f"{hard} {k} " + "word " * (k * 7 % 90)) for k in range(40)]
    rows += [(2, 0, None, None), (2, None, "assistant", "x"), (2, 0, "assistant", "y"), (None, 1, "assistant", "z"), (3, 0, "assistant", "long " * 3000), (3, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.windows(df, PIECES, budget=300)
    seen = by_id(chat.digests(windows), "conv_id")
    for conv in (1, 2, 3, None):
        own = sorted([(-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, r, t in own if r == "assistant")
        everything = "".join(f"{r}\n{t}\n" for _, r, t in own)
        assert (seen[conv].n_turns, seen[conv].turns_sha256) == (len(own), hashlib.sha256(everything.encode()).hexdigest())
        assert (seen[conv].loss_chars, seen[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = sorted((w for w in windows.collect() if w.conv_id == 1), key=lambda w: w.number)
    assert len(one) > 3 and all(w.tokens <= 300 or len(chat.read_back(w.formatted)) == 1 for w in one)
    assert any(w.repeated > 1 for w in one) and sum(len(chat.read_back(w.formatted)) - w.repeated for w in one) == 40
    assert all(chat.read_back(w.formatted)[0][0] == "system" for w in one)
    assert chat.unescape(chat.escape(hard)) == hard and chat.digests(chat.windows(df.limit(0), PIECES)).count() == 0
    assert by_id(queries.QUERIES["op9_chat_format"](spark, sf_dir), "conv_id")[-7].loss_chars == 21


# 10


def test_token_counts(spark, odd, docs, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    texts = [*HARD, *list(docs[1].values())[:60]]
    assert tc.counter(BYTES).counts(texts) == [count(t) for t in texts]
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = tc.with_token_counts(odd[0], BYTES, "doc_id", cache=cache).collect()
        want = [(r[0], len((r[1] or "").encode()), count(r[1])) for r in odd[1]]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        assert spark.read.parquet(cache).count() == len({r[1] or "" for r in odd[1]})
    assert tc.with_token_counts(odd[0].limit(0), BYTES, "doc_id").count() == 0


# the pipeline


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as cp

    rows, previous = docs[0], None
    for k, (_, stage) in enumerate(cp.STAGES):
        out = cp.stored(stage(spark, rows, sf_dir), "test-stage")
        before, after = Counter(r.doc_id for r in rows.select("doc_id").collect()), Counter(r.doc_id for r in out.select("doc_id").collect())
        assert set(after) <= set(before)
        if k < 4:
            assert out.columns == docs[0].columns
        if k == 2:
            kept = brute_classes({r.doc_id: r.text for r in rows.collect()})
            assert set(after) == {c for _, c in kept.values()} and max(after.values()) == 1
        if k == 3:
            assert max(after.values()) <= 2
        rows, previous = out, before
    assert sum(after.values()) == sum(previous.values())


def test_pipeline_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline as cp

    for df in (odd[0], odd[0].limit(0)):
        for _, stage in cp.STAGES[:4]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns and out.count() <= 2 * len(odd[1])
    left = cp.minhash_dedup_stage(spark, odd[0], sf_dir).collect()
    texts = Counter((r.text or "").lower().strip() for r in left if r.text and "word1 " in r.text)
    assert sum(texts.values()) == 1


def test_pipeline_mixes_words(spark, sf_dir):
    """Each source of the mix has as many words as the mix takes of it; pieces are the documents' own words in blocks."""
    import corpus_pipeline as cp

    texts = [" ".join(f"a{k}_{i}" for i in range(400)) for k in range(200)] + ["\t " + "  ".join(f"b{i}" for i in range(100_000)) + " \n"]
    rows = [(k, t, "en", "skewed", len(t)) for k, t in enumerate(texts)]
    rows += [(1000 + k, " ".join(f"c{k}_{i}" for i in range(1 + 37 * k)), None, f"s{k % 2}", 5) for k in range(80)] + [(2000, None, "en", "s0", 0), (2001, " ", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sources = {r[0]: (r[3], WORD.findall(r[1] or "")) for r in rows}
    mixed = mixing.with_taken(mixing.mix(docs, "doc_id")).collect()
    got, out = Counter(), cp.mixing_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    for r in out.collect():
        source, words = sources[r.doc_id]
        place = {w: k for k, w in enumerate(words)}
        at = [place[w] for w in WORD.findall(r.text)]
        assert r.source == source and at and at == sorted(set(at))
        got[r.doc_id] += len(at)
    assert got == +Counter({r.key: r.taken for r in mixed})
    for source, goal in {(r.source, r.target) for r in mixed}:
        words = sum(n for k, n in got.items() if sources[k][0] == source)
        assert abs(words - goal) <= 2.5 * mixing.BLOCK, (source, words, goal)
    cuts = spark.createDataFrame([(texts[-1], 77)], "text string, lead int").select(mixing.cut(F.col("text"), F.col("lead"))).first()[0]
    sizes = [len(WORD.findall(c)) for c in cuts]
    assert "".join(cuts) == texts[-1] and sizes[0] == mixing.BLOCK - 77 and set(sizes[1:-1]) == {mixing.BLOCK}


def test_workers_give_freed_memory_back(monkeypatch):
    from undulo.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    step = common.giving_back(lambda batches: (2 * b for b in batches))
    assert list(step(iter([1, 2, 3]))) == [2, 4, 6] and given == [True]
    assert sp.TEXTS <= 64  # texts whose offsets a worker holds at once
