"""MinHash near-duplicates, with odd sketches to verify candidates.

A document's set holds its distinct five-word shingles. Documents with the same words in the same order, by a cryptographic digest of 128
bits, form a class at once; the rest works on classes. 256 MinHash samples give a class 32 keys, one for each of the first 32 groups of four samples,
and an odd sketch: a bitmap of 1,024 bits in which every sample flips one. Two classes that share a key
are candidates. The population count of two sketches' exclusive or estimates their similarity; a pair that
it puts more than 4.5 standard deviations below 0.75 is dropped, every other is decided on the shingles themselves, so that no hash can make a link.

Not all pairs of a key are made. First every class is paired with one of its key, another class for each key; the
links found are joined to components. Only keys that still hold several components are looked at again: there
the classes outside the largest component are compared, in blocks, with all classes of the key, by sketch. A block names the classes that have a
candidate in it, never the pairs; the words of these alone are fetched, to blocks cut by their size, and decide. A block sends back no more
links than join its components. A pair that both rounds leave out is connected already or has sketches too far
apart. A pair with similarity 0.75 misses all keys with probability 5e-6, and less the more alike it is. ``exact`` puts all classes under one
key and drops the sketches' bound: every pair that isn't connected already is then decided on the shingles, at quadratic cost.

Texts of fewer than five words have one shingle, the whole sequence. Null texts and texts without words have an empty set
and link with nothing: their component is their own key. The component is the smallest key that is reachable,
null only if all keys of the component are; ``kept`` holds where the key equals it, so repeated rows share their fate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import Tables, giving_back, mix64, shingle_set, small_batches, small_side, word_hashes, words_of
from undulo.llm.components import components

SAMPLES, BAND, BANDS, BITS = 256, 4, 32, 1024
WORDS, PERCENT = 5, 75
#: Bits in which two sketches may differ: 66 above the mean of 113 at similarity 0.75, where the deviation is 14.7.
MOST_BITS = 179
#: Classes on either side of a block that is compared by sketches, shingles on either side of one that is compared by words, and rows or shingles
#: that go to a task's group of blocks about.
SIDE, SIDE_SHINGLES, GROUP, GROUP_SHINGLES = 1024, 1 << 18, 1 << 14, 1 << 19

_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_ODD = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SAMPLE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest value that each of the hash functions takes on a set."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(least, ((x[k : k + 1024, None] ^ _XOR) * _ODD).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for column in least[: BANDS * BAND].reshape(BANDS, BAND).T:
        keys = mix64(keys ^ column.astype(np.uint64))
    return keys.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity of the number of samples that fall on each bit."""
    bit = (mix64(_SAMPLE | least.astype(np.uint64)) >> np.uint64(54)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def similarity(bits: np.ndarray) -> np.ndarray:
    """The similarity that an odd sketch estimates from the number of differing bits."""
    share = np.minimum(2 * np.asarray(bits) / BITS, 1 - 1e-9)
    return 1 + BITS * np.log1p(-share) / (4 * SAMPLES)


def digest(words: list[bytes]) -> bytes:
    """The class of a sequence of words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingles(said: bytes) -> set[bytes]:
    """The shingles themselves, of words between single spaces."""
    words = said.split(b" ")
    return {b" ".join(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))}


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
    values = np.concatenate([np.empty(0, np.int64), *(r.view(np.int64) for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([r is None for r in rows]))


def signatures(docs: DataFrame) -> DataFrame:
    """key, digest, n_shingles, keys and sketch of rows (key, text); without words digest, keys and sketch are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, keys, sketches = [], [], [], []
            for t in b["text"].to_pylist():
                words = words_of(t)
                found = shingle_set(word_hashes(words), WORDS)
                least = samples(found) if len(found) else None
                digests.append(digest(words) if words else None)
                sizes.append(len(found))
                keys.append(None if least is None else band_keys(least))
                sketches.append(None if least is None else odd_sketch(least))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys), _lists(sketches)], ["key", "digest", "n_shingles", "keys", "sketch"])

    return docs.mapInArrow(giving_back(run), f"key {docs.schema['key'].dataType.simpleString()}, digest binary, n_shingles long, keys array<long>, sketch array<long>")


def said_words(docs: DataFrame) -> DataFrame:
    """digest and the words, between single spaces, of rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w for w in map(words_of, b["text"].to_pylist()) if w]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(digest, words)), pa.binary()), pa.array([b" ".join(w) for w in words], pa.binary())], ["digest", "said"])

    return docs.select("text").mapInArrow(giving_back(run), "digest binary, said binary")


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and sketches allow a link."""
    for side in ("a", "b"):
        own = sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(own.hint("merge"), side)
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return pairs.filter(fits & (bits <= MOST_BITS)).select("a", "b")


def alike(a: set[bytes], b: set[bytes]) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(a & b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _links(pairs: DataFrame, said: DataFrame) -> DataFrame:
    """The pairs whose sets are alike enough."""
    for side in ("a", "b"):
        pairs = pairs.join(said.select(F.col("node").alias(side), F.col("said").alias(f"said_{side}")).hint("merge"), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set[bytes]] = {}
        held = 0
        for b in batches:
            found = []
            for x, y, said_x, said_y in zip(*(b[c].to_pylist() for c in ("a", "b", "said_a", "said_b")), strict=True):
                if held > SIDE_SHINGLES:
                    sets, held = {}, 0
                for node, said in ((x, said_x), (y, said_y)):
                    if node not in sets:
                        sets[node] = shingles(said)
                        held += len(sets[node])
                if alike(sets[x], sets[y]):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "said_a", "said_b").mapInArrow(giving_back(run), "a long, b long")


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _blocks(table: pa.Table, columns: list[str]) -> list[np.ndarray]:
    """The rows of each block."""
    block = np.unique(np.stack([table[c].to_numpy() for c in columns]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(block, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(block[order])) + 1)


def _candidates(table: pa.Table, most: int) -> pa.Table:
    """Of the classes of some blocks those that sketches allow to be linked with a class of another component, a minor one on either side."""
    root, n, minor = (table[c].to_numpy() for c in ("root", "n", "minor"))
    sketch = table["sketch"].combine_chunks().flatten().to_numpy().reshape(len(root), -1).view(np.uint64)
    found = np.zeros(len(root), bool)
    for rows in _blocks(table, ["key", "i", "j"]):
        every = rows[~minor[rows]]
        for x in rows[minor[rows]]:
            y = every[(root[every] != root[x]) & (100 * np.minimum(n[x], n[every]) >= PERCENT * np.maximum(n[x], n[every]))]
            y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(1) <= most]
            found[y] = True
            found[x] |= len(y) > 0
    return table.filter(pa.array(found)).select(["key", "i", "j", "node", "root", "n", "minor"])


def _compare(table: pa.Table) -> pa.Table:
    """Links between components in some blocks, decided on the shingles; of the links of a block, those that join components."""
    node, root, minor = (table[c].to_numpy() for c in ("node", "root", "minor"))
    said, links = table["said"], []
    for rows in _blocks(table, ["key", "i", "j", "si", "sj"]):
        few, every = rows[minor[rows]], rows[~minor[rows]]
        if not len(few) or not len(every):
            continue
        number: dict[bytes, int] = {}  # the shingles of the block, numbered, so that sets can be compared in numpy
        sets = {}
        for r in rows.tolist():
            if int(node[r]) not in sets:
                own = shingles(said[r].as_py())
                sets[int(node[r])] = np.fromiter((number.setdefault(s, len(number)) for s in own), np.int64, len(own))
        lists = [sets[int(node[r])] for r in every]
        n, place = np.array(list(map(len, lists))), np.concatenate(lists)
        first = np.cumsum(n) - n
        joined = {r: r for r in root[rows].tolist()}

        def top(r: int, joined: dict = joined) -> int:
            while joined[r] != r:
                joined[r] = r = joined[joined[r]]
            return r

        for x in few:
            mine, own = sets[int(node[x])], np.zeros(len(number), bool)
            own[mine] = True
            common = np.add.reduceat(own[place], first, dtype=np.int64)
            for k in np.flatnonzero((root[every] != root[x]) & (100 * common >= PERCENT * (len(mine) + n - common))).tolist():
                a, b = top(int(root[x])), top(int(root[every[k]]))
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    links.append((int(node[x]), int(node[every[k]])))
    pairs = np.sort(np.array(links, np.int64).reshape(-1, 2), axis=1)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _crossed(rows: DataFrame, minor: Column, low: Column, high: Column, names: tuple[str, str]) -> DataFrame:
    """Rows in blocks of ``low`` parts of the minor ones by ``high`` parts of all of them: a row is in each block of its part, and once
    more, as ``minor``, if it is a minor one."""
    i, j = names
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    every = rows.select("*", F.lit(False).alias("_minor"), part(high, 0).alias(j), each(low).alias(i))
    few = rows.filter(minor).select("*", F.lit(True).alias("_minor"), each(high).alias(j), part(low, 1).alias(i))
    return every.unionByName(few)


def _left_over(tables: Tables, members: DataFrame, roots: DataFrame, sketches: DataFrame, words_for, most: int) -> DataFrame | None:
    """Links of classes that share a key but no component; None if no key has such classes. words_for: from nodes to their words."""
    rows = members.filter("n_key > 2").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = tables.stored(rows.select("key", "node", "root"), "rooted")
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most").select("key")
    sizes = rows.join(mixed.hint("merge"), "key", "left_semi").groupBy("key", "root").agg(F.count("*").alias("n"))
    major = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    parts = F.ceil(F.col("n") / SIDE), F.ceil((F.col("n") - F.col("most.n")) / SIDE)
    major = tables.stored(major.select("key", F.col("most.root").alias("major"), parts[0].alias("high"), parts[1].alias("low")), "major")
    n_major = major.count()
    if not n_major:
        return None
    rows = rows.join(small_side(major, n_major), "key")
    placed = _crossed(rows, F.col("root") != F.col("major"), F.col("low"), F.col("high"), ("i", "j"))
    placed = placed.select("key", "i", "j", "node", "root", F.col("_minor").alias("minor"))
    placed = placed.join(sketches.select("node", "n", "sketch").hint("merge"), "node")
    n_placed = rows.select(F.sum(F.col("low") + F.when(F.col("root") != F.col("major"), F.col("high")).otherwise(0))).first()[0]
    part = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, n_placed // GROUP)))
    kinds = "key long, i int, j int, node long, root long, n long, minor boolean"
    few = placed.withColumn("part", part).groupBy("part").applyInArrow(lambda t: _candidates(t, most), kinds)
    few = tables.stored(few, "candidates")

    # blocks of candidates, cut where they hold too many shingles
    sizes = few.groupBy("key", "i", "j").agg(*[F.ceil(F.sum(F.when(F.col("minor") == m, F.col("n")).otherwise(0)) / SIDE_SHINGLES).alias(c) for m, c in ((True, "low"), (False, "high"))])
    sizes = tables.stored(sizes.filter("low > 0 and high > 0"), "candidate-sizes")
    few = few.join(small_side(sizes, sizes.count()), ["key", "i", "j"])
    cut = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    few = few.withColumn("si", F.explode(F.when(F.col("minor"), F.array(cut("low", 2))).otherwise(each("low"))))
    few = few.withColumn("sj", F.explode(F.when(F.col("minor"), each("high")).otherwise(F.array(cut("high", 3)))))
    few = tables.stored(few, "cut-candidates")
    total = few.agg(F.sum("n")).first()[0] or 0
    few = few.join(words_for(few.select("node").distinct()).hint("merge"), "node")
    part = F.pmod(F.xxhash64("key", "i", "j", "si", "sj"), F.lit(max(1, total // GROUP_SHINGLES)))
    return few.withColumn("part", part).groupBy("part").applyInArrow(_compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str, text: str = "text", exact: bool = False) -> DataFrame:
    """``key``, n_shingles, component_id and kept, one row for each row of ``df``."""
    with small_batches(df.sparkSession):
        return _near_duplicates(df.select(F.col(key).alias("key"), F.col(text).alias("text")), key, BITS if exact else MOST_BITS)


def _near_duplicates(docs: DataFrame, out_key: str, most: int) -> DataFrame:
    tables = Tables(docs.sparkSession, "minhash")
    signed = tables.stored(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    worded = signed.filter("digest is not null")
    copied = worded.groupBy("digest").agg(F.min("row").alias("first_row"), F.min("key").alias("first"), F.count("*").alias("n"))
    copied = tables.stored(copied.filter("n > 1").drop("n"), "copied")
    classed = worded.join(small_side(copied, copied.count()), "digest", "left")
    node = F.coalesce("first_row", "row")
    named = tables.stored(classed.select("key", "row", node.alias("node"), F.when(F.col("first_row").isNull(), F.col("key")).otherwise(F.col("first")).alias("first")), "classes")
    one = classed.filter(node == F.col("row")).withColumn("node", F.col("row")).withColumn("n", F.col("n_shingles"))
    sketches = one.select("node", "n", "sketch")
    rows = one.select("node", F.explode("keys" if most == MOST_BITS else F.array(F.lit(0).cast("long"))).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n_key"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("lead"))
    shared = tables.stored(shared.filter("n_key > 1"), "shared")
    members = rows.join(small_side(shared, shared.count()), "key").withColumn("lead", F.col("lead").bitwiseXOR(F.col("key")))
    members = tables.stored(members, "members")

    def words_for(nodes: DataFrame) -> DataFrame:
        """node and its words, from the text of its first row."""
        wanted = tables.stored(one.select("node", "digest", "key").join(nodes.hint("merge"), "node", "left_semi"), "wanted")
        n = wanted.count()
        ids = wanted.select("key").distinct()
        texts = docs.join(small_side(ids, n), docs["key"].eqNullSafe(ids["key"]), "left_semi")
        said = tables.stored(said_words(texts).join(small_side(wanted.select("node", "digest"), n), "digest").select("node", "said"), "said")
        return said if said.count() == n else said.dropDuplicates(["node"])  # keys that don't tell rows apart bring copies

    tried = members.filter("node != lead").select(*_pair("node", "lead")).distinct()
    tried = tables.stored(_close(tried, sketches) if most == MOST_BITS else tried, "pairs")
    ends = [tried.select(F.col(side).alias("node")) for side in ("a", "b")]
    links = tables.stored(_links(tried, words_for(ends[0].unionByName(ends[1]).distinct())), "links")
    roots = components(links, "a", "b", lambda df: tables.stored(df, "roots"))
    more = _left_over(tables, members, roots, sketches, words_for, most)
    if more is not None:
        roots = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(roots.unionByName(more), "a", "b", lambda df: tables.stored(df, "all-roots"))

    firsts = named.filter("node = row").select("node", "first")
    linked = tables.stored(firsts.join(roots.hint("merge"), "node"), "linked")
    lowest = tables.stored(linked.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    linked = tables.stored(linked.join(small_side(lowest, lowest.count()), "root").select("node", "component_id"), "components")
    own = named.join(small_side(linked, linked.count()), "node", "left").select("row", F.coalesce("component_id", "first").alias("component_id"))
    out = signed.select("key", "row", "n_shingles", "digest").join(own.hint("merge"), "row", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component_id")))
    tables.keep("signatures", "classes", "components")
    return out.select(F.col("key").alias(out_key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
