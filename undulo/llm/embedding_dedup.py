"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector is padded with zeros to ``CODE_BITS`` dimensions and rotated at random; its code holds the signs, and beside
it stands the correction factor, the inner product of the rotated vector with its code. For a pair, the code
of one and the rotated other give an inner product that, divided by the factor, estimates the cosine without bias, with a
standard deviation of at most sqrt((1 - f^2) / f^2 / (bits - 1)). A pair whose estimate plus ``SIGMAS`` of these is below
the limit is dropped; every other one is recomputed from the vectors in double precision.

Pairs come from tables of buckets keyed by a few code bits each. The number of bits follows the largest label's size, so that a bucket holds ``BUCKET``
vectors about at every size, and the number of tables follows from the bits: tables draw from one code, so a pair's misses depend
on each other, and the tables suffice for a miss of ``MISS`` on average over how many bits of the code differ. Vectors that are equal, label and all components,
are one class from the start. First, codes alone go to the buckets: two codes that differ in too many bits for the limit are
no candidates, and a pair is one only in the first table that both share. A bucket is compared in blocks of two chunks of at most ``CHUNK``
classes, and a block names the classes that have a candidate in it, never the pairs. Their vectors alone are fetched, for estimates and exact
cosines. A block sends back a row for each class with links: how many, and its root inside the block.

Buckets that need several chunks are found by counting, in large tables over a sample of the classes by hash, of which one in ``n / COUNTED`` is taken: a bucket that escapes it
holds no more than some times that number, which only makes its block larger. ``exact`` leaves keys, codes and bounds out and compares all classes of a label in blocks, at quadratic cost.

Vectors that are null or empty, have length zero or components that are null or not finite, or have no label link with
nothing. Vectors of one label but different dimensions are not compared. Copies of a vector link with each other. The component is the smallest
reachable id; a null id counts as no candidate for it, and ``kept`` holds where the two are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.llm.common import Tables, small_batches, small_side
from undulo.llm.components import components

LIMIT, CODE_BITS, SIGMAS, MISS = 0.98, 256, 5.0, 1e-4
#: Classes in a bucket about, classes of a chunk at most, classes that are counted, rows that go to a task's group of blocks about (of rows with vectors, a 32nd).
BUCKET, CHUNK, COUNTED, GROUP = 64, 1024, 2_000_000, 8192


@cache
def rotation(dimensions: int, seed: int = 97) -> np.ndarray:
    """Orthonormal rows, one for each dimension: the part of a random rotation that meets a zero-padded vector."""
    bits = max(CODE_BITS, dimensions)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dimensions)))
    return (q * np.sign(np.diag(r))).T.astype(np.float32)


def _differing(limit: float, size: int) -> np.ndarray:
    """How likely each number of differing bits of the codes is for a pair at the limit."""
    share, d = math.acos(limit) / math.pi, np.arange(size + 1)
    log_choose = np.array([math.lgamma(size + 1) - math.lgamma(k + 1) - math.lgamma(size - k + 1) for k in d])
    return np.exp(log_choose + d * math.log(share) + (size - d) * math.log1p(-share))


def layout(rows: int, limit: float = LIMIT) -> tuple[int, int]:
    """Bits of a key and number of tables for labels of so many rows."""
    bits = min(48, max(4, math.ceil(math.log2(max(rows, 2) / BUCKET))))
    weight, d = _differing(limit, CODE_BITS), np.arange(CODE_BITS + 1)
    same = np.ones(CODE_BITS + 1)  # that a key's bits, drawn from the code, all agree
    for k in range(bits):
        same *= np.maximum(CODE_BITS - d - k, 0) / (CODE_BITS - k)
    tables = 1
    while weight @ (1 - same) ** tables > MISS:
        tables = math.ceil(tables * 1.05)
    return bits, tables


def most_bits(size: int, limit: float = LIMIT) -> int:
    """Bits in which two codes of ``size`` bits may differ: a pair at the limit differs in more with probability 1e-7."""
    return int(np.flatnonzero(_differing(limit, size)[::-1].cumsum()[::-1] > 1e-7)[-1])


@cache
def _picked(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(5).permuted(np.tile(np.arange(size), (tables, 1)), axis=1)[:, :bits]


def keys_of(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each row in each table; tables draw their bits from the code at random."""
    keys = np.zeros((len(signs), tables), np.int64)
    for k, places in enumerate(_picked(signs.shape[1], bits, tables).T):
        keys |= signs[:, places].astype(np.int64) << k
    return keys


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    largest = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / largest
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _signs(codes: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(packed, axis=1)[:, :size].astype(bool)


def codes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, dimensions, code, factor and keys of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b["vector"].value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                turned = unit(_matrix(part["vector"])).astype(np.float32) @ rotation(int(size))
                signs = turned > 0
                factor = np.abs(turned).sum(1, dtype=np.float64) / math.sqrt(turned.shape[1])
                packed = [x.tobytes() for x in np.packbits(signs, axis=1)]
                key = keys_of(signs, bits, tables)
                ends = pa.array(np.arange(len(part) + 1) * tables, pa.int32())
                fields = {"node": part["node"], "dimensions": pa.array(np.full(len(part), size, np.int32)), "code": pa.array(packed, pa.binary()), "factor": pa.array(factor), "keys": pa.ListArray.from_arrays(ends, pa.array(key.ravel()))}
                yield pa.RecordBatch.from_arrays(list(fields.values()), list(fields))

    return classes.select("node", "vector").mapInArrow(run, "node long, dimensions int, code binary, factor double, keys array<long>")


def _pairs(block: np.ndarray, mixed: np.ndarray, chunk: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each block, rows sorted by block; of a block of two chunks those of one with the other."""
    for step in range(1, len(block)):
        p = np.flatnonzero(block[step:] == block[:-step])
        if not len(p):
            break
        q = p + step
        fits = (~mixed[p] | (chunk[p] != chunk[q])) & (node[p] != node[q])
        yield p[fits], q[fits]


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows by block, the blocks' numbers, and whether a block has two chunks."""
    block = np.unique(np.stack([table[c].to_numpy() for c in ("label", "table", "key", "i", "j")]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(block, kind="stable")
    table = table.take(pa.array(order))
    return table, block[order], table["i"].to_numpy() != table["j"].to_numpy()


def candidates(table: pa.Table, bits: int, tables: int, limit: float) -> pa.Table:
    """Of the classes of some blocks those with a candidate: codes near enough, in the first table that both share."""
    table, block, mixed = _sorted(table)
    node, chunk, which = (table[c].to_numpy() for c in ("node", "chunk", "table"))
    size = max(CODE_BITS, table["dimensions"][0].as_py())
    signs = _signs(table["code"], size)
    packed = np.packbits(np.pad(signs, ((0, 0), (0, -size % 64))), axis=1).view(np.uint64)
    keys, most, found = keys_of(signs, bits, tables), most_bits(size, limit), np.zeros(len(node), bool)
    for p, q in _pairs(block, mixed, chunk, node):
        near = np.bitwise_count(packed[p] ^ packed[q]).sum(1) <= most
        p, q = p[near], q[near]
        first = ~((keys[p] == keys[q]) & (np.arange(tables) < which[p, None])).any(1)
        found[p[first]] = found[q[first]] = True
    return table.filter(pa.array(found)).drop_columns(["code", "part"])


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position of each position's component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def compare(table: pa.Table, bits: int, tables: int, limit: float, exact: bool) -> pa.Table:
    """For the classes of some blocks: node, links (copies of other classes linked), root."""
    table, block, mixed = _sorted(table)
    node, n, factor, which, chunk = (table[c].to_numpy() for c in ("node", "n", "factor", "table", "chunk"))
    raw = _matrix(table["vector"]).astype(np.float64)
    turned = unit(raw).astype(np.float32) @ rotation(raw.shape[1])
    size, raw = turned.shape[1], raw / np.abs(raw).max(1, keepdims=True)
    signs = _signs(table["code"], size)
    keys, length = keys_of(signs, bits, tables), np.sqrt((raw * raw).sum(1))
    slack = SIGMAS * np.sqrt((1 - np.minimum(factor, 1) ** 2) / factor**2 / (size - 1))
    signs = (signs.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
    left, right = [], []
    for every_p, every_q in _pairs(block, mixed, chunk, node):
        for k in range(0, len(every_p), 8192):
            x, y = every_p[k : k + 8192], every_q[k : k + 8192]
            if not exact:
                first = ~((keys[x] == keys[y]) & (np.arange(tables) < which[x, None])).any(1)
                x, y = x[first], y[first]
                estimate = np.einsum("ij,ij->i", signs[x], turned[y]) / factor[x]
                near = estimate + slack[x] >= limit
                x, y = x[near], y[near]
            linked = np.einsum("ij,ij->i", raw[x], raw[y]) / (length[x] * length[y]) >= limit
            left.append(x[linked])
            right.append(y[linked])
    a, b = (np.concatenate([np.empty(0, np.int64), *s]) for s in (left, right))
    # a class may stand in several blocks of the table
    ids, place = np.unique(node, return_inverse=True)
    root, links = _roots(place[a], place[b], len(ids)), np.zeros(len(ids), np.int64)
    np.add.at(links, place[a], n[b])
    np.add.at(links, place[b], n[a])
    some = links > 0
    return pa.table({"node": ids[some], "links": links[some], "root": ids[root[some]]})


def near_vectors(df: DataFrame, key: str, vector: str = "embedding", label: str = "label", limit: float = LIMIT, exact: bool = False) -> DataFrame:
    """``key``, n_links, component_id and kept, one row for each row of ``df``."""
    with small_batches(df.sparkSession, rows=4000):
        return _near_vectors(df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label")), key, limit, exact)


def _near_vectors(rows: DataFrame, out_key: str, limit: float, exact: bool) -> DataFrame:
    tables = Tables(rows.sparkSession, "vectors")
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    rows = rows.select("key", "label", F.when(fine, v).alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = tables.stored(rows, "rows")
    good = rows.filter("vector is not null")
    copied = good.groupBy("label", "vector").agg(F.min("row").alias("first_row"), F.min("key").alias("first"), F.count("*").alias("n"))
    copied = tables.stored(copied.filter("n > 1"), "copied")
    size = copied.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    classed = good.join(small_side(copied.withColumnRenamed("first", "lowest"), size[0] * (1 + size[1] // 8)), ["label", "vector"], "left")  # a vector counts as its bytes
    node, alone = F.coalesce("first_row", "row"), F.col("first_row").isNull()
    named = tables.stored(classed.select("row", node.alias("node")), "named")
    own = [node.alias("node"), "label", F.when(alone, F.col("key")).otherwise(F.col("lowest")).alias("first"), F.coalesce("n", F.lit(1)).alias("n")]
    classes = tables.stored(classed.filter(node == F.col("row")).select(*own, "vector"), "classes")
    counted = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    largest, n_classes = counted[0] or 0, counted[1] or 0
    bits, n_tables = (1, 1) if exact else layout(largest, limit)
    coded = tables.stored(codes(classes, bits, n_tables), "codes")
    labels = classes.select("node", F.xxhash64("label").alias("label"))  # labels that share a hash share buckets; they are told apart below
    keys = F.array(F.lit(0).cast("long")) if exact else F.col("keys")
    placed = coded.join(labels, "node").select("node", "label", "dimensions", "code", F.posexplode(keys).alias("table", "key"))

    one_in = max(1, n_classes // COUNTED)
    sample = placed.filter(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0)
    hot = sample.groupBy("label", "dimensions", "table", "key").agg((F.count("*") * one_in).alias("in_bucket"))
    hot = tables.stored(hot.filter(F.col("in_bucket") > max(CHUNK, 3 * one_in)), "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        placed = placed.join(small_side(hot, n_hot), ["label", "dimensions", "table", "key"], "left")
        placed = placed.withColumn("chunks", F.coalesce(F.ceil(F.col("in_bucket") / CHUNK), F.lit(1)).cast("int")).drop("in_bucket")
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node", "table"), F.col("chunks")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        placed = placed.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    else:
        zero = F.lit(0).cast("int")
        placed = placed.withColumn("chunk", zero).withColumn("i", zero).withColumn("j", zero)

    def parts(n: int, group: int):
        return F.pmod(F.xxhash64("label", "table", "key", "i", "j"), F.lit(max(1, n // group))).cast("int").alias("part")

    names = ["node", "label", "dimensions", "table", "key", "chunk", "i", "j"]
    kinds = "node long, label long, dimensions int, table int, key long, chunk int, i int, j int"
    if exact:
        few = tables.stored(placed.select(names), "candidates")
    else:
        blocks = placed.select(*names, "code", parts(n_classes * n_tables, GROUP)).groupBy("dimensions", "part")
        few = tables.stored(blocks.applyInArrow(lambda t: candidates(t, bits, n_tables, limit), kinds), "candidates")
    n_few = few.count()
    # here the label itself parts a block, so that no hash can link two
    whole = few.join(classes.select("node", "n", "vector", F.col("label").alias("own")).hint("merge"), "node").join(coded.select("node", "code", "factor").hint("merge"), "node")
    blocks = whole.select(*names, "own", "n", "vector", "code", "factor", parts(n_few, GROUP // 32)).groupBy("dimensions", "own", "part")
    found = tables.stored(blocks.applyInArrow(lambda t: compare(t, bits, n_tables, limit, exact), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "a", "b", lambda df: tables.stored(df, "roots"))
    linked = tables.stored(classes.select("node", "first").join(roots.hint("merge"), "node"), "linked")
    lowest = tables.stored(linked.groupBy("root").agg(F.min("first").alias("lowest")), "lowest")
    linked = linked.join(small_side(lowest, lowest.count()), "root").join(links, "node")
    linked = tables.stored(linked.select("node", "links", "lowest"), "linked-classes")
    whole = classes.select("node", "first", "n").join(small_side(linked, linked.count()), "node", "left")
    whole = whole.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "first").alias("component_id"))
    whole = tables.stored(whole, "components")  # a table of its own, so that Spark can split a class of very many copies
    out = tables.stored(rows.select("key", "row"), "keys").join(named.hint("merge"), "row", "left").join(whole.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    out = out.select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    tables.keep("keys", "named", "components")
    return out.select(F.col("key").alias(out_key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id")
