"""The registered queries, each with its DuckDB counterpart.

The texts: columns in the order of their tables' keys, the characters and bytes of ``documents``, and a made text of 5-byte symbols in a binary file, whose
alphabet has more than 2^20 of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.functions.bits import bitrev, expand, level_bit, node_of, pack
from undulo.functions.running import running_sum
from undulo.operators import build as B
from undulo.operators import decode as D
from undulo.operators import force, report, split
from undulo.plans import alphabet as A
from undulo.sources import store
from undulo.sources import text as T
from undulo.sources.scratch import fresh, stored

COLUMNS = {
    "events": ("events", "event_type", "event_id"),
    "users": ("events", "user_id", "event_id"),
    "status": ("orders", "o_orderstatus", "o_orderkey"),
    "types": ("part", "p_type", "p_partkey"),
    "sizes": ("part", "p_size", "p_partkey"),
    "quality": ("labels", "quality", "doc_id"),
}
UNITS = {"chars": "char", "bytes": "byte"}
WORKERS, PREFIX = 4, 100_000
#: The wide text: symbol k is (k mod WIDE) * WIDE_STEP mod 2^40, for WIDE + 500 places.
WIDE, WIDE_STEP = (1 << 20) + 500, 982_451_653
Query = Callable[[SparkSession, str], DataFrame]


class Text:
    """A named text of a folder of tables with what the queries need of it."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str):
        self.spark, self.name, self.packed = spark, name, name in UNITS or name == "wide"
        if name in UNITS:
            self.docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        elif name != "wide":
            table, column, self.key = COLUMNS[name]
            self.rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(self.key).alias("_key"), F.col(column).alias("raw"))

    @cached_property
    def raw_chunks(self) -> DataFrame:
        if self.name in UNITS:
            return T.from_strings(self.docs, "text", "doc_id", UNITS[self.name])
        path = fresh(self.spark, "wide")
        made = self.spark.range(WIDE + 500).select(F.col("id").alias("pos"), F.expr(f"(id % {WIDE}) * {WIDE_STEP}L % (1L << 40)").alias("raw"))
        store.export(made, ["pos"], "raw", 5, f"{path}/text", store.TEXT)
        return T.from_binary(self.spark, f"{path}/text*.{store.TEXT}", 5)

    @cached_property
    def hist(self) -> DataFrame:
        return A.packed_histogram(self.raw_chunks) if self.packed else A.histogram(self.rows)

    @cached_property
    def alphabet(self) -> A.Alphabet:
        return A.effective_alphabet(self.hist)

    @cached_property
    def chunks(self) -> DataFrame:
        """Of raw symbols, or of codes where the text comes from a column."""
        if self.packed:
            return self.raw_chunks
        codes = A.effective_text(self.rows, self.alphabet, "_key")
        return T.pack(codes if self.alphabet.counts is not None else stored(codes, "codes"), ["_key", "code"], "code", "int")  # packing looks at rows three times

    def symbols(self) -> DataFrame:
        return T.unpack(self.chunks) if self.packed else T.from_column(self.rows, "raw", "_key")

    def codes(self) -> DataFrame:
        return A.effective_text(self.symbols(), self.alphabet) if self.packed else T.unpack(self.chunks).withColumnRenamed("raw", "code")

    def build(self, kind: str, form: Callable = B.build) -> DataFrame:
        alphabet = self.alphabet
        if not self.packed and alphabet.symbols is not None:
            alphabet = replace(alphabet, symbols=list(range(alphabet.sigma)))
        elif not self.packed:
            alphabet = replace(alphabet, table=alphabet.table.withColumn("raw", F.col("code")), coded=True)
        return form(self.chunks, alphabet, kind)

    def decode(self, words: DataFrame, kind: str) -> DataFrame:
        return D.decode(words, self.alphabet.n, self.alphabet.height, kind)

    def verify(self, words: DataFrame, kind: str) -> DataFrame:
        return D.verify(words, self.codes(), self.alphabet.n, self.alphabet.height, kind)


def _bits(t: Text) -> DataFrame:
    """(pos, bit) of the root."""
    return t.codes().select("pos", level_bit(F.col("code"), F.lit(0), t.alphabet.height).alias("bit"))


# --- DuckDB ------------------------------------------------------------------------------------------------


def _ctes(name: str, where: str = "") -> str:
    """t (pos, raw), h (raw, occ), a (raw, occ, code), s (n, sigma, height), e (pos, code)."""
    if name in UNITS:
        if name == "chars":
            each = "list_transform(string_split(coalesce(text, ''), ''), lambda c: unicode(c)::BIGINT)"
        else:
            each = "list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), (2 * i + 1)::INT, 2))::BIGINT)"
        size = "length(coalesce(text, ''))" if name == "chars" else "octet_length(encode(coalesce(text, '')))"
        t = f"""d AS (SELECT doc_id, {each} AS cs, (sum({size}) OVER (ORDER BY doc_id) - {size})::BIGINT AS start FROM documents),
        t AS (SELECT start + k - 1 AS pos, raw FROM (SELECT start, unnest(cs) AS raw, unnest(range(1, len(cs) + 1)) AS k FROM d))"""
    elif name == "wide":
        t = f"t AS (SELECT range AS pos, (range % {WIDE}) * {WIDE_STEP} % (1::BIGINT << 40) AS raw FROM range({WIDE + 500}))"
    else:
        table, column, key = COLUMNS[name]
        t = f"t AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS pos, {column} AS raw FROM {table})"
    if where:
        t = t + f", u AS (SELECT * FROM t WHERE {where})"
    of = "u" if where else "t"
    return f"""WITH {t},
    h AS (SELECT raw, count(*) AS occ FROM {of} GROUP BY raw),
    a AS (SELECT raw, occ, row_number() OVER (ORDER BY raw) - 1 AS code FROM h),
    s AS (SELECT sum(occ)::BIGINT AS n, count(*) AS sigma, CASE WHEN count(*) < 2 THEN 0 ELSE length(bin(count(*) - 1)) END AS height FROM h),
    l AS (SELECT unnest(range(height))::INT AS level, height::INT AS height, n FROM s),
    e AS (SELECT pos, code FROM {of} JOIN a USING (raw))"""


_REV = "coalesce(list_sum(list_transform(range(level), lambda i: ((node >> i::INT) & 1) * (1::BIGINT << (level - 1 - i)::INT))), 0)::BIGINT"
_WORD = "CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END::BIGINT"


def _levels(matrix: bool) -> str:
    """Follows _ctes: p (level, node, code, pos, bit), q with its place, w (level, word_idx, word)."""
    order = "rev, pos" if matrix else "node, pos"
    return f""", p0 AS (SELECT level, code >> (height - level) AS node, (code >> (height - 1 - level)) & 1 AS bit, pos FROM e, l),
    p1 AS (SELECT *, {_REV if matrix else "0"} AS rev FROM p0),
    q AS (SELECT level, node, bit, pos, row_number() OVER (PARTITION BY level ORDER BY {order}) - 1 AS p FROM p1),
    w0 AS (SELECT level, p // 64 AS word_idx, sum(bit::HUGEINT << (63 - p % 64)::INT) AS x FROM q GROUP BY ALL),
    w AS (SELECT level, word_idx::BIGINT AS word_idx, {_WORD} AS word FROM w0)"""


def _nodes() -> str:
    return f""", q AS (SELECT (1::BIGINT << level) + (code >> (height - level)) AS node_id, (code >> (height - 1 - level)) & 1 AS bit,
        row_number() OVER (PARTITION BY level, code >> (height - level) ORDER BY pos) - 1 AS p FROM e, l),
    w0 AS (SELECT node_id, p // 64 AS word_idx, sum(bit::HUGEINT << (63 - p % 64)::INT) AS x FROM q GROUP BY ALL),
    w AS (SELECT node_id, word_idx::BIGINT AS word_idx, {_WORD} AS word FROM w0)"""


#: Made records with all keys: two algorithms, several runs of each.
_RUNS = [
    ("tree", 4, 20, "a.txt", 1 << 30, 1, 101, 0.5, 3.0, 0.25, 10.0, 1.5, 8 << 30, 3 << 30, 1 << 20),
    ("tree", 4, 20, "a.txt", 1 << 30, 1, 101, 0.5, 3.5, 0.25, 11.0, 1.0, 9 << 30, 3 << 30, 1 << 10),
    ("tree", 4, 20, "a.txt", 1 << 30, 1, 101, 0.75, 2.5, 0.5, 13.0, 2.0, 7 << 30, 5 << 30, 0),
    ("matrix", 8, 20, "b.txt", 1 << 31, 4, 256, 1.5, 4.0, 0.5, 20.0, 0.0, 20 << 30, 9 << 30, 1 << 30),
    ("matrix", 8, 20, "b.txt", 1 << 31, 4, 256, 1.5, 4.0, 0.5, 18.0, 0.0, 22 << 30, 7 << 40, 500),
]


def _records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RUNS, report.SCHEMA)


_RECORDS = f"WITH r({', '.join(report.KEYS)}) AS (VALUES {', '.join(str(r) for r in _RUNS)})"


def _iec(x: str) -> str:
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    cases = " ".join(f"WHEN {x} < {1024 ** (k + 1)} THEN printf('%.3f {u}', {x} / {float(1024**k)})" for k, u in enumerate(units[:-1]))
    return f"CASE {cases} ELSE printf('%.3f TiB', {x} / {float(1024**4)}) END"


def _registry() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def add(name: str, query: Callable[[Text], DataFrame], text: str, oracle: str) -> None:
        queries[name] = lambda spark, sf_dir: query(Text(spark, sf_dir, text))
        sql[name] = oracle

    def tree(kind: str) -> Callable[[Text], DataFrame]:
        return lambda t: t.build(kind)

    for name in ("events", "chars", "bytes"):
        add(f"hist_{name}", lambda t: t.hist, name, _ctes(name) + " SELECT raw, occ FROM h")
    add("hist_bytes_hex", lambda t: t.hist.select(F.lpad(F.hex("raw"), 2, "0").alias("byte"), "occ"), "bytes", _ctes("bytes") + " SELECT lpad(hex(raw), 2, '0') AS byte, occ FROM h")
    for name in ("events", "chars"):
        add(f"alphabet_size_{name}", lambda t: t.hist.agg(F.count("*").alias("sigma")), name, _ctes(name) + " SELECT sigma FROM s")
        add(f"text_length_{name}", lambda t: t.hist.agg(F.sum("occ").alias("n")), name, _ctes(name) + " SELECT n FROM s")
    for name in ("events", "users", "chars", "wide"):
        add(f"effective_alphabet_{name}", lambda t: t.alphabet.table, name, _ctes(name) + " SELECT raw, code, occ FROM a")
    for name in ("users", "sizes"):
        c = " SELECT code, (sum(occ) OVER (ORDER BY code) - occ)::BIGINT AS c FROM (SELECT code, occ FROM a UNION ALL SELECT sigma, 0 FROM s)"
        add(f"c_array_{name}", lambda t: A.c_array(t.alphabet), name, _ctes(name) + c)
    for name in ("users", "chars"):
        add(f"effective_text_{name}", lambda t: t.codes(), name, _ctes(name) + " SELECT pos, code FROM e")
    add("inverse_transform", lambda t: A.inverse_text(t.codes(), t.alphabet), "events", _ctes("events") + " SELECT pos, raw FROM t")
    for name in ("users", "types"):
        sizes = """, z0 AS (SELECT (1::BIGINT << level) + (code >> (height - level)) AS node_id, sum(occ)::BIGINT AS size FROM a, l GROUP BY ALL),
        z AS (SELECT (length(bin(i)) - 1)::INT AS level, i AS node_id, coalesce(size, 0)::BIGINT AS size FROM (SELECT unnest(range(1, (1::BIGINT << height))) AS i FROM s) LEFT JOIN z0 ON node_id = i)"""
        add(f"node_sizes_{name}", lambda t: A.node_sizes(t.alphabet), name, _ctes(name) + sizes + " SELECT level, node_id, size FROM z")
        starts = " SELECT level, node_id, size, (sum(size) OVER (PARTITION BY level ORDER BY node_id) - size)::BIGINT AS start FROM z"
        add(f"node_starts_{name}", lambda t: A.node_starts(A.node_sizes(t.alphabet)), name, _ctes(name) + sizes + starts)
        starts = f" SELECT level, node_id, size, (sum(size) OVER (PARTITION BY level ORDER BY rev) - size)::BIGINT AS start FROM (SELECT *, {_REV} AS rev FROM (SELECT *, node_id - (1::BIGINT << level) AS node FROM z))"
        add(f"node_starts_matrix_{name}", lambda t: A.node_starts(A.node_sizes(t.alphabet), True), name, _ctes(name) + sizes + starts)

    for name, text in {"sigma2": "quality", "sigma3": "status", "sigma5": "events", "users": "users", "types": "types", "sizes": "sizes", "chars": "chars", "bytes": "bytes", "wide": "wide"}.items():
        add(f"wt_levels_{name}", tree(B.TREE), text, _ctes(text) + _levels(False) + " SELECT * FROM w")
        if text != "wide":
            add(f"wm_levels_{name}", tree(B.MATRIX), text, _ctes(text) + _levels(True) + " SELECT * FROM w")
    for name in ("types", "users"):
        add(f"wt_nodes_{name}", tree(B.NODES), name, _ctes(name) + _nodes() + " SELECT * FROM w")
        add(f"wt_merge_nodes_{name}", lambda t: B.merge_nodes(t.build(B.NODES), t.alphabet), name, sql[f"wt_levels_{name}"])
        add(f"wm_merge_nodes_{name}", lambda t: B.merge_nodes(t.build(B.NODES), t.alphabet, True), name, sql[f"wm_levels_{name}"])
    for name in ("events", "users"):
        z = _ctes(name) + " SELECT level, sum(1 - ((code >> (height - 1 - level)) & 1))::BIGINT AS z FROM e, l GROUP BY level"

        def counted(t: Text) -> DataFrame:
            h = t.alphabet.height
            rows = t.codes().select("code", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("level"))
            return rows.groupBy("level").agg(F.sum(1 - level_bit(F.col("code"), F.col("level"), h)).alias("z"))

        add(f"wm_z_count_{name}", counted, name, z)
        add(f"wm_z_popcount_{name}", lambda t: B.z_from_words(t.build(B.MATRIX), t.alphabet.n), name, z)
        add(f"wm_z_hist_{name}", lambda t: B.z_from_histogram(t.alphabet), name, z)

    def text_prefix(t: Text) -> DataFrame:
        raw = stored(T.prefix(t.chunks, PREFIX), "prefix")
        chunks = T.pack(raw, ["pos"], "raw", "int")
        return B.build(chunks, A.effective_alphabet(A.packed_histogram(chunks)))

    add("wt_text_prefix", text_prefix, "chars", _ctes("chars", f"pos < {PREFIX}") + _levels(False) + " SELECT * FROM w")
    def node_bits(t: Text) -> DataFrame:
        """The bits of each node beside their index in it: places after a node's end, which fill up its last word, left out."""
        sizes = A.node_sizes(t.alphabet).select("node_id", "size")
        return expand(t.build(B.NODES), ["node_id"]).join(F.broadcast(sizes), "node_id").filter("p < size").select("node_id", "p", "bit")

    bit = "CASE WHEN x < 0 THEN x::HUGEINT + 18446744073709551616::HUGEINT ELSE x::HUGEINT END"
    expanded = f" SELECT level, word_idx * 64 + k AS p, (({bit} >> (63 - k)::INT) & 1)::INT AS bit FROM (SELECT level, word_idx, word AS x, unnest(range(64)) AS k FROM w)"
    add("expand_bits", lambda t: expand(t.build(B.TREE), ["level"]), "events", _ctes("events") + _levels(False) + expanded)
    add("popcount", lambda t: t.build(B.TREE).select("level", "word_idx", F.bit_count("word").alias("ones")), "events", _ctes("events") + _levels(False) + " SELECT level, word_idx, bit_count(word)::INT AS ones FROM w")
    for name in ("events", "types"):
        for short, kind in (("wt", B.TREE), ("wm", B.MATRIX)):
            add(f"{short}_decode_{name}", lambda t, kind=kind: A.inverse_text(t.decode(t.build(kind), kind), t.alphabet), name, _ctes(name) + " SELECT pos, raw FROM t")
            add(f"{short}_verify_{name}", lambda t, kind=kind: t.verify(t.build(kind), kind), name, "SELECT 0::BIGINT AS differences")
        add(f"wt_decode_nodes_{name}", lambda t: A.inverse_text(t.decode(t.build(B.NODES), B.NODES), t.alphabet), name, _ctes(name) + " SELECT pos, raw FROM t")
        at = ", q AS (SELECT (1::BIGINT << level) + (code >> (height - level)) AS node_id, row_number() OVER (PARTITION BY level, code >> (height - level) ORDER BY pos) - 1 AS p, pos, ((code >> (height - 1 - level)) & 1)::INT AS bit FROM e, l)"
        add(f"node_bits_{name}", lambda t: node_bits(t), name, _ctes(name) + at + " SELECT node_id, p, bit FROM q")
    root = _ctes("events") + ", b AS (SELECT pos, ((code >> (height - 1)) & 1)::INT AS bit FROM e, s), c AS (SELECT sum(1 - bit)::BIGINT AS num0, sum(bit)::BIGINT AS num1 FROM b)"
    root += f", g AS (SELECT *, CASE WHEN num1 > 0 THEN least(ceil(num0 * {WORKERS} / (num0 + num1)), {WORKERS - 1}) ELSE ceil(num0 * {WORKERS} / (num0 + num1)) END::BIGINT AS targets0 FROM c)"
    root += f", f AS (SELECT *, {WORKERS} - targets0 AS targets1, CASE WHEN targets0 > 0 THEN ceil(num0 / targets0) ELSE 0 END::BIGINT AS per0, CASE WHEN {WORKERS} - targets0 > 0 THEN ceil(num1 / ({WORKERS} - targets0)) ELSE 0 END::BIGINT AS per1 FROM g)"
    add("dsplit_plan", lambda t: split.split_plan(_bits(t), WORKERS), "events", root + " SELECT num0, num1, targets0, targets1, per0, per1 FROM f")
    ranked = " SELECT pos, bit, (CASE WHEN bit = 0 THEN r // per0 ELSE targets0 + r // per1 END)::BIGINT AS target FROM (SELECT *, row_number() OVER (PARTITION BY bit ORDER BY pos) - 1 AS r FROM b), f"
    add("dsplit_targets", lambda t: split.split_targets(_bits(t), WORKERS), "events", root + ranked)

    def sorted_prefix(t: Text) -> DataFrame:
        h = t.alphabet.height
        keyed = t.codes().select("pos", "code", node_of(F.col("code"), F.lit(h - 1), h).alias("node"))
        sizes = keyed.groupBy("node").agg(F.count("*").alias("size"))
        starts = running_sum(sizes, [], "node", "size", "start").select("node", "start")
        ranked = running_sum(keyed.withColumn("one", F.lit(1)), ["node"], "pos", "one", "rank")
        return ranked.join(starts, "node").select("pos", "code", (F.col("start") + F.col("rank")).alias("place"))

    add("stable_sort_prefix", sorted_prefix, "events", _ctes("events") + " SELECT pos, code, row_number() OVER (ORDER BY code >> 1, pos) - 1 AS place FROM e")

    def buckets(t: Text) -> list[DataFrame]:
        bits = t.codes().join(_bits(t), "pos")
        return [bits.filter(F.col("bit") == b).select("pos", "code") for b in (0, 1)]

    add("union_buckets", lambda t: buckets(t)[0].unionByName(buckets(t)[1]), "events", _ctes("events") + " SELECT pos, code FROM e")

    def concat(t: Text) -> DataFrame:
        zeros, ones = (running_sum(b.withColumn("one", F.lit(1)), [], "pos", "one", "rank") for b in buckets(t))
        z = zeros.count()
        return zeros.select("code", F.col("rank").alias("pos")).unionByName(ones.select("code", (F.col("rank") + z).alias("pos")))

    add("concat_bits", concat, "events", _ctes("events") + " SELECT code, row_number() OVER (ORDER BY (code >> (height - 1)) & 1, pos) - 1 AS pos FROM e, s")
    scan = _ctes("chars") + ", k AS (SELECT pos // 4096 AS chunk, code, count(*) AS n FROM e GROUP BY ALL)"

    def counts(t: Text) -> DataFrame:
        return t.codes().groupBy(F.expr("pos div 4096").alias("chunk"), "code").agg(F.count("*").alias("n"))

    add("exclusive_scan", lambda t: running_sum(counts(t), ["code"], "chunk", "n", "before"), "chars", scan + " SELECT chunk, code, n, (sum(n) OVER (PARTITION BY code ORDER BY chunk) - n)::BIGINT AS before FROM k")
    add("inclusive_scan", lambda t: running_sum(counts(t), ["code"], "chunk", "n", "upto", True), "chars", scan + " SELECT chunk, code, n, (sum(n) OVER (PARTITION BY code ORDER BY chunk))::BIGINT AS upto FROM k")
    queries["bitrev"] = lambda spark, sf_dir: spark.range(256).select("id", bitrev(F.col("id"), F.lit(8)).alias("rev"))
    sql["bitrev"] = "SELECT range AS id, list_sum(list_transform(range(8), lambda i: ((range >> i::INT) & 1) * (1::BIGINT << (7 - i)::INT)))::BIGINT AS rev FROM range(256)"
    packed = ", b0 AS (SELECT pos // 64 AS word_idx, sum(((code >> (height - 1)) & 1)::HUGEINT << (63 - pos % 64)::INT) AS x FROM e, s GROUP BY ALL)"
    add("pack_words", lambda t: pack(_bits(t), [], "pos", "bit"), "events", _ctes("events") + packed + f" SELECT word_idx, {_WORD} AS word FROM b0")
    keep = (97, 99, 103, 116)
    add("keep_filter", lambda t: t.symbols().filter(F.col("raw").isin(*keep)), "chars", _ctes("chars") + f" SELECT pos, raw FROM t WHERE raw IN {keep}")
    add("max_symbol", lambda t: t.hist.agg(F.max("raw").alias("most")), "users", "SELECT max(user_id) AS most FROM events")
    add("zip_with_index", lambda t: t.symbols(), "chars", _ctes("chars") + " SELECT pos, raw FROM t")
    add("zip_compare", lambda t: B.differences(t.symbols(), t.symbols().withColumn("raw", F.when(F.col("raw") == 1, F.lit(0)).otherwise(F.col("raw"))), "raw"), "users", "SELECT count(*) AS differences FROM events WHERE user_id = 1")
    queries["throughput"] = lambda spark, sf_dir: report.throughput(_records(spark))
    sql["throughput"] = _RECORDS + " SELECT algo, nodes, size, size * ceil(log2(alphabet)) / median(time_construct + time_merge + time_hist) / 1073741824 AS throughput FROM r GROUP BY algo, nodes, size, alphabet"
    queries["mem_per_node"] = lambda spark, sf_dir: report.memory_per_node(_records(spark))
    sql["mem_per_node"] = _RECORDS + " SELECT algo, nodes, avg(memory) / nodes / 1073741824 AS mem_per_node FROM r GROUP BY algo, nodes"
    queries["traffic"] = lambda spark, sf_dir: report.traffic(_records(spark))
    sql["traffic"] = _RECORDS + " SELECT algo, nodes, avg(traffic) / 1073741824 AS traffic FROM r GROUP BY algo, nodes"
    queries["result_line"] = lambda spark, sf_dir: report.result_line(_records(spark))
    fields = ", ".join(f"'{k}=' || {k}::DOUBLE" if k.startswith("time") else f"'{k}=' || {k}" for k in report.KEYS)
    sql["result_line"] = _RECORDS + f" SELECT concat_ws(' ', 'RESULT', {fields}) AS line FROM r"
    queries["summary"] = lambda spark, sf_dir: report.summary(_records(spark))
    total = " + ".join(k for k in report.KEYS if k.startswith("time"))
    sql["summary"] = _RECORDS + f""" SELECT algo || ' on ' || input || ': ' || {_iec('size')} || ' in ' || printf('%.3f', ({total})::DOUBLE) || ' s on ' || nodes || ' nodes of ' || workers_per_node || ' workers, traffic ' || {_iec('traffic')}
        || ' (asymmetry ' || {_iec('traffic_asym')} || '), memory ' || {_iec('memory')} || ' (' || {_iec('(memory // (nodes * workers_per_node))')} || ' a worker)' AS text FROM r"""

    # stored indexes, written and read back
    def kept(kind: str) -> Callable[[Text], str]:
        def write(t: Text) -> str:
            path, words = fresh(t.spark, "index"), stored(t.build(kind), "words")
            store.write_index(path, words, t.alphabet.table.select("raw", "occ"), B.z_from_words(words, t.alphabet.n) if kind == B.MATRIX else None)
            return path

        return write

    add("store_levels_users", lambda t: store.read_levels(t.spark, kept(B.TREE)(t)), "users", sql["wt_levels_users"])
    add("store_matrix_users", lambda t: store.read_levels(t.spark, kept(B.MATRIX)(t)), "users", sql["wm_levels_users"])
    add("store_nodes_types", lambda t: store.read_levels(t.spark, kept(B.NODES)(t)), "types", sql["wt_nodes_types"])
    add("store_hist_users", lambda t: store.read_histogram(t.spark, kept(B.TREE)(t)), "users", _ctes("users") + " SELECT raw, occ FROM h")
    add("store_z_users", lambda t: store.read_zeros(t.spark, kept(B.MATRIX)(t)), "users", sql["wm_z_hist_users"])
    add("store_level_scan", lambda t: store.read_levels(t.spark, kept(B.TREE)(t), 2), "users", sql["wt_levels_users"] + " WHERE level = 2")

    def exported(t: Text, kind: str) -> DataFrame:
        path = f"{fresh(t.spark, 'export')}/index"
        store.export_passes(t.build(kind, B.blocks_in_passes), path)
        return store.read_words(t.spark, path, "node_id" if kind == B.NODES else "level")

    add("export_levels_users", lambda t: exported(t, B.TREE), "users", sql["wt_levels_users"])
    add("export_matrix_chars", lambda t: exported(t, B.MATRIX), "chars", sql["wm_levels_chars"])
    add("export_nodes_types", lambda t: exported(t, B.NODES), "types", sql["wt_nodes_types"])

    def small_parts(t: Text, zeros: bool) -> DataFrame:
        path, alphabet = f"{fresh(t.spark, 'export')}/index", t.alphabet
        if zeros:
            store.export_zeros({r.level: r.z for r in B.z_from_histogram(alphabet).collect()}, path)
            return store.import_zeros(t.spark, path)
        store.export_histogram(list(zip(alphabet.symbols, alphabet.counts.tolist(), strict=True)), 4, path)
        return store.import_histogram(t.spark, 4, path)

    add("export_hist_chars", lambda t: small_parts(t, False), "chars", sql["hist_chars"])
    add("export_z_users", lambda t: small_parts(t, True), "users", sql["wm_z_hist_users"])

    def binary(t: Text) -> DataFrame:
        """The bytes of documents in a binary file, a file for each range, read as a text."""
        path = f"{fresh(t.spark, 'bytes')}/text"
        store.export_strings(t.docs, "text", "doc_id", path, store.TEXT)
        return T.from_binary(t.spark, f"{path}*.{store.TEXT}")

    add("binary_hist", lambda t: A.packed_histogram(binary(t)), "bytes", sql["hist_bytes"])

    def verified(t: Text) -> DataFrame:
        """The stored index of a stored text, decoded and held against it."""
        chunks = binary(t)
        names = A.effective_alphabet(A.packed_histogram(chunks))
        path = f"{fresh(t.spark, 'export')}/index"
        store.export_passes(B.blocks_in_passes(chunks, names), path)
        return D.verify_files(path, chunks, names)

    add("verify_stored_bytes", verified, "bytes", "SELECT 0::BIGINT AS differences")
    queries["file_sizes"] = lambda spark, sf_dir: spark.read.format("binaryFile").load(f"{sf_dir}/*.parquet").agg(F.count("*").alias("files"), F.min(F.col("length") > 0).alias("filled"))
    sql["file_sizes"] = "SELECT 14::BIGINT AS files, true AS filled"

    # forced scans, sizes, parts, packed symbols
    def forced(t: Text, scans: Callable[[DataFrame], tuple]) -> DataFrame:
        return t.spark.createDataFrame([scans(t.symbols())], "n long, again long")

    add("input_scan", lambda t: forced(t, force.scanned_twice), "users", "SELECT count(*) AS n, count(*) AS again FROM events")
    add("force_levels", lambda t: t.spark.createDataFrame([(force.force(t.build(B.TREE))[1],)], "words long"), "events", _ctes("events") + _levels(False) + " SELECT count(*) AS words FROM w")
    add("text_size", lambda t: t.symbols().agg(F.count("*").alias("n")), "sizes", "SELECT count(*) AS n FROM part")

    def parts(t: Text) -> DataFrame:
        path, rows = fresh(t.spark, "parts"), t.symbols()
        size = -(-t.alphabet.n // WORKERS)
        rows.withColumn("part", F.expr(f"pos div {size}")).write.partitionBy("part").parquet(path)
        return t.spark.read.parquet(path).select(F.col("part").cast("long").alias("part"), "pos", "raw")

    add("text_parts", parts, "users", _ctes("users") + f" SELECT pos // ((n + {WORKERS - 1}) // {WORKERS}) AS part, pos, raw FROM t, s")

    def packed_symbols(t: Text) -> DataFrame:
        """Eight one-byte symbols in a word, the first in its lowest byte."""
        return T.in_words(t.chunks)

    def unpacked_symbols(t: Text) -> DataFrame:
        rows = packed_symbols(t).select("word_idx", "word", F.explode(F.expr("sequence(0, 7)")).alias("k"))
        byte = F.call_function("shiftrightunsigned", "word", F.col("k") * 8).bitwiseAND(F.lit(255))
        return rows.select((F.col("word_idx") * 8 + F.col("k")).alias("pos"), byte.alias("raw")).filter(F.col("pos") < t.alphabet.n)

    packed = ", b0 AS (SELECT pos // 8 AS word_idx, sum(raw::HUGEINT << (pos % 8 * 8)::INT) AS x FROM t GROUP BY ALL)"
    add("pack_symbols", packed_symbols, "bytes", _ctes("bytes") + packed + f" SELECT word_idx, {_WORD} AS word FROM b0")
    add("unpack_symbols", unpacked_symbols, "bytes", _ctes("bytes") + " SELECT pos, raw FROM t")

    def kept_bytes(t: Text) -> DataFrame:
        """Keeps some bytes of a file and writes them to another, which is read again."""
        path = f"{fresh(t.spark, 'kept')}/text"
        store.export(t.symbols().filter(F.col("raw").isin(*keep)), ["pos"], "raw", 1, path, store.TEXT)
        return T.unpack(T.from_binary(t.spark, f"{path}*.{store.TEXT}"))

    add("keep_filter_file", kept_bytes, "bytes", _ctes("bytes") + f" SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, raw FROM t WHERE raw IN {keep}")
    def hist_tool(t: Text) -> DataFrame:
        named = F.when(F.col("raw") == 9, "\\t").when(F.col("raw") == 10, "\\n").when(F.col("raw") == 13, "\\r").otherwise(F.char("raw"))
        rows = t.hist.select(F.concat(F.lit("0x"), F.lpad(F.hex("raw"), 2, "0")).alias("byte"), F.when(F.col("raw") < 128, named).alias("name"), "occ")
        return rows.unionByName(t.hist.select(F.lit("total").alias("byte"), F.lit(None).cast("string").alias("name"), F.sum("occ").alias("occ")))

    tool = " SELECT '0x' || lpad(hex(raw), 2, '0') AS byte, CASE WHEN raw = 9 THEN '\\t' WHEN raw = 10 THEN '\\n' WHEN raw = 13 THEN '\\r' WHEN raw < 128 THEN chr(raw::INT) END AS name, occ FROM h UNION ALL SELECT 'total', NULL, n FROM s"
    add("hist_tool", hist_tool, "bytes", _ctes("bytes") + tool)
    queries["max_nodes"] = lambda spark, sf_dir: spark.range(0, 63).select(F.col("id").alias("height"), (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").cast("int")) - 1).alias("nodes"))
    sql["max_nodes"] = "SELECT range AS height, ((1::HUGEINT << range::INT) - 1)::BIGINT AS nodes FROM range(63)"

    # splits down the tree
    n01 = """, n01 AS (SELECT level, (1::BIGINT << level) + (code >> (height - level)) AS node_id, sum(CASE WHEN (code >> (height - 1 - level)) & 1 = 0 THEN occ ELSE 0 END)::BIGINT AS num0,
        sum(CASE WHEN (code >> (height - 1 - level)) & 1 = 1 THEN occ ELSE 0 END)::BIGINT AS num1 FROM a, l GROUP BY ALL)"""
    add("dsplit_counts", lambda t: split.split_counts(t.alphabet), "users", _ctes("users") + n01 + " SELECT level, node_id, num0, num1 FROM n01")
    for workers in (WORKERS, 23):
        wanted = "ceil(num0 * r.workers / (num0 + num1))"
        targets0 = f"CASE WHEN num1 > 0 THEN least({wanted}, r.workers - 1) ELSE {wanted} END::BIGINT"
        tree_ = f""", r(node_id, first, workers) AS (SELECT 1::BIGINT, 0::BIGINT, {workers}::BIGINT UNION ALL
            SELECT 2 * r.node_id + b, CASE WHEN b = 0 THEN r.first ELSE r.first + {targets0} END, CASE WHEN b = 0 THEN {targets0} ELSE r.workers - {targets0} END
            FROM r JOIN n01 ON n01.node_id = r.node_id, (SELECT unnest([0, 1])::BIGINT AS b) WHERE r.workers > 1),
        g AS (SELECT level, r.node_id, first, workers, num0, num1, {targets0} AS targets0 FROM r JOIN n01 ON n01.node_id = r.node_id WHERE r.workers > 1)
        SELECT *, workers - targets0 AS targets1, CASE WHEN targets0 > 0 THEN ceil(num0 / targets0) ELSE 0 END::BIGINT AS per0, CASE WHEN workers > targets0 THEN ceil(num1 / (workers - targets0)) ELSE 0 END::BIGINT AS per1 FROM g"""
        add(f"dsplit_tree_{workers}", lambda t, workers=workers: split.split_tree(t.alphabet, workers), "users", (_ctes("users") + n01 + tree_).replace("WITH t", "WITH RECURSIVE t", 1))
    return queries, sql


QUERIES, ORACLES = _registry()
