"""DuckDB SQL of the queries whose rows follow from the tables alone."""

from __future__ import annotations

from undulo.llm import license_scan

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reached(key: str, table: str) -> str:
    """Follows links (a, b): r (key, seen), every row with all that it reaches."""
    return f"""e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    r(id, seen) AS (SELECT {key}, {key} FROM {table} UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)"""


MINHASH = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS shingle FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
    {_reached("doc_id", "documents")}
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    g AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS length FROM v WHERE label IS NOT NULL AND len(v) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id
        WHERE list_inner_product(x.v, y.v) / (x.length * y.length) >= 0.98),
    {_reached("vec_id", "embeddings")},
    n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id"""



def _licenses() -> str:
    """Words stand between two spaces each, so that hits in a row share none; a hit takes one on either side and gets a mark before and behind it."""
    rules = ",\n".join(f"('{key}', ' (?:{pattern[6:-5].replace(' ', '  ')}) ', '{label}', {level}, {place}, {sure})" for key, pattern, label, level, place, sure in license_scan.rules())
    longest = " WHEN ".join(f"array_to_string(w[i + 1:i + {phrase.count(' ') + 1}], ' ') = '{phrase}' THEN '{label}'" for phrase, label in license_scan.BASE.items())
    return rf"""WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) || ' ' AS x FROM documents),
    d AS (SELECT doc_id, x, replace(x, ' ', '  ') AS y, regexp_extract_all(x, '[^ ]+') AS w FROM t),
    rules(keyword, pattern, label, level, place, sure) AS (VALUES {rules}),
    f AS MATERIALIZED (SELECT doc_id, level, place, label, sure, regexp_extract_all(regexp_replace(y, pattern, chr(1) || '\0' || chr(2), 'g'), '[^ ]+') AS w FROM d JOIN rules ON contains(x, keyword)),
    p AS (SELECT *, list_filter(range(len(w)), lambda i: w[i + 1] = chr(1)) AS opened, list_filter(range(len(w)), lambda i: w[i + 1] = chr(2)) AS closed FROM f),
    h AS MATERIALIZED (SELECT doc_id, level, place, label, sure, unnest(list_transform(range(len(opened)), lambda k: opened[k + 1] - 2 * k)) AS s,
        unnest(list_transform(range(len(closed)), lambda k: closed[k + 1] - 2 * k - 1)) AS e FROM p),
    kept AS (SELECT doc_id, label, sure FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.s <= h.s AND o.e >= h.e
        AND (o.level < h.level OR (o.level = h.level AND (o.e - o.s > h.e - h.s OR (o.e - o.s = h.e - h.s AND o.place < h.place)))))),
    b AS (SELECT doc_id, i, CASE WHEN {longest} END AS label FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) WHERE label IS NOT NULL),
    based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
    every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score FROM (SELECT doc_id, label, sure FROM kept UNION ALL SELECT doc_id, label, 0.75 FROM b) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN based USING (doc_id) LEFT JOIN every USING (doc_id)"""


ORACLES = {"op2_license_scan": _licenses(), "op6_minhash_dedup": MINHASH, "op7_embedding_dedup": VECTORS}
