"""DuckDB SQL for the queries that SQL can express; the other queries are held against brute force in the tests."""

from __future__ import annotations

from .common import ASCII_LOWER, ASCII_UPPER
from .fingerprints import LEAF

_LOWER = f"translate({{}}, '{ASCII_UPPER}', '{ASCII_LOWER}')"

#: The rules alone: the table's pages name no canonical links or redirects, so no page has an alias.
OP1 = f"""
WITH u AS (
  SELECT page_id, COALESCE({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS k
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, COALESCE(arg_max(verdict, length(h || p)), 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p)
GROUP BY k, page_id, host, path
"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_TREE = (
    "list_transform(string_split({}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), "
    f"lambda p: list_transform(regexp_extract_all(p, '(?s){LEAF.replace('{0,200}+', '{0,200}')}'), lambda x: substr(sha256(x), 1, 32))))"
).replace("{0,200}", "{{0,200}}").replace("{1,200}", "{{1,200}}")
_ROOT = (
    "sha256('R' || array_to_string(list_transform({0}, lambda s: sha256('S' || array_to_string(list_transform(s, lambda p: sha256('P' || array_to_string(p, ''))), ''))), ''))"
)
_LIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"

OP4 = f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, COALESCE(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after, length(text) AS n FROM d),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(after, 1, n // 2) AS edited FROM n),
t AS (SELECT *, {_TREE.format("text")} AS a, {_TREE.format("edited")} AS b, {_TREE.format("after")} AS c FROM e),
l AS (SELECT *, list_distinct(flatten(flatten(a))) AS la, list_distinct(flatten(flatten(b))) AS lb, list_distinct(flatten(flatten(c))) AS lc FROM t)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_ROOT.format("a")} AS fingerprint, {_ROOT.format("b")} AS edited_fingerprint,
       {_LIKE.format("la", "lb")} AS near_edited, {_LIKE.format("la", "lc")} AS near_next
FROM l
"""

OP11 = f"""
WITH d AS (
  SELECT * FROM (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents WHERE text IS NOT NULL)
  WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS nt FROM d),
p AS (SELECT doc_id, k, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, k, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t),
i AS (SELECT item_id, t, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, k,
         sum(q * CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // nt)))))::BIGINT AS score
  FROM i JOIN f USING (t) JOIN p USING (t) CROSS JOIN c GROUP BY item_id, doc_id, k)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

OP12 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

SQL: dict[str, str] = {"op1_url_filter": OP1, "op2_top_products": OP2, "op4_merkle_fingerprint": OP4, "op11_lexical_search": OP11, "op12_hard_negatives": OP12}
