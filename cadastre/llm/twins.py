"""SQL twins of the queries of this subpackage, for the checking engine."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _components(n: int, percent: int, columns: str) -> str:
    """Components of documents by the similarity of their n-word shingles: all pairs with a shingle in common."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reached FROM s WHERE doc_id IS NOT NULL UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, {columns} FROM s LEFT JOIN c ON c.node = s.doc_id"""


SQL["op11_minhash_near_dedup"] = _components(2, 80, "component_id, doc_id IS NOT DISTINCT FROM component_id AS kept")

# three times over: nearest entries, then entries moved to the mean of their parts
_NEAREST = "SELECT vec_id, x.p, part, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN {book} USING (p)"


def _round(i: int) -> str:
    near = _NEAREST.format(book=f"b{i}")
    return f"""
a{i} AS MATERIALIZED (SELECT vec_id, p, part, arg_min(e, (d, e)) AS e FROM ({near}) t GROUP BY ALL),
m{i + 1} AS (SELECT p, e, i, floor(sum(part[i])::DOUBLE / count(*))::BIGINT AS c FROM a{i}, range(1, (SELECT dim // 16 + 2 FROM n)) r(i) WHERE i <= len(part) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, coalesce(f.entry, b{i}.entry) AS entry FROM b{i} LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS entry FROM m{i + 1} GROUP BY ALL) f USING (p, e)),"""


SQL["op12_vector_codes"] = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_WHOLE}),
n AS (SELECT len(v) AS dim FROM kept ORDER BY vec_id LIMIT 1),
x AS MATERIALIZED (SELECT vec_id, p, v[p * dim // 16 + 1 : (p + 1) * dim // 16] AS part FROM kept, n, range(16) r(p) WHERE len(v) = dim),
b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry
  FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),{_round(0)}{_round(1)}
z AS (SELECT vec_id, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM ({_NEAREST.format(book="b2")}) t GROUP BY vec_id, p),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS s FROM (SELECT p, e, array_to_string(entry, ',') AS t FROM b2) t)
SELECT kept.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM kept JOIN c USING (vec_id), h"""

SQL["op13_hard_negatives"] = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""

# links between different sets, of the least document of each set
SQL["op8_ngram_jaccard_join"] = _components(4, 85, "component_id, n_links") + """
LEFT JOIN (
  SELECT a, count(DISTINCT s) AS n_links FROM (
    SELECT l.a, list_sort(t.s) AS s FROM l JOIN s t ON t.doc_id = l.b JOIN s o ON o.doc_id = l.a
    WHERE list_sort(t.s) <> list_sort(o.s) AND l.a IN (SELECT min(doc_id) FROM s GROUP BY list_sort(s))) q
  GROUP BY a) q ON q.a = s.doc_id"""
SQL["op10_exact_top_k"] = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_WHOLE})
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS rank
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)) t
WHERE rank <= 5"""
