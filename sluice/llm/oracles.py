"""DuckDB SQL of the document queries that SQL can express."""

from __future__ import annotations

from sluice.llm import secrets

WORDS = r"regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')"
N_WORDS = f"len(list_filter({WORDS}, lambda w: w <> ''))"

OP4 = f"""
WITH sized AS (SELECT doc_id, source, {N_WORDS}::BIGINT AS size, sha256(coalesce(doc_id::VARCHAR, 'null')) AS seed FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM per),
level0 AS (
  SELECT *, source_size * 2.0::DOUBLE AS room,
    ((SELECT sum(source_size) FROM per)::DOUBLE * 1.5
      - coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM named
  WINDOW w AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(room, coalesce((SELECT max(level) FROM level0 WHERE level * weight <= room) * weight, room)) AS target
  FROM level0),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
draws AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.rate, j.j,
    (('0x' || substr(d.seed, 4 * j.j + 1, 8))::BIGINT / 4294967296.0::DOUBLE < r.rate - floor(r.rate))::INT AS extra
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, (SELECT unnest(range(15))::INT AS j) j),
sums AS (SELECT source, j, abs(any_value(floor(rate) * source_size) + sum(size * extra) - any_value(target)) AS far FROM draws GROUP BY source, j),
chosen AS (SELECT source, any_value(j) AS j FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY far, j) AS k FROM sums) WHERE k = 1 GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * (floor(d.rate)::BIGINT + d.extra))::BIGINT AS taken
FROM draws d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.j = c.j
"""


def _spans(kind: str, order: int, pattern: str, group: int = 0, keep: str = "true") -> str:
    """Rows (doc_id, start, order, end, kind) of a pattern's matches, as places between the pieces that splitting leaves."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, q + sum(length(p)) OVER w + coalesce(sum(length(m)) OVER v, 0) AS s, {order} AS ord, q + sum(length(p)) OVER w + sum(length(m)) OVER w AS e, '{kind}' AS kind, {keep} AS keep
    FROM (SELECT doc_id, 0 AS q, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS p
          FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g, regexp_split_to_array(text, '{p}') AS p
                FROM documents WHERE regexp_matches(text, '{p}')))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i), v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _op1() -> str:
    found = " UNION ALL ".join(_spans(r.kind, i, r.pattern, r.group, f"length(g) >= {r.least}") for i, r in enumerate(secrets.RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in secrets.BASE)
    text = "concat_ws(':', kind, s::BIGINT::VARCHAR, e::BIGINT::VARCHAR)"
    return f"""
    WITH found AS (SELECT * FROM ({found}) WHERE keep),
    per AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY s, ord) FILTER (ord < {len(secrets.BASE)}) AS base, string_agg({text}, ',' ORDER BY s, ord) AS spans FROM found GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN per USING (doc_id)"""


OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

ORACLES = {"op1_secrets": _op1(), "op4_mixing": OP4, "op11_negatives": OP11}
