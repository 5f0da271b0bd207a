"""The queries that plain SQL can express, written a second time."""

from __future__ import annotations

from surety.llm.licenses import DICE, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"

OP9 = f"""
WITH lines AS (SELECT doc_id, line, i FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
    FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS l FROM documents))),
keyed AS (SELECT *, translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), '{UPPER}', '{LOWER}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING COUNT(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
  sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _templates() -> str:
    rows = ", ".join(f"({n}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for n, (name, text) in enumerate(TEMPLATES))
    return f"(VALUES {rows}) v(n, license, body)"


def _bigrams(words: str) -> str:
    return (f"list_distinct(list_transform(range(1, len({words})), lambda i: list_extract({words}, i) || ' ' || list_extract({words}, i + 1)))")


def _words(text: str) -> str:
    return f"string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' ')"


OP8 = f"""
WITH texts AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, 'line' AS unit, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS unit_no FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM texts)
  UNION ALL
  SELECT doc_id, 'block', body, unit_no FROM (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) - 1 AS unit_no
    FROM (SELECT doc_id, regexp_split_to_array(t, '\\n( *\\n)+') AS l FROM texts)) WHERE contains(body, chr(10))),
grams AS (SELECT doc_id, unit, unit_no, {_bigrams('w')} AS g FROM (SELECT *, {_words('body')} AS w FROM parts) WHERE len(w) >= 2),
tpl AS (SELECT license, {_bigrams('w')} AS g FROM (SELECT license, {_words('body')} AS w FROM {_templates()})),
scored AS (SELECT doc_id, unit, unit_no, license, 2.0::DOUBLE * len(list_intersect(grams.g, tpl.g)) / (len(grams.g) + len(tpl.g)) AS dice
  FROM grams JOIN tpl ON len(grams.g) <= 3 * len(tpl.g) AND len(tpl.g) <= 3 * len(grams.g))
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, license, dice FROM scored WHERE dice >= {DICE}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license DESC) = 1"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"""

ORACLES: dict[str, str] = {"op8_licenses": OP8.strip(), "op9_line_dedup": OP9.strip(), "op12_hard_negatives": OP12.strip()}
