"""DuckDB SQL for the queries that SQL can say. Operators 5, 6, 7, 9 and 12 are tested by brute force or held-out accuracy instead."""

from __future__ import annotations

from trailmark.llm import quality

OP1 = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations WHERE role IN ('user', 'assistant')),
u AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id,
    CASE WHEN turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS parent,
    CASE length(t) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' WHEN 2 THEN 'rank' ELSE 'browse' END AS name,
    len(string_split(t, ' ')) AS words, md5(t) AS h
  FROM c WHERE role = 'user'),
k AS (
  SELECT u.*, p.call_id IS NOT NULL AS linked FROM u LEFT JOIN u p ON u.conv_id = p.conv_id AND u.parent = p.call_id),
d AS (
  SELECT *, coalesce(turn - max(turn) FILTER (WHERE NOT linked) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn), 0) // 2 AS depth FROM k),
r AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, md5(t) AS result FROM c WHERE role = 'assistant'),
j AS (
  SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.call_id, r.call_id) AS call_id, coalesce(d.turn, r.turn) AS turn, d.depth, d.name,
    CASE WHEN d.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
    CASE WHEN d.call_id IS NULL THEN '' ELSE array_to_string(list_sort(list_filter([
      CASE WHEN d.name = 'browse' THEN 'tool:browse' END,
      CASE WHEN d.name = 'search' AND words > 200 THEN 'range:words' END,
      CASE WHEN d.name = 'translate' THEN 'type:words' END,
      CASE WHEN d.name = 'rank' THEN 'missing:top' END,
      CASE WHEN d.name = 'rank' THEN 'unknown:words' END,
      CASE WHEN d.parent IS NOT NULL AND NOT d.linked THEN 'parent:' || d.parent END], lambda x: x IS NOT NULL)), ',') END AS errors,
    '{"arguments":' || CASE WHEN d.call_id IS NULL THEN 'null' ELSE '{"query_md5":"' || d.h || '","words":' || d.words || '}' END
      || ',"call_id":"' || coalesce(d.call_id, r.call_id) || '","name":' || coalesce('"' || d.name || '"', 'null')
      || ',"result":' || coalesce('"' || r.result || '"', 'null') || '}' AS canonical
  FROM d FULL JOIN r ON d.conv_id = r.conv_id AND d.call_id = r.call_id)
SELECT conv_id, call_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, 1099511627776), turn, call_id, CASE WHEN status = 'linked' THEN 0 ELSE 1 END, status) - 1 AS position,
  depth, name, status, errors, canonical FROM j
"""

_TESTS = sum(len(c) for _, c in quality.RULES.values())
_PAIRS = ", ".join(f"('{r}', {c})" for r, (_, cuts) in quality.RULES.items() for c in cuts)
_SCORES = ", ".join(f"{e.split(' / ')[0]} / nullif({e.split(' / ')[1]}, 0)::DOUBLE AS s_{r}" for r, (e, _) in quality.RULES.items())
_SCORE = "CASE rule " + " ".join(f"WHEN '{r}' THEN s_{r}" for r in quality.RULES) + " END"

OP2 = rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
v AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM v, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_bangs
  FROM t LEFT JOIN n ON t.doc_id = n.doc_id),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_SCORES} FROM m),
p AS (SELECT * FROM (VALUES {_PAIRS}) AS p(rule, cutoff)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
k AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE {_SCORE} > cutoff) AS k
  FROM s SEMI JOIN good ON s.doc_id = good.doc_id CROSS JOIN p WHERE NOT base_failed GROUP BY ALL),
q AS (
  SELECT lang, rule, cutoff, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.ALPHA / len(quality.RULES)})
      + (n - j) * ln(1 - {quality.ALPHA / len(quality.RULES)}))) FROM (SELECT unnest(range(0, k + 1)) AS j)) AS p FROM k),
cut AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM q WHERE p <= {quality.DELTA} / ((SELECT count(DISTINCT coalesce(lang, chr(0))) FROM k) * {_TESTS}) GROUP BY ALL),
bad AS (SELECT DISTINCT s.doc_id FROM s JOIN cut ON s.lang IS NOT DISTINCT FROM cut.lang WHERE {_SCORE} > cutoff)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM s LEFT JOIN bad ON s.doc_id = bad.doc_id
"""

_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP3 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate({_STRIP.format('line')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, coalesce(k.doc_id < h.last, false) AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h, n) ELSE page_id END AS last FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM m
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * o >= 80 * (na.n + nb.n - o)),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM b UNION SELECT b.b, r.seen FROM r JOIN b ON r.node = b.a),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.node
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
r(node, seen) AS (SELECT a, a FROM p UNION SELECT p.b, r.seen FROM r JOIN p ON r.node = p.a),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT t.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.c, t.vec_id) AS component_id, coalesce(c.c, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN k ON t.vec_id = k.a LEFT JOIN c ON t.vec_id = c.node
"""

OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, piece, unnest(w) AS x, unnest(range(len(w))) AS pos FROM w),
x AS (SELECT lang, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM i WINDOW s AS (PARTITION BY piece ORDER BY pos)),
g AS (
  SELECT lang, 1 AS k, x AS phrase, [x] AS words FROM x UNION ALL SELECT lang, 2, x || ' ' || y, [x, y] FROM x WHERE y IS NOT NULL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, [x, y, z] FROM x WHERE z IS NOT NULL),
f AS (SELECT lang, k, phrase, any_value(words) AS words, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (
  SELECT f.lang, f.k, f.phrase, f.words, f.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * f.a * f.a) // (l.a::HUGEINT * r.a) AS score
  FROM f CROSS JOIN (SELECT unnest([1, 2]) AS j) JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.words[1 : j], ' ')
    JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.words[j + 1 : f.k], ' ')
  WHERE j < f.k QUALIFY row_number() OVER (PARTITION BY f.lang, f.phrase ORDER BY score, j) = 1),
t AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(words[1 : 2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(words[2 : 3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
o AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, c.a DESC, encode(c.phrase)) AS rank
  FROM c LEFT JOIN t ON c.k = 2 AND c.lang = t.lang AND c.phrase = t.phrase WHERE t.a IS NULL OR 100 * t.a < 50 * c.a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, other))::INT AS rank, other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, other) <= 3
"""

ORACLES = {"op1_tool_calls": OP1, "op2_quality_rules": OP2, "op3_line_dedup": OP3, "op4_warc": OP4, "op8_ngram_join": OP8, "op10_embeddings": OP10, "op11_collocations": OP11, "op13_hard_negatives": OP13}


def oracle_sql() -> dict[str, str]:
    return ORACLES
