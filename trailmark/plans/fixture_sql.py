"""The fixture views as SQL common table expressions, joined in front of a check's own SQL."""

from __future__ import annotations

import re

FX: dict[str, str] = {
    "fx_xy": """
SELECT frame, (frame - 1) // 24 + 1 AS m, (frame - 1) % 24 + 1 AS mf, ant, arg_max(x, event_id) AS x, arg_max(y, event_id) AS y FROM (
  SELECT 'U' || lpad((user_id % 16)::VARCHAR, 2, '0') AS ant, floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600)::BIGINT + 1 AS frame, event_id,
    value * 1e-4 AS x, json_extract_string(props, '$.k')::DOUBLE * 1e-3 AS y FROM events) GROUP BY frame, ant""",
    "fx_movies": "SELECT m, 24 * (m - 1) + 1 AS fi, 24 * m AS ff, 24::BIGINT AS nframes, 1.0::DOUBLE AS fps FROM (SELECT unnest(range(1, 31)) AS m)",
    "fx_recorded": "SELECT m, 24 * (m - 1) + 1 AS fi, 24 * m AS ff, max(mf) AS nframes, 1.0::DOUBLE AS fps FROM fx_xy GROUP BY m",
    "fx_frames": "SELECT frame, (frame - 1) // 24 + 1 AS m, (frame - 1) % 24 + 1 AS mf FROM (SELECT unnest(range(1, 721)) AS frame)",
    "fx_ants": "SELECT DISTINCT ant FROM fx_xy",
    "fx_tracklets": """
SELECT tracklet, colony, fi, ff, ff - fi + 1 AS len, score, label, area FROM (
  SELECT o_orderkey AS tracklet, o_custkey // 60 AS colony, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 1 AS fi,
    date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 1 + (o_orderkey * 7919) % 30 AS ff, o_totalprice AS score,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'A' || (o_custkey % 8) WHEN '2-HIGH' THEN 'A' || (o_custkey % 8) WHEN '3-MEDIUM' THEN 'MultiAnt'
      WHEN '4-NOT SPECIFIED' THEN 'NoAnt' ELSE 'Unknown' END AS label FROM orders)
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS area FROM lineitem GROUP BY 1) ON tracklet = l_orderkey""",
    "fx_edges": "SELECT a.colony, a.tracklet AS src, b.tracklet AS dst FROM fx_tracklets a JOIN fx_tracklets b ON a.colony = b.colony AND b.fi = a.ff + 1",
    "fx_untagged": """
SELECT tracklet, colony, frame, ((tracklet * 7919 + frame * 31) % 1000) / 1000.0::DOUBLE AS x, ((tracklet * 104729 + frame * 17) % 1000) / 1000.0::DOUBLE AS y, area
FROM (SELECT tracklet, colony, area, unnest(range(fi, ff + 1)) AS frame FROM fx_tracklets)""",
    "fx_scores": """
SELECT vec_id // 5 AS tracklet, vec_id % 5 AS frame, list_transform(w, lambda v: v / list_sum(w)) AS p FROM (
  SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS w FROM (SELECT vec_id, list_transform(range(10), lambda k: 40.0::DOUBLE * list_sum(list_transform(range(k + 1, len(embedding) + 1, 10), lambda i: embedding[i]::DOUBLE))) AS z FROM embeddings))""",
    "fx_dat": "SELECT frame, avg(v) AS S1, " + ", ".join(f"avg(v) FILTER (WHERE k = {k}) AS T{k + 1}" for k in range(4)) + """ FROM (
  SELECT floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600)::BIGINT + 1 AS frame, user_id % 4 AS k, value AS v FROM events) GROUP BY frame""",
}


def with_fixtures(sql: str, extra: dict[str, str] | None = None) -> str:
    """sql with the common table expressions that it names, in order of need."""
    views, done = FX | (extra or {}), []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:fx|vw)_\w+", text)):
            if name in views and name not in done:
                need(views[name].replace(name, ""))
                done.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({views[n].strip()})" for n in done)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:].strip()}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
