"""Queries on frame scores and classifier measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import fixtures as fx
from trailmark.operators import classify as cl
from trailmark.plans.registry import query

ANT = [f"C{i}" for i in range(7)]
LIST = "['C0', 'C1', 'C2', 'C3', 'C4', 'C5', 'C6', 'Unknown', 'NoAnt', 'MultiAnt']"
V = {
    "vw_f": f"SELECT tracklet, frame, p, {LIST}[list_position(p, list_max(p))] AS label FROM fx_scores",
    "vw_c": "SELECT tracklet, label, count(*) AS n, min(frame) AS seen FROM vw_f GROUP BY ALL",
    "vw_k": """
SELECT tracklet, sum(n) AS n, coalesce(sum(n) FILTER (WHERE label LIKE 'C%'), 0) AS n_ant, coalesce(sum(n) FILTER (WHERE label = 'NoAnt'), 0) AS n_non, coalesce(sum(n) FILTER (WHERE label = 'MultiAnt'), 0) AS n_multi,
  arg_max(label, n * 1000 - seen) AS common, 'MultiAnt' AS common_multi FROM vw_c GROUP BY tracklet""",
    "vw_s": """
SELECT tracklet, list_position(s, list_max(s)) - 1 AS won, list_max(s) AS sum, top, f[list_position(s, list_max(s))] AS frame FROM (
  SELECT tracklet, [sum(p[1]), sum(p[2]), sum(p[3]), sum(p[4]), sum(p[5]), sum(p[6]), sum(p[7])] AS s, max(list_max(p[1:7])) AS top, [arg_max(frame, p[1]), arg_max(frame, p[2]), arg_max(frame, p[3]), arg_max(frame, p[4]), arg_max(frame, p[5]), arg_max(frame, p[6]), arg_max(frame, p[7])] AS f FROM vw_f WHERE label LIKE 'C%' GROUP BY tracklet)""",
    "vw_truth": "SELECT 'C' || (e.label % 7) AS truth, f.label AS predicted FROM embeddings e JOIN vw_f f ON e.vec_id // 5 = f.tracklet AND e.vec_id % 5 = f.frame",
}


def truth(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).cast("long").alias("tracklet"), (F.col("vec_id") % 5).alias("frame"), F.concat(F.lit("C"), (F.col("label") % 7).cast("string")).alias("truth"))
    f = fx.scores(spark, d).select("tracklet", "frame", F.get(F.array(*[F.lit(c) for c in fx.CLASSES]), cl.argmax("p")).alias("predicted"))
    return e.join(f, ["tracklet", "frame"])


@query("""
SELECT k.tracklet, CASE WHEN n_non = n THEN common WHEN many THEN common_multi WHEN n_ant = 0 THEN common WHEN unsure THEN 'Unknown' ELSE 'C' || won END AS label,
  CASE WHEN n_non = n OR many OR n_ant = 0 OR unsure THEN 0 ELSE sum END AS score, CASE WHEN n_non = n OR many OR n_ant = 0 OR unsure THEN -1 ELSE frame END AS best_frame
FROM (SELECT k.*, s.* EXCLUDE tracklet, (n_multi > 0 AND n_ant = 0) OR n_multi > 0.25 * n AS many, top < 0.9 OR (n_ant < 5 AND top < 0.99) AS unsure FROM vw_k k LEFT JOIN vw_s s ON k.tracklet = s.tracklet) k""", V)
def tracklet_vote(spark, d):
    return cl.tracklet_vote(fx.scores(spark, d), fx.CLASSES, ant=ANT, non_ant=["NoAnt"], multi=["MultiAnt"])


@query("SELECT truth, predicted, count(*) AS n FROM vw_truth GROUP BY ALL", V)
def confusion_matrix(spark, d):
    return cl.confusion_matrix(truth(spark, d))


@query("""
WITH t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (WHERE truth = predicted) AS tp FROM vw_truth GROUP BY 1), p AS (SELECT predicted AS label, count(*) AS said FROM vw_truth GROUP BY 1),
j AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(said, 0) AS said FROM t FULL JOIN p ON t.label = p.label),
r AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM j)
SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM r""", V)
def class_report(spark, d):
    return cl.class_report(truth(spark, d))


@query("SELECT 1 - avg((truth = predicted)::INT::DOUBLE) AS error FROM vw_truth", V)
def class_error(spark, d):
    return truth(spark, d).agg((1 - F.avg((F.col("truth") == F.col("predicted")).cast("double"))).alias("error"))


@query("SELECT label, sum(n) OVER () / (count(*) OVER () * n) * CASE label WHEN 'Unknown' THEN 20 WHEN 'MultiAnt' THEN 0.1::DOUBLE ELSE 1 END AS weight FROM (SELECT label, count(*)::DOUBLE AS n FROM fx_tracklets GROUP BY 1)")
def class_weights(spark, d):
    return cl.class_weights(fx.tracklets(spark, d), {"Unknown": 20.0, "MultiAnt": 0.1})


@query("SELECT label, count(*) AS n FROM fx_tracklets GROUP BY 1 HAVING count(*) > 900")
def class_counts(spark, d):
    return fx.tracklets(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 900")
