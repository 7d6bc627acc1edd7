"""Export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import fixtures as fx
from trailmark.operators import export as ex
from trailmark.operators import tracks as tk
from trailmark.operators.blocks import TASK_ROWS, dealt_out
from trailmark.plans.registry import query
from trailmark.plans.tracklet_queries import AREA, IDS
from trailmark.plans.tracklet_queries import V as TV


def _single(spark, d):
    t = fx.tracklets(spark, d)
    return t.join(tk.singles(t, fx.edges(t), min_area=AREA[0], max_area=AREA[1]), "tracklet")


@query("SELECT u.tracklet, frame, x, y, u.area, label, CASE WHEN label = 'NoAnt' THEN 0 ELSE 1 END AS nants FROM fx_untagged u JOIN fx_tracklets t ON u.tracklet = t.tracklet")
def export_untagged(spark, d):
    t = fx.tracklets(spark, d)
    return ex.untagged(fx.untagged(t), t, t.select("tracklet", F.when(F.col("label") == "NoAnt", 0).otherwise(1).alias("nants")))


@query("SELECT u.colony, label AS ant, frame, arg_max(x, fi * 10000000 + u.tracklet) AS x, arg_max(y, fi * 10000000 + u.tracklet) AS y FROM fx_untagged u JOIN fx_tracklets t ON u.tracklet = t.tracklet WHERE label LIKE 'A%' GROUP BY ALL")
def export_noprop(spark, d):
    t = fx.tracklets(spark, d)
    return ex.no_propagation(fx.untagged(t), t, IDS)


@query("SELECT tracklet, CASE WHEN NOT single THEN 'multi' WHEN label LIKE 'A%' THEN label ELSE '?' END AS id FROM vw_single", TV)
def export_groupids(spark, d):
    return ex.group_ids(_single(spark, d), IDS)


@query("SELECT tracklet AS target, count(*) AS n, min(frame) AS first_frame, arg_min(x * 0.02 * 1000, frame) AS x0, arg_max(y * 0.02 * 1000, frame) AS y1, any_value(sqrt(area) * 0.02 * 1000 / 4 * sqrt(1 - 0.36)) AS b FROM fx_untagged GROUP BY tracklet")
def export_trx(spark, d):
    # a target becomes a row for each of up to 30 frames
    u = fx.untagged(dealt_out(fx.tracklets(spark, d), "tracklet", rows=TASK_ROWS // 15)).select(F.col("tracklet").alias("target"), "frame", "x", "y", F.sqrt("area").alias("majax"), F.lit(0.36).alias("eccentricity"))
    t = ex.targets(u, 0.02)
    return t.select("target", F.size("trx").cast("long").alias("n"), F.col("trx")[0]["frame"].alias("first_frame"), F.col("trx")[0]["x"].alias("x0"), F.element_at("trx", -1)["y"].alias("y1"), F.element_at("trx", 1)["b"].alias("b"))


@query("""
SELECT id, label, t0, t1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY t0, t1, id) AS r FROM (
  SELECT tracklet AS id, label, greatest(floor(fi / 10.0 * 2)::BIGINT + 1, 1) AS t0, least(floor(ff / 10.0 * 2)::BIGINT, 720) AS t1 FROM fx_tracklets) WHERE t0 <= t1) WHERE r <= 50""")
def jaaba_labels(spark, d):
    l = fx.tracklets(spark, d).select(F.col("tracklet").alias("id"), "label", (F.col("fi") / 10).alias("t_from"), (F.col("ff") / 10).alias("t_to"))
    return ex.behaviour_labels(l, fx.frames(spark), fps=2.0, first=50)


@query("SELECT DISTINCT t.colony AS id, t.ff AS at FROM fx_tracklets t WHERE NOT EXISTS (SELECT 1 FROM fx_tracklets s WHERE s.colony = t.colony AND s.fi = t.ff)")
def jaaba_importance(spark, d):
    return ex.importance(fx.tracklets(spark, d).select(F.col("colony").alias("id"), F.col("fi").alias("t0"), F.col("ff").alias("t1")))


@query("""
WITH p AS (SELECT u.colony, label, frame, max_by(struct_pack(x := CASE WHEN single OR frame NOT IN (fi, ff) THEN x END, area := CASE WHEN single THEN u.area END, single := single), fi * 10000000 + u.tracklet) AS p
  FROM fx_untagged u JOIN vw_single t ON u.tracklet = t.tracklet WHERE label LIKE 'A%' GROUP BY ALL),
a AS (SELECT colony, label, unnest(range(1, 3001)) AS frame FROM (SELECT DISTINCT colony, label FROM fx_tracklets WHERE label LIKE 'A%'))
SELECT a.colony, a.label, a.frame, p.p.x AS x, p.p.area AS area, coalesce(p.p.single, false) AS single FROM a LEFT JOIN p ON a.colony = p.colony AND a.label = p.label AND a.frame = p.frame""", TV)
def ant_frames(spark, d):
    s = _single(spark, d).where(F.col("label").isin(*IDS))
    rows = fx.untagged(s.drop("single")).drop("colony")
    return ex.ant_frames(1, 3000, s, rows, key=["colony", "label"], hide_ends=True).select("colony", "label", "frame", "x", "area", "single")


ANTS = [f"U{i:02d}" for i in range(fx.N_ANTS)]


@query("SELECT frame, " + ", ".join(f"max({c}) FILTER (WHERE ant = '{a}') AS {a}_{c}" for a in ANTS for c in "xy") + " FROM fx_xy GROUP BY frame")
def export_wide(spark, d):
    return ex.wide(fx.xy(spark, d), ANTS)
