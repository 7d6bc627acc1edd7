"""Queries on numerical kernels; most have no SQL and are compared with plain code in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trailmark import fixtures as fx
from trailmark.operators import borders as bd
from trailmark.operators import embedding as em
from trailmark.operators import kernels as kn
from trailmark.operators import trajectory as tr
from trailmark.operators.components import cut
from trailmark.plans.registry import query
from trailmark.plans.trajectory_queries import V, dense


@query("SELECT frame, CASE WHEN count(nest_x) OVER w = 101 THEN quantile_cont(nest_x, 0.5) OVER w END AS nest_x_med FROM vw_nest WINDOW w AS (ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)", V)
def medfilt(spark, d):
    n = tr.nest(dense(spark, d)).withColumn("colony", F.lit(1).cast("long"))
    return kn.median_filter(n, "nest_x", 101, key=["colony"], block=200).select("frame", "nest_x_med")


@query("SELECT frame, quantile_cont(nest_x, 0.5) OVER w AS nest_x_med FROM vw_nest WINDOW w AS (ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)", V)
def medfilt_shrink(spark, d):
    n = tr.nest(dense(spark, d)).withColumn("colony", F.lit(1).cast("long"))
    return kn.median_filter(n, "nest_x", 101, key=["colony"], edge="shrink", block=200).select("frame", "nest_x_med")


@query("""
SELECT f.frame, quantile_cont(coalesce(nest_x, 0), 0.5) OVER w AS nest_x_med FROM (SELECT unnest(range(-49, 771)) AS frame) f LEFT JOIN vw_nest n ON f.frame = n.frame
WINDOW w AS (ORDER BY f.frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) QUALIFY f.frame BETWEEN 1 AND 720""", V)
def medfilt_zero(spark, d):
    """Zero-padded edges; the published analysis uses 36,001 frames, more than the fixture has."""
    n = tr.nest(dense(spark, d)).withColumn("colony", F.lit(1).cast("long"))
    return kn.median_filter(n, "nest_x", 101, key=["colony"], edge="zero", block=200).select("frame", "nest_x_med")


@query(None)
def fix_orientation(spark, d):
    u = fx.untagged(fx.tracklets(spark, d)).withColumns({"eccentricity": F.col("tracklet") % 10 / 10.0, "dt": F.lit(100.0)}).withColumn("orient", F.atan2("y", "x"))
    return kn.fix_orientations(u)


@query(None)
def cross_movie_links(spark, d):
    """Blobs are the places of a border's two frames in one cell of a grid, so animals side by side share one."""
    t = fx.tracklets(spark, d)
    rows = fx.untagged(t)
    at = rows.withColumns({"blob": F.floor(F.col("x") * 20) * 100 + F.floor(F.col("y") * 20), "after": (F.col("frame") - 1) % fx.MOVIE_FRAMES == 0})
    at = at.where(F.col("after") | (F.col("frame") % fx.MOVIE_FRAMES == 0)).withColumn("m", fx.movie_of(F.col("frame")) - F.col("after").cast("long"))
    blobs = cut(at.groupBy("m", "colony", "after", "blob").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))
    before, after = (blobs.where(c).drop("after") for c in (~F.col("after"), F.col("after")))
    near = bd.within(before.withColumnRenamed("blob", "prev"), after.withColumnRenamed("blob", "cur"), 0.1)
    return bd.border_links(*kn.boundary_points(t, rows, fx.MOVIE_FRAMES), before, after, near, alone=0.02)


@query("""
SELECT a.m FROM fx_movies a JOIN fx_movies b ON b.fi = a.ff + 1 LEFT JOIN (SELECT frame, coalesce(S1 - 499, 1) AS dt FROM fx_dat) d ON d.frame = b.fi WHERE coalesce(d.dt <= 2.5, true)""")
def open_borders(spark, d):
    dat = fx.dat(spark, d).select("frame", F.coalesce(F.col("S1") - 499, F.lit(1.0)).alias("tracking_dt"))
    return bd.open_borders(fx.movies(spark), dat, 2.5)


@query(None)
def wavelet(spark, d):
    return kn.wavelets(tr.interpolate(dense(spark, d), ends="clamp"), "x")


def _components(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query("""
WITH u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT i, avg(v) AS m FROM u GROUP BY i)
SELECT a.i AS i, b.i AS j, round(avg(a.v * b.v) - any_value(ma.m) * any_value(mb.m), 9) + 0.0 AS cov FROM u a JOIN u b ON a.vec_id = b.vec_id JOIN m ma ON a.i = ma.i JOIN m mb ON b.i = mb.i GROUP BY ALL""")
def covariance(spark, d):
    _, cov, _ = kn.gram(_components(spark, d), "v")
    rows = [(i, j, round(float(x), 9) + 0.0) for i, r in enumerate(cov) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "i int, j int, cov double")


@query(None)
def pca(spark, d):
    mean, axes, var = kn.pca(_components(spark, d), "v", 3)
    rows = [(i, float(var[i]), [float(x) for x in axes[i]]) for i in range(3)]
    return spark.createDataFrame(rows, "axis int, variance double, loading array<double>")


@query(None)
def pca_project(spark, d):
    x = _components(spark, d)
    mean, axes, _ = kn.pca(x, "v", 3)
    return kn.project(x, "v", mean, axes).select("vec_id", "pc")


@query("""
WITH t AS (SELECT i, list_transform(range(10), lambda k: ((i * 7 + k * 3) % 11 + 1)::DOUBLE) AS q FROM (SELECT unnest(range(8)) AS i)), n AS (SELECT i, list_transform(q, lambda v: v / list_sum(q)) AS q FROM t),
k AS (SELECT s.tracklet * 5 + s.frame AS id, n.i, list_sum(list_transform(range(1, 11), lambda j: p[j] * ln(p[j] / q[j]))) AS kl FROM fx_scores s, n)
SELECT id, arg_min(i, kl) AS best, round(min(kl), 9) AS kl FROM k GROUP BY id""")
def knn_kl(spark, d):
    train = np.array([[(i * 7 + k * 3) % 11 + 1.0 for k in range(10)] for i in range(8)])
    p = fx.scores(spark, d).select((F.col("tracklet") * 5 + F.col("frame")).alias("id"), "p")
    return kn.nearest_by_kl(p, train).select("id", "best", F.round("kl", 9).alias("kl"))


@query(None)
def fit_ellipse(spark, d):
    a = F.col("i") * 0.7
    t = fx.tracklets(spark, d).select("tracklet", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    r1, r2 = F.col("tracklet") % 7 + 3, F.col("tracklet") % 3 + 1
    return kn.fit_ellipse(t.select("tracklet", (F.cos(a) * r1 + F.col("tracklet") % 10).alias("x"), (F.sin(a) * r2 + 1).alias("y")), "tracklet")


@query(None)
def embed_points(spark, d):
    """Class distributions placed among those of the 1,500 tracklets and frames of least number, whose places are their first two axes."""
    p = fx.scores(spark, d).select((F.col("tracklet") * 5 + F.col("frame")).alias("id"), "p")
    known = np.array([r["p"] for r in p.orderBy("id").limit(1_500).collect()])
    logs = np.log(known / known.sum(axis=1, keepdims=True))
    return em.embed(p, known, em.axes(logs, 2))
