"""Trajectory queries: positions to speeds, nest, outside, interactions, stops, kinematics, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import fixtures as fx
from trailmark.operators import trajectory as tr
from trailmark.plans.registry import query

RADIUS, NEAR, DMAX, VSLOW = 0.03, 0.005, 0.04, 0.02

V = {
    "vw_dense": "SELECT f.frame, f.m, f.mf, a.ant, p.x, p.y FROM fx_frames f CROSS JOIN fx_ants a LEFT JOIN fx_xy p ON p.frame = f.frame AND p.ant = a.ant",
    "vw_v": "SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS v FROM vw_dense WINDOW w AS (PARTITION BY ant ORDER BY frame)",
    "vw_near": """
SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f0,
  first_value(x IGNORE NULLS) OVER n AS x1, first_value(y IGNORE NULLS) OVER n AS y1, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS f1
FROM vw_dense WINDOW b AS (PARTITION BY ant ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY ant ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "vw_inside": """
SELECT frame, m, mf, ant, CASE WHEN f1 = f0 THEN x0 ELSE x0 + (x1 - x0) * (frame - f0) / (f1 - f0) END AS x,
  CASE WHEN f1 = f0 THEN y0 ELSE y0 + (y1 - y0) * (frame - f0) / (f1 - f0) END AS y FROM vw_near""",
    "vw_nest": "SELECT frame, quantile_cont(x, 0.5) AS nest_x, quantile_cont(y, 0.5) AS nest_y FROM vw_inside GROUP BY frame",
    "vw_out": f"""
SELECT p.*, nest_x, nest_y, sqrt((x - nest_x) ** 2 + (y - nest_y) ** 2) AS d, coalesce(sqrt((x - nest_x) ** 2 + (y - nest_y) ** 2) > {RADIUS}, false) AS outside
FROM vw_v p LEFT JOIN vw_nest n ON p.frame = n.frame""",
    "vw_pair": """
SELECT a.frame, a.ant AS a, b.ant AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, a.outside AS out_a, b.outside AS out_b
FROM vw_out a JOIN vw_out b ON a.frame = b.frame AND a.ant <> b.ant WHERE a.x IS NOT NULL AND b.x IS NOT NULL""",
}


def dense(spark: SparkSession, d: str) -> DataFrame:
    return tr.densify(fx.xy(spark, d), fx.frames(spark))


def moving(spark: SparkSession, d: str) -> DataFrame:
    return tr.step_speed(dense(spark, d))


def away(spark: SparkSession, d: str) -> DataFrame:
    g = dense(spark, d)
    return tr.outside(tr.step_speed(g), tr.nest(g), RADIUS)


@query("SELECT ant, avg(v) AS speed, avg(outside::INT::DOUBLE) AS outside, count(x) AS frames FROM vw_out GROUP BY ant", V)
def ant_summary(spark, d):
    return away(spark, d).groupBy("ant").agg(F.avg("v").alias("speed"), F.avg(F.col("outside").cast("double")).alias("outside"), F.count("x").alias("frames"))


@query("SELECT frame, m, mf, ant, x, y FROM fx_xy WHERE m IN (2, 3, 5) AND ant IN ('U01', 'U07', 'U12')")
def scan_xy(spark, d):
    return fx.xy(spark, d).where(F.col("m").isin(2, 3, 5) & F.col("ant").isin("U01", "U07", "U12"))


@query("SELECT * FROM vw_dense", V)
def densify(spark, d):
    return dense(spark, d)


@query("SELECT frame, ant, v FROM vw_v", V)
def velocity(spark, d):
    return moving(spark, d).select("frame", "ant", "v")


@query(f"SELECT frame, ant, CASE WHEN coalesce(v > {DMAX}, false) THEN NULL ELSE x END AS x, CASE WHEN coalesce(v > {DMAX}, false) THEN NULL ELSE y END AS y FROM vw_v", V)
def filter_jumps(spark, d):
    return tr.filter_jumps(dense(spark, d), DMAX).select("frame", "ant", "x", "y")


@query("SELECT frame, ant, x, y FROM vw_inside", V)
def interp_inside(spark, d):
    return tr.interpolate(dense(spark, d)).select("frame", "ant", "x", "y")


@query("SELECT frame, ant, coalesce(CASE WHEN f1 = f0 THEN x0 ELSE x0 + (x1 - x0) * (frame - f0) / (f1 - f0) END, x0, x1) AS x, coalesce(CASE WHEN f1 = f0 THEN y0 ELSE y0 + (y1 - y0) * (frame - f0) / (f1 - f0) END, y0, y1) AS y FROM vw_near", V)
def interp_clamped(spark, d):
    return tr.interpolate(dense(spark, d), ends="clamp").select("frame", "ant", "x", "y")


GAP = "x IS NULL AND f1 - f0 - 1 <= 3 AND sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) <= 0.05"


@query(f"""
SELECT frame, ant, CASE WHEN {GAP} THEN x0 + (x1 - x0) * ((frame - f0) / (f1 - f0)) ELSE x END AS x, CASE WHEN {GAP} THEN y0 + (y1 - y0) * ((frame - f0) / (f1 - f0)) ELSE y END AS y,
  CASE WHEN {GAP} THEN 5 WHEN x IS NOT NULL THEN 1 END AS ass_type FROM vw_near""", V)
def interpolate_xy(spark, d):
    g = dense(spark, d).withColumn("ass_type", F.when(F.col("x").isNotNull(), 1))
    return tr.interpolate_gaps(g, max_frames=3, max_distance=0.05).select("frame", "ant", "x", "y", "ass_type")


@query("SELECT * FROM vw_nest", V)
def nest_xy(spark, d):
    return tr.nest(dense(spark, d))


@query("""
SELECT frame, CASE WHEN count(nest_x) OVER w = 15 THEN quantile_cont(nest_x, 0.5) OVER w END AS nest_x_s, CASE WHEN count(nest_y) OVER w = 15 THEN quantile_cont(nest_y, 0.5) OVER w END AS nest_y_s
FROM vw_nest WINDOW w AS (ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""", V)
def nest_smooth(spark, d):
    return tr.smooth_by_movie(tr.nest(dense(spark, d)), ["nest_x", "nest_y"], 15).select("frame", "nest_x_s", "nest_y_s")


@query("SELECT frame, ant, d, outside FROM vw_out", V)
def outside(spark, d):
    return away(spark, d).select("frame", "ant", "d", "outside")


@query("SELECT frame, avg(outside::INT::DOUBLE) AS fracout, avg(outside::INT::DOUBLE) <= 0.5 AS valid FROM vw_out GROUP BY frame", V)
def nest_valid(spark, d):
    return tr.nest_valid(away(spark, d))


@query("SELECT * FROM vw_pair", V)
def pair_distances(spark, d):
    return tr.pair_distances(away(spark, d))


@query(f"""
SELECT o.frame, o.ant, n.nearest, coalesce(o.outside AND n.nearest < {NEAR}, false) AS interacting
FROM vw_out o LEFT JOIN (SELECT frame, a, min(dist) AS nearest FROM vw_pair GROUP BY ALL) n ON o.frame = n.frame AND o.ant = n.a""", V)
def interacting(spark, d):
    return tr.interacting(away(spark, d), NEAR)


@query(f"SELECT a, b, avg((dist < {NEAR * 2})::INT::DOUBLE) AS share, count(*) AS frames FROM vw_pair WHERE out_a AND out_b GROUP BY ALL", V)
def interaction_matrix(spark, d):
    return tr.interaction_matrix(away(spark, d), NEAR * 2)


@query(f"SELECT a AS src, b AS dst, share AS weight FROM (SELECT a, b, avg((dist < {NEAR * 2})::INT::DOUBLE) AS share FROM vw_pair WHERE out_a AND out_b GROUP BY ALL) WHERE a < b AND share > 0", V)
def interaction_network(spark, d):
    m = tr.interaction_matrix(away(spark, d), NEAR * 2)
    return m.where("a < b and share > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("share").alias("weight"))


@query("SELECT ant, sum(v) AS path FROM vw_v GROUP BY ant", V)
def path_length(spark, d):
    return tr.path_length(dense(spark, d))


@query(f"""
SELECT frame, ant, coalesce(CASE WHEN count(vo) OVER w = 3 THEN avg(vo) OVER w END < {VSLOW} AND outside, false) AS stop
FROM (SELECT *, v * outside::INT AS vo FROM vw_out) WINDOW w AS (PARTITION BY ant ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", V)
def stops(spark, d):
    return tr.stops(away(spark, d), 3, VSLOW).select("frame", "ant", "stop")


def _grad(c: str) -> str:
    return f"CASE WHEN row_number() OVER w = 1 THEN lead({c}) OVER w - {c} WHEN frame = 720 THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END"


_W = "WINDOW w AS (PARTITION BY ant ORDER BY frame)"


@query(f"SELECT frame, ant, {_grad('x')} AS gx, {_grad('y')} AS gy FROM vw_inside {_W}", V)
def gradient(spark, d):
    return tr.gradients(tr.interpolate(dense(spark, d)), {"gx": "x", "gy": "y"}).select("frame", "ant", "gx", "gy")


@query(f"""
WITH a AS (SELECT frame, ant, ({_grad('x')}) * 0.1 AS vx, ({_grad('y')}) * 0.1 AS vy FROM vw_inside {_W}),
b AS (SELECT *, sqrt(vx * vx + vy * vy) AS v FROM a),
c AS (SELECT *, ({_grad('vx')}) * 0.1 AS ax, ({_grad('vy')}) * 0.1 AS ay, ({_grad('v')}) * 0.1 AS a FROM b {_W})
SELECT frame, ant, round(v, 9) AS v, round(a, 9) + 0.0 AS a, round((vx * ay - vy * ax) / nullif(v, 0), 9) + 0.0 AS an FROM c""", V)
def kinematics(spark, d):
    k = tr.kinematics(tr.interpolate(dense(spark, d)), dt=0.1)
    return k.select("frame", "ant", F.round("v", 9).alias("v"), *[(F.round(c, 9) + 0.0).alias(c) for c in ("a", "an")])


@query("""
WITH r AS (SELECT *, sum(new) OVER (PARTITION BY ant ORDER BY frame) AS run FROM (
  SELECT ant, frame, outside, (outside IS DISTINCT FROM lag(outside) OVER (PARTITION BY ant ORDER BY frame) OR row_number() OVER (PARTITION BY ant ORDER BY frame) = 1)::INT AS new FROM vw_out))
SELECT ant, any_value(outside) AS value, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM r GROUP BY ant, run""", V)
def segments(spark, d):
    return tr.segments(away(spark, d), "outside")


@query("""
WITH c AS (SELECT frame, coalesce(S1 > 55, false)::INT AS c FROM (SELECT f.frame, S1 FROM fx_frames f LEFT JOIN fx_dat d ON f.frame = d.frame))
SELECT frame, edge FROM (SELECT frame, coalesce(c - lag(c) OVER (ORDER BY frame), 0) AS edge FROM c) WHERE edge <> 0""")
def onsets(spark, d):
    s = fx.frames(spark).join(fx.dat(spark, d), "frame", "left")
    return tr.onsets(s, F.col("S1") > 55).where("edge <> 0").select("frame", "edge")


def _events(spark, d):
    return tr.onsets(fx.frames(spark).join(fx.dat(spark, d), "frame", "left"), F.col("S1") > 55).where("edge = 1").select(F.col("frame").alias("onset"))


@query("""
WITH c AS (SELECT frame, coalesce(S1 > 55, false)::INT AS c FROM (SELECT f.frame, S1 FROM fx_frames f LEFT JOIN fx_dat d ON f.frame = d.frame)),
o AS (SELECT frame AS onset FROM (SELECT frame, c - lag(c) OVER (ORDER BY frame) AS e FROM c) WHERE e = 1),
n AS (SELECT frame, sum(outside::INT)::DOUBLE AS nout FROM vw_out GROUP BY frame),
w AS (SELECT onset, n.frame - onset AS off, nout FROM o JOIN n ON n.frame >= onset - 5 AND n.frame < onset + 20),
a AS (SELECT onset, list(nout ORDER BY off) AS nout, max(nout) FILTER (WHERE off BETWEEN 0 AND 9) AS nout_max, avg(nout) FILTER (WHERE off BETWEEN 0 AND 9) AS nout_mean,
  arg_max(nout, off) FILTER (WHERE off BETWEEN 0 AND 9) AS nout_end FROM w GROUP BY onset)
SELECT a.onset, array_to_string(list_transform(a.nout, lambda v: v::BIGINT), ',') AS nout, nout_max, nout_mean, nout_end,
  min(w.off) FILTER (WHERE w.off BETWEEN 0 AND 9 AND w.nout > nout_max * (1 - 1 / exp(1.0))) / 10.0 AS nout_tau
FROM a JOIN w ON a.onset = w.onset GROUP BY ALL""", V)
def make_events(spark, d):
    n = away(spark, d).groupBy("frame").agg(F.sum(F.col("outside").cast("double")).alias("nout"))
    e = tr.event_windows(n, _events(spark, d), ["nout"], before=5, after=20, within=10)
    return e.withColumn("nout", F.array_join(F.transform("nout", lambda v: v.cast("long").cast("string")), ","))


@query("SELECT ant, least(floor((x - 0.0) * 1000.0)::BIGINT + 1, 100) AS bx, least(floor((y - 0.0) * 1000.0)::BIGINT + 1, 100) AS by, count(*) AS n FROM fx_xy WHERE x BETWEEN 0 AND 0.1 AND y BETWEEN 0 AND 0.1 GROUP BY ALL")
def heatmap(spark, d):
    return tr.heatmap(fx.xy(spark, d), (0.0, 0.1), (0.0, 0.1))


@query("""
WITH q AS (SELECT ant, frame, atan2(x, y) AS a1, atan2(y, x + 0.01) AS a2 FROM vw_inside),
e AS (SELECT ant, frame, a1 - lag(a1) OVER w AS d1, a2 - lag(a2) OVER w AS d2 FROM q WINDOW w AS (PARTITION BY ant ORDER BY frame)),
f AS (SELECT ant, frame, (d1 + pi()) - 2 * pi() * floor((d1 + pi()) / (2 * pi())) - pi() AS d1, (d2 + pi()) - 2 * pi() * floor((d2 + pi()) / (2 * pi())) - pi() AS d2 FROM e),
g AS (SELECT ant, frame, count(d1) OVER w AS n, avg(d1 * d1) OVER w AS p1, avg(d2 * d2) OVER w AS p2, avg(d1 * d2) OVER w AS p12 FROM f WINDOW w AS (PARTITION BY ant ORDER BY frame ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING))
SELECT ant, frame, CASE WHEN n = 51 THEN round(p1 + p2, 9) END AS power, CASE WHEN n = 51 AND p1 * p2 > 0 THEN round(p12 / sqrt(p1 * p2), 6) END AS coherence FROM g""", V)
def antpower(spark, d):
    g = tr.interpolate(dense(spark, d)).select("ant", "frame", F.atan2("x", "y").alias("a1"), F.atan2(F.col("y"), F.col("x") + 0.01).alias("a2"))
    return tr.antenna_power(g, 51).select("ant", "frame", F.round("power", 9).alias("power"), F.round("coherence", 6).alias("coherence"))
