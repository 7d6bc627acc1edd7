"""Tracklet, interval and naming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import fixtures as fx
from trailmark.functions import names
from trailmark.operators import intervals as iv
from trailmark.operators import sampling as sm
from trailmark.operators import tracks as tk
from trailmark.plans.registry import query

AREA = (35.0, 182.0)
IDS = [f"A{i}" for i in range(8)]
V = {
    "vw_deg": """
SELECT tracklet, coalesce(i.n, 0) AS indeg, coalesce(o.n, 0) AS outdeg FROM fx_tracklets
LEFT JOIN (SELECT dst, count(*) AS n FROM fx_edges GROUP BY 1) i ON tracklet = i.dst LEFT JOIN (SELECT src, count(*) AS n FROM fx_edges GROUP BY 1) o ON tracklet = o.src""",
    "vw_single": "SELECT t.*, coalesce(area > 35 AND area < 182, false) AND indeg <= 1 AND outdeg <= 1 AND label <> 'MultiAnt' AS single FROM fx_tracklets t JOIN vw_deg d ON t.tracklet = d.tracklet",
    "vw_cmd": "SELECT 'all' AS colony, 'A' || i AS id, 1000 + 300 * (i + 1) AS fi, 1000 + 300 * (i + 1) + 40 AS ff FROM (SELECT unnest(range(4)) AS i) UNION ALL SELECT i::VARCHAR, 'A' || (i + 4), 700 * (i + 2), 700 * (i + 2) + 90 FROM (SELECT unnest(range(3)) AS i)",
    "vw_rows": "SELECT tracklet, frame, ((tracklet * 7919 + frame * 31) % 1000) / 1000.0::DOUBLE AS x, ((tracklet * 104729 + frame * 17) % 1000) / 1000.0::DOUBLE AS y, area + frame % 7 AS area FROM fx_untagged",
}


def tracks(spark, d):
    return fx.tracklets(spark, d)


def edges(spark, d):
    return fx.edges(tracks(spark, d))


def commands(spark):
    rows = [("all", f"A{i}", 1000 + 300 * (i + 1), 1000 + 300 * (i + 1) + 40) for i in range(4)] + [(str(i), f"A{i + 4}", 700 * (i + 2), 700 * (i + 2) + 90) for i in range(3)]
    return spark.createDataFrame(rows, "colony string, id string, fi long, ff long")


@query("SELECT tracklet, fi, ff, colony, label FROM fx_tracklets WHERE colony IN (1, 4)")
def scan_tracklets(spark, d):
    return tracks(spark, d).where(F.col("colony").isin(1, 4)).select("tracklet", "fi", "ff", "colony", "label")


@query("SELECT colony, frame, count(*) AS n, sum(x) AS sx FROM fx_untagged GROUP BY ALL")
def scan_untagged(spark, d):
    return fx.untagged(tracks(spark, d)).groupBy("colony", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))


@query("SELECT u.tracklet, u.frame, u.frame - t.fi AS frameix, x, y, t.label FROM fx_untagged u JOIN fx_tracklets t ON u.tracklet = t.tracklet WHERE label LIKE 'A%'")
def tracklet_data(spark, d):
    t = tracks(spark, d).where(F.col("label").isin(*IDS))
    return fx.untagged(t).join(t.select("tracklet", "label", "fi"), "tracklet").select("tracklet", "frame", (F.col("frame") - F.col("fi")).alias("frameix"), "x", "y", "label")


@query("SELECT frame, S1, T1 FROM fx_dat WHERE frame BETWEEN 100 AND 300")
def frame_dat(spark, d):
    return fx.dat(spark, d).where(F.col("frame").between(100, 300)).select("frame", "S1", "T1")


@query("SELECT m, nframes, (sum(nframes) OVER (ORDER BY m) - nframes)::BIGINT + 1 AS fi, (sum(nframes) OVER (ORDER BY m))::BIGINT AS ff FROM fx_recorded")
def movies_fi_ff(spark, d):
    return iv.movie_frames(fx.recorded(spark, d).select("m", "nframes")).select("m", "nframes", "fi", "ff")


@query("""
SELECT t.tracklet, CASE WHEN tracklet % 3 <> 0 THEN label END AS autoid, CASE WHEN tracklet % 50 = 0 THEN 'A0' END AS manualid,
  CASE WHEN tracklet % 50 = 0 THEN 'A0' WHEN tracklet % 3 <> 0 THEN label ELSE '' END AS propid,
  CASE WHEN tracklet % 50 = 0 THEN 'inf' WHEN tracklet % 3 <> 0 THEN 'auto' ELSE 'none' END AS kind FROM fx_tracklets t""")
def load_ids(spark, d):
    t = tracks(spark, d)
    manual = t.where("tracklet % 50 = 0").select("tracklet", F.lit("A0").alias("label"))
    r = tk.load_ids(t.drop("label", "score"), t.where("tracklet % 3 <> 0").select("tracklet", "label", "score"), manual)
    kind = F.when(F.col("propscore") == float("inf"), "inf").when(F.col("propscore") > 0, "auto").otherwise("none")
    return r.select("tracklet", "autoid", "manualid", "propid", kind.alias("kind"))


@query("SELECT m FROM fx_movies WHERE m NOT IN (SELECT DISTINCT m FROM fx_xy WHERE ant = 'U03' AND mf = 7 AND x > 0.003)")
def missing_movies(spark, d):
    return fx.movies(spark).select("m").join(fx.xy(spark, d).where("ant = 'U03' and mf = 7 and x > 0.003").select("m"), "m", "left_anti")


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) AS dt_us, event_id // 1000 AS folder FROM events")
def frame_dt(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return sm.global_difference(e, "t", "event_id").select("event_id", F.col("dt").alias("dt_us"), F.floor(F.col("event_id") / 1000).cast("long").alias("folder"))


@query("SELECT CASE WHEN label LIKE 'A%' THEN 'ant_labels' WHEN label = 'NoAnt' THEN 'noant_labels' ELSE 'other_labels' END AS category, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM fx_tracklets GROUP BY 1")
def labels_by_category(spark, d):
    c = F.when(F.col("label").isin(*IDS), "ant_labels").when(F.col("label") == "NoAnt", "noant_labels").otherwise("other_labels")
    return tracks(spark, d).groupBy(c.alias("category")).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


@query("SELECT tracklet, list_sort(list_distinct(list_concat(range(fi, ff + 1), [colony])))::VARCHAR AS movies FROM fx_tracklets")
def parse_movlist(spark, d):
    t = tracks(spark, d).select("tracklet", F.concat_ws("", F.col("fi"), F.lit("-"), F.col("ff"), F.lit(","), F.col("colony")).alias("t"))
    return t.select("tracklet", F.concat(F.lit("["), F.array_join(F.transform(names.movies_of(F.col("t")), lambda x: x.cast("string")), ", "), F.lit("]")).alias("movies"))


@query("""
WITH r AS (SELECT ant, m, m - row_number() OVER (PARTITION BY ant ORDER BY m) AS r FROM (SELECT DISTINCT ant, m FROM fx_xy WHERE frame % 5 = 0)),
g AS (SELECT ant, min(m) AS a, max(m) AS b FROM r GROUP BY ant, r)
SELECT ant, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS movies FROM g GROUP BY ant""")
def movlist2str(spark, d):
    return names.movlist_text(fx.xy(spark, d).where("frame % 5 = 0"), "ant")


@query("SELECT tracklet, single FROM vw_single", V)
def singles(spark, d):
    t = tracks(spark, d)
    return tk.singles(t, fx.edges(t), min_area=AREA[0], max_area=AREA[1])


@query("SELECT tracklet, CASE WHEN tracklet % 40 = 0 THEN tracklet % 80 = 0 ELSE single END AS single FROM vw_single", V)
def singles_cfg(spark, d):
    t = tracks(spark, d)
    pick = t.where("tracklet % 40 = 0")
    c = pick.select("tracklet", F.when(F.col("tracklet") % 80 == 0, 1).otherwise(0).alias("value"), F.lit(1).alias("line")).union(pick.select("tracklet", F.lit(1), F.lit(2)))
    return tk.singles(t, fx.edges(t), min_area=AREA[0], max_area=AREA[1], commands=c)


@query("SELECT tracklet, indeg, outdeg FROM vw_deg", V)
def degrees(spark, d):
    t = tracks(spark, d)
    return tk.degrees(t, fx.edges(t))


@query("SELECT tracklet, label FROM fx_tracklets WHERE label <> 'NoAnt'")
def only_ants(spark, d):
    return tk.only_ants(tracks(spark, d)).select("tracklet", "label")


@query("SELECT tracklet, label LIKE 'A%' AS single FROM fx_tracklets")
def singles_only(spark, d):
    return tracks(spark, d).select("tracklet", tk.is_single_label(F.col("label"), IDS, []).alias("single"))


@query("SELECT tracklet FROM fx_tracklets WHERE EXISTS (SELECT 1 FROM (SELECT unnest([1150, 1151, 1900, 2900]) AS f) WHERE f BETWEEN fi AND ff)")
def in_time(spark, d):
    return iv.in_time(tracks(spark, d), spark.createDataFrame([(x,) for x in (1150, 1151, 1900, 2900)], "frame long")).select("tracklet")


@query("SELECT tracklet, label FROM fx_tracklets WHERE contains(tracklet::VARCHAR, '77')")
def with_name(spark, d):
    return tk.with_name(tracks(spark, d), "77").select("tracklet", "label")


@query("SELECT tracklet FROM fx_tracklets WHERE label IN ('A1', 'A5') AND score > 200000")
def with_ids(spark, d):
    return tk.with_ids(tracks(spark, d), ["A1", "A5"], 200000).select("tracklet")


@query("""
SELECT tracklet, round(p, 9) AS score, e1 >= 0 AND e2 >= 0 AND e3 >= 0 AND e4 >= 0 AS passed FROM (
  SELECT *, (2 / (1 + exp(-e1))) * (2 / (1 + exp(-e2))) * (2 / (1 + exp(-e3))) * (2 / (1 + exp(-e4))) AS p FROM (
    SELECT tracklet, least((area - 35) / 35, 0) AS e1, least((182 - area) / 182, 0) AS e2, least(((tracklet % 100) / 100.0::DOUBLE - 0.2) / 0.2, 0) AS e3, least((0.9 - (tracklet % 100) / 100.0::DOUBLE) / 0.9, 0) AS e4
    FROM fx_tracklets WHERE area IS NOT NULL))""")
def frame_quality(spark, d):
    t = tracks(spark, d).where("area is not null").withColumn("eccentricity", F.col("tracklet") % 100 / 100.0)
    return tk.frame_quality(t, area=AREA, eccentricity=(0.2, 0.9)).select("tracklet", F.round("score", 9).alias("score"), "passed")


@query("SELECT o_custkey AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS blob, o_totalprice AS size FROM orders WHERE o_totalprice >= 250000")
def blob_filter(spark, d):
    b = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("frame"), F.col("o_orderkey").alias("blob"), F.col("o_totalprice").alias("size"))
    return tk.filter_blobs(b, "size", 250000)


@query("""
SELECT tracklet, CASE WHEN min(c) = max(c) THEN min(c) END AS colony FROM (
  SELECT tracklet, CASE WHEN floor(x * 4) < 2 THEN 1 WHEN floor(y * 4) < 2 THEN 2 END AS c FROM fx_untagged) GROUP BY tracklet""")
def colony_of_tracklet(spark, d):
    cells = spark.createDataFrame([(x, y, 1 if x < 2 else 2) for x in range(4) for y in range(4) if x < 2 or y < 2], "cx long, cy long, colony int")
    return tk.colony_of(fx.untagged(tracks(spark, d)), cells, 0.25)


@query("SELECT tracklet, frame, x * 0.02 AS x, y * 0.02 AS y, area * 0.0004 AS rarea FROM fx_untagged")
def scale_xy(spark, d):
    return tk.scaled(fx.untagged(tracks(spark, d)), 0.02).select("tracklet", "frame", "x", "y", "rarea")


@query("SELECT event_id, f.frame, m, mf FROM (SELECT event_id, floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600)::BIGINT + 1 AS frame FROM events) f JOIN fx_frames x ON f.frame = x.frame")
def frame_to_movie(spark, d):
    e = fx.table(spark, d, "events").select("event_id", fx.hour_of(F.col("ts")).alias("frame"))
    return iv.frame_to_movie(e, fx.movies(spark))


@query("SELECT event_id, frame, least((frame - 1) // 24 + 1, l) AS m, frame - 24 * (least((frame - 1) // 24 + 1, l) - 1) AS mf FROM (SELECT event_id, floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 3600)::BIGINT + 81 AS frame FROM events), (SELECT max(m) AS l FROM fx_recorded)")
def frame_to_movie_open(spark, d):
    e = fx.table(spark, d, "events").select("event_id", (fx.hour_of(F.col("ts")) + 80).alias("frame"))
    return iv.frame_to_movie(e, fx.recorded(spark, d), open_end=True)


@query("SELECT colony, frame, any_value(tracklet) AS tracklet FROM (SELECT colony, frame, tracklet FROM fx_untagged WHERE frame % 10 = 0) GROUP BY colony, frame HAVING count(*) = 1")
def tracklet_at_frame(spark, d):
    t = tracks(spark, d)
    at = F.sequence(*[F.lit(x).cast("long") for x in (10, 3700, 10)])
    p = t.select("colony").distinct().withColumn("frame", F.explode(at))
    return iv.tracklet_at_frame(t.select("tracklet", "colony", "fi", "ff"), p, on=["colony"])


@query("SELECT a.colony, a.tracklet AS a, b.tracklet AS b FROM fx_tracklets a JOIN fx_tracklets b ON a.colony = b.colony AND a.fi <= b.ff AND a.ff >= b.fi AND a.tracklet <> b.tracklet")
def overlaps(spark, d):
    return iv.overlaps(tracks(spark, d))


@query("""
SELECT t.tracklet, t.colony, s.label, s.fi, s.ff FROM fx_tracklets t JOIN (SELECT colony, label, min(fi) AS fi, max(ff) AS ff FROM fx_tracklets GROUP BY ALL) s ON t.colony = s.colony AND t.fi <= s.ff AND t.ff >= s.fi AND t.label <> s.label""")
def overlaps_spans(spark, d):
    """Tracklets beside the spans, hundreds of times as long, over which another label occurs in their colony."""
    t = tracks(spark, d)
    spans = t.groupBy("colony", "label").agg(F.min("fi").alias("fi"), F.max("ff").alias("ff"))
    j = iv.dyadic_join(t.select("tracklet", "colony", "label", "fi", "ff"), spans, ["colony"])
    return j.where("label_a <> label_b").select(F.col("tracklet_a").alias("tracklet"), "colony", F.col("label_b").alias("label"), F.col("fi_b").alias("fi"), F.col("ff_b").alias("ff"))


@query("SELECT a.tracklet, b.tracklet AS other, greatest(0, b.fi - a.ff, a.fi - b.ff) AS gap FROM fx_tracklets a JOIN fx_tracklets b ON a.colony = b.colony AND a.fi = b.fi AND a.tracklet < b.tracklet")
def node_dist(spark, d):
    t = tracks(spark, d)
    b = t.select("colony", "fi", F.col("tracklet").alias("other"), F.col("ff").alias("ff2"), F.col("fi").alias("fi2"))
    j = t.join(b, ["colony", "fi"]).where("tracklet < other")
    return j.select("tracklet", "other", iv.node_distance(F.col("fi"), F.col("ff"), F.col("fi2"), F.col("ff2")).alias("gap"))


@query("SELECT e.src, e.dst FROM fx_edges e WHERE src IN (SELECT tracklet FROM fx_tracklets WHERE label <> 'NoAnt') AND dst IN (SELECT tracklet FROM fx_tracklets WHERE label <> 'NoAnt')")
def links_in_graph(spark, d):
    t = tracks(spark, d)
    n = tk.only_ants(t)
    e = fx.edges(t)
    return e.join(n, e.src == n.tracklet, "left_semi").join(n, e.dst == n.tracklet, "left_semi").select("src", "dst")


@query("SELECT DISTINCT t.tracklet, c.id FROM fx_tracklets t JOIN vw_cmd c ON (c.colony = 'all' OR c.colony = t.colony::VARCHAR) AND t.fi <= c.ff AND t.ff >= c.fi", V)
def temporal_config(spark, d):
    return iv.temporal_removals(tracks(spark, d), commands(spark))


@query("SELECT tracklet, frame - fi AS ix, frame FROM (SELECT tracklet, fi, unnest(range(fi, ff + 1)) AS frame FROM fx_tracklets)")
def blob_table(spark, d):
    return iv.blob_table(tracks(spark, d)).select("tracklet", F.col("ix").cast("long").alias("ix"), "frame")


@query("""
SELECT tracklet, avg(area) AS mean_area, count(*) AS len, min(frame) AS fi, max(frame) AS ff, arg_min(x, frame) AS xi, arg_min(y, frame) AS yi, arg_max(x, frame) AS xf, arg_max(y, frame) AS yf
FROM vw_rows GROUP BY tracklet""", V)
def tracklet_stats(spark, d):
    u = fx.untagged(tracks(spark, d)).withColumn("area", F.col("area") + F.col("frame") % 7)
    return tk.tracklet_stats(u)


@query("""
SELECT tracklet, frame, sqrt(vx * vx + vy * vy) AS vnorm, atan2(vy, vx) AS vang FROM (
  SELECT tracklet, frame, (x - lag(x) OVER w) / 0.1 AS vx, (y - lag(y) OVER w) / 0.1 AS vy FROM fx_untagged WINDOW w AS (PARTITION BY tracklet ORDER BY frame))""")
def tracklet_velocity(spark, d):
    u = fx.untagged(tracks(spark, d)).withColumn("dt", F.lit(0.1))
    return tk.tracklet_velocity(u).select("tracklet", "frame", "vnorm", "vang")


@query("SELECT sum(len) / (3000.0 * 8 * c) AS rate, sum(CASE WHEN single THEN len ELSE 0 END) / (3000.0 * 8 * c) AS classified FROM vw_single, (SELECT count(DISTINCT colony) AS c FROM fx_tracklets) WHERE label LIKE 'A%' GROUP BY c", V)
def assignment_rate(spark, d):
    t = tracks(spark, d)
    s = tk.singles(t, fx.edges(t), min_area=AREA[0], max_area=AREA[1]).withColumnRenamed("single", "source")
    return tk.assignment_rate(t.where(F.col("label").isin(*IDS)).join(s, "tracklet"), 3000, len(IDS), t.select("colony").distinct().count())


@query("""
WITH e AS (SELECT colony, 'A' || i AS id, 3000 AS frames FROM (SELECT DISTINCT colony FROM fx_tracklets), (SELECT unnest(range(8)) AS i)),
a AS (SELECT colony, label AS id, sum(len) AS got FROM fx_tracklets WHERE label LIKE 'A%' GROUP BY ALL),
r AS (SELECT e.colony, e.id, sum(ff - fi + 1) AS gone FROM e JOIN vw_cmd c ON e.id = c.id AND (c.colony = 'all' OR c.colony = e.colony::VARCHAR) GROUP BY ALL)
SELECT e.colony, e.id, sum(coalesce(got, 0)) / sum(frames - coalesce(gone, 0)) AS rate FROM e LEFT JOIN a ON e.colony = a.colony AND e.id = a.id LEFT JOIN r ON e.colony = r.colony AND e.id = r.id
GROUP BY ROLLUP (e.colony, e.id)""", V)
def assignment_report(spark, d):
    t = tracks(spark, d)
    ids = F.explode(F.array(*[F.lit(i) for i in IDS]))
    e = t.select("colony").distinct().select("colony", ids.alias("id"), F.lit(3000).alias("frames"))
    c = commands(spark).withColumn("n", F.col("ff") - F.col("fi") + 1)
    one = e.withColumn("c", F.col("colony").cast("string")).join(c.select(F.col("colony").alias("c"), "id", "n"), ["c", "id"]).select("colony", "id", F.col("n").alias("frames"))
    every = e.join(c.where("colony = 'all'").select("id", "n"), "id").select("colony", "id", F.col("n").alias("frames"))
    return tk.assignment_report(t.where(F.col("label").isin(*IDS)).select("colony", F.col("label").alias("id"), "len"), e, one.union(every))


@query("SELECT ant, frame, arg_max(x, tracklet) AS x, max(tracklet) AS tracklet FROM (SELECT u.tracklet, frame, x, 'C' || u.colony || label AS ant FROM fx_untagged u JOIN fx_tracklets t ON u.tracklet = t.tracklet WHERE label LIKE 'A%') GROUP BY ant, frame")
def stitch_xy(spark, d):
    t = tracks(spark, d).where(F.col("label").isin(*IDS))
    u = fx.untagged(t).join(t.select("tracklet", F.concat(F.lit("C"), F.col("colony").cast("string"), "label").alias("ant")), "tracklet")
    return tk.stitch(u, "tracklet").select("ant", "frame", "x", "tracklet")


@query("SELECT p.tracklet, p.frame, u.x FROM (SELECT tracklet, fi + 3 AS frame FROM fx_tracklets) p LEFT JOIN fx_untagged u ON p.tracklet = u.tracklet AND p.frame = u.frame")
def value_at(spark, d):
    t = tracks(spark, d)
    return tk.value_at(fx.untagged(t), t.select("tracklet", (F.col("fi") + 3).alias("frame")), "x")


NAME = "'trj_id' || tracklet || '_ti' || ((fi - 1) // 600 + 1) || '_' || ((fi - 1) % 600 + 1) || '_tf' || ((ff - 1) // 600 + 1) || '_' || ((ff - 1) % 600 + 1)"


@query(f"SELECT {NAME} AS name, (fi - 1) // 600 + 1 AS m1, (fi - 1) % 600 + 1 AS mf1, (ff - 1) // 600 + 1 AS m2, (ff - 1) % 600 + 1 AS mf2 FROM fx_tracklets")
def parse_tracklet_name(spark, d):
    m, mf = (lambda c: F.floor((F.col(c) - 1) / 600).cast("long") + 1), (lambda c: F.col(c) - F.floor((F.col(c) - 1) / 600).cast("long") * 600)
    t = tracks(spark, d).select(names.tracklet_name(F.col("tracklet"), m("fi"), mf("fi"), m("ff"), mf("ff")).alias("name"))
    return t.select("name", *[c.alias(n) for n, c in names.parse_tracklet_name(F.col("name")).items()])


@query("""
SELECT CASE ant WHEN 'U00' THEN 'start' WHEN 'U01' THEN 'f' || frame ELSE 'm' || m || 'f' || mf END AS "from", CASE ant WHEN 'U00' THEN 'end' WHEN 'U01' THEN 'f' || frame WHEN 'U02' THEN 'oops' ELSE 'm' || m END AS "to",
  CASE ant WHEN 'U00' THEN first ELSE frame END AS fi, CASE ant WHEN 'U00' THEN last WHEN 'U01' THEN frame WHEN 'U02' THEN NULL ELSE 24 * m END AS ff
FROM fx_xy, (SELECT min(fi) AS first, max(ff) AS last FROM fx_recorded)""")
def parse_time_config(spark, d):
    ant, frame = F.col("ant"), F.concat_ws("", F.lit("f"), F.col("frame"))
    frm = F.when(ant == "U00", "start").when(ant == "U01", frame).otherwise(F.concat_ws("", F.lit("m"), F.col("m"), F.lit("f"), F.col("mf")))
    to = F.when(ant == "U00", "end").when(ant == "U01", frame).when(ant == "U02", "oops").otherwise(F.concat_ws("", F.lit("m"), F.col("m")))
    return names.parse_times(fx.xy(spark, d).select(frm.alias("from"), to.alias("to")), fx.recorded(spark, d))


@query("SELECT CASE WHEN tracklet % 2 = 0 THEN 'assign' ELSE 'eliminate' END AS command, 'trj_' || tracklet AS tracklet, label || CASE WHEN tracklet % 2 = 0 THEN '' ELSE ',OP' END AS value FROM fx_tracklets WHERE tracklet % 3 <> 0")
def parse_prop_config(spark, d):
    line = F.when(F.col("tracklet") % 3 == 0, "# note").when(F.col("tracklet") % 2 == 0, F.format_string("Assign  trj_%d %s", "tracklet", "label")).otherwise(F.format_string("ELIMINATE trj_%d %s, OP", "tracklet", "label"))
    return names.parse_properties(tracks(spark, d).select(line.alias("line")))


@query("WITH l AS (SELECT DISTINCT label FROM fx_tracklets) SELECT a.label || b.label AS id FROM l a, l b")
def all_possible_ids(spark, d):
    return names.all_possible_ids(tracks(spark, d), "label")


@query("SELECT tracklet, 'len' AS k, len::VARCHAR AS v FROM fx_tracklets UNION ALL SELECT tracklet, 'label', label FROM fx_tracklets")
def parse_options(spark, d):
    t = tracks(spark, d).select("tracklet", F.format_string("len=%d, label=%s", "len", "label").alias("t"))
    return t.select("tracklet", F.explode(names.parse_options(F.col("t"))).alias("k", "v"))


@query("SELECT tracklet, score, row_number() OVER (PARTITION BY colony ORDER BY score DESC, tracklet) AS rank FROM vw_single WHERE single AND label LIKE 'A%'", V)
def sources_ranked(spark, d):
    t = tracks(spark, d)
    s = t.join(tk.singles(t, fx.edges(t), min_area=AREA[0], max_area=AREA[1]), "tracklet").where(F.col("single") & F.col("label").isin(*IDS))
    return sm.ranked(s, ["colony"], [F.desc("score"), F.asc("tracklet")]).select("tracklet", "score", "rank")


@query("SELECT label, tracklet FROM fx_tracklets QUALIFY row_number() OVER (PARTITION BY label ORDER BY tracklet) <= 5")
def topn_per_label(spark, d):
    return sm.first_n(tracks(spark, d).select("label", "tracklet"), ["label"], [F.asc("tracklet")], 5)


@query("SELECT ant, frame FROM fx_xy QUALIFY row_number() OVER (PARTITION BY ant ORDER BY md5(frame::VARCHAR), frame) <= 6")
def sample_per_ant(spark, d):
    x = fx.xy(spark, d).select("ant", "frame")
    return sm.sample_n(x, ["ant"], "frame", 6)


@query("""
SELECT label, tracklet, cum FROM (SELECT label, tracklet, len, sum(len) OVER (PARTITION BY label ORDER BY md5(tracklet::VARCHAR), tracklet) AS cum FROM fx_tracklets) WHERE cum - len < 200""")
def sample_until(spark, d):
    return sm.sample_until(tracks(spark, d), ["label"], "tracklet", "len", 200).select("label", "tracklet", "cum")


@query("SELECT tracklet, label, percent_rank() OVER (PARTITION BY label ORDER BY md5(tracklet::VARCHAR), tracklet) < 0.8 AS train FROM fx_tracklets")
def train_val_split(spark, d):
    return sm.split_share(tracks(spark, d), ["label"], "tracklet", 0.8).select("tracklet", "label", "train")


@query("SELECT ant, frame FROM (SELECT ant, frame, row_number() OVER (PARTITION BY ant ORDER BY frame) AS r FROM fx_xy) WHERE (r - 3) % 10 = 0 AND r >= 3")
def stride_sample(spark, d):
    return sm.stride(fx.xy(spark, d), ["ant"], "frame", first=3, skip=10).select("ant", "frame")


@query("SELECT m, ntile(7) OVER (ORDER BY m) AS part FROM fx_recorded")
def divide2groups(spark, d):
    return sm.divide(fx.recorded(spark, d), "m", 7).select("m", "part")


@query("SELECT m FROM fx_recorded WHERE (m - 1) % 4 = 0")
def downsample(spark, d):
    return sm.downsample(fx.recorded(spark, d), "m", 4).select("m")


@query("SELECT m // 10 AS grp, min(m) AS first_m, max(m) AS last_m, string_agg(m::VARCHAR, ',' ORDER BY m) AS movies FROM fx_recorded GROUP BY 1")
def solve_groups(spark, d):
    return sm.solve_groups(fx.recorded(spark, d), 10).withColumn("movies", F.array_join("movies", ","))


@query("SELECT a.colony, b.colony AS other, a.ids = b.ids AS same FROM (SELECT colony, list_sort(list(DISTINCT label)) AS ids FROM fx_tracklets GROUP BY 1) a JOIN (SELECT colony, list_sort(list(DISTINCT label)) AS ids FROM fx_tracklets GROUP BY 1) b ON b.colony = a.colony + 1")
def set_equal(spark, d):
    s = tracks(spark, d).groupBy("colony").agg(F.collect_set("label").alias("ids"))
    return sm.set_equal(s.select("colony", "ids"), s.select((F.col("colony") - 1).alias("colony"), F.col("colony").alias("other"), F.col("ids").alias("ids2")))


@query("SELECT tracklet, CASE WHEN tracklet % 5 = 0 THEN 'B' ELSE label END AS label FROM fx_tracklets")
def dict_merge(spark, d):
    t = tracks(spark, d).select("tracklet", "label")
    return sm.merge_later([t, t.where("tracklet % 5 = 0").withColumn("label", F.lit("B"))], ["tracklet"])


@query("SELECT m, format('{}_{}', 10 * ((m - 1) // 10) + 1, 10 * ((m - 1) // 10) + 10) AS subdir FROM fx_recorded")
def subdirs(spark, d):
    return fx.recorded(spark, d).select("m", names.subdir(F.col("m"), 10).alias("subdir"))
