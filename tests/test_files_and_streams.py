"""Readers, writers, and streams that must agree with their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.sources import files as fl
from trailmark.streaming import lifecycle as lc


def test_movies(spark, tmp_path):
    (tmp_path / "movies.txt").write_text("index name fps duration nframes\n1 a 10 6 60\n2 b 10 6 \n3 c 10 6 60\n")
    m = fl.read_movies(spark, str(tmp_path / "movies.txt")).orderBy("m").collect()
    assert [(r["m"], r["fi"], r["ff"]) for r in m] == [(1, 1, 60), (2, 61, 120), (3, 121, 180)]
    (tmp_path / "gap.txt").write_text("index name fps duration nframes\n1 a 10 6 60\n3 c 10 6 60\n")
    with pytest.raises(ValueError):
        fl.read_movies(spark, str(tmp_path / "gap.txt"))


def test_dat_and_labels(spark, tmp_path):
    (tmp_path / "a.dat").write_text("% framenum\ttimestamp\tT1\n1\t0.1\t20\n2\t0.2\tNaN\n")
    d = fl.read_dat(spark, str(tmp_path / "a.dat"), ["T1"]).orderBy("frame").collect()
    assert [tuple(r) for r in d] == [(1, 20.0), (2, None)]
    (tmp_path / "l.csv").write_text("label\tcategory\nBB\tant_labels\nx\tnonant_labels\n")
    assert {r["category"] for r in fl.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {"ant_labels", "noant_labels"}
    assert fl.default_labels(spark).where("category = 'ant_labels'").count() == 16


def test_ids_and_tables(spark, tmp_path):
    (tmp_path / "autoids_3.csv").write_text("tracklet,label,score,best_frame\nt1,BG,3.5,4\nt2,Unknown,0,0\n")
    r = fl.read_autoids(spark, str(tmp_path / "autoids_*.csv")).orderBy("tracklet").collect()
    assert [(x["m"], x["best_frame"]) for x in r] == [(3, 4), (3, None)]
    (tmp_path / "tab_1.csv").write_text("ant,from,to,m,tracklet,assigned,single,source\nBG,1,9,1,t1,1,1,0\n")
    p = str(tmp_path / "tab_1.csv")
    assert fl.read_tracklet_tables(spark, [p, p]).count() == 1


def test_commands_and_scores(spark, tmp_path):
    (tmp_path / "ids.cfg").write_text("# all\nremove 2 BG start m3\n\n")
    r = fl.read_id_commands(spark, str(tmp_path / "ids.cfg")).collect()
    assert [tuple(x) for x in r] == [("remove", "2", "BG", "start", "m3")]
    (tmp_path / "scores_rest_long_2.csv").write_text("BG,BO\n0.5,1\nNaN,2\n")
    m = spark.createDataFrame([(2, 101)], "m long, fi long")
    s = fl.read_behaviour_scores(spark, str(tmp_path / "scores_*.csv"), m).orderBy("frame", "ant").collect()
    assert [(x["behaviour"], x["frame"], x["ant"], x["score"]) for x in s] == [("rest_long", 101, "BG", 0.5), ("rest_long", 101, "BO", 1.0), ("rest_long", 102, "BG", None), ("rest_long", 102, "BO", 2.0)]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    p = str(tmp_path / "xy")
    fl.write_by_movie(spark.createDataFrame([(1, 1, 0.0), (2, 25, 0.0)], "m long, frame long, x double"), p)
    fl.write_by_movie(spark.createDataFrame([(2, 26, 5.0)], "m long, frame long, x double"), p)
    assert sorted((r["m"], r["frame"]) for r in fl.read_by_movie(spark, p).collect()) == [(1, 1), (2, 26)]
    assert fl.read_by_movie(spark, p, [1]).count() == 1
    want = spark.createDataFrame([(1,), (2,), (3,)], "m long")
    assert [r["m"] for r in fl.missing(want, fl.read_by_movie(spark, p)).collect()] == [3]


def test_parameters(spark):
    p = fl.Parameters.from_json('{"fps": 25.0, "unknown": 1}')
    assert p.fps == 25.0 and fl.Parameters.from_json(p.to_json()) == p and p.as_table(spark).count() > 5


def drained(writer):
    """Run a stream over what lies there; a stream that does not end fails the test."""
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()


def blobs(n=30):
    rows = [(1, f, t) for f in range(1, n + 1) for t in (1, 2) if not (t == 2 and 10 <= f <= 14)]
    return rows + [(2, f, 1) for f in range(1, 8)]


def test_tracklets_stream_like_batch(spark, tmp_path):
    rows = blobs()
    schema = "movie long, frame long, track long"
    for i, (a, b) in enumerate(((1, 12), (13, 22), (23, 60))):
        spark.createDataFrame([r for r in rows if a <= r[1] <= b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # a last blob far ahead closes what is open
    spark.createDataFrame([(1, 900, 9), (2, 900, 9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(lc.stream_tracklets(s, most=8).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append"))
    got = sorted((r["movie"], r["fi"], r["ff"], r["n"]) for r in spark.table("closed").collect())
    want = sorted((r["movie"], r["fi"], r["ff"], r["n"]) for r in lc.batch_tracklets(spark.createDataFrame(rows, schema), most=8).collect())
    assert got == want and len(got) > 6


def test_silent_movie_closes(spark, tmp_path):
    schema = "movie long, frame long, track long, ts timestamp"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    for rows in ([(1, f, 1, at(f)) for f in range(1, 6)], [(2, 1, 1, at(50))], [(2, 2, 1, at(55))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = lc.stream_tracklets(s, ts="ts", late="1 second", silent_ms=10_000)
    drained(out.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append"))
    assert [(r["movie"], r["fi"], r["ff"], r["n"]) for r in spark.table("silent").collect()] == [(1, 1, 5, 5)]


def test_windows_on_stream_and_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in lc.windowed_counts(e, late="1 hour", width="6 hours").select("start", "event_type", "n").collect()}
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    drained(lc.windowed_counts(s, late="1 hour", width="6 hours").writeStream.format("memory").queryName("w").outputMode("complete"))
    assert {tuple(r) for r in spark.table("w").select("start", "event_type", "n").collect()} == batch
    assert lc.sessions(e, late="1 hour", gap="30 minutes").agg(F.sum("n")).first()[0] == e.count()
    seen = []
    drained(lc.for_each_movie(s, [lambda d: seen.append(d.count())]))
    assert sum(seen) == e.count()


def test_tracking_dt_falls_back(spark):
    d = spark.createDataFrame([(1, None, None), (2, 5.0, 0.3), (3, 5.2, None)], "frame long, timestamp double, dt double")
    got = [round(r["tracking_dt"], 6) for r in lc.tracking_dt(d, fps=10.0).orderBy("frame").collect()]
    assert got == [0.1, 0.3, 0.2]


def test_tracklets_of_a_large_table_are_many_tasks_with_one_sort(spark, monkeypatch):
    from trailmark.operators import blocks

    monkeypatch.setattr(blocks, "TASK_ROWS", 500)
    b = spark.range(4000).select((F.col("id") % 2).alias("movie"), (F.col("id") % 40).alias("track"), F.floor(F.col("id") / 40).alias("frame"))
    b = b.where("frame % 7 <> 3").withColumns({"dt": F.lit(0.1), "boundary": F.col("frame") < 30})
    out = lc.batch_tracklets(b, most=4, fps=10.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert out.rdd.getNumPartitions() == 7
    got = [(r["fi"], r["ff"], r["n"]) for r in out.where("track = 5").orderBy("fi").collect()]
    assert got[:3] == [(0, 2, 3), (4, 7, 4), (8, 9, 2)] and (29, 29, 1) in got and (30, 30, 1) in got and sum(n for *_, n in got) == 86
    # of two rows of one frame the second is late: both are of the run that it begins
    twice = spark.createDataFrame([(0, 1, f, dt, True) for f, dt in ((1, 0.1), (2, 0.1), (2, 30.0), (3, 0.1), (4, 0.1))], "movie int, track int, frame long, dt double, boundary boolean")
    assert sorted((r["fi"], r["ff"], r["n"]) for r in lc.batch_tracklets(twice, most=3, fps=10.0).collect()) == [(1, 1, 1), (2, 3, 3), (4, 4, 1)]
