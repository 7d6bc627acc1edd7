"""Trajectory, tracklet, graph and classifier shapes derived from general-purpose tables.

The same arithmetic is written as SQL in ``trailmark.plans.fixture_sql`` for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_FRAMES, MOVIE_FRAMES, N_ANTS, COLONY = 720, 24, 16, 60
EPOCH = "2024-01-01"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def movie_of(f: Column) -> Column:
    return F.floor((f - 1) / MOVIE_FRAMES).cast("long") + 1


def movie_frame(f: Column) -> Column:
    return F.pmod(f - 1, F.lit(MOVIE_FRAMES)).cast("long") + 1


def hour_of(ts: Column) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts) / 3600).cast("long") + 1


def xy(spark: SparkSession, path: str) -> DataFrame:
    """Sparse tagged trajectories (frame, m, mf, ant, x, y): the last event of an ant in a frame counts."""
    e = table(spark, path, "events").select(
        F.concat(F.lit("U"), F.lpad((F.col("user_id") % N_ANTS).cast("string"), 2, "0")).alias("ant"),
        hour_of(F.col("ts")).alias("frame"),
        "event_id",
        F.struct((F.col("value") * 1e-4).alias("x"), (F.get_json_object("props", "$.k").cast("double") * 1e-3).alias("y")).alias("p"),
    )
    last = e.groupBy("ant", "frame").agg(F.max_by("p", "event_id").alias("p"))
    return last.select("frame", movie_of(F.col("frame")).alias("m"), movie_frame(F.col("frame")).alias("mf"), "ant", "p.x", "p.y")


def movies(spark: SparkSession) -> DataFrame:
    m = spark.range(1, N_FRAMES // MOVIE_FRAMES + 1).withColumnRenamed("id", "m")
    return m.select("m", ((F.col("m") - 1) * MOVIE_FRAMES + 1).alias("fi"), (F.col("m") * MOVIE_FRAMES).alias("ff"), F.lit(MOVIE_FRAMES).cast("long").alias("nframes"), F.lit(1.0).alias("fps"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The movies in which an ant was seen, as many as the events ask for; nframes reaches to the last frame with one."""
    m = xy(spark, path).groupBy("m").agg(F.max("mf").alias("nframes"))
    return m.select("m", ((F.col("m") - 1) * MOVIE_FRAMES + 1).alias("fi"), (F.col("m") * MOVIE_FRAMES).alias("ff"), "nframes", F.lit(1.0).alias("fps"))


def frames(spark: SparkSession) -> DataFrame:
    f = spark.range(1, N_FRAMES + 1).withColumnRenamed("id", "frame")
    return f.select("frame", movie_of(F.col("frame")).alias("m"), movie_frame(F.col("frame")).alias("mf"))


def tracklets(spark: SparkSession, path: str) -> DataFrame:
    """(tracklet, colony, fi, ff, len, score, label, area): one row per order; area is its summed quantity."""
    o = table(spark, path, "orders")
    fi = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long") + 1
    kind = F.col("o_orderpriority")
    label = (
        F.when(kind.isin("1-URGENT", "2-HIGH"), F.concat(F.lit("A"), (F.col("o_custkey") % 8).cast("string")))
        .when(kind == "3-MEDIUM", "MultiAnt").when(kind == "4-NOT SPECIFIED", "NoAnt").otherwise("Unknown")
    )
    t = o.select(F.col("o_orderkey").alias("tracklet"), F.floor(F.col("o_custkey") / COLONY).cast("long").alias("colony"), fi.alias("fi"), F.col("o_totalprice").alias("score"), label.alias("label"))
    t = t.withColumn("ff", F.col("fi") + F.col("tracklet") * 7919 % 30).withColumn("len", F.col("ff") - F.col("fi") + 1)
    area = table(spark, path, "lineitem").groupBy(F.col("l_orderkey").alias("tracklet")).agg(F.sum("l_quantity").alias("area"))
    return t.join(area, "tracklet", "left").select("tracklet", "colony", "fi", "ff", "len", "score", "label", "area")


def edges(tracks: DataFrame) -> DataFrame:
    """(src, dst) where dst begins in the frame after src ends, in one colony."""
    a = tracks.select("colony", F.col("tracklet").alias("src"), (F.col("ff") + 1).alias("at"))
    b = tracks.select("colony", F.col("tracklet").alias("dst"), F.col("fi").alias("at"))
    return a.join(b, ["colony", "at"]).select("colony", "src", "dst")


def untagged(tracks: DataFrame, *more: str) -> DataFrame:
    """(tracklet, colony, frame, x, y, area) for every frame of every tracklet, and more columns of the tracklet."""
    t = tracks.select("tracklet", "colony", "area", *more, F.explode(F.sequence("fi", "ff")).alias("frame"))
    place = lambda p, q: (F.col("tracklet") * p + F.col("frame") * q) % 1000 / 1000.0
    return t.select("tracklet", "colony", "frame", place(7919, 31).alias("x"), place(104729, 17).alias("y"), "area", *more)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(tracklet, frame, p): class probabilities, the softmax of 40 times ten sums of every tenth component."""
    each = lambda k: F.transform(F.sequence(k, F.size("embedding") - 1, F.lit(10)), lambda i: F.get("embedding", i).cast("double"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: 40.0 * F.aggregate(each(k), F.lit(0.0), lambda a, v: a + v))
    e = table(spark, path, "embeddings").select("vec_id", sums.alias("z"))
    e = e.withColumn("w", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    return e.select(F.floor(F.col("vec_id") / 5).cast("long").alias("tracklet"), (F.col("vec_id") % 5).alias("frame"), F.transform("w", lambda v: v / total).alias("p"))


CLASSES = ("C0", "C1", "C2", "C3", "C4", "C5", "C6", "Unknown", "NoAnt", "MultiAnt")


def dat(spark: SparkSession, path: str) -> DataFrame:
    """Frame data (frame, S1, T1..T4): mean event value per hour, and per user class."""
    e = table(spark, path, "events").select(hour_of(F.col("ts")).alias("frame"), (F.col("user_id") % 4).alias("k"), F.col("value").cast("decimal(18,6)").alias("value"))
    mean = lambda k: F.avg(F.when(F.col("k") == k, F.col("value"))).cast("double").alias(f"T{k + 1}")
    return e.groupBy("frame").agg(F.avg("value").cast("double").alias("S1"), *[mean(k) for k in range(4)])
