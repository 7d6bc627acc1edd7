"""Body parts per tracklet frame: pose (tracklet, ix, bodypart, x, y, likelihood)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.blocks import by_tracklet, per_frame


def pose_rows(pose: DataFrame, tracks: DataFrame, bodyparts: Sequence[str] | None = None) -> DataFrame:
    """pose of known tracklets with frame, counted from the tracklet's first (ix 0)."""
    d = pose if bodyparts is None else pose.where(F.col("bodypart").isin(*bodyparts))
    return d.join(by_tracklet(tracks.select("tracklet", "fi")), "tracklet").withColumn("frame", F.col("fi") + F.col("ix")).drop("fi")


def combined(rows: DataFrame, pose: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Both tables in one: where both have a value, that of rows counts."""
    p = pose.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(per_frame(p), list(key), "full").select(*key, *[F.coalesce(c, f"__{c}").alias(c) for c in columns])


def weighted(likelihood: Column, least: float, *values: Column) -> list[Column]:
    """Values times their likelihood where that is at least ``least``, else NULL."""
    return [F.when(likelihood >= least, v * likelihood) for v in values]


def relative_to(rows: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with x and y relative to the reference's in the same ``on``; rows without one go."""
    r = reference.select(*on, F.col("x").alias("__x"), F.col("y").alias("__y"))
    return rows.join(r, list(on)).withColumns({"x": F.col("x") - F.col("__x"), "y": F.col("y") - F.col("__y")}).drop("__x", "__y")


def frame_tracklet_data(rows: DataFrame, tracks: DataFrame, autoids: DataFrame, pose: DataFrame | None = None, *, ants: Sequence[str] = (), only_ants: bool = False) -> DataFrame:
    """Tracklet rows with frameix, their tracklet's automatic label, and a column x_<part>, y_<part> per body part.

    See ``assert_unique`` for keys (tracklet, frame) that are found twice.
    """
    t = tracks.select("tracklet", "fi").join(autoids.select("tracklet", F.col("label").alias("autoid")), "tracklet", "left")
    if only_ants:
        t = t.where(F.col("autoid").isin(*ants))
    d = per_frame(rows).join(t, "tracklet").withColumn("frameix", F.col("frame") - F.col("fi")).drop("fi")
    if pose is not None:
        parts = sorted(r[0] for r in pose.select("bodypart").distinct().collect())  # a handful of body parts
        # both kinds of rows stand side by side, by tracklet: of neither are the rows per frame sent again for their meeting
        q = per_frame(pose.select("tracklet", F.col("ix").alias("frameix"), F.col("bodypart").alias("__part"), F.col("x").alias("__x"), F.col("y").alias("__y"))).join(t.select("tracklet"), "tracklet", "left_semi")
        one = Window.partitionBy("tracklet", "frameix")
        names = {f"{c}_{p}": F.first(F.when(F.col("__part") == p, F.col(f"__{c}")), True).over(one) for p in parts for c in "xy"}
        both = d.withColumn("__row", F.lit(True)).unionByName(q.withColumn("__row", F.lit(False)), True)
        d = both.withColumns(names).where("__row").select(*d.columns, *names)
    return d


def assert_unique(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows; an error names a key that is found twice. Counting is one partial aggregate."""
    twice = rows.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not unique: {twice[0].asDict()}")
    return rows
