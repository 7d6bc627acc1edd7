"""Tables that leave the engine: exports of trajectories, targets and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.blocks import BLOCK, block_of, by_tracklet, dealt_out, in_block, per_frame


def untagged(rows: DataFrame, tracks: DataFrame, counts: DataFrame) -> DataFrame:
    """Every tracklet frame with its number of animals."""
    t = tracks.select("tracklet", "label").join(counts.select("tracklet", "nants"), "tracklet", "left")
    return rows.join(by_tracklet(t), "tracklet").select("tracklet", "frame", "x", "y", "area", "label", "nants")


def no_propagation(rows: DataFrame, tracks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Positions by a tracklet's own label only; of two tracklets in a frame the later one counts."""
    d = per_frame(rows).join(tracks.where(F.col("label").isin(*ids)).select("tracklet", F.col("label").alias("ant"), "fi"), "tracklet")
    g = d.groupBy("colony", "ant", "frame").agg(F.max_by(F.struct("x", "y"), F.struct("fi", "tracklet")).alias("p"))
    return g.select("colony", "ant", "frame", "p.x", "p.y")


def group_ids(tracks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(tracklet, id): the id of single tracklets, '?' if they have none, 'multi' for the others."""
    one = F.when(F.col("label").isin(*ids), F.col("label")).otherwise("?")
    return tracks.select("tracklet", F.when(F.col("single"), one).otherwise("multi").alias("id"))


def targets(rows: DataFrame, scale: float) -> DataFrame:
    """One row per target with its frames in order: positions in mm, a quarter of the axes, b = a * sqrt(1 - e)."""
    mm = lambda c: F.col(c) * scale * 1000
    a = mm("majax") / 4
    point = F.struct("frame", mm("x").alias("x"), mm("y").alias("y"), a.alias("a"), (a * F.sqrt(1 - F.col("eccentricity"))).alias("b"))
    return rows.groupBy("target").agg(F.array_sort(F.collect_list(point)).alias("trx"))


def behaviour_labels(labels: DataFrame, frames: DataFrame, *, fps: float, first: int) -> DataFrame:
    """(id, label, t0, t1) in frames: seconds turned to frames, cut to the frames that exist, the first n per label."""
    span = frames.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    d = labels.join(F.broadcast(span))  # one row
    d = d.select("id", "label", F.greatest(F.floor(F.col("t_from") * fps).cast("long") + 1, "lo").alias("t0"), F.least(F.floor(F.col("t_to") * fps).cast("long"), "hi").alias("t1")).where("t0 <= t1")
    w = Window.partitionBy("label").orderBy("t0", "t1", "id")
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= first).drop("__r")


def importance(intervals: DataFrame) -> DataFrame:
    """Interval ends that no other interval of the id begins at."""
    starts = intervals.select("id", F.col("t0").alias("at"))
    return intervals.select("id", F.col("t1").alias("at")).distinct().join(starts, ["id", "at"], "left_anti")


def ant_frames(first: int, last: int, table: DataFrame, rows: DataFrame, *, key: Sequence[str] = ("ant",), hide_ends: bool = False) -> DataFrame:
    """Every ant on a dense frame axis through its tracklet table (key..., tracklet, fi, ff, single).

    Area only where the tracklet is single; hide_ends removes the positions of the first and last frame of
    tracklets that are not.
    """
    k = list(key)
    d = rows.join(by_tracklet(table.select(*k, "tracklet", "fi", "ff", "single").dropna(subset=k)), "tracklet").where((F.col("frame") >= F.greatest("fi", F.lit(first))) & (F.col("frame") <= F.least("ff", F.lit(last))))
    end = ~F.col("single") & ((F.col("frame") == F.col("fi")) | (F.col("frame") == F.col("ff"))) if hide_ends else F.lit(False)
    p = F.struct(F.when(~end, F.col("x")).alias("x"), F.when(~end, F.col("y")).alias("y"), F.when(F.col("single"), F.col("area")).alias("area"), "single")
    d = d.select(*k, "frame", F.struct("fi", "tracklet").alias("order"), p.alias("p"))
    # each block of an ant begins with a row of its own, which a tracklet's row at that frame replaces; a row then fills the frames up to the next
    blocks = F.explode(F.sequence(block_of(F.lit(first)), block_of(F.lit(last))))
    begin = table.select(*k).distinct().select(*k, blocks.alias("__b")).withColumn("frame", F.greatest(F.lit(first), F.col("__b") * BLOCK).cast("long"))
    d = dealt_out(d.withColumn("__b", block_of("frame")).unionByName(begin, allowMissingColumns=True), *k, "__b")
    d = d.groupBy(*k, "__b", "frame").agg(F.max_by("p", "order").alias("p"))
    d = d.withColumn("__to", F.coalesce(F.lead("frame").over(in_block(*k)), F.least(F.lit(last + 1), (F.col("__b") + 1) * BLOCK)) - 1)
    d = d.withColumn("__f", F.explode(F.sequence("frame", "__to")))
    p = F.when(F.col("__f") == F.col("frame"), F.col("p"))
    return d.select(*k, F.col("__f").alias("frame"), p.alias("p")).select(*k, "frame", "p.x", "p.y", "p.area", F.coalesce("p.single", F.lit(False)).alias("single"))


def wide(xy: DataFrame, ants: Sequence[str], columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """A column per ant and feature, for files at the edge of the system only."""
    return xy.groupBy("frame").pivot("ant", list(ants)).agg(*[F.first(c).alias(c) for c in columns])
