"""From class probabilities per frame to one label per tracklet, and the measures of a classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def argmax(p: str):
    """First index of the largest element, 0-based."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def tracklet_vote(scores: DataFrame, classes: Sequence[str], *, ant: Sequence[str], non_ant: Sequence[str], multi: Sequence[str], other: Sequence[str] = (), confidence: bool = True, factor: float = 0.5,
                  tracklets: DataFrame | None = None) -> DataFrame:
    """(tracklet, label, score, best_frame) from scores (tracklet, frame, p), the first rule that fits:

    all frames non-ant: the most common label; any multi and no ant, or more than a quarter multi: the most
    common multi label; all in other, or no ant frame: the most common label; else the ant class with the
    greatest sum over ant frames, its sum as score, and the ant frame of the greatest probability of this class.
    Ties go to what is seen first, in frame order or class order. With confidence, an uncertain result is Unknown.
    Tracklets of ``tracklets`` without any frame are Unknown.
    Only the last rule gives a score and a frame; the others give 0 and -1. Label counts are aggregates per
    (tracklet, label), so nothing is gathered per tracklet.
    """
    names = F.array(*[F.lit(c) for c in classes])
    f = scores.withColumn("label", F.get(names, argmax("p")))
    isin = lambda s: F.col("label").isin(*s) if s else F.lit(False)
    counts = f.groupBy("tracklet", "label").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("seen"))
    best = lambda where: F.max(F.when(where, F.struct("n", (-F.col("seen")).alias("early"), "label")))["label"]
    kinds = counts.groupBy("tracklet").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(isin(s), F.col("n")).otherwise(0)).alias(k) for k, s in (("n_ant", ant), ("n_non", non_ant), ("n_multi", multi), ("n_other", other))],
        best(F.lit(True)).alias("common"),
        best(isin(multi)).alias("common_multi"),
    )
    at = {c: i for i, c in enumerate(classes)}
    ant_p = lambda: [F.get("p", F.lit(at[c])) for c in ant]
    a = f.where(isin(ant))
    sums = a.groupBy("tracklet").agg(
        *[F.sum(p).alias(f"s{i}") for i, p in enumerate(ant_p())],
        *[F.max_by("frame", F.struct(p, -F.col("frame"))).alias(f"f{i}") for i, p in enumerate(ant_p())],
        F.max(F.greatest(*ant_p())).alias("top"),
    )
    every = lambda x: F.array(*[F.col(f"{x}{i}") for i in range(len(ant))])
    sums = sums.withColumn("s", every("s")).select("tracklet", F.get(F.array(*[F.lit(c) for c in ant]), argmax("s")).alias("won"), F.array_max("s").alias("sum"), "top", F.get(every("f"), argmax("s")).alias("frame"))
    d = kinds.join(sums, "tracklet", "left")
    many = ((F.col("n_multi") > 0) & (F.col("n_ant") == 0)) | (F.col("n_multi") > 0.25 * F.col("n"))
    plain = (F.col("n_non") == F.col("n")) | (F.col("n_other") == F.col("n")) | (F.col("n_ant") == 0)
    unsure = F.lit(False)
    if confidence:
        unsure = (F.col("top") < 1 - 0.2 * factor) | ((F.col("n_ant") < 5) & (F.col("top") < 1 - 0.02 * factor))
    voted = ~((F.col("n_non") == F.col("n")) | many | plain | unsure)
    label = F.when(F.col("n_non") == F.col("n"), F.col("common")).when(many, F.col("common_multi")).when(plain, F.col("common")).when(unsure, "Unknown").otherwise(F.col("won"))
    out = d.select("tracklet", label.alias("label"), F.when(voted, F.col("sum")).otherwise(0.0).alias("score"), F.when(voted, F.col("frame")).otherwise(-1).alias("best_frame"))
    if tracklets is None:
        return out
    none = {"label": "Unknown", "score": 0.0, "best_frame": -1}
    return tracklets.select("tracklet").join(out, "tracklet", "left").fillna(none)


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """(truth, predicted, n)"""
    return pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support); measures with an empty denominator are 0."""
    c = confusion_matrix(pairs)
    hit = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    d = hit.join(said, "label", "full").fillna(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    d = d.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support"))})
    return d.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def class_weights(labels: DataFrame, factors: dict[str, float] | None = None) -> DataFrame:
    """(label, weight): n / (k * count), times a factor for named labels."""
    c = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # a row per class
    factor = F.lit(1.0)
    for name, x in (factors or {}).items():
        factor = F.when(F.col("label") == name, x).otherwise(factor)
    return c.select("label", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")) * factor).alias("weight"))
