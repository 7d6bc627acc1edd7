"""Operators on tracklets (one row each) and on their rows per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.model import MULTI_LABELS, NON_ANT_LABELS
from trailmark.operators.blocks import per_frame


def tracklet_stats(rows: DataFrame) -> DataFrame:
    """Mean area, length and end points of each tracklet from its rows per frame, and whether any touches the boundary, if rows say so."""
    first, last = F.min_by(F.struct("x", "y"), "frame"), F.max_by(F.struct("x", "y"), "frame")
    touch = [F.bool_or("boundary").alias("boundary")] if "boundary" in rows.columns else []
    s = rows.groupBy("tracklet").agg(*touch, F.avg("area").alias("mean_area"), F.count(F.lit(1)).alias("len"), F.min("frame").alias("fi"), F.max("frame").alias("ff"), first.alias("i"), last.alias("f"))
    return s.select("tracklet", "mean_area", "len", "fi", "ff", F.col("i.x").alias("xi"), F.col("i.y").alias("yi"), F.col("f.x").alias("xf"), F.col("f.y").alias("yf"), *["boundary"] * len(touch))


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "tracklet") -> DataFrame:
    """(node, indeg, outdeg)."""
    i, o = (edges.groupBy(F.col(c).alias(node)).agg(F.count(F.lit(1)).alias(n)) for c, n in (("dst", "indeg"), ("src", "outdeg")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select(node).join(i, node, "left").join(o, node, "left").select(node, zero("indeg"), zero("outdeg"))


def singles(tracks: DataFrame, edges: DataFrame, *, min_area: float, max_area: float, one_link: bool = True, commands: DataFrame | None = None) -> DataFrame:
    """(tracklet, single): area inside the limits, at most one link on either side, no multi label.

    commands (tracklet, value, line) overrule; the first line of a tracklet counts.
    """
    d = tracks.join(degrees(tracks, edges), "tracklet")
    ok = F.coalesce((F.col("area") > min_area) & (F.col("area") < max_area), F.lit(False)) & ~F.coalesce(F.col("label").isin(*MULTI_LABELS), F.lit(False))
    if one_link:
        ok = ok & (F.col("indeg") <= 1) & (F.col("outdeg") <= 1)
    if commands is None:
        return d.select("tracklet", ok.alias("single"))
    first = commands.groupBy("tracklet").agg(F.min_by("value", "line").alias("__v"))
    return d.join(first, "tracklet", "left").select("tracklet", F.coalesce(F.col("__v") == 1, ok).alias("single"))


def load_ids(tracks: DataFrame, auto: DataFrame, manual: DataFrame) -> DataFrame:
    """tracks with autoid, manualid and the id that counts (manual before auto) with its score."""
    d = tracks.join(auto.select("tracklet", F.col("label").alias("autoid"), F.col("score").alias("autoscore")), "tracklet", "left")
    d = d.join(manual.select("tracklet", F.col("label").alias("manualid")), "tracklet", "left")
    score = F.when(F.col("manualid").isNotNull(), F.lit(float("inf"))).otherwise(F.coalesce("autoscore", F.lit(0.0)))
    return d.withColumns({"propid": F.coalesce("manualid", "autoid", F.lit("")), "propscore": score}).drop("autoscore")


def is_single_label(label: Column, ant: list[str], other: list[str]) -> Column:
    return (label.isin(*ant) & ~label.isin(*MULTI_LABELS)) | label.isin(*other)


def only_ants(tracks: DataFrame, non_ant: tuple[str, ...] = NON_ANT_LABELS) -> DataFrame:
    return tracks.where(~F.coalesce(F.col("label").isin(*non_ant), F.lit(False)))


def frame_quality(rows: DataFrame, *, area: tuple[float, float], eccentricity: tuple[float, float]) -> DataFrame:
    """rows with score (a product of four sigmoids, at most 1) and passed (all limits hold).

    Each excess is cut at 0 from above, so only violations lower the score.
    """
    low = lambda e: F.least(e, F.lit(0.0))
    a, e = F.col("area"), F.col("eccentricity")
    parts = [low((a - area[0]) / area[0]), low((area[1] - a) / area[1]), low((e - eccentricity[0]) / eccentricity[0]), low((eccentricity[1] - e) / eccentricity[1])]
    score: Column = F.lit(1.0)
    passed: Column = F.lit(True)
    for p in parts:
        score, passed = score * (2 / (1 + F.exp(-p))), passed & (p >= 0)
    return rows.withColumns({"score": score, "passed": passed})


def filter_blobs(blobs: DataFrame, column: str, least: float) -> DataFrame:
    """Blobs with column >= least, numbered anew from 1 inside each frame."""
    w = Window.partitionBy("frame").orderBy("blob")
    return blobs.where(F.col(column) >= least).withColumn("blob", F.row_number().over(w).cast("long"))


def colony_of(rows: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(tracklet, colony): the only colony whose mask cells (cx, cy, colony) its positions meet, else NULL."""
    at = rows.select("tracklet", F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy"))
    j = at.join(cells, ["cx", "cy"], "left").groupBy("tracklet").agg(F.min("colony").alias("a"), F.max("colony").alias("b"))
    return j.select("tracklet", F.when(F.col("a") == F.col("b"), F.col("a")).alias("colony"))


def tracklet_velocity(rows: DataFrame) -> DataFrame:
    """rows with vnorm and vang inside each tracklet, from positions and dt."""
    w = Window.partitionBy("tracklet").orderBy("frame")
    vx, vy = ((F.col(c) - F.lag(c).over(w)) / F.col("dt") for c in ("x", "y"))
    return rows.withColumns({"vx": vx, "vy": vy}).withColumns({"vnorm": F.hypot("vx", "vy"), "vang": F.atan2("vy", "vx")}).drop("vx", "vy")


def scaled(rows: DataFrame, scale: float) -> DataFrame:
    """rows with x and y in real units and rarea, the area in real units."""
    return rows.withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale, "rarea": F.col("area") * (scale * scale)})


def with_name(tracks: DataFrame, part: str) -> DataFrame:
    """Tracklets whose name holds a text."""
    return tracks.where(F.col("tracklet").cast("string").contains(part))


def with_ids(tracks: DataFrame, ids: list[str], above: float = float("-inf")) -> DataFrame:
    """Tracklets of certain labels with a score above a limit."""
    return tracks.where(F.col("label").isin(*ids) & (F.col("score") > above))


def known_rows(rows: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """Rows whose columns are present; with label also those whose label is not empty."""
    d = rows.dropna(subset=columns)
    return d if label is None else d.where(F.coalesce(F.col(label), F.lit("")) != "")


def nearest_blob(centres: DataFrame, blobs: DataFrame) -> DataFrame:
    """(tracklet, frame, blob, dist): of the blobs (frame, blob, x, y) of a frame the one nearest to the tracklet's centre; the lower number on a tie."""
    j = centres.select("tracklet", "frame", F.col("x").alias("cx"), F.col("y").alias("cy")).join(blobs.select("frame", "blob", "x", "y"), "frame")
    j = j.withColumn("dist", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    return j.groupBy("tracklet", "frame").agg(F.min(F.struct("dist", "blob")).alias("p")).select("tracklet", "frame", "p.blob", "p.dist")


def positions_at(rows: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """points (target, frame, offset) with the target's columns at frame + offset; NULL where it has no row there."""
    at = rows.select("target", F.col("frame").alias("__at"), *columns)
    return points.withColumn("__at", F.col("frame") + F.col("offset")).join(per_frame(at), ["target", "__at"], "left").drop("__at")


def close_tracklets(rows: DataFrame, cells: DataFrame, size: float, *, area: tuple[float, float], eccentricity: tuple[float, float]) -> DataFrame:
    """What is known when tracklets are closed: their stats, colony, and the number of frames that pass the quality limits.

    rows: (tracklet, frame, x, y, area, eccentricity). Orientation is set right by ``kernels.fix_orientations``.
    """
    passed = frame_quality(rows, area=area, eccentricity=eccentricity).groupBy("tracklet").agg(F.count_if("passed").alias("passed"))
    return tracklet_stats(rows).join(colony_of(rows, cells, size), "tracklet").join(passed, "tracklet")


def split_every(rows: DataFrame, most: int = 600) -> DataFrame:
    """rows (chain, frame, ...) with tracklet part: a chain is cut after every ``most`` rows."""
    w = Window.partitionBy("chain").orderBy("frame")
    return rows.withColumn("part", F.floor((F.row_number().over(w) - 1) / most).cast("long"))


def stitch(rows: DataFrame, order: str) -> DataFrame:
    """One position per (ant, frame): that of the tracklet latest in ``order``."""
    s = rows.groupBy("ant", "frame").agg(F.max_by(F.struct("x", "y", "tracklet"), F.struct(order, "tracklet")).alias("p"))
    return s.select("ant", "frame", "p.x", "p.y", "p.tracklet")


def value_at(rows: DataFrame, points: DataFrame, column: str) -> DataFrame:
    """points (tracklet, frame) with a column of the tracklet's row at that frame; missing where there is none."""
    return points.join(per_frame(rows.select("tracklet", "frame", column)), ["tracklet", "frame"], "left")


def assignment_rate(table: DataFrame, frames: int, ants: int, colonies: int) -> DataFrame:
    """(rate, classified): covered (ant, frame) cells over all of them, and the same of source tracklets."""
    cells = float(frames * ants * colonies)
    return table.agg((F.sum("len") / cells).alias("rate"), (F.sum(F.when(F.col("source"), F.col("len")).otherwise(0)) / cells).alias("classified"))


def assignment_report(assigned: DataFrame, expected: DataFrame, removed: DataFrame) -> DataFrame:
    """(colony, id, rate): frames assigned over frames expected less frames removed; NULL colony and id are totals."""
    a = assigned.groupBy("colony", "id").agg(F.sum("len").alias("got"))
    r = removed.groupBy("colony", "id").agg(F.sum("frames").alias("gone"))
    d = expected.join(a, ["colony", "id"], "left").join(r, ["colony", "id"], "left")
    g = d.rollup("colony", "id").agg(F.sum(F.coalesce("got", F.lit(0))).alias("got"), F.sum(F.col("frames") - F.coalesce("gone", F.lit(0))).alias("of"))
    return g.select("colony", "id", F.try_divide("got", "of").alias("rate"))
