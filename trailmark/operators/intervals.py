"""Joins and expansions over frames and closed frame intervals [fi, ff]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.blocks import block_of, per_frame


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], *, width: int, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Pairs of rows of one group whose intervals overlap, as an equi join on blocks of frames.

    Each interval is entered under every block of ``width`` frames that it touches; a pair counts
    in the block of the later start only, so none is met twice. Intervals much longer than the
    width cost more rows, a width much larger than the intervals costs more comparisons.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        d = df.withColumn("__block", F.explode(F.sequence(F.floor(F.col("fi") / width).cast("long"), F.floor(F.col("ff") / width).cast("long"))))
        return d.select(*on, "__block", *[F.col(c).alias(c + s) for c in df.columns if c not in on])

    x, y = suffixes
    j = per_frame(side(a, x)).join(per_frame(side(b, y)), [*on, "__block"])
    first = F.floor(F.greatest("fi" + x, "fi" + y) / width).cast("long")
    return j.where((F.col("fi" + x) <= F.col("ff" + y)) & (F.col("ff" + x) >= F.col("fi" + y)) & (F.col("__block") == first)).drop("__block")


def _shift(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def cover_nodes(lo: Column, hi: Column, levels: int) -> Column:
    """Array of (level, node) of a binary tree over the whole numbers that together hold lo..hi and nothing else: at most two per level."""

    def at(level: Column) -> Column:
        begin, end = -_shift(-lo, level), _shift(hi + 1, level)
        odd = lambda x: (x.bitwiseAND(F.lit(1)) == 1) & (begin < end)
        return F.array(F.when(odd(begin), F.struct(level.alias("level"), begin.alias("node"))), F.when(odd(end), F.struct(level.alias("level"), (end - 1).alias("node"))))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at)), lambda x: x.isNotNull())


def stab_join(points: DataFrame, intervals: DataFrame, on: list[str], *, at: str = "frame", leaf: int = 32, levels: int | None = None) -> DataFrame:
    """points joined with the intervals [fi, ff] of their group that hold them, each pair once; names other than ``on`` differ.

    Blocks of ``leaf`` frames are the leaves of a binary tree. An interval enters the few nodes that cover its blocks, a point
    all nodes above its own block, so an interval of any length costs about twice the logarithm of it. levels: how many the
    longest interval needs; without it they are counted first. Intervals that end before they begin, and nulls, hold nothing.
    """
    block = lambda c: F.floor(F.col(c) / leaf).cast("long")
    if levels is None:
        longest = intervals.agg(F.max(block("ff") - block("fi") + 1)).first()[0] or 1
        levels = max(1, int(longest).bit_length())
    above = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda level: F.struct(level.alias("level"), _shift(block(at), level).alias("node")))
    p = points.where(F.col(at).isNotNull()).withColumn("__node", F.explode(above))
    i = intervals.where("fi <= ff").withColumn("__node", F.explode(cover_nodes(block("fi"), block("ff"), levels)))
    return per_frame(p).join(per_frame(i), [*on, "__node"]).where((F.col("fi") <= F.col(at)) & (F.col(at) <= F.col("ff"))).drop("__node")


def dyadic_join(a: DataFrame, b: DataFrame, on: list[str], *, leaf: int = 32, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """As overlap_join, for intervals of very different lengths: one of two overlapping intervals holds the other's first
    frame, so the pairs are two joins of first frames with intervals, and each is met once."""
    x, y = suffixes
    named = lambda df, s: df.select(*on, *[F.col(c).alias(c + s) for c in df.columns if c not in on])
    l, r = named(a.where("fi <= ff"), x), named(b.where("fi <= ff"), y)
    held = lambda points, at, rows, s: stab_join(points, rows.withColumns({"fi": F.col("fi" + s), "ff": F.col("ff" + s)}), on, at=at, leaf=leaf).drop("fi", "ff")
    later = held(l, "fi" + x, r, y)
    return later.unionByName(held(r, "fi" + y, l, x).where(F.col("fi" + y) > F.col("fi" + x)))


def overlaps(tracks: DataFrame, on: str = "colony", width: int = 32) -> DataFrame:
    """(colony, a, b): ordered pairs of different tracklets of a colony that share a frame."""
    t = tracks.select(on, "tracklet", "fi", "ff")
    return overlap_join(t, t, [on], width=width).where("tracklet_a <> tracklet_b").select(on, F.col("tracklet_a").alias("a"), F.col("tracklet_b").alias("b"))


def frame_to_movie(df: DataFrame, movies: DataFrame, *, open_end: bool = False) -> DataFrame:
    """df with the movie m of each frame and the frame mf inside it.

    Closed: the movie whose [fi, ff] holds the frame. open_end: the last movie that begins at or before it.
    Movies are equi joined on blocks of frames, so no comparison with all movies is made.
    """
    if open_end:
        # an as-of join: movies and frames in one ordered sequence of blocks; a block's first frames take the last movie before it
        m = movies.select(F.col("fi").alias("__at"), F.lit(0).alias("__o"), F.struct(F.col("fi").alias("fi"), F.col("m").alias("m")).alias("__m"))
        d = df.withColumns({"__at": F.col("frame"), "__o": F.lit(1)}).unionByName(m, allowMissingColumns=True)
        d = d.withColumn("__b", block_of("__at"))
        w = Window.partitionBy("__b").orderBy("__at", "__o").rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
        tops = d.groupBy("__b").agg(F.max("__m").alias("__top")).select("__b", F.last("__top", True).over(ahead).alias("__before"))
        d = d.withColumn("__m", F.last("__m", True).over(w)).where("__o = 1").join(tops, "__b")
        d = d.withColumn("__m", F.coalesce("__m", "__before"))
        return d.select(*df.columns, "__m.m", (F.col("frame") - F.col("__m.fi") + 1).alias("mf"))
    width = 64
    m = movies.select("m", "fi", "ff", F.explode(F.sequence(F.floor(F.col("fi") / width).cast("long"), F.floor(F.col("ff") / width).cast("long"))).alias("__b"))
    d = df.withColumn("__b", F.floor(F.col("frame") / width).cast("long")).join(m, "__b").where((F.col("fi") <= F.col("frame")) & (F.col("frame") <= F.col("ff")))
    return d.select(*df.columns, "m", (F.col("frame") - F.col("fi") + 1).alias("mf"))


def at_frames(tracks: DataFrame, points: DataFrame, *, on: list[str], width: int = 32) -> DataFrame:
    """points (on..., frame, ...) joined with the tracklets alive at that frame."""
    t = tracks.withColumn("__b", F.explode(F.sequence(F.floor(F.col("fi") / width).cast("long"), F.floor(F.col("ff") / width).cast("long"))))
    p = points.withColumn("__b", F.floor(F.col("frame") / width).cast("long"))
    return p.join(t, [*on, "__b"]).where((F.col("fi") <= F.col("frame")) & (F.col("frame") <= F.col("ff"))).drop("__b")


def tracklet_at_frame(tracks: DataFrame, points: DataFrame, *, on: list[str]) -> DataFrame:
    """points that exactly one tracklet covers, with that tracklet."""
    j = at_frames(tracks, points, on=on).groupBy(*points.columns).agg(F.count(F.lit(1)).alias("__n"), F.first("tracklet").alias("tracklet"))
    return j.where("__n = 1").drop("__n")


def in_time(tracks: DataFrame, frames: DataFrame, width: int = 32) -> DataFrame:
    """Tracklets that exist at any of the given frames."""
    alive = at_frames(tracks.select("tracklet", "fi", "ff"), frames.select("frame").distinct(), on=[], width=width).select("tracklet").distinct()
    return tracks.join(alive, "tracklet", "left_semi")


def blob_table(tracks: DataFrame) -> DataFrame:
    """A row per tracklet and frame, with its position ix (0..) in the tracklet."""
    return tracks.select("tracklet", F.posexplode(F.sequence("fi", "ff")).alias("ix", "frame"))


def temporal_removals(tracks: DataFrame, commands: DataFrame, leaf: int = 64) -> DataFrame:
    """(tracklet, id) taken out by commands (colony, id, fi, ff); the colony 'all' stands for every colony.

    The wildcard is a union of two equi joins, not a condition with OR. A command may span the whole recording. Commands
    are lines written by hand, so they are sent to all tasks.
    """
    commands = F.broadcast(commands)
    here = commands.where("colony <> 'all'").withColumn("colony", F.col("colony").cast("long"))
    every = commands.where("colony = 'all'").drop("colony")
    t = tracks.select("tracklet", "colony", "fi", "ff")
    one = dyadic_join(t, here, ["colony"], leaf=leaf).select(F.col("tracklet_a").alias("tracklet"), F.col("id_b").alias("id"))
    two = dyadic_join(t, every, [], leaf=leaf).select(F.col("tracklet_a").alias("tracklet"), F.col("id_b").alias("id"))
    return one.union(two).distinct()


def node_distance(fi1: Column, ff1: Column, fi2: Column, ff2: Column) -> Column:
    """Frames between two intervals, 0 if they overlap."""
    return F.greatest(F.lit(0), fi2 - ff1, fi1 - ff2)


def movie_frames(movies: DataFrame) -> DataFrame:
    """Running first and last frame of movies in index order (a row per movie)."""
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return movies.withColumn("ff", F.sum("nframes").over(w)).withColumn("fi", F.col("ff") - F.col("nframes") + 1)
