"""Links between tracklets of one movie and of the next.

The tracklets that end in a movie's last frame are matched with the blobs of that frame, and those that begin in the
next movie's first frame with the blobs of that one. A parent and a child are linked where their blobs are; blobs
split and merge, so a tracklet may have several partners on either side.

Only pairs nearer than the gate can be part of a cheapest matching. They are found over grid cells, and the matching
falls into one small problem per connected component of such pairs, which Spark deals out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.components import connected_components, cut

AT = ("m", "colony")


def within(a: DataFrame, b: DataFrame, reach: float, on: Sequence[str] = AT) -> DataFrame:
    """Rows of a joined with the rows of b nearer than reach (by x and y), with their distance d.

    Both have x, y and the columns ``on``; their other names differ. Rows without a place, or with a null in ``on``, have no partner.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    left = a.where(known).withColumnsRenamed({"x": "__x", "y": "__y"}).withColumns({"__i": F.floor(F.col("__x") / reach).cast("long"), "__j": F.floor(F.col("__y") / reach).cast("long")})
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    right = b.where(known).withColumn("__i", around("x")).withColumn("__j", around("y"))
    d = F.hypot(F.col("__x") - F.col("x"), F.col("__y") - F.col("y"))
    return left.join(right, [*on, "__i", "__j"]).withColumn("d", d).where(F.col("d") < reach).drop("__i", "__j", "__x", "__y", "x", "y")


def cheapest(pairs: Iterable[tuple[int, int, float]], alone: float) -> list[tuple[int, int]]:
    """The matching of (row, column, cost) pairs with least total cost, where a row or a column left over costs ``alone``.

    Rows enter one by one along the cheapest augmenting path; every row may also end in a place of its own that stands
    for being left over and costs as much as a row and a column alone.
    """
    near: dict[int, dict[int, float]] = {}
    for i, j, c in pairs:
        near.setdefault(i, {})
        near[i][j] = min(c, near[i].get(j, np.inf))
    for i, to in near.items():
        to[-1 - i] = 2 * alone  # columns are not negative, places of their own are
    row_of: dict[int, int] = {}
    column_of: dict[int, int] = {}
    price: dict[int, float] = {}  # of columns; a row's is what its cheapest place leaves
    due: dict[int, float] = {}
    for start in sorted(near):
        due[start] = min(c - price.get(j, 0.0) for j, c in near[start].items())
        best, came, done, heap, far = {}, {}, {}, [], {start: 0.0}
        i = start
        while True:
            for j, c in near[i].items():
                new = far[i] + c - due[i] - price.get(j, 0.0)
                if j not in done and new < best.get(j, np.inf):
                    best[j], came[j] = new, i
                    heapq.heappush(heap, (new, j))
            while heap[0][1] in done or heap[0][0] > best[heap[0][1]]:
                heapq.heappop(heap)
            length, j = heapq.heappop(heap)
            done[j] = length
            if j not in row_of:
                break
            i = row_of[j]
            far[i] = length
        for k, v in done.items():
            price[k] = price.get(k, 0.0) + v - length
        for k, v in far.items():
            due[k] += length - v
        while True:
            i = came[j]
            row_of[j], free, column_of[i] = i, column_of.get(i), j
            if i == start:
                break
            j = free
    return sorted((i, j) for j, i in row_of.items() if j >= 0)


def assignments(tracks: DataFrame, blobs: DataFrame, *, alone: float, on: Sequence[str] = AT) -> DataFrame:
    """(*on, tracklet, blob): per value of ``on`` the cheapest matching of tracks (*on, tracklet, x, y) with blobs
    (*on, blob, x, y), by distance, where a track or a blob left over costs ``alone``.

    Whole-numbered ids. Of equal ids within ``on`` the nearer place counts. Among matchings of one cost any may come out, the same for the same table.
    """
    pairs = cut(within(tracks.select(*on, "tracklet", "x", "y"), blobs.select(*on, "blob", "x", "y"), 2 * alone, on))
    # nodes that share a number by accident only put two problems into one
    ends = pairs.withColumns({"a": F.xxhash64(F.lit(0), *on, "tracklet"), "b": F.xxhash64(F.lit(1), *on, "blob")})
    d = cut(ends.join(connected_components(ends.select("a", "b")).withColumnRenamed("node", "a"), "a").drop("a", "b"))
    nearest = F.min_by(F.struct("tracklet", "blob", *on), F.struct("d", "tracklet", "blob"))
    plain = lambda c: F.min(c) == F.max(c)
    kinds = d.groupBy("component").agg((plain("tracklet") | plain("blob")).alias("easy"), nearest.alias("p"), *[plain(c).alias(f"__{c}") for c in on])
    one = F.col("easy")
    for c in on:
        one = one & F.col(f"__{c}")
    easy = kinds.where(one).select("p.*").select(*on, "tracklet", "blob")
    hard = d.join(kinds.where(~one).select("component"), "component", "left_semi")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, q in p.groupby(list(on), sort=True):
            q = q.sort_values(["tracklet", "blob", "d"])
            t, b = np.unique(q["tracklet"]), np.unique(q["blob"])
            got = cheapest(zip(np.searchsorted(t, q["tracklet"]).tolist(), np.searchsorted(b, q["blob"]).tolist(), q["d"].tolist(), strict=True), alone)
            same = {c: q[c].iloc[0] for c in on}
            out.append(pd.DataFrame({**{c: [v] * len(got) for c, v in same.items()}, "tracklet": [t[i] for i, _ in got], "blob": [b[j] for _, j in got]}))
        return pd.concat(out, ignore_index=True)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in easy.schema)
    return easy.unionByName(hard.groupBy("component").applyInPandas(work, schema))


def open_borders(movies: DataFrame, dat: DataFrame, longest: float) -> DataFrame:
    """(m): the movies after whose last frame another one begins, no more than ``longest`` seconds later.

    movies: (m, fi, ff), dat: (frame, tracking_dt); a step that is not known does not close a border.
    """
    begin = movies.select(F.col("fi").alias("frame")).distinct().join(dat.select("frame", "tracking_dt"), "frame", "left")
    begin = begin.where(F.coalesce(F.col("tracking_dt") <= longest, F.lit(True))).select("frame")
    return movies.select("m", (F.col("ff") + 1).alias("frame")).join(begin, "frame", "left_semi").select("m")


def border_links(ends: DataFrame, starts: DataFrame, blobs_before: DataFrame, blobs_after: DataFrame, blob_links: DataFrame, *, alone: float = 2.0, borders: DataFrame | None = None) -> DataFrame:
    """(m, parent, child) over the borders after movies m.

    ends, starts: (m, colony, tracklet, x, y); blobs_before, blobs_after: (m, colony, blob, x, y), of the last frame of m and the first one after it;
    blob_links: (m, colony, prev, cur) between these. borders: (m) of those that may be crossed (all, if None). Tables without rows give none.
    """
    sides = [t.withColumn("side", F.lit(k)) for k, t in enumerate((ends, starts))]
    spots = [t.withColumn("side", F.lit(k)) for k, t in enumerate((blobs_before, blobs_after))]
    need, blob = ("side", *AT, "tracklet", "x", "y"), ("side", *AT, "blob", "x", "y")
    tracks = sides[0].select(*need).unionByName(sides[1].select(*need))
    seen = spots[0].select(*blob).unionByName(spots[1].select(*blob))
    if borders is not None:
        tracks = tracks.join(borders.select("m").distinct(), "m", "left_semi")
    got = cut(assignments(tracks, seen, alone=alone, on=("side", *AT)))
    parent = got.where("side = 0").select(*AT, F.col("tracklet").alias("parent"), F.col("blob").alias("prev"))
    child = got.where("side = 1").select(*AT, F.col("tracklet").alias("child"), F.col("blob").alias("cur"))
    return parent.join(blob_links.select(*AT, "prev", "cur").distinct(), [*AT, "prev"]).join(child, [*AT, "cur"]).select("m", "parent", "child").distinct()
