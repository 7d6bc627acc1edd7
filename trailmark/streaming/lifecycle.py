"""Frame-ordered operators: time steps, links between frames, tracklet lifecycle; batch and streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmark.operators.blocks import BLOCK, dealt_out
from trailmark.operators.sampling import global_difference


def tracking_dt(dat: DataFrame, *, fps: float) -> DataFrame:
    """dat with tracking_dt: difference of timestamps, else dt, else 1 / fps. One row per frame of one recording."""
    d = global_difference(dat.withColumnRenamed("dt", "__dt"), "timestamp", "frame", BLOCK, order="frame")
    return d.withColumn("tracking_dt", F.coalesce("dt", "__dt", F.lit(1 / fps))).drop("dt").withColumnRenamed("__dt", "dt")


def drop_interrupted(dat: DataFrame, *, keep: bool = False) -> DataFrame:
    """Frames at which the recording was interrupted are not tracked, unless they are asked for."""
    return dat if keep else dat.where(F.coalesce(F.col("interrupt") != 1, F.lit(True)))


def link_clusters(members: DataFrame) -> DataFrame:
    """(frame, prev, cur) links of clusters with one blob of either frame; members: (frame, cluster, prev, cur)."""
    g = members.groupBy("frame", "cluster").agg(F.count_distinct("prev").alias("np"), F.count_distinct("cur").alias("nc"), F.min("prev").alias("prev"), F.min("cur").alias("cur"))
    return g.where("np = 1 and nc = 1").select("frame", "prev", "cur")


def link_single(candidates: DataFrame, ratio: float = 5.0) -> DataFrame:
    """One candidate per (frame, roi): the nearest if distances differ by more than ``ratio``, else the largest.

    candidates: (frame, roi, blob, dist, area)
    """
    g = candidates.groupBy("frame", "roi").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.min_by("blob", F.struct("dist", "blob")).alias("near"), F.max_by("blob", F.struct(F.col("area"), -F.col("blob"))).alias("large"))
    return g.select("frame", "roi", F.when(F.col("hi") > ratio * F.col("lo"), F.col("near")).otherwise(F.col("large")).alias("blob"))


LINKING = {"clusters": link_clusters, "single": link_single}


def link(frames: DataFrame, how: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between frames by a strategy of LINKING, or by any function of the frames' candidates."""
    return (LINKING[how] if isinstance(how, str) else how)(frames)


def continuations(links: DataFrame) -> DataFrame:
    """Links whose source has no other link out and whose target has no other link in."""
    return links.withColumns({"__o": F.count(F.lit(1)).over(Window.partitionBy("src")), "__i": F.count(F.lit(1)).over(Window.partitionBy("dst"))}).where("__o = 1 and __i = 1").drop("__o", "__i")


LIFE_OUT = "movie long, tracklet long, fi long, ff long, n long"
LIFE_STATE = "last long, serial long, open string"


def lifecycle_step(frames: pd.DataFrame, state: dict, *, most: int, max_gap: int) -> tuple[list[tuple[int, int, int, int]], dict]:
    """Advance one movie by its next blobs (frame, blob, track), sorted by frame.

    ``track`` says which chain a blob continues. A tracklet closes when its chain is missing for more than
    max_gap frames or has ``most`` rows. Returns closed tracklets (serial, fi, ff, n) and the new state.
    """
    open_, serial, out = state["open"], state["serial"], []
    for frame, group in frames.groupby("frame", sort=True):
        for track in sorted(group["track"]):
            cur = open_.get(track)
            if cur and (frame - cur[2] > max_gap or cur[3] >= most):
                out.append(tuple(cur))
                cur = None
            if cur is None:
                open_[track] = cur = [serial, int(frame), int(frame), 0]
                serial += 1
            cur[2], cur[3] = int(frame), cur[3] + 1
        gone = [t for t, c in open_.items() if frame - c[2] > max_gap]
        out += [tuple(open_.pop(t)) for t in sorted(gone)]
        state["last"] = int(frame)
    return out, {"last": state["last"], "serial": serial, "open": open_}


def stream_tracklets(blobs: DataFrame, *, most: int = 600, max_gap: int = 1, ts: str | None = None, late: str = "1 minute", silent_ms: int = 60_000) -> DataFrame:
    """Closed tracklets of a stream of blobs (movie, frame, track), one state per movie.

    Frames of a movie arrive in order (one camera writes them); the state holds its open tracklets only. With an
    event-time column ``ts``, a movie that is silent until the watermark has passed its last batch by silent_ms
    closes all of them; without one, tracklets close by the movie's later frames alone.
    """
    import json

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = {"last": 0, "serial": 0, "open": {}}
        if state.exists:
            last, serial, text = state.get
            now = {"last": last, "serial": serial, "open": {int(k): v for k, v in json.loads(text).items()}}
        if state.hasTimedOut:
            out = [tuple(v) for v in now["open"].values()]
            state.remove()
        else:
            rows = pd.concat(list(parts))
            out, now = lifecycle_step(rows, now, most=most, max_gap=max_gap)
            state.update((now["last"], now["serial"], json.dumps(now["open"])))
            if ts:
                newest = int(rows[ts].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + silent_ms)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["movie", "tracklet", "fi", "ff", "n"])

    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    stream = blobs.withWatermark(ts, late) if ts else blobs
    return stream.groupBy("movie").applyInPandasWithState(work, LIFE_OUT, LIFE_STATE, "append", timeout)


def batch_tracklets(blobs: DataFrame, *, most: int = 600, max_gap: int = 1, fps: float | None = None) -> DataFrame:
    """The same tracklets from a finished table, by windows in one order: (movie, track, fi, ff, n).

    With fps, a frame that came more than 2.5 * fps after the one before (column dt) begins a new tracklet, as the published
    rule has it; with a column boundary, so does a change of state at the open boundary.
    """
    w = Window.partitionBy("movie", "track").orderBy("frame")
    begins = F.col("frame") - F.lag("frame").over(w) > max_gap
    if fps is not None:
        begins = begins | F.coalesce(F.col("dt") > 2.5 * fps, F.lit(False))
    if "boundary" in blobs.columns:
        begins = begins | (F.lag(F.lit(1)).over(w).isNotNull() & ~F.col("boundary").eqNullSafe(F.lag("boundary").over(w)))
    d = dealt_out(blobs, "movie", "track").withColumns({"begins": F.coalesce(begins, F.lit(True)), "row": F.row_number().over(w), "rank": F.rank().over(w)})
    # a run is named by its first row; all rows of a frame belong to one run
    d = d.withColumn("run", F.max(F.when(F.col("begins"), F.col("rank"))).over(w))
    d = d.withColumn("part", F.floor((F.col("row") - F.col("run")) / most))
    return d.groupBy("movie", "track", "run", "part").agg(F.min("frame").alias("fi"), F.max("frame").alias("ff"), F.count(F.lit(1)).alias("n")).drop("run", "part")


def windowed_counts(events: DataFrame, *, late: str, width: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts and sums per event-time window behind a watermark; works on streams and tables."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(frame, by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), by, "n", "total")


def sessions(events: DataFrame, *, late: str, gap: str, by: str = "user_id") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), by, "n")


def for_each_movie(stream: DataFrame, commands: list) -> object:
    """A writer that runs each of ``commands`` (functions of a DataFrame) on every finished batch."""

    def run(batch: DataFrame, _: int) -> None:
        for c in commands:
            c(batch)

    return stream.writeStream.foreachBatch(run)
