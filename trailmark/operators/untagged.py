"""Collective measures of untagged tracklets: rows (tracklet, colony, frame, x, y, area, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.model import mean_all
from trailmark.operators.blocks import per_frame


def area_share(rows: DataFrame, n: float, key: Sequence[str] = ("frame",)) -> DataFrame:
    """rows with w, their share of the frame's area, nants = n * w, and the frame's total_area."""
    total = F.sum("area").over(Window.partitionBy(*key))
    return rows.withColumn("total_area", total).withColumn("w", F.try_divide("area", "total_area")).withColumn("nants", F.col("w") * n)


def weighted_medians(rows: DataFrame, values: Sequence[str], weight: str, key: Sequence[str], *more: Column) -> DataFrame:
    """(key..., med<value>..., more...) with aggregates more of the same rows: a value with more than half of the weight wins;
    else the value at which the running weight passes the middle, or the mean of the two around it if the middle is met exactly.
    Rows without value or weight do not count. All values are found in rows that are sent once.
    """
    p, d, aggregates, picks = Window.partitionBy(*key), rows, [], []
    for c in values:
        v, s, cum, half, after, best, m = (f"__{n}_{c}" for n in ("v", "s", "cum", "half", "after", "best", "m"))
        known = F.col(c).isNotNull() & F.col(weight).isNotNull()
        d = d.withColumns({v: F.when(known, F.col(c)), s: F.when(known, F.col(weight))})
        w = p.orderBy(F.asc_nulls_last(v), F.asc_nulls_last(s))
        d = d.withColumns({cum: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, 0)), half: F.sum(s).over(p) / 2, after: F.lead(v).over(w)})
        # the last row whose running weight does not pass the middle names the two candidates
        at = known & (F.col(cum) <= F.col(half))
        aggregates += [
            F.struct(F.max_by(v, s).alias("top"), F.max(s).alias("most"), F.first(half).alias("half"), F.min(v).alias("low")).alias(best),
            F.max(F.when(at, F.struct(F.col(cum).alias("cum"), F.col(v).alias("v"), F.col(after).alias("n")))).alias(m),
        ]
        b, x = (lambda n, best=best: F.col(f"{best}.{n}")), (lambda n, m=m: F.col(f"{m}.{n}"))
        meet = F.when(x("cum") == b("half"), (x("v") + F.coalesce(x("n"), x("v"))) / 2).otherwise(x("n"))
        picks.append(F.when(b("most") > b("half"), b("top")).when(F.col(m).isNull(), b("low")).otherwise(meet).alias(f"med{c}"))
    g = d.groupBy(*key).agg(*aggregates, *more)
    return g.select(*key, *picks, *[c for c in g.columns if c not in key and not c.startswith(("__best_", "__m_"))])


def weighted_median(rows: DataFrame, value: str, weight: str, key: Sequence[str]) -> DataFrame:
    """(key..., median) of keys with a known value and weight, see ``weighted_medians``."""
    d = rows.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return weighted_medians(d, [value], weight, key).withColumnRenamed(f"med{value}", "median")


def weighted_mean(rows: DataFrame, value: str, weight: str, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("mean"))


def nest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., medx, medy, total_area, majmax): weighted medians of the positions by area."""
    return weighted_medians(rows, ["x", "y"], "area", key, F.sum("area").alias("total_area"), F.max("majax").alias("majmax"))


def velocity(rows: DataFrame, fps: float = 10.0) -> DataFrame:
    """rows with v inside each tracklet."""
    w = Window.partitionBy("tracklet").orderBy("frame")
    return rows.withColumn("v", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * fps)


def collective_measures(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., nout, fracout, vout) from rows with nants, w, v, outside, single.

    nout and fracout add up over tracklets outside and are 0 when there are none; vout is the mean speed of single
    tracklets outside, 0 with nobody outside, and NULL if there are no such singles or any of them has no speed.
    """
    out, lone = F.col("outside"), F.col("outside") & F.col("single")
    g = rows.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(out, F.col("nants"))), F.lit(0.0)).alias("nout"),
        F.coalesce(F.sum(F.when(out, F.col("w"))), F.lit(0.0)).alias("fracout"),
        F.when(~F.bool_or(out), 0.0).when(F.count_if(lone) == F.count(F.when(lone, F.col("v"))), F.avg(F.when(lone, F.col("v")))).alias("vout"),
    )
    return g


def row_mean(*columns: str):
    """The mean of the values present in several columns of a row."""
    there = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def zscore(df: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """df with z: population standard score inside each group; groups are added up before the shuffle, and their two numbers joined back."""
    names = [f"__k{i}" for i in range(len(key))]
    g = df.groupBy(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)]).agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__sd"))
    on = F.lit(True)
    for c, n in zip(key, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return df.join(g, on).withColumn("z", F.try_divide(F.col(column) - F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd", *names)


def merge_movies(rows: DataFrame, movies: DataFrame) -> DataFrame:
    """rows (m, mf, ...) of several movies on one absolute frame axis."""
    return rows.join(F.broadcast(movies.select("m", F.col("fi").alias("__fi"))), "m").withColumn("frame", F.col("__fi") + F.col("mf") - 1).drop("__fi")


def symmetric_kl(hist: DataFrame, key: str) -> DataFrame:
    """(a, b, dkl) for all pairs a < b of normalised histograms (key, bin, n), over the bins that both fill.

    The join is on bins; the keys are individuals or states, of which there are few.
    """
    p = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    a, b = (p.select("bin", F.col(key).alias(s), F.col("p").alias(f"p{s}")) for s in ("a", "b"))
    j = a.join(b, "bin").where("a < b and pa > 0 and pb > 0")
    return j.groupBy("a", "b").agg((F.sum((F.col("pa") - F.col("pb")) * F.log(F.col("pa") / F.col("pb"))) / 2).alias("dkl"))


def relative_bins(values: DataFrame, edges: Sequence[float], column: str = "value") -> DataFrame:
    """values with bin (0-based) and the fraction of the way through it; outside all bins NULL."""
    e = sorted(edges)
    rows: list = [F.when((F.col(column) >= a) & (F.col(column) < b), F.struct(F.lit(i).alias("bin"), ((F.col(column) - a) / (b - a)).alias("fraction"))) for i, (a, b) in enumerate(zip(e[:-1], e[1:], strict=True))]
    return values.withColumn("__r", F.coalesce(*rows)).select(*values.columns, "__r.bin", "__r.fraction")


def derivative_features(rows: DataFrame, features: Sequence[str], key: Sequence[str] = ("tracklet",)) -> DataFrame:
    """rows with d<feature>: change per dt inside each tracklet, or each piece of one with a key of more columns."""
    w = Window.partitionBy(*key).orderBy("frame")
    return rows.withColumns({f"d{c}": (F.col(c) - F.lag(c).over(w)) / F.col("dt") for c in features})


def arena_features(rows: DataFrame, grid: DataFrame, *, cell: float, centre: tuple[float, float], scale: float, key: Sequence[str], dealt: bool = False) -> DataFrame:
    """rows (tracklet, x, y, theta, area) with area in real units and dist_ and angle_ to the centre, the wall, the open wall and the frame's median.

    grid (cx, cy, wall, wall_angle, openwall, openwall_angle) holds the arena's distances per cell, a picture's number of rows;
    angles are theta less the direction. Rows outside the grid have no distance to walls. Rows are dealt out by frame once for the
    median, and by tracklet before features are worked out, so that no shuffle carries these; ``derivative_features`` needs no other.
    With ``dealt``, a task holds all rows of a frame already, as those of ``blocks.pieces``, and none is sent.
    """
    frame = Window.partitionBy(*key)
    d = rows if dealt else rows.repartition(*key)
    d = d.withColumns({"__mx": F.percentile("x", 0.5).over(frame), "__my": F.percentile("y", 0.5).over(frame)})
    d = d if dealt else d.repartition("tracklet")
    d = d.withColumns({"__cx": F.floor(F.col("x") / cell).cast("long"), "__cy": F.floor(F.col("y") / cell).cast("long")})
    d = d.join(grid.withColumnsRenamed({"cx": "__cx", "cy": "__cy"}), ["__cx", "__cy"], "left")
    to = lambda x, y: {"dist": scale * F.hypot(F.col("x") - x, F.col("y") - y), "angle": F.col("theta") - F.atan2(F.col("y") - y, F.col("x") - x)}
    out = {f"{k}_{n}": c for n, (x, y) in (("center", (F.lit(centre[0]), F.lit(centre[1]))), ("median", (F.col("__mx"), F.col("__my")))) for k, c in to(x, y).items()}
    out |= {f"dist_{w}": scale * F.col(w) for w in ("wall", "openwall")} | {f"angle_{w}": F.col("theta") - F.col(f"{w}_angle") for w in ("wall", "openwall")}
    return d.withColumns(out | {"area": F.col("area") * (scale * scale)}).drop("__cx", "__cy", "__mx", "__my", "wall", "wall_angle", "openwall", "openwall_angle")


def blob_mates(rows: DataFrame, *, near: float, scale: float, key: Sequence[str]) -> DataFrame:
    """rows with n_in_blob, those of the frame closer than ``near`` (itself included), and frac_in_blob, their share of the frame.

    Rows are dealt out by frame once. A row also stands in the cells, four times as wide as ``near``, that it is near to, so it
    meets those of its own cell only.
    """
    reach = near / scale * (1 + 1e-9)
    cell = lambda x: F.floor(x / (4 * reach)).cast("long")
    near_to = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))
    d = rows.repartition(*key).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    placed = d.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    placed = placed.withColumn("__cx", near_to("x")).withColumn("__cy", near_to("y"))
    placed = placed.withColumn("__seen", F.collect_list(F.struct("x", "y")).over(Window.partitionBy(*key, "__cx", "__cy")))
    mates = F.filter("__seen", lambda p: scale * F.hypot(F.col("x") - p["x"], F.col("y") - p["y"]) < near)
    placed = placed.where((F.col("__cx") == cell(F.col("x"))) & (F.col("__cy") == cell(F.col("y")))).withColumn("n_in_blob", F.size(mates).cast("long"))
    lost = d.where(F.col("x").isNull() | F.col("y").isNull()).withColumn("n_in_blob", F.lit(0).cast("long"))
    out = placed.drop("__cx", "__cy", "__seen").unionByName(lost)
    return out.withColumn("frac_in_blob", F.col("n_in_blob") / F.col("__all")).drop("__all")


def at_frames(dat: DataFrame, points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """points with columns of the frame data at their frame; missing where there is none."""
    return points.join(dat.select("frame", *columns), "frame", "left")


def by_movie(dat: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame data with the movie and movie frame of frames (frame, m, mf)."""
    return frames.join(dat, "frame")
