"""Operators on tagged trajectories: long tables (ant, frame, x, y, ...), one row per position."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trailmark.model import wrap
from trailmark.operators.blocks import block_of, in_block, known_neighbours, own_rows, running_count, with_halo


def by_frame(*key: str) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("frame")


def densify(xy: DataFrame, frames: DataFrame, ants: DataFrame | None = None) -> DataFrame:
    """A row for every frame and ant; positions that were not recorded are NULL.

    The ants are a dimension: as many rows as there are individuals, checked by Spark's own
    size estimate before it is sent to all tasks.
    """
    who = ants if ants is not None else xy.select("ant").distinct()
    grid = frames.join(who)
    rest = [c for c in xy.columns if c not in frames.columns and c != "ant"]
    return grid.join(xy.select("ant", "frame", *rest), ["ant", "frame"], "left")


def step_speed(dense: DataFrame, *, key: Sequence[str] = ("ant",), fps: float = 1.0, name: str = "v") -> DataFrame:
    """Distance moved since the frame before, times fps; dense has a row per key and frame."""
    w = in_block(*key)
    d = with_halo(dense, 1, 0)
    return own_rows(d.withColumn(name, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * fps))


def filter_jumps(dense: DataFrame, dmax: float) -> DataFrame:
    """Positions reached by a step longer than dmax become NULL; an unknown step removes nothing."""
    d = step_speed(dense, name="__d")
    far = F.coalesce(F.col("__d") > dmax, F.lit(False))
    return d.withColumns({c: F.when(~far, F.col(c)) for c in ("x", "y")}).drop("__d")


def interpolate(dense: DataFrame, columns: Sequence[str] = ("x", "y"), *, key: Sequence[str] = ("ant",), ends: str = "null") -> DataFrame:
    """Fill missing values on the line between their known neighbours.

    ends: ``null`` leaves what has no neighbour on one side, ``clamp`` repeats the nearest value.
    """
    out = {}
    for c in columns:
        (v0, f0), (v1, f1) = ((F.col(f"__{c}{k}")["v"], F.col(f"__{c}{k}")["frame"]) for k in (0, 1))
        line = F.when(f1 == f0, v0).otherwise(v0 + (v1 - v0) * (F.col("frame") - f0) / (f1 - f0))
        out[c] = F.coalesce(line, v0, v1) if ends == "clamp" else line
    return known_neighbours(dense, columns, key).withColumns(out).select(*dense.columns)


def interpolate_gaps(dense: DataFrame, *, max_frames: int = 300, max_distance: float = 0.01, key: Sequence[str] = ("ant",), mark: int = 5) -> DataFrame:
    """Fill gaps of at most max_frames rows across which the ant moved at most max_distance; filled rows get ass_type ``mark``."""
    d = known_neighbours(dense, ["x", "y"], key)
    v = {f"{c}{k}": F.col(f"__{c}{k}")["v"] for c in "xy" for k in (0, 1)}
    f0, f1 = F.col("__x0")["frame"], F.col("__x1")["frame"]
    gap = F.col("x").isNull() & (f1 - f0 - 1 <= max_frames) & (F.hypot(v["x1"] - v["x0"], v["y1"] - v["y0"]) <= max_distance)
    part = (F.col("frame") - f0) / (f1 - f0)
    d = d.withColumn("__gap", F.coalesce(gap, F.lit(False)))
    filled = {c: F.when(F.col("__gap"), v[f"{c}0"] + (v[f"{c}1"] - v[f"{c}0"]) * part).otherwise(F.col(c)) for c in "xy"}
    return d.withColumns(filled | {"ass_type": F.when(F.col("__gap"), mark).otherwise(F.col("ass_type"))}).select(*dense.columns)


def fill_gaps(rows: DataFrame, *, max_frames: int = 300, max_distance: float = 0.01, key: Sequence[str] = ("ant",), mark: int = 5, block: int | None = None) -> DataFrame:
    """``interpolate_gaps`` for rows of known places alone, without the frames of longer gaps: what is filled is added to the rows, with nulls in other columns.

    With block, the last of the key is ``__b``, a block of frames that also has the rows up to max_frames + 1 frames ahead of it; these are not returned.
    """
    w = Window.partitionBy(*key).orderBy("frame")
    d = rows.withColumn("__p", F.lag(F.struct("frame", "x", "y")).over(w))
    if block is not None:
        d = d.where(F.col("__b") == block_of("frame", block))
    f0, f1 = F.col("__p.frame"), F.col("frame")
    gap = (f1 - f0 - 1 <= max_frames) & (F.hypot(F.col("x") - F.col("__p.x"), F.col("y") - F.col("__p.y")) <= max_distance)
    d = d.withColumn("__f", F.explode(F.sequence(F.when(gap, f0 + 1).otherwise(f1), f1)))
    own, part = F.col("__f") == f1, (F.col("__f") - f0) / (f1 - f0)
    filled = {c: F.when(own, F.col(c)).otherwise(F.col(f"__p.{c}") + (F.col(c) - F.col(f"__p.{c}")) * part) for c in "xy"} | {"ass_type": F.when(own, F.col("ass_type")).otherwise(mark), "frame": F.col("__f")}
    return d.select(*[(F.col(c) if c in key else filled.get(c, F.when(own, F.col(c)))).alias(c) for c in rows.columns if c != "__b"])


def nest(dense: DataFrame) -> DataFrame:
    """(frame, nest_x, nest_y): median over the ants of their positions, gaps inside filled."""
    return interpolate(dense).groupBy("frame").agg(F.percentile("x", 0.5).alias("nest_x"), F.percentile("y", 0.5).alias("nest_y"))


def rolling(column: str, w: WindowSpec, before: int, after: int, how: str = "mean") -> Column:
    """A moving mean or median that is NULL unless all values of its window are present."""
    over = w.rowsBetween(-before, after)
    value = F.avg(column) if how == "mean" else F.percentile(column, 0.5)
    return F.when(F.count(column).over(over) == before + after + 1, value.over(over))


def smooth_by_movie(frames: DataFrame, columns: Sequence[str], window: int) -> DataFrame:
    """Centred moving medians with NULL at the edges, of a row per frame; windows up to about 200 rows, see kernels for longer ones."""
    half = window // 2
    after = window - 1 - half
    d = with_halo(frames, half, after)
    return own_rows(d.withColumns({f"{c}_s": rolling(c, in_block(), half, after, "median") for c in columns}))


def outside(dense: DataFrame, nests: DataFrame, radius: float) -> DataFrame:
    """dense with its distance d from the nest and outside (a missing position is not outside)."""
    d = dense.join(nests, "frame", "left").withColumn("d", F.hypot(F.col("x") - F.col("nest_x"), F.col("y") - F.col("nest_y")))
    return d.withColumn("outside", F.coalesce(F.col("d") > radius, F.lit(False)))


def nest_valid(out: DataFrame, most: float = 0.5) -> DataFrame:
    """(frame, fracout, valid): a nest counts while at most a share ``most`` of all ants is outside."""
    f = out.groupBy("frame").agg(F.avg(F.col("outside").cast("double")).alias("fracout"))
    return f.withColumn("valid", F.col("fracout") <= most)


def pair_distances(out: DataFrame) -> DataFrame:
    """(frame, a, b, dist, out_a, out_b) for all ordered pairs of different ants seen in a frame.

    A frame holds as many rows as there are ants, so the self join per frame stays small.
    """
    seen = out.where("x is not null")
    side = lambda s: seen.select("frame", F.col("ant").alias(s), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"), F.col("outside").alias(f"out_{s}"))
    p = side("a").join(side("b"), "frame").where("a <> b")
    return p.select("frame", "a", "b", F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")).alias("dist"), "out_a", "out_b")


def interacting(out: DataFrame, thresh: float) -> DataFrame:
    """(frame, ant, nearest, interacting): an outside ant whose nearest other ant is closer than thresh."""
    near = pair_distances(out).groupBy("frame", F.col("a").alias("ant")).agg(F.min("dist").alias("nearest"))
    d = out.select("frame", "ant", "outside").join(near, ["frame", "ant"], "left")
    return d.select("frame", "ant", "nearest", F.coalesce(F.col("outside") & (F.col("nearest") < thresh), F.lit(False)).alias("interacting"))


def interaction_matrix(out: DataFrame, thresh: float) -> DataFrame:
    """(a, b, share): share of the frames with both outside in which the two are closer than thresh."""
    p = pair_distances(out).where("out_a and out_b")
    return p.groupBy("a", "b").agg(F.avg((F.col("dist") < thresh).cast("double")).alias("share"), F.count(F.lit(1)).alias("frames"))


def path_length(dense: DataFrame) -> DataFrame:
    return step_speed(dense).groupBy("ant").agg(F.sum("v").alias("path"))


def stops(moving: DataFrame, window: int, vthresh: float) -> DataFrame:
    """moving (ant, frame, v, outside) with stop: slow over the trailing window, counted only outside."""
    d = with_halo(moving.withColumn("vo", F.col("v") * F.col("outside").cast("double")), window - 1, 0)
    mean = rolling("vo", in_block("ant"), window - 1, 0)
    return own_rows(d.withColumn("stop", F.coalesce((mean < vthresh) & F.col("outside"), F.lit(False)))).drop("vo")


def gradient(column: str, w: WindowSpec) -> Column:
    """Central differences, one-sided at both ends of the sequence."""
    before, here, after = F.lag(column).over(w), F.col(column), F.lead(column).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first & last, F.lit(None)).when(first, after - here).when(last, here - before).otherwise((after - before) / 2)


def gradients(dense: DataFrame, columns: dict[str, str], *, key: Sequence[str] = ("ant",)) -> DataFrame:
    """dense with the gradients of columns, new name -> column, along the frames of each key."""
    w = in_block(*key)
    return own_rows(with_halo(dense, 1, 1).withColumns({n: gradient(c, w) for n, c in columns.items()}))


def kinematics(dense: DataFrame, *, dt: float = 1.0, key: Sequence[str] = ("ant",), per_second: bool = False) -> DataFrame:
    """dense with v, a, an (normal acceleration) and curvature.

    The derivatives are multiplied by dt, as in the published analysis; per_second divides instead. A block looks two
    rows to either side: of the inner one it needs the central difference.
    """
    w, s = in_block(*key), 1 / dt if per_second else dt
    d = with_halo(dense, 2, 2).withColumns({"vx": gradient("x", w) * s, "vy": gradient("y", w) * s})
    d = d.withColumn("v", F.hypot("vx", "vy")).withColumns({"ax": gradient("vx", w) * s, "ay": gradient("vy", w) * s, "a": gradient("v", w) * s})
    cross = F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax")
    d = d.withColumns({"an": F.try_divide(cross, F.col("v")), "curvature": F.try_divide(cross, F.pow("v", F.lit(3.0)))}).drop("vx", "vy", "ax", "ay")
    return own_rows(d)


def segments(df: DataFrame, column: str, *, key: Sequence[str] = ("ant",)) -> DataFrame:
    """Runs of one value over a row per frame: (key..., value, start, stop, length); missing values are a value of their own."""
    w = in_block(*key)
    new = F.lag(F.lit(1)).over(w).isNull() | ~F.col(column).eqNullSafe(F.lag(column).over(w))
    d = own_rows(with_halo(df, 1, 0).withColumn("__new", new))
    d = running_count(d, F.col("__new"), "__run", key)
    g = d.groupBy(*key, "__run").agg(F.first(column).alias("value"), F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count(F.lit(1)).alias("length"))
    return g.drop("__run")


def onsets(df: DataFrame, condition: Column, *, key: Sequence[str] = ()) -> DataFrame:
    """df, a row per frame, with edge: +1 on the row where the condition begins, -1 where it has ended, else 0."""
    d = with_halo(df.withColumn("__c", F.coalesce(condition, F.lit(False)).cast("int")), 1, 0)
    return own_rows(d.withColumn("edge", F.coalesce(F.col("__c") - F.lag("__c").over(in_block(*key)), F.lit(0)))).drop("__c")


def angle_to(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction from 1 to 2, measured from the y axis."""
    return F.atan2(x2 - x1, y2 - y1)


def antenna_power(pose: DataFrame, window: int) -> DataFrame:
    """pose (ant, frame, a1, a2: antenna angles) with the moving mean of squared angle changes and their coherence."""
    w, half = in_block("ant"), window // 2
    d = with_halo(pose, half + 1, half).withColumns({f"d{i}": wrap(F.col(f"a{i}") - F.lag(f"a{i}").over(w)) for i in (1, 2)})
    d = d.withColumns({"p1": F.col("d1") * F.col("d1"), "p2": F.col("d2") * F.col("d2"), "p12": F.col("d1") * F.col("d2")})
    d = d.withColumns({c: rolling(c, w, half, window - 1 - half) for c in ("p1", "p2", "p12")})
    d = own_rows(d)
    return d.select("ant", "frame", (F.col("p1") + F.col("p2")).alias("power"), F.try_divide(F.col("p12"), F.sqrt(F.col("p1") * F.col("p2"))).alias("coherence"))


def heatmap(xy: DataFrame, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 100) -> DataFrame:
    """(ant, bx, by, n): a two-dimensional histogram; bins count from 1, the upper edge belongs to the last."""
    cell = lambda c, r: F.least(F.floor((c - r[0]) * (bins / (r[1] - r[0]))).cast("long") + 1, F.lit(bins).cast("long"))
    d = xy.where(F.col("x").between(*x_range) & F.col("y").between(*y_range))
    return d.groupBy("ant", cell(F.col("x"), x_range).alias("bx"), cell(F.col("y"), y_range).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def event_windows(series: DataFrame, starts: DataFrame, columns: Sequence[str], *, before: int, after: int, within: int, fps: float = 10.0) -> DataFrame:
    """Per onset: traces over [onset-before, onset+after) and, over [onset, onset+within), max, mean, last value and rise time.

    The rise time is the first offset at which a value exceeds max * (1 - 1/e), over fps. Onsets are few, so
    the range join is an equi join on blocks of frames.
    """
    size = before + after
    s = series.withColumn("__b", F.floor(F.col("frame") / size).cast("long"))
    lo, hi = F.col("onset") - before, F.col("onset") + after - 1
    o = starts.select("onset", F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))).alias("__b"))
    d = s.join(o, "__b").where((F.col("frame") >= lo) & (F.col("frame") <= hi)).withColumn("off", F.col("frame") - F.col("onset"))
    near = F.col("off").between(0, within - 1)
    aggs = []
    for c in columns:
        v = F.when(near, F.col(c))
        aggs += [
            F.array_sort(F.collect_list(F.struct(F.col("off"), F.col(c).alias("v")))).alias(f"{c}_t"),
            F.max(v).alias(f"{c}_max"),
            F.when(F.count(v) == F.count_if(near), F.avg(v)).alias(f"{c}_mean"),
            F.max_by(v, F.when(near, F.col("off"))).alias(f"{c}_end"),
        ]
    e = d.groupBy("onset").agg(*aggs)
    rise = 1 - 1 / math.e
    for c in columns:
        tau = F.array_min(F.transform(_late(c, within, rise), lambda x: x.off)) / fps
        e = e.withColumns({f"{c}_tau": tau, c: F.transform(f"{c}_t", lambda x: x.v)})
    return e.drop(*[f"{c}_t" for c in columns])


def _late(c: str, within: int, rise: float) -> Column:
    top = F.col(f"{c}_max")
    return F.filter(f"{c}_t", lambda x: (x.off >= 0) & (x.off < within) & (x.v > top * rise))
