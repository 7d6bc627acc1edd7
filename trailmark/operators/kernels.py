"""Numerical kernels that column expressions cannot say, run per group or per batch by Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.blocks import by_tracklet


def centred_median(x: np.ndarray, k: int, edge: str) -> np.ndarray:
    """Centred moving median over k values (odd). edge: ``null`` leaves the ends empty, ``zero`` pads with
    zeros, ``shrink`` uses the part of the window that exists and skips missing values."""
    s, half = pd.Series(x, dtype=float), k // 2
    if edge == "zero":
        padded = pd.concat([pd.Series(np.zeros(half)), s, pd.Series(np.zeros(half))], ignore_index=True)
        return padded.rolling(k, center=True).median().to_numpy()[half : half + len(s)]
    return s.rolling(k, center=True, min_periods=k if edge == "null" else 1).median().to_numpy()


def median_filter(df: DataFrame, column: str, k: int, *, key: Sequence[str], edge: str = "null", block: int = 20_000) -> DataFrame:
    """df (key..., frame dense from its first row) with ``<column>_med``.

    The sequence is cut into blocks; each block also gets the k // 2 rows on either side, so a task holds
    block + k rows however long the recording is.
    """
    if k % 2 == 0:
        raise ValueError("the window must be odd")
    half, keys = k // 2, list(key)
    ends = df.groupBy(*keys).agg(F.min("frame").alias("__lo"), F.max("frame").alias("__hi"))
    d = df.select(*keys, "frame", column).join(ends, keys)
    near = F.sequence(F.floor((F.col("frame") - half) / block).cast("long"), F.floor((F.col("frame") + half) / block).cast("long"))
    d = d.withColumn("__b", F.explode(near))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def work(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        lo, hi, b = p["__lo"].iloc[0], p["__hi"].iloc[0], p["__b"].iloc[0]
        first, last = max(lo, b * block), min(hi, (b + 1) * block - 1)
        x, f = p[column].to_numpy(float), p["frame"].to_numpy()
        med = centred_median(x, k, edge)
        mine = (f >= first) & (f <= last)
        out = p.loc[mine, [*keys, "frame"]]
        out[f"{column}_med"] = med[mine]
        return out

    med = d.groupBy(*keys, "__b").applyInPandas(work, f"{kinds}, frame long, {column}_med double")
    med = med.withColumn(f"{column}_med", F.when(~F.isnan(f"{column}_med"), F.col(f"{column}_med")))
    return df.join(med, [*keys, "frame"], "left")


@dataclass(frozen=True)
class HeadCosts:
    """Fixed values of the head's cost: turning weighs between e_min and e_max by eccentricity, moving off the head's direction up to w_max by
    speed and nothing above v_max; both weights are sigmoids about a centre."""

    v_max: float = 0.008
    w_max: float = 0.25
    v_width: float = 0.0005
    v_centre: float = 0.003
    e_max: float = 0.7
    e_min: float = 0.01
    e_centre: float = 0.7
    e_width: float = 0.025

    def moving(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.where(v <= self.v_max, self.w_max / (1 + np.exp(-(v - self.v_centre) / self.v_width)), 0.0)

    def turning(self, e: np.ndarray) -> np.ndarray:
        return (self.e_max - self.e_min) / (1 + np.exp(-(e - self.e_centre) / self.e_width)) + self.e_min


def fix_orientation(orient: np.ndarray, eccentricity: np.ndarray, speed: np.ndarray, move: np.ndarray, costs: HeadCosts | None = None) -> np.ndarray:
    """An axis has two heads: per frame orient or orient + pi, by the cheapest sequence of turns from the frame before and of
    distances from the direction of motion towards the frame (speed and move of a row are those of the step that leads to it).

    Differences are taken as they are, without wrapping; an unknown cost counts as none, a tie keeps the unturned head.
    """
    n, costs = len(orient), costs or HeadCosts()
    if n == 0:
        return orient
    both = np.stack([orient, orient + math.pi], axis=1)
    local = np.nan_to_num(costs.moving(speed)[:, None] * np.abs(both - move[:, None]))
    turn = np.nan_to_num(costs.turning(eccentricity))
    cost, came = np.zeros(2), np.zeros((n, 2), np.int8)
    for t in range(1, n):
        step = turn[t] * np.abs(both[t][None, :] - both[t - 1][:, None]) + cost[:, None]
        came[t] = step.argmin(axis=0)
        cost = step.min(axis=0) + local[t]
    k, out = int(cost.argmin()), np.empty(n)
    for t in range(n - 1, -1, -1):
        out[t] = both[t, k]
        k = came[t, k]
    return (out + math.pi) % (2 * math.pi) - math.pi


def fix_orientation_many(orient: np.ndarray, eccentricity: np.ndarray, speed: np.ndarray, move: np.ndarray, first: np.ndarray, costs: HeadCosts | None = None) -> np.ndarray:
    """``fix_orientation`` of many sequences one after another, each beginning at its number in ``first``; a step is taken in all of them at once."""
    n, costs = len(orient), costs or HeadCosts()
    if n == 0:
        return orient
    length = np.diff(np.r_[first, n])
    longest = np.argsort(-length, kind="stable")
    at, size = first[longest], length[longest]
    both = np.stack([orient, orient + math.pi], axis=1)
    local = np.nan_to_num(costs.moving(speed)[:, None] * np.abs(both - move[:, None]))
    turn = np.nan_to_num(costs.turning(eccentricity))
    cost, came = np.zeros((len(at), 2)), np.zeros((n, 2), np.int8)
    going = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # sequences of that many rows and more
    for t in range(1, size[0]):
        rows = at[: going[t]] + t
        step = turn[rows, None, None] * np.abs(both[rows][:, None, :] - both[rows - 1][:, :, None]) + cost[: going[t], :, None]
        came[rows] = step.argmin(axis=1)
        cost[: going[t]] = step.min(axis=1) + local[rows]
    k, out = cost.argmin(axis=1), np.empty(n)
    for t in range(size[0] - 1, -1, -1):
        rows, head = at[: going[t]] + t, k[: going[t]]
        out[rows] = both[rows, head]
        k[: going[t]] = came[rows, head]
    return (out + math.pi) % (2 * math.pi) - math.pi


def fix_orientations(rows: DataFrame, costs: HeadCosts | None = None) -> DataFrame:
    """(tracklet, frame, orient) for rows (tracklet, frame, x, y, orient, eccentricity, dt); a tracklet has a bounded number of rows.

    A task reads its tracklets in order and works on all that a batch completes; the last one waits for the next batch.
    """

    def work(p: pd.DataFrame) -> pd.DataFrame:
        first = np.flatnonzero(np.r_[True, p["tracklet"].to_numpy()[1:] != p["tracklet"].to_numpy()[:-1]])
        vx, vy = (np.r_[np.nan, np.diff(p[c].to_numpy(float))] / p["dt"].to_numpy(float) for c in ("x", "y"))
        vx[first] = vy[first] = np.nan
        fixed = fix_orientation_many(p["orient"].to_numpy(float), p["eccentricity"].to_numpy(float), np.hypot(vx, vy), np.arctan2(vy, vx), first, costs)
        return pd.DataFrame({"tracklet": p["tracklet"].to_numpy(), "frame": p["frame"].to_numpy(), "orient": fixed})

    def whole_tracklets(parts):
        held = []
        for p in parts:
            if not len(p):
                continue
            last = p["tracklet"].to_numpy() == p["tracklet"].iloc[-1]
            if not last.all():
                yield work(pd.concat([*held, p[~last]], ignore_index=True))
                held = [p[last]]
            elif held and held[0]["tracklet"].iloc[0] != p["tracklet"].iloc[0]:
                yield work(pd.concat(held, ignore_index=True))
                held = [p]
            else:
                held.append(p)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    none = F.lit(-(2**63))  # rows without a tracklet stay together, and numbers whole
    d = rows.select(F.coalesce("tracklet", none).alias("tracklet"), "frame", "x", "y", "orient", "eccentricity", "dt")
    d = d.repartition("tracklet").sortWithinPartitions("tracklet", "frame").mapInPandas(whole_tracklets, "tracklet long, frame long, orient double")
    return d.withColumn("tracklet", F.nullif("tracklet", none))


def dyadic_periods(n: int, shortest: float, longest: float) -> np.ndarray:
    return shortest * 2 ** (np.arange(n) * math.log2(longest / shortest) / (n - 1))


def morlet(x: np.ndarray, scales: np.ndarray, w0: float = 5.0) -> np.ndarray:
    """Absolute Morlet coefficients, scales x time, by products in the frequency domain."""
    n = len(x)
    omega = 2 * math.pi * np.fft.fftfreq(n)
    spectrum = np.fft.fft(x - x.mean())
    out = np.empty((len(scales), n))
    for i, s in enumerate(scales):
        bank = math.pi**-0.25 * math.sqrt(2 * s) * np.exp(-0.5 * (s * omega - w0) ** 2) * (omega > 0)
        out[i] = np.abs(np.fft.ifft(spectrum * bank))
    return out


def wavelets(rows: DataFrame, column: str, *, key: str = "ant", n_scales: int = 25, longest: float = 50.0) -> DataFrame:
    """(key, frame, w: array of n_scales) from the z-scored column of each individual; missing values count as 0."""
    scales = dyadic_periods(n_scales, 1.0, longest)

    def work(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        x = p[column].to_numpy(float)
        sd = np.nanstd(x)
        z = np.nan_to_num((x - np.nanmean(x)) / sd) if sd > 0 else np.zeros(len(x))
        return pd.DataFrame({key: p[key].to_numpy(), "frame": p["frame"].to_numpy(), "w": list(morlet(z, scales).T)})

    return rows.select(key, "frame", column).groupBy(key).applyInPandas(work, f"{key} string, frame long, w array<double>")


def gram(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) of an array column: each task adds up the products of its rows, Spark adds up the tasks' sums.

    Rows without an array, or with a missing component, are left out; dim x dim sums come to the driver.
    """

    def work(parts):
        total = None
        for p in parts:
            x = np.stack([np.asarray(v, float) for v in p[column]]) if len(p) else np.zeros((0, 0))
            if not len(x):
                continue
            x = np.column_stack([np.ones(len(x)), x])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    full = rows.select(column).where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull()))
    got = full.mapInPandas(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    side = 1 + max((r["i"] for r in got), default=0)
    m = np.zeros((side, side))
    for r in got:
        m[r["i"], r["j"]] = r["s"]
    n = m[0, 0]
    mean = m[0, 1:] / n if n else m[0, 1:]
    return mean, m[1:, 1:] / max(n, 1) - np.outer(mean, mean), int(n)


def pca(rows: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k axes as rows, their variances); each axis points to its largest component."""
    mean, cov, _ = gram(rows, column)
    value, axis = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:k]
    axes = axis[:, order].T
    return mean, axes * np.sign(axes[np.arange(len(order)), np.abs(axes).argmax(axis=1)])[:, None], value[order]


def project(rows: DataFrame, column: str, mean: np.ndarray, axes: np.ndarray, name: str = "pc") -> DataFrame:
    """rows with the coordinates along the axes, as column expressions."""
    dot = lambda a: F.aggregate(F.transform(F.arrays_zip(F.col(column).alias("x"), F.lit([float(v) for v in a]).alias("a"), F.lit([float(v) for v in mean]).alias("m")), lambda z: (z["x"].cast("double") - z["m"]) * z["a"]), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn(name, F.array(*[dot(a) for a in axes]))


def nearest_by_kl(points: DataFrame, training: np.ndarray) -> DataFrame:
    """(id, best, kl) for points (id, p): the training distribution (rows of a bounded array) with least KL divergence."""
    t = training / training.sum(axis=1, keepdims=True)
    logs = np.log(t)

    def work(parts):
        for p in parts:
            x = np.stack(p["p"].to_numpy())
            x = x / x.sum(axis=1, keepdims=True)
            kl = (x * np.log(x)).sum(axis=1)[:, None] - x @ logs.T
            yield pd.DataFrame({"id": p["id"].to_numpy(), "best": kl.argmin(axis=1), "kl": kl.min(axis=1)})

    return points.select("id", "p").mapInPandas(work, "id long, best long, kl double")


def fit_ellipse(points: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, a, b, theta) of the conic a x2 + b xy + c y2 + d x + e y = 1 with least squares.

    Spark adds up the products of each group; the 5 x 5 systems are solved in batches of groups.
    """
    mid = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = points.join(mid, key).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    t = [F.col("u") * F.col("u"), F.col("u") * F.col("v"), F.col("v") * F.col("v"), F.col("u"), F.col("v")]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    g = d.groupBy(key, "mx", "my").agg(F.array(*[F.sum(t[i] * t[j]) for i, j in pairs]).alias("g"), F.array(*[F.sum(x) for x in t]).alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 5")

    def work(parts):
        for p in parts:
            out = []
            for k, mx, my, gv, s in zip(p[key], p["mx"], p["my"], p["g"], p["s"], strict=True):
                m = np.zeros((5, 5))
                for (i, j), x in zip(pairs, gv, strict=True):
                    m[i, j] = m[j, i] = x
                try:
                    a, b, c, dd, e = np.linalg.solve(m, np.asarray(s))
                except np.linalg.LinAlgError:
                    continue
                if 4 * a * c - b * b <= 0:
                    continue
                x0, y0 = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-dd, -e])
                f = 1 + a * x0 * x0 + b * x0 * y0 + c * y0 * y0
                ev, vec = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) / f)
                if ev[0] <= 0:
                    continue
                out.append((k, mx + x0, my + y0, 1 / math.sqrt(ev[0]), 1 / math.sqrt(ev[1]), math.atan2(vec[1, 0], vec[0, 0]) % math.pi))
            yield pd.DataFrame(out, columns=[key, "x0", "y0", "a", "b", "theta"])

    return g.mapInPandas(work, f"{key} {points.schema[key].dataType.simpleString()}, x0 double, y0 double, a double, b double, theta double")


def boundary_points(tracks: DataFrame, rows: DataFrame, movie: int) -> tuple[DataFrame, DataFrame]:
    """Ends in the last and starts in the first frame of movies of ``movie`` frames, keyed by the movie that ends."""
    first, last = F.min_by(F.struct("x", "y"), "frame"), F.max_by(F.struct("x", "y"), "frame")
    t = tracks.where((F.col("ff") % movie == 0) | ((F.col("fi") - 1) % movie == 0))
    p = rows.join(by_tracklet(t.select("tracklet")), "tracklet", "left_semi").groupBy("tracklet").agg(first.alias("i"), last.alias("f"))
    t = t.join(p, "tracklet")
    ends = t.where(F.col("ff") % movie == 0).select((F.col("ff") / movie).cast("long").alias("m"), "colony", "tracklet", "f.x", "f.y")
    starts = t.where((F.col("fi") - 1) % movie == 0).select(((F.col("fi") - 1) / movie).cast("long").alias("m"), "colony", "tracklet", "i.x", "i.y")
    return ends, starts


