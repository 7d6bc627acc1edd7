"""Places of new points in an embedding that exists already.

A point is a distribution (wavelet amplitudes, class probabilities). Its neighbours are the training distributions of
least KL divergence, weighted so that they have a given perplexity; its place is where a t-distributed kernel over the
neighbours' places fits these weights best. Rows do not depend on each other: Spark deals them out, and a task moves
all simplexes of a batch at once. Training points are a bounded table that every task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TINY = 1e-300  # stands for a training component of zero
MOST_TRAINING_BYTES = 256 << 20
CELLS = 4_000_000  # divergences held at a time


def axes(x: np.ndarray, k: int) -> np.ndarray:
    """Coordinates along the k axes of most variance; each axis points to its largest component."""
    x = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    v = v[:k]
    return x @ (v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]).T


def divergences(x: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """KL divergences in bits, rows of x against training rows given as logarithms."""
    own = np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0).sum(axis=1)
    return np.maximum((own[:, None] - x @ logs.T) / np.log(2), 0.0)


def weights(d: np.ndarray, highest: np.ndarray, perplexity: float, tolerance: float, rounds: int = 200) -> np.ndarray:
    """Per row of divergences d the Gaussian weights whose perplexity is within tolerance of the one asked for, by halving.

    highest: the row's largest divergence, where halving begins. A perplexity that the row cannot reach ends at the nearest one that it can.
    """

    def at(rows: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = -0.5 * (d[rows] / sigma[:, None]) ** 2
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0).sum(axis=1)
        return p, 2.0**entropy

    low, high = np.full(len(d), 1e-10), np.maximum(highest, 1e-9)
    out = np.empty_like(d)
    rows = np.arange(len(d))
    for _ in range(rounds):
        mid = 0.5 * (low[rows] + high[rows])
        out[rows], p = at(rows, mid)
        wide = p > perplexity
        high[rows[wide]], low[rows[~wide]] = mid[wide], mid[~wide]
        rows = rows[np.abs(p - perplexity) > tolerance]
        if not len(rows):
            break
    return out


def costs(at: np.ndarray, z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What each place costs its neighbours z (rows x neighbours x 2) of weights p; neighbours without weight do not count."""
    d = 1 + ((at[:, None] - z) ** 2).sum(axis=2)
    return np.log(((p > 0) / d).sum(axis=1)) + (p * np.log(d)).sum(axis=1)


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, iterations: int, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) by one downhill simplex per row of start, all moved together; f takes (row numbers, their places)."""
    n, k = start.shape
    s = np.repeat(start[:, None], k + 1, axis=1)
    for j in range(k):
        s[:, j + 1, j] = np.where(start[:, j] != 0, 1.05 * start[:, j], 0.00025)
    v = np.stack([f(np.arange(n), s[:, j]) for j in range(k + 1)], axis=1)
    rows = np.arange(n)
    for turn in range(iterations):
        order = np.argsort(v[rows], axis=1, kind="stable")
        v[rows] = np.take_along_axis(v[rows], order, axis=1)
        s[rows] = np.take_along_axis(s[rows], order[:, :, None], axis=1)
        still = (np.abs(v[rows] - v[rows, :1]).max(axis=1) > tolerance) | (np.abs(s[rows] - s[rows, :1]).max(axis=(1, 2)) > tolerance)
        rows = rows[still]
        if not len(rows) or turn == iterations - 1:
            break
        mid, worst = s[rows, :k].mean(axis=1), s[rows, k]
        along = lambda t, m=mid, w=worst: m + t * (m - w)
        best, second, last = v[rows, 0], v[rows, k - 1], v[rows, k]
        new = along(1.0)
        value = f(rows, new)
        far, out, back = value < best, (value >= second) & (value < last), value >= last
        step = np.where(far, 2.0, np.where(out, 0.5, -0.5))
        other = along(step[:, None])
        tried = far | out | back
        again = np.full(len(rows), np.inf)
        again[tried] = f(rows[tried], other[tried])
        use = (far & (again < value)) | (out & (again <= value)) | (back & (again < last))
        shrink = (out | back) & ~use
        new[use], value[use] = other[use], again[use]
        move = ~shrink
        s[rows[move], k], v[rows[move], k] = new[move], value[move]
        small = rows[shrink]
        for j in range(1, k + 1):
            s[small, j] = s[small, 0] + 0.5 * (s[small, j] - s[small, 0])
            v[small, j] = f(small, s[small, j])
    low = v.argmin(axis=1)
    return s[np.arange(n), low], v[np.arange(n), low]


def inside(at: np.ndarray, z: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each place lies in the hull of its weighted neighbours, border included: no half plane through it is free of them."""
    gap = z - at[:, None]
    has = p > 0
    angle = np.arctan2(gap[..., 1], gap[..., 0])
    first = np.take_along_axis(angle, has.argmax(axis=1)[:, None], axis=1)
    angle = np.sort(np.where(has, angle, first), axis=1)
    turns = np.diff(np.concatenate([angle, angle[:, :1] + 2 * np.pi], axis=1), axis=1)
    return (turns.max(axis=1) <= np.pi + 1e-12) | (has & (gap == 0).all(axis=2)).any(axis=1)


def place(x: np.ndarray, logs: np.ndarray, places: np.ndarray, *, perplexity: float, tolerance: float, neighbours: int, iterations: int) -> tuple[np.ndarray, ...]:
    """(places, costs, inside, start) of distributions x; start: 1 the neighbours' weighted mean, 2 the place of the nearest."""
    d = divergences(x, logs)
    k = min(neighbours, d.shape[1])
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    p = weights(np.take_along_axis(d, near, axis=1), d.max(axis=1), perplexity, tolerance)
    z = places[near]
    starts = np.stack([(z * p[..., None]).sum(axis=1), z[:, 0]], axis=1)
    n = len(x)
    of = np.repeat(np.arange(n), 2)
    got, cost = minimise(lambda rows, at: costs(at, z[of[rows]], p[of[rows]]), starts.reshape(2 * n, 2), iterations)
    ok = inside(got, z[of], p[of]).reshape(n, 2)
    got, cost = got.reshape(n, 2, 2), cost.reshape(n, 2)
    pick = np.where(ok.any(axis=1)[:, None], np.where(ok, cost, np.inf), cost).argmin(axis=1)
    each = np.arange(n)
    found = ok[each, pick]
    return np.where(found[:, None], got[each, pick], starts[each, pick]), cost[each, pick], found, pick + 1


def embed(points: DataFrame, training: np.ndarray, places: np.ndarray, *, perplexity: float = 32.0, tolerance: float = 1e-5, neighbours: int = 200, iterations: int = 100) -> DataFrame:
    """(id, x, y, cost, inside, start) for points (id: long, p: array of doubles).

    training: rows of components not below zero, places: theirs in the plane; together at most MOST_TRAINING_BYTES, else an error. A place found
    outside its neighbours' hull is replaced by its start. Rows whose p is null, has a null, negative or non-finite component, another
    length than the training rows, or sums to zero, come out with nulls. Repeated ids give repeated rows, equal p equal places; other columns are left out.
    """
    t, places = np.asarray(training, float), np.asarray(places, float)
    if not len(t) or t.shape[0] != len(places) or not np.isfinite(t).all() or (t < 0).any() or (t.sum(axis=1) <= 0).any():
        raise ValueError("training rows must be finite, not negative, not all zero, and have a place each")
    if t.nbytes + places.nbytes > MOST_TRAINING_BYTES:
        raise ValueError("too many training rows for a table that every task holds")
    logs = np.log(np.maximum(t / t.sum(axis=1, keepdims=True), TINY))
    at_once = max(1, CELLS // max(len(t), 8 * min(neighbours, len(t))))

    def fit(p: object) -> np.ndarray | None:
        if p is None or len(p) != t.shape[1]:
            return None
        v = np.array([np.nan if c is None else c for c in p], float)
        return v / v.sum() if np.isfinite(v).all() and (v >= 0).all() and 0 < v.sum() < np.inf else None

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [fit(p) for p in part["p"]]
            ok = np.array([r is not None for r in rows], bool)
            out = pd.DataFrame({"id": part["id"].to_numpy(), "x": np.nan, "y": np.nan, "cost": np.nan, "inside": None, "start": None}).astype({"inside": "boolean", "start": "Int32"})
            for lo in range(0, int(ok.sum()), at_once):
                at = np.flatnonzero(ok)[lo : lo + at_once]
                xy, cost, hull, start = place(np.stack([rows[i] for i in at]), logs, places, perplexity=perplexity, tolerance=tolerance, neighbours=neighbours, iterations=iterations)
                out.loc[at, "x"], out.loc[at, "y"], out.loc[at, "cost"], out.loc[at, "inside"], out.loc[at, "start"] = xy[:, 0], xy[:, 1], cost, hull, start
            yield out

    return points.select("id", "p").mapInPandas(work, "id long, x double, y double, cost double, inside boolean, start int")
