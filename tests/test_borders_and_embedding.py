"""Border links against all matchings, the embedding against one simplex at a time."""

import math
import random
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import SMALL
from trailmark import fixtures as fx
from trailmark import plans
from trailmark.operators import borders as bd
from trailmark.operators import embedding as em

TRACK, BLOB, LINK = "m long, colony long, tracklet long, x double, y double", "m long, colony long, blob long, x double, y double", "m long, colony long, prev long, cur long"


def all_matchings(cost: list[list[float]], alone: float) -> tuple[float, tuple[tuple[int, int], ...]]:
    """Least cost over all matchings of rows with columns, by trying every one."""
    wide = len(cost[0]) if cost else 0

    @cache
    def best(i: int, used: int) -> tuple[float, tuple]:
        if i == len(cost):
            return alone * (wide - used.bit_count()), ()
        c, pairs = best(i + 1, used)
        found = (c + alone, pairs)
        for j in range(wide):
            if not used >> j & 1:
                c, pairs = best(i + 1, used | 1 << j)
                found = min(found, (c + cost[i][j], ((i, j), *pairs)))
        return found

    return best(0, 0)


def test_cheapest_against_all_matchings():
    rng = random.Random(3)
    for _ in range(400):
        n, k, alone = rng.randint(0, 6), rng.randint(0, 7), rng.choice([0.1, 0.4, 2.0])
        cost = [[rng.random() for _ in range(k)] for _ in range(n)]
        want = all_matchings(cost, alone)[1] if n and k else ()
        near = [(i, j, c) for i, r in enumerate(cost) for j, c in enumerate(r) if c < 2 * alone]
        assert bd.cheapest(near, alone) == sorted(want)


def test_cheapest_gives_way():
    # the middle column is nearest to both, the pair with both ends is cheaper
    assert bd.cheapest([(0, 0, 1.0), (1, 0, 1.1), (1, 1, 3.5)], 2.0) == [(0, 0), (1, 1)]
    assert bd.cheapest([(0, 0, 1.0), (1, 0, 1.1), (1, 1, 3.95), (2, 1, 0.5)], 2.0) == [(0, 0), (2, 1)]
    assert bd.cheapest([], 2.0) == []


def test_assignments_over_cells_and_components(spark):
    rng = random.Random(5)
    tracks = [(m, c, 10 * m + i, rng.uniform(-3, 3), rng.uniform(-1, 1)) for m in range(8) for c in range(2) for i in range(6)]
    blobs = [(m, c, i, rng.uniform(-3, 3), rng.uniform(-1, 1)) for m in range(8) for c in range(2) for i in range(7)]
    got = bd.assignments(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(blobs, BLOB), alone=0.7)
    want = set()
    for m in range(8):
        for c in range(2):
            a, b = ([r for r in t if r[:2] == (m, c)] for t in (tracks, blobs))
            _, pairs = all_matchings([[math.hypot(p[3] - q[3], p[4] - q[4]) for q in b] for p in a], 0.7)
            want |= {(m, c, a[i][2], b[j][2]) for i, j in pairs}
    rows = [(r["m"], r["colony"], r["tracklet"], r["blob"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_links_split_and_merge_over_a_border(spark):
    ends = spark.createDataFrame([(1, 0, 1, 0.0, 0.0), (1, 0, 2, 5.0, 0.0), (1, 0, 3, 50.0, 0.0), (2, 0, 1, 0.0, 0.0), (1, None, 8, 0.0, 0.0), (1, 0, 9, None, 0.0)], TRACK)
    starts = spark.createDataFrame([(1, 0, 11, 0.2, 0.0), (1, 0, 12, 5.0, 1.0), (1, 0, 13, 9.0, 0.0), (2, 0, 14, 0.0, 0.0)], TRACK)
    before = spark.createDataFrame([(1, 0, 1, 0.1, 0.0), (1, 0, 2, 5.0, 0.1), (1, 0, 3, 90.0, 0.0), (2, 0, 1, 0.0, 0.0)], BLOB)
    after = spark.createDataFrame([(1, 0, 1, 0.1, 0.0), (1, 0, 2, 5.0, 0.9), (1, 0, 3, 9.0, 0.1), (2, 0, 1, 0.0, 0.0)], BLOB)
    links = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 2, 3), (1, 0, 1, 2), (1, 0, 1, 1), (2, 0, 1, 1)], LINK)
    of = lambda **kw: sorted((r["parent"], r["child"]) for r in bd.border_links(ends, starts, before, after, links, **kw).collect())
    assert of() == [(1, 11), (1, 12), (1, 14), (2, 12), (2, 13)]
    assert of(borders=spark.createDataFrame([(1,)], "m long")) == [(1, 11), (1, 12), (2, 12), (2, 13)]
    none = [t.where("false") for t in (ends, starts)]
    assert bd.border_links(*none, before, after, links).count() == 0


def test_open_borders(spark):
    movies = spark.createDataFrame([(1, 1, 10), (2, 11, 20), (3, 25, 30), (4, 31, 40), (5, 41, 50)], "m long, fi long, ff long")
    dat = spark.createDataFrame([(11, 1.0), (25, 1.0), (31, 9.0), (41, None)], "frame long, tracking_dt double")
    assert sorted(r["m"] for r in bd.open_borders(movies, dat, 2.5).collect()) == [1, 4]


def test_border_query_against_all_matchings(spark):
    """The whole small table, border by border, with the cells' means and the links between blobs made anew."""
    t = fx.tracklets(spark, SMALL)
    span = {r["tracklet"]: (r["colony"], r["fi"], r["ff"]) for r in t.select("tracklet", "colony", "fi", "ff").collect()}
    rows = fx.untagged(t).where(((F.col("frame") - 1) % 24 == 0) | (F.col("frame") % 24 == 0)).collect()
    want = set()
    for m in range(1, max(ff for _, _, ff in span.values()) // 24 + 1):
        for colony in {c for c, _, _ in span.values()}:
            side, ids = [], []
            for frame, at in ((m * 24, 2), (m * 24 + 1, 1)):
                here = [r for r in rows if r["frame"] == frame and r["colony"] == colony]
                cells: dict[tuple, list] = {}
                for r in here:
                    cells.setdefault((math.floor(r["x"] * 20), math.floor(r["y"] * 20)), []).append((r["x"], r["y"]))
                blobs = [tuple(sum(v) / len(v) for v in zip(*p, strict=True)) for p in cells.values()]
                tracks = [r for r in here if span[r["tracklet"]][at] == frame]
                pairs = all_matchings([[math.hypot(r["x"] - b[0], r["y"] - b[1]) for b in blobs] for r in tracks], 0.02)[1] if len(tracks) < 12 and len(blobs) < 16 else None
                if pairs is None:
                    pairs = bd.cheapest([(i, j, math.hypot(r["x"] - b[0], r["y"] - b[1])) for i, r in enumerate(tracks) for j, b in enumerate(blobs) if math.hypot(r["x"] - b[0], r["y"] - b[1]) < 0.04], 0.02)
                side.append([(tracks[i]["tracklet"], blobs[j]) for i, j in pairs])
            want |= {(m, p, c) for p, a in side[0] for c, b in side[1] if math.hypot(a[0] - b[0], a[1] - b[1]) < 0.1}
    got = [tuple(r) for r in plans.queries()["cross_movie_links"](spark, SMALL).select("m", "parent", "child").collect()]
    assert set(got) == want and len(got) == len(want) and want


def plain_weights(d, highest, perplexity, tolerance):
    low, high = 1e-10, highest
    for _ in range(200):
        s = (low + high) / 2
        p = [math.exp(-0.5 * (v / s) ** 2 + 0.5 * (min(d) / s) ** 2) for v in d]
        p = [v / sum(p) for v in p]
        h = 2 ** -sum(v * math.log2(v) for v in p if v > 0)
        if abs(h - perplexity) <= tolerance:
            break
        low, high = (low, s) if h > perplexity else (s, high)
    return p


def plain_simplex(f, x, steps):
    """Downhill simplex of one point in the plane, step by step."""
    s = [list(x) for _ in range(3)]
    for j in range(2):
        s[j + 1][j] = s[j + 1][j] * 1.05 if s[j + 1][j] else 0.00025
    s = sorted(((f(p), p) for p in s), key=lambda t: t[0])
    for _ in range(steps):
        if max(abs(v - s[0][0]) for v, _ in s) <= 1e-4 and max(abs(a - b) for _, p in s for a, b in zip(p, s[0][1], strict=True)) <= 1e-4:
            break
        mid = [(s[0][1][i] + s[1][1][i]) / 2 for i in range(2)]
        go = lambda t, m=mid, w=s[2][1]: [a + t * (a - b) for a, b in zip(m, w, strict=True)]
        r = go(1.0)
        v = f(r)
        new = (v, r)
        if v < s[0][0]:
            e = go(2.0)
            new = (f(e), e) if f(e) < v else new
        elif v >= s[1][0]:
            c = go(0.5 if v < s[2][0] else -0.5)
            new = (f(c), c) if (f(c) <= v if v < s[2][0] else f(c) < s[2][0]) else None
        if new is None:
            half = [[a + 0.5 * (b - a) for a, b in zip(s[0][1], p, strict=True)] for _, p in s[1:]]
            s = [s[0]] + [(f(p), p) for p in half]
        else:
            s[2] = new
        s.sort(key=lambda t: t[0])
    return s[0][1], s[0][0]


def in_hull(p, z):
    """Whether no line through p leaves all of z strictly on one side, over the lines that are square to directions of z and between."""
    v = [(a - p[0], b - p[1]) for a, b in z]
    turns = sorted(math.atan2(b, a) for a, b in v)
    normals = [t + s * math.pi / 2 + e for t in turns for s in (1, -1) for e in (1e-9, -1e-9)]
    return not any(all(a * math.cos(n) + b * math.sin(n) > 0 for a, b in v) for n in normals)


def plain_place(x, training, places, perplexity, tolerance, neighbours, iterations):
    d = [max(0.0, sum(a * math.log2(a / b) for a, b in zip(x, q, strict=True) if a > 0)) for q in training]
    near = sorted(range(len(d)), key=lambda i: d[i])[:neighbours]
    sub = [d[i] for i in near]
    p = plain_weights(sub, max(d), perplexity, tolerance)
    z = [tuple(places[i]) for i in near]
    cost = lambda at: math.log(sum(1 / (1 + (at[0] - a) ** 2 + (at[1] - b) ** 2) for (a, b), w in zip(z, p, strict=True) if w > 0)) + sum(w * math.log(1 + (at[0] - a) ** 2 + (at[1] - b) ** 2) for (a, b), w in zip(z, p, strict=True))
    starts = [[sum(w * q[i] for w, q in zip(p, z, strict=True)) for i in range(2)], list(z[0])]
    got = [plain_simplex(cost, s, iterations - 1) for s in starts]
    hull = [in_hull(g, [q for q, w in zip(z, p, strict=True) if w > 0]) for g, _ in got]
    pick = min((i for i in range(2) if hull[i] or not any(hull)), key=lambda i: got[i][1])
    return (got[pick][0] if hull[pick] else starts[pick]), got[pick][1], hull[pick], pick + 1


def test_embedding_against_plain(spark):
    rng = np.random.default_rng(7)
    training = rng.dirichlet(np.full(6, 0.8), 120)
    places = em.axes(np.log(np.maximum(training, 1e-9)), 2)
    x = np.concatenate([rng.dirichlet(np.full(6, 0.8), 60), training[:5], [[1.0, 0, 0, 0, 0, 0]]])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, p array<double>").repartition(3)
    how = {"perplexity": 8.0, "tolerance": 1e-5, "neighbours": 40, "iterations": 100}
    got = {r["id"]: r for r in em.embed(df, training, places, **how).collect()}
    assert len(got) == len(x)
    for i, v in enumerate(x):
        xy, cost, hull, start = plain_place(list(v), training.tolist(), places.tolist(), **how)
        r = got[i]
        assert (r["x"], r["y"], r["cost"]) == pytest.approx((*xy, cost), abs=2e-4)
        assert r["inside"] == hull and r["start"] == start


def test_embedding_defined_results(spark):
    training = np.array([[0.7, 0.3], [0.5, 0.5], [0.2, 0.8], [0.0, 1.0]])
    places = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    rows = [(1, None), (2, [0.5, None]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [-1.0, 2.0]), (7, [1.0, 1.0]), (7, [2.0, 2.0]), (8, [])]
    df = spark.createDataFrame(rows, "id long, p array<double>").withColumn("x", F.lit("other"))
    got = em.embed(df, training, places, perplexity=2.0).collect()
    known = [r for r in got if r["cost"] is not None and not math.isnan(r["cost"])]
    assert len(got) == 9 and [r["id"] for r in known] == [7, 7] and known[0][1:] == known[1][1:]
    assert all(r["inside"] is None and r["start"] is None and r["x"] is None for r in got if r["id"] != 7)
    assert em.embed(df.where("false"), training, places).count() == 0
    with pytest.raises(ValueError):
        em.embed(df, training[:0], places[:0])
    with pytest.raises(ValueError):
        em.embed(df, -training, places)


def test_hull():
    z = np.array([[[0.0, 0.0], [2.0, 0.0], [0.0, 2.0], [9.0, 9.0]]])
    p = np.array([[0.5, 0.3, 0.2, 0.0]])
    inside = lambda x, y: bool(em.inside(np.array([[x, y]]), z, p)[0])
    assert inside(0.5, 0.5) and inside(1.0, 1.0) and inside(0.0, 0.0) and inside(1.0, 0.0)
    assert not inside(1.1, 1.0) and not inside(-0.1, 0.5) and not inside(3.0, 3.0)
