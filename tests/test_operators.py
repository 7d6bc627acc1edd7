"""Kernels, rules and edge cases against naive code."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.functions import names
from trailmark.model import nan_to_null, wrap
from trailmark.operators import borders as bd
from trailmark.operators import classify as cl
from trailmark.operators import counts as ct
from trailmark.operators import graph as gr
from trailmark.operators import intervals as iv
from trailmark.operators import kernels as kn
from trailmark.operators import sampling as sm
from trailmark.operators import solve as sv
from trailmark.operators import trajectory as tr
from trailmark.operators import untagged as ug


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_movie_lists(spark):
    assert names.parse_movlist("1-5,7") == [1, 2, 3, 4, 5, 7]
    assert names.parse_movlist("9, 2-3,2") == [2, 3, 9]
    assert names.parse_movlist("all", [3, 1]) == [1, 3] and names.parse_movlist("") == []
    with pytest.raises(ValueError):
        names.parse_movlist("a-b")
    t = spark.createDataFrame([("k", m) for m in (1, 2, 3, 5, 7, 8)], "k string, m long")
    assert names.movlist_text(t, "k").first()["movies"] == "1-3,5,7-8"


def test_wrap(spark):
    x = [math.pi, -math.pi, 3 * math.pi, 0.5, -7.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(wrap(F.col("x"))).collect()]
    assert got[-1] is None
    for v, g in zip(x[:-1], got, strict=False):
        assert -math.pi <= g < math.pi and math.isclose(math.cos(v), math.cos(g), abs_tol=1e-12)


def test_nan_becomes_null(spark):
    d = nan_to_null(spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, x double"))
    assert values(d.where("x is null"), "i") == [(1,)]


def xy(spark, xs):
    return spark.createDataFrame([("a", i + 1, x, 0.0 if x is not None else None, 1 if x is not None else None) for i, x in enumerate(xs)], "ant string, frame long, x double, y double, ass_type int")


def test_interpolation_modes(spark):
    d = xy(spark, [None, 1.0, None, 3.0, None, None, None, 3.005, None])
    inside = [r["x"] for r in tr.interpolate(d).orderBy("frame").collect()]
    assert inside[:4] == [None, 1.0, 2.0, 3.0] and inside[-1] is None and abs(inside[5] - 3.0025) < 1e-9
    ends = [r["x"] for r in tr.interpolate(d, ends="clamp").orderBy("frame").collect()]
    assert ends[0] == 1.0 and ends[-1] == 3.005
    near = tr.interpolate_gaps(d, max_frames=3, max_distance=0.01).orderBy("frame").collect()
    assert [r["ass_type"] for r in near] == [None, 1, None, 1, 5, 5, 5, 1, None]
    short = tr.interpolate_gaps(d, max_frames=2, max_distance=9.0).orderBy("frame").collect()
    assert [r["ass_type"] for r in short] == [None, 1, 5, 1, None, None, None, 1, None]


def test_rolling_needs_full_window(spark):
    d = xy(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0])
    got = [r[0] for r in d.select(tr.rolling("x", tr.by_frame("ant"), 1, 0).alias("v"), "frame").orderBy("frame").collect()]
    assert got == [None, 1.5, None, None, 4.5, 5.5]


def test_segments_cover_the_axis(spark):
    d = xy(spark, [1.0, 1.0, None, None, 2.0, 1.0])
    s = sorted(tr.segments(d, "x").collect(), key=lambda r: r["start"])
    assert [(r["value"], r["start"], r["stop"]) for r in s] == [(1.0, 1, 2), (None, 3, 4), (2.0, 5, 5), (1.0, 6, 6)]


@pytest.mark.parametrize(("rows", "want"), [([(1.0, 1.0)], 1.0), ([(1.0, 1.0), (2.0, 1.0)], 1.5), ([(1.0, 9.0), (2.0, 1.0), (3.0, 1.0)], 1.0), ([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], 2.0), ([(1.0, 2.0), (4.0, 1.0), (8.0, 1.0)], 2.5)])
def test_weighted_median(spark, rows, want):
    d = spark.createDataFrame([("k", *r) for r in rows], "k string, x double, w double")
    assert ug.weighted_median(d, "x", "w", ["k"]).first()["median"] == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-5, 5)), min_size=1, max_size=40), st.sampled_from([1, 3, 7]))
def test_centred_median(x, k):
    v, half = np.array([np.nan if a is None else a for a in x]), k // 2
    for edge in ("null", "shrink", "zero"):
        got = kn.centred_median(v, k, edge)
        for i in range(len(v)):
            if edge == "zero":
                w = [v[j] if 0 <= j < len(v) else 0.0 for j in range(i - half, i + half + 1)]
                want = np.nan if any(map(math.isnan, w)) else float(np.median(w))
            else:
                w = v[max(0, i - half) : i + half + 1]
                full = len(w) == k and not np.isnan(w).any()
                seen = w[~np.isnan(w)]
                want = (np.median(w) if full else np.nan) if edge == "null" else (np.median(seen) if len(seen) else np.nan)
            assert (math.isnan(want) and math.isnan(got[i])) or math.isclose(want, got[i], abs_tol=1e-9)


def test_median_filter_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    d = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(x)], "k long, frame long, x double")
    for edge in ("null", "zero", "shrink"):
        got = np.array([np.nan if r["x_med"] is None else r["x_med"] for r in kn.median_filter(d, "x", 51, key=["k"], edge=edge, block=60).orderBy("frame").collect()])
        assert np.allclose(got, kn.centred_median(x, 51, edge), equal_nan=True)
    with pytest.raises(ValueError):
        kn.median_filter(d, "x", 4, key=["k"])


def test_overlaps_are_symmetric_and_complete(spark):
    rng = random.Random(2)
    t = [(i, i % 2, a := rng.randint(1, 200), a + rng.randint(0, 90)) for i in range(60)]
    d = spark.createDataFrame(t, "tracklet long, colony long, fi long, ff long")
    want = sorted((x[1], x[0], y[0]) for x in t for y in t if x[0] != y[0] and x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    for width in (1, 7, 500):
        assert values(iv.overlaps(d, width=width), "colony", "a", "b") == want


def naive_assign(c):
    import itertools

    n, m = c.shape
    return min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)) if n <= m else naive_assign(c.T)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment(n, m, seed):
    c = np.random.default_rng(seed).random((n, m))
    pairs = bd.cheapest(((i, j, float(c[i, j])) for i in range(n) for j in range(m)), 10.0)  # nothing is worth being left over
    assert len(pairs) == min(n, m) and math.isclose(sum(c[i, j] for i, j in pairs), naive_assign(c))


def test_orientation_is_the_cheapest_sequence():
    import itertools

    rng = np.random.default_rng(3)
    n, c = 8, kn.HeadCosts()
    o, m, v, e = rng.uniform(-3, 3, n), rng.uniform(-3, 3, n), rng.uniform(0, 0.01, n), rng.uniform(0.5, 0.9, n)

    def cost(a):
        moving = [c.w_max / (1 + math.exp(-(v[i] - c.v_centre) / c.v_width)) if v[i] <= c.v_max else 0.0 for i in range(n)]
        turning = [(c.e_max - c.e_min) / (1 + math.exp(-(e[i] - c.e_centre) / c.e_width)) + c.e_min for i in range(n)]
        return sum(moving[i] * abs(a[i] - m[i]) + turning[i] * abs(a[i] - a[i - 1]) for i in range(1, n))

    every = {flip: cost([x + math.pi * f for x, f in zip(o, flip, strict=True)]) for flip in itertools.product((0, 1), repeat=n)}
    got = kn.fix_orientation(o, e, v, m)
    flips = tuple(int(abs((g - x + 1) % (2 * math.pi) - 1) > 0.5) for g, x in zip(got, o, strict=True))
    assert math.isclose(every[flips], min(every.values()), rel_tol=1e-9)
    assert ((got >= -math.pi) & (got < math.pi)).all()
    assert len(kn.fix_orientation(*[np.zeros(0)] * 4)) == 0
    still = kn.fix_orientation(np.zeros(3), np.full(3, 0.8), np.full(3, np.nan), np.full(3, np.nan))  # unknown motion costs nothing
    assert (still == 0).all()


def test_ellipse(spark):
    t = np.linspace(0, 6, 12)
    c, s = math.cos(0.4), math.sin(0.4)
    pts = [(1, float(5 + 3 * math.cos(a) * c - math.sin(a) * s), float(2 + 3 * math.cos(a) * s + math.sin(a) * c)) for a in t]
    r = kn.fit_ellipse(spark.createDataFrame([*pts, (2, 0.0, 0.0)], "k long, x double, y double"), "k").collect()
    assert len(r) == 1 and np.allclose([r[0][x] for x in ("x0", "y0", "a", "b", "theta")], [5, 2, 3, 1, 0.4])


def test_pca(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * [3, 1, 0.2]
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    mean, axes, var = kn.pca(d, "v", 2)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(var, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2])
    got = np.array([r["pc"] for r in kn.project(d, "v", mean, axes).orderBy("i").collect()])
    assert np.allclose(got, (x - mean) @ axes.T)


def test_wavelet_finds_the_period():
    x = np.sin(2 * math.pi * np.arange(400) / 16)
    scales = kn.dyadic_periods(25, 1.0, 50.0)
    w = kn.morlet(x, scales).mean(axis=1)
    assert abs(scales[w.argmax()] * 2 * math.pi / 5 - 16) < 3


def vote(spark, frames):
    classes = ["A", "B", "Unknown", "NoAnt", "MultiAnt"]
    d = spark.createDataFrame([(1, i, [float(x) for x in p]) for i, p in enumerate(frames)], "tracklet long, frame long, p array<double>")
    r = cl.tracklet_vote(d, classes, ant=["A", "B"], non_ant=["NoAnt"], multi=["MultiAnt"], other=["Unknown"]).first()
    return r["label"], round(r["score"], 9), r["best_frame"]


def one(k, p=0.996):
    return [p if i == k else (1 - p) / 4 for i in range(5)]


def test_vote_branches(spark):
    assert vote(spark, [one(3), one(3)]) == ("NoAnt", 0.0, -1)
    assert vote(spark, [one(4), one(3)]) == ("MultiAnt", 0.0, -1)
    assert vote(spark, [one(0), one(0), one(4)]) == ("MultiAnt", 0.0, -1)
    assert vote(spark, [one(2), one(2)]) == ("Unknown", 0.0, -1)
    assert vote(spark, [one(0, 0.8)] * 6) == ("Unknown", 0.0, -1)
    assert vote(spark, [one(0, 0.95)] * 4) == ("Unknown", 0.0, -1)
    label, score, best = vote(spark, [one(0, 0.95)] * 5 + [one(0, 0.97)] + [one(1, 0.9)])
    assert (label, best) == ("A", 5) and score > 5
    # two ant classes: the frame of the winner's greatest probability counts, not that of another class
    rows = [one(0, 0.95)] * 4 + [one(0, 0.96), one(1, 0.99), one(0, 0.95)]
    assert vote(spark, rows)[0] == "A" and vote(spark, rows)[2] == 4
    assert vote(spark, [one(3), one(2)])[0] == "NoAnt"  # a tie goes to the label seen first


def test_components_and_chains(spark):
    n = spark.createDataFrame([(i,) for i in range(1300)], "tracklet long")
    e = spark.createDataFrame([(i, i + 1) for i in range(1200)] + [(1250, 1290)], "src long, dst long")
    c = {r["tracklet"]: r["component"] for r in gr.weak_components(n, e).collect()}
    assert c[1200] == 0 and c[1290] == 1250 and c[1299] == 1299
    chain = gr.build_chains(e, n.select(F.col("tracklet").alias("node"))).where("node = 1200").first()
    assert (chain["chain"], chain["pos"]) == (0, 1200)


def test_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "src long, dst long")
    assert values(gr.hop_distance(e, 2), "src", "dst", "hops") == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 3, 1), (2, 4, 2), (3, 4, 1)]
    assert values(gr.siblings(e), "a", "b") == [(2, 3), (3, 2)]


def diamond():
    nodes = pd.DataFrame({"tracklet": [1, 2, 3, 4, 5], "colony": 0, "fi": [1, 1, 11, 21, 21], "ff": [10, 10, 20, 30, 30], "len": 10, "area": 1.0, "label": ["A", "B", "", "A", ""], "score": [5.0, 4.0, 0.0, 3.0, 0.0], "single": [True, True, False, True, True], "noant": False})
    edges = pd.DataFrame({"src": [1, 2, 3, 3], "dst": [3, 3, 4, 5]})
    none = pd.DataFrame({"src": [], "dst": [], "hops": []}).astype("int64")
    return nodes, edges, none, pd.DataFrame({"tracklet": [], "id": []}), NO_COMMANDS


NO_COMMANDS = pd.DataFrame({"command": [], "tracklet": [], "value": [], "line": []})


def test_solver_passes_ids_through_a_merge():
    r = sv.solve_colony(*diamond(), ["A", "B"])
    got = {(t, i) for t, i, a in zip(r["tracklet"], r["id"], r["assigned"], strict=True) if a}
    assert got == {(1, "A"), (2, "B"), (3, "A"), (3, "B"), (4, "A"), (5, "B")}


def test_solver_prefers_the_better_source():
    nodes = pd.DataFrame({"tracklet": [1, 2], "colony": 0, "fi": [1, 5], "ff": [10, 14], "len": 10, "area": 1.0, "label": ["A", "A"], "score": [1.0, 2.0], "single": True, "noant": False})
    none = pd.DataFrame({"src": [], "dst": [], "hops": []}).astype("int64")
    r = sv.solve_colony(nodes, none, none, pd.DataFrame({"tracklet": [], "id": []}), NO_COMMANDS, ["A"])
    assert {(t, a) for t, a in zip(r["tracklet"], r["assigned"], strict=True)} == {(2, True)}


class Plain:
    """The rules of propagation written as plain recursion over sets, to compare with."""

    def __init__(self, nodes, edges, ids):
        self.n = nodes.sort_values(["fi", "tracklet"]).to_dict("records")
        self.span = {r["tracklet"]: (r["fi"], r["ff"]) for r in self.n}
        self.single = {r["tracklet"]: r["single"] for r in self.n}
        self.up = {t: [a for a, b in edges if b == t] for t in self.span}
        self.down = {t: [b for a, b in edges if a == t] for t in self.span}
        self.possible = {(t, i) for t in self.span for i in ids}
        self.assigned, self.ids = {}, ids

    def assign(self, t, i, score):
        if (t, i) in self.assigned or (t, i) not in self.possible:
            return 0
        self.assigned[t, i] = score
        if self.single[t]:
            self.possible -= {(t, j) for j in self.ids if (t, j) not in self.assigned}
        lo, hi = self.span[t]
        self.possible -= {(o, i) for o, (a, b) in self.span.items() if a <= hi and b >= lo and (o, i) not in self.assigned}
        return 1 + self.propagate(t, i, score)

    def propagate(self, t, i, score):
        made = 0
        for side in (self.up, self.down):
            can = [m for m in side[t] if (m, i) in self.possible]
            if not any((m, i) in self.assigned for m in side[t]) and len(can) == 1:
                made += self.assign(can[0], i, score)
        return made

    def sweep(self):
        while sum(self.propagate(t, i, self.assigned[t, i]) for t in [r["tracklet"] for r in self.n] for i in self.ids if (t, i) in self.assigned):
            pass


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_solver_propagates_like_plain_recursion(seed):
    r = np.random.default_rng(seed)
    k, ids = 14, ["A", "B", "C"]
    fi = r.integers(1, 40, k)
    nodes = pd.DataFrame({"tracklet": np.arange(k), "colony": 0, "fi": fi, "ff": fi + r.integers(0, 12, k), "single": r.random(k) < 0.6})
    edges = [(a, b) for a in range(k) for b in range(k) if nodes["fi"][b] > nodes["ff"][a] and r.random() < 0.25]
    c, plain = sv.Colony(nodes, pd.DataFrame(edges, columns=["src", "dst"]), ids), Plain(nodes, edges, ids)
    at = {t: n for n, t in enumerate(c.nodes["tracklet"])}
    for t, i in zip(r.permutation(k)[:5], r.integers(0, 3, 5), strict=True):
        assert c.assign(at[t], int(i), float(t)) == plain.assign(t, ids[i], float(t))
    c.sweep()
    plain.sweep()
    number = {n: t for t, n in at.items()}
    assert {(number[n], ids[i]): c.score[n, i] for n, i in zip(*np.nonzero(c.assigned), strict=True)} == plain.assigned
    assert {(number[n], ids[i]) for n, i in zip(*np.nonzero(c.possible), strict=True)} == plain.possible


def test_solver_follows_the_parents_side_first():
    # 3 comes from 1 and leads to 4; by the parent's path 1 -> 2 -> 4's rival the id is taken before the child is looked at
    nodes = pd.DataFrame({"tracklet": [1, 2, 3], "colony": 0, "fi": [1, 11, 5], "ff": [4, 20, 10], "single": [False, True, True]})
    edges = pd.DataFrame({"src": [1, 1, 3], "dst": [3, 2, 2]})
    c = sv.Colony(nodes, edges, ["A"])
    c.assign(1, 0, 1.0)
    assert c.assigned[:, 0].tolist() == [True, True, True]


def test_solver_takes_manual_commands():
    nodes, edges, pairs, gone, _ = diamond()
    said = pd.DataFrame({"command": ["assign", "single", "eliminate"], "tracklet": [5, 3, 4], "value": ["A", "0", "A"], "line": [1, 2, 3]})
    r = sv.solve_colony(nodes, edges, pairs, gone, said, ["A", "B"])
    got = {(t, i): s for t, i, a, s in zip(r["tracklet"], r["id"], r["assigned"], r["score"], strict=True) if a}
    assert got[5, "A"] == math.inf and (4, "A") not in got and got[4, "B"] == 4.0
    groups = nodes.assign(score=1.0)
    unsafe = sv.solve_colony(groups, edges, pairs, pd.DataFrame({"tracklet": [1], "id": ["A"]}), NO_COMMANDS, ["A", "B"], safe=False)
    assert (1, "A") in {(t, i) for t, i, a in zip(unsafe["tracklet"], unsafe["id"], unsafe["assigned"], strict=True) if a}


def test_solve_groups_are_solved_apart(spark):
    nodes, edges, *_ = diamond()
    n = spark.createDataFrame(nodes.assign(grp=[0, 0, 0, 1, 1]))
    e = spark.createDataFrame(edges)
    pairs, gone = spark.createDataFrame([], "src long, dst long, hops long"), spark.createDataFrame([], "tracklet long, id string")
    s = {(r["tracklet"], r["id"]) for r in sv.solve(n, e, pairs, gone, ["A", "B"]).where("assigned").collect()}
    assert s == {(1, "A"), (2, "B"), (3, "A"), (3, "B"), (4, "A")}
    told = spark.createDataFrame([("assign", 5, "B", 1)], "command string, tracklet long, value string, line long")
    s = {(r["tracklet"], r["id"]) for r in sv.solve(n, e, pairs, gone, ["A", "B"], commands=told).where("assigned").collect()}
    assert (5, "B") in s


def test_solver_invariants(spark):
    from trailmark.plans.graph_queries import solve

    from tests.oracle import SMALL

    s = solve(spark, SMALL)
    assert s.where("assigned and not possible").count() == 0
    from trailmark import fixtures as fx

    from trailmark.plans.graph_queries import GROUP

    t = fx.tracklets(spark, SMALL).select("tracklet", "fi", "ff")
    grp = F.floor((F.col("fi") - 1) / GROUP).cast("string")
    a = s.where("assigned").join(t, "tracklet").withColumn("g", F.concat_ws(":", F.col("colony").cast("string"), grp, "id")).select("g", "tracklet", "fi", "ff")
    assert iv.overlaps(a, on="g").count() == 0


def test_counts_through_a_diamond(spark):
    n = spark.createDataFrame([(1, 1.0, True), (2, 1.0, True), (3, 9.0, False), (4, 1.0, True), (5, 2.0, False), (6, 0.0, False)], "tracklet long, area double, single boolean")
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (3, 5)], "src long, dst long")
    assert values(ct.infer_counts(n, e, small=0.5), "tracklet", "nants") == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (6, 0)]


def test_counts_split_diamonds_alike(spark):
    n = spark.createDataFrame([(1, 1.0, True), (2, 1.0, True), (3, 9.0, False), (4, 9.0, False), (5, 9.0, False), (6, 9.0, False)], "tracklet long, area double, single boolean")
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6)], "src long, dst long")
    assert values(ct.infer_counts(n, e, small=0.5), "tracklet", "nants") == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1), (6, None)]


def test_prune_drops_late_roots_and_early_leaves(spark):
    k = 12
    nodes = spark.createDataFrame([(i, 1, 10 * i, 10 * i + 9) for i in range(k)] + [(1000, 1, 50, 59), (1001, 1, 80, 89)], "tracklet long, colony long, fi long, ff long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(k - 1)] + [(1000, 7), (3, 1001)], "src long, dst long")
    parts = nodes.select("tracklet", F.lit(0).cast("long").alias("component"))
    assert values(gr.prune_components(parts, nodes, edges, margin=5), "tracklet") == [(i,) for i in range(k)]


def test_bottleneck_diamond(spark):
    n = spark.createDataFrame([(1, 0, 1, 5), (2, 0, 1, 5), (3, 0, 6, 10), (4, 0, 11, 15), (5, 0, 11, 15), (6, 0, 16, 20)], "tracklet long, colony long, fi long, ff long")
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6)], "src long, dst long")
    assert values(gr.bottleneck_pairs(n, e), "src", "dst", "hops") == [(3, 6, 2)]


def test_sets_and_samples(spark):
    d = spark.createDataFrame([("a", i, 10) for i in range(20)], "k string, i long, n long")
    assert sm.sample_n(d, ["k"], "i", 6).count() == 6
    assert sm.sample_until(d, ["k"], "i", "n", 35).count() == 4
    assert sm.split_share(d, ["k"], "i", 0.8).where("train").count() == 16
    assert [r["part"] for r in sm.divide(d, "i", 3).groupBy("part").count().orderBy("part").collect()] == [1, 2, 3]


def test_texts_of_all_forms(spark):
    """The odd forms of movie lists, times, properties and options; the queries read theirs off the tables."""
    movies = spark.createDataFrame([(m, 24 * m - 23, 24 * m, 24) for m in range(1, 31)], "m long, fi long, ff long, nframes long")
    lists = spark.createDataFrame([(x,) for x in ("4", "3,5,6", "1-5,7", "9,2-3,2")], "t string")
    assert [r[0] for r in lists.select(names.movies_of(F.col("t"))).collect()] == [[4], [3, 5, 6], [1, 2, 3, 4, 5, 7], [2, 3, 9]]
    times = spark.createDataFrame([("start", "end"), ("f400", "f450"), ("m3", "m3"), ("m3f10", "m4f2"), ("oops", "m99")], "from string, to string")
    assert {(r["from"], r["fi"], r["ff"]) for r in names.parse_times(times, movies).collect()} == {("start", 1, 720), ("f400", 400, 450), ("m3", 49, 72), ("m3f10", 58, 74), ("oops", None, None)}
    lines = spark.createDataFrame([(x,) for x in ("single trj_1 1", "# note", "", "Assign  trj_2 B G", "ELIMINATE trj_3 BG, OP")], "line string")
    assert values(names.parse_properties(lines), "command", "tracklet", "value") == [("assign", "trj_2", "BG"), ("eliminate", "trj_3", "BG,OP"), ("single", "trj_1", "1")]
    options = spark.createDataFrame([("a=1, b=x,c=2.5",)], "t string").select(names.parse_options(F.col("t"))).first()[0]
    assert options == {"a": "1", "b": "x", "c": "2.5"}
    assert names.all_possible_ids(spark.createDataFrame([("B",), ("G",), ("G",)], "colour string")).count() == 4


def test_known_rows_do_not_meet_their_tracklets_frame_by_frame(spark):
    from trailmark.plans.extra_queries import known_rows

    plan = known_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of tracklets with their areas
