"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import negatives


def brute(rows, anchors):
    sound = [(k, str(g), [math.floor(256 * float(x)) for x in v]) for k, v, g, _ in rows if k is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (a, g, v) in enumerate(sound):
        if not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), k, h) for j, (k, h, w) in enumerate(sound) if j != i and len(w) == len(v)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == g][:5]:
            inside = [(k, t) for t, k, h in scored if h != g and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, n + 1, k, -s, -t) for n, (k, t) in enumerate(inside)]
    return sorted(out)


def rows_of(seed, n=400, dim=7):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = [(i, [x + r.gauss(0, 0.4) for x in centres[i % 5]], "abc"[r.randrange(3)], 1) for i in range(n)]
    out += [(n + i, out[3][1], "a", 1) for i in range(30)] + [(n + 40, out[3][1], "b", 2), (n + 41, [0.0] * dim, "a", 2), (10, out[7][1], "c", 1)]
    return out + [(n + 50, None, "a", 1), (n + 51, [math.nan] * dim, "a", 1), (n + 52, out[0][1], None, 1), (None, out[0][1], "a", 1), (n + 53, [1.0, None], "b", 1), (n + 60, [1.0, 2.0], "b", 1), (n + 70, [], "b", 1), (n + 80, [], "c", 1)]


def run(spark, rows, step=10, **sizes):
    df = spark.createDataFrame([(k, v, g, x) for k, v, g, x in rows], "vec_id long, embedding array<double>, label string, node int").repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % step == 0, **sizes).collect())


def test_against_brute_force(spark):
    rows = rows_of(1)
    want = brute(rows, lambda k: k % 10 == 0)
    assert len(want) > 100
    assert run(spark, rows) == want
    assert run(spark, rows, tile=60, block=7) == want


def test_numbers_as_labels_and_no_rows(spark):
    rows = [(i, [0.1 * (i % 7), 0.3], i % 2, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, t int")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    as_float = [(k, [float(np.float32(x)) for x in v], g, t) for k, v, g, t in rows]
    assert got == brute(as_float, lambda k: k % 10 == 0)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(2)
    q = rng.integers(-200, 200, (700, 11))
    q[::3] = q[0] + rng.integers(-3, 3, (234, 11))
    centroids = negatives.fit_centroids(q[:300].tolist())
    codes, left = negatives.coded(q, centroids)
    row = {"dim": 11, "labels": ["x"] * 700, "ids": np.arange(700).tobytes(), "nodes": np.arange(700).tobytes(), "q": q.astype(np.int32).tobytes(), "codes": codes.tobytes(), "left": left.tobytes()}
    row |= {"a_labels": ["x"] * 5, "a_ids": np.arange(5).tobytes(), "a_nodes": np.arange(5).tobytes(), "a_q": q[:5].astype(np.int32).tobytes(), "a_scores": [[]] * 5}
    met = negatives.Met(row, centroids)
    for i in range(5):
        lower, upper = met.bounds(i)
        exact = q @ q[i]
        assert (lower <= exact).all() and (exact <= upper).all()
    assert len(list(negatives.positives_of(met, 3))) == 5
    assert met.seen < 5 * 700 / 4
