"""Counts of animals against whole sweeps over plain sets, and small cases."""

import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.operators import counts


def plain(nodes, edges, small):
    """Every rule as a loop over all nodes, until nothing changes."""
    rows = nodes.sort_values(["fi", "tracklet"]).to_dict("records")
    order = [r["tracklet"] for r in rows]
    par = {t: {a for a, b in edges if b == t} for t in order}
    chi = {t: {b for a, b in edges if a == t} for t in order}
    sib = {t: {x for x in order if x != t and par[x] & par[t]} for t in order}
    cop = {t: {x for x in order if x != t and chi[x] & chi[t]} for t in order}
    n, nan = {}, math.nan
    for r in rows:
        t = r["tracklet"]
        n[t] = 1 if r["single"] else nan
        if not par[t] and not chi[t] and r["area"] < small:
            n[t] = 0
        elif math.isnan(n[t]) and len(par[t]) <= 1 and len(chi[t]) <= 1 and r["area"] < small:
            n[t] = 1
    ok = lambda s: not any(math.isnan(n[x]) for x in s)
    add = lambda s: sum(n[x] for x in s)
    some = lambda s: sum(n[x] for x in s if not math.isnan(n[x]))
    ends = lambda s, of: set().union(*[of[x] for x in s])
    while True:
        before = dict(n)
        for r in rows:
            t = r["tracklet"]
            if r["touching"] or not math.isnan(n[t]):
                continue
            guess = []
            for side, beside in ((par, sib), (chi, cop)):
                if side[t] and not beside[t] and ok(side[t]):
                    guess.append(add(side[t]))
                elif side[t] and ok(side[t]) and ok(beside[t]) and ends(beside[t], side) == side[t]:
                    guess.append(add(side[t]) - add(beside[t]))
            if guess:
                n[t] = guess[0]
        if sum(math.isnan(x) for x in n.values()) == sum(math.isnan(x) for x in before.values()):
            break
    old = dict(n)
    for t in order:
        if math.isnan(old[t]):
            side = sib[t] | {t}
            top, low = ends(side, par), ends(side, chi)
            if side == cop[t] | {t} and ends(top, chi) == side == ends(low, par):
                a, b = sum(old[x] for x in top), sum(old[x] for x in low)
                n[t] = (b if math.isnan(a) else a) / len(side)
    out, into = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for r in rows:
        t = r["tracklet"]
        if not r["touching"] or not (par[t] or chi[t]):
            continue
        whole = {}
        rest = {}
        least = {}
        for k, side, beside in (("p", par, sib), ("c", chi, cop)):
            whole[k] = ok(side[t]) and ends(beside[t], side) | side[t] == side[t]
            x = add(side[t]) - add(beside[t])
            rest[k] = 1 if math.isnan(x) else max(1, x)
            least[k] = max(1, some(ends(beside[t], side)) - some(beside[t]))
        if not par[t]:
            n[t] = out[t] = rest["c"] if whole["c"] and ok(cop[t]) else least["c"]
        elif not chi[t]:
            n[t] = into[t] = rest["p"] if whole["p"] and ok(sib[t]) else least["p"]
        else:
            law = rest if whole["p"] and whole["c"] else least
            n[t], into[t], out[t] = law["p"], max(0, law["p"] - law["c"]), max(0, law["c"] - law["p"])
    return {t: (n[t], out[t], into[t]) for t in order}


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**7))
def test_like_plain_sweeps(seed):
    r = np.random.default_rng(seed)
    k = 14
    fi = r.integers(1, 8, k)
    nodes = pd.DataFrame({"tracklet": r.permutation(k), "fi": fi, "area": r.choice([0.5, 2.0, np.nan], k), "single": r.random(k) < 0.4, "touching": r.random(k) < 0.25})
    at = nodes.set_index("tracklet")
    edges = [(a, b) for a in range(k) for b in range(k) if at.fi[b] in (at.fi[a] + 1, at.fi[a] + 2) and r.random() < 0.4]
    got = counts.count_group(nodes, pd.DataFrame(edges, columns=["src", "dst"]).astype("int64"), 1.0)
    want = plain(nodes, edges, 1.0)
    for t, *x in got.itertuples(index=False):
        assert all(map(same, x, want[t])), (t, x, want[t])


def run(spark, rows, edges, small=1.0):
    n = spark.createDataFrame(rows, "tracklet long, fi long, area double, single boolean, touching boolean")
    e = spark.createDataFrame(edges, "src long, dst long")
    return {r["tracklet"]: (r["nants"], r["exits"], r["entrances"]) for r in counts.infer_counts(n, e, small=small).collect()}


def test_a_diamond_with_two_parents(spark):
    got = run(spark, [(1, 1, 9.0, True, False), (2, 1, 9.0, True, False), (3, 2, 9.0, False, False), (4, 2, 9.0, False, False), (5, 3, 9.0, False, False)], [(1, 3), (2, 3), (1, 4), (2, 4), (3, 5), (4, 5)])
    assert [got[t][0] for t in (3, 4, 5)] == [1.0, 1.0, None]


def test_flow_over_the_boundary(spark):
    # 1 comes out of the boundary and splits into three singles; 2 and 3 merge into 9, which goes back in
    rows = [(1, 1, 9.0, False, True), (2, 2, 9.0, True, False), (3, 2, 9.0, True, False), (4, 2, 9.0, True, False), (9, 3, 9.0, False, True), (10, 3, None, False, False), (11, 1, 0.5, False, False)]
    got = run(spark, rows, [(1, 2), (1, 3), (1, 4), (2, 9), (3, 9)])
    assert got[1] == (3.0, 3.0, 0.0) and got[9] == (2.0, 0.0, 2.0) and got[10] == (None, 0.0, 0.0) and got[11] == (0.0, 0.0, 0.0)


def test_order_decides_between_parents_and_children(spark):
    got = run(spark, [(1, 1, 9.0, True, False), (2, 2, 9.0, False, False), (3, 3, 9.0, True, False), (4, 3, 9.0, True, False)], [(1, 2), (2, 3), (2, 4)])
    assert got[2][0] == 1.0
    assert run(spark, [], []) == {}
