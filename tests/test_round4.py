"""Whole results, and what must not grow faster than the input: rows per frame are not sent where their tracklets can be, folders do not follow colonies."""

import math
import random
from itertools import accumulate

import pandas as pd
import pytest

from tests.oracle import SMALL
from tests.test_growth import planned  # noqa: F401
from trailmark import plans
from trailmark.operators import blocks
from trailmark.operators import pose as ps
from trailmark.operators import solve as sv
from trailmark.operators import trajectory as tr
from trailmark.operators import untagged as ug
from trailmark.plans import untagged_queries as uq
from trailmark.sources import files as fl


def middle(pairs):
    """The weighted median of (value, weight), one after the other."""
    pairs = sorted(p for p in pairs if p[1] is not None)
    if not pairs:
        return None
    half, run = sum(w for _, w in pairs) / 2, list(accumulate(w for _, w in pairs))
    if max(w for _, w in pairs) > half:
        return max(pairs, key=lambda p: p[1])[0]
    before = [i for i, c in enumerate(run) if c <= half]
    if not before:
        return pairs[0][0]
    i = before[-1]
    return (pairs[i][0] + pairs[i + 1][0]) / 2 if run[i] == half else pairs[i + 1][0]


def test_nest_has_both_medians(spark):
    """The place of a nest is a point: x and y, each the weighted median of its own."""
    assert plans.queries()["nest_untagged"](spark, SMALL).columns == ["colony", "frame", "medx", "medy", "total_area", "majmax"]
    rng = random.Random(4)
    rows = [(1, f, rng.random(), rng.random(), None if rng.random() < 0.2 else float(rng.randint(1, 9))) for f in range(40) for _ in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "colony long, frame long, x double, y double, area double").selectExpr("*", "sqrt(area) as majax")
    got = {r["frame"]: r for r in ug.nest(df, ["colony", "frame"]).collect()}
    assert len(got) == 40
    for f, r in got.items():
        mine = [p for p in rows if p[1] == f]
        for c, i in (("medx", 2), ("medy", 3)):
            want = middle([(p[i], p[4]) for p in mine])
            assert (r[c] is None) == (want is None) and (want is None or math.isclose(r[c], want))


@pytest.mark.parametrize("name", ["nest_untagged", "weighted_median", "weighted_mean", "jaaba_features"])
def test_rows_of_frames_are_not_sent(planned, name):
    """Pieces of tracklets are dealt out; what is above the explode needs no other exchange."""
    plan = planned(name)
    assert "Exchange" not in plan[: plan.index("explode(sequence(fi")]


def groups_to_solve(spark):
    """Nodes of many small groups, one of them without a colony, and their links."""
    n = spark.range(60).selectExpr("id as tracklet", "if(id % 6 = 5, null, id % 6) as colony", "id div 6 * 10 as fi", "id div 6 * 10 + 9 as ff", "10L as len", "if(id % 7 = 0, null, 1D) as area", "if(id % 4 = 0, 'A', if(id % 4 = 1, 'B', 'Unknown')) as label", "if(id % 9 = 0, null, id / 60D) as score", "true as single", "false as noant", "id div 30 as grp")
    e = spark.range(54).selectExpr("id as src", "id + 6 as dst").where("src % 11 > 0")
    return n, e, spark.createDataFrame([(0, 12, 2)], "src long, dst long, hops long"), spark.createDataFrame([(6, "A")], "tracklet long, id string")


def test_groups_are_solved_without_a_table_each(spark):
    """Groups reach the kernel in batches of many, and one that batches cut is whole again."""
    n, e, p, r = groups_to_solve(spark)
    df = sv.solve(n, e, p, r, ["A", "B"])
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
    want = []
    t, links, pairs, gone = (d.toPandas() for d in (n, e, p, r))
    for _, g in t.groupby(["colony", "grp"], dropna=False):
        inside = links[links["src"].isin(g["tracklet"])]
        want.append(sv.solve_colony(g, inside, pairs[pairs["src"].isin(g["tracklet"])], gone, pd.DataFrame(columns=["command", "tracklet", "value", "line"]), ["A", "B"]))
    told = lambda rows: sorted(((None if c is None or c != c else int(c), int(t), x, bool(a), bool(b), None if s is None or s != s else s, bool(f)) for c, t, x, a, b, s, f in rows), key=str)
    want = sorted((x for w in want for x in told(w.itertuples(index=False))), key=str)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in (size, 1, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert sorted(told(map(tuple, df.collect())), key=str) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert any(x[0] is None for x in want) and any(x[4] for x in want)


def test_folders_do_not_follow_colonies(spark, tmp_path):
    """Colonies share folders, and are replaced and read one by one all the same."""
    path, schema = str(tmp_path / "xy"), "colony long, type string, m long, x double"
    fl.write_xy(spark.createDataFrame([(c, t, m, c / 1000) for c in range(200) for t in ("final", "untagged") for m in (0, 1)] + [(None, "final", 0, 7.0)], schema), path)
    assert sum(1 for f in (tmp_path / "xy").rglob("m=*")) <= 2 * 2 * fl.FOLDERS
    assert len(list((tmp_path / "xy").rglob("*.parquet"))) <= 2 * 2 * fl.FOLDERS
    fl.write_xy(spark.createDataFrame([(5, "final", 1, 9.0), (900, "final", 1, 8.0), (None, "final", 0, 6.0)], schema), path)
    got = sorted((tuple(r) for r in fl.read_xy(spark, path).select("colony", "m", "x").collect()), key=str)
    want = [(c, m, 9.0 if (c, m) == (5, 1) else c / 1000) for c in range(200) for m in (0, 1)] + [(900, 1, 8.0), (None, 0, 6.0)]
    assert got == sorted(want, key=str)
    assert fl.read_xy(spark, path, type="untagged").count() == 400
    assert [r["x"] for r in fl.read_xy(spark, path, colony=5, movies=[1]).collect()] == [9.0]
    assert fl.read_xy(spark, path, colony=6, movies=[1]).columns == fl.read_xy(spark, path).columns


def test_graphs_of_named_colonies(spark, tmp_path):
    path = str(tmp_path / "graph")
    nodes = spark.createDataFrame([(i, f"c{i % 50}", i % 3) for i in range(300)], "tracklet long, colony string, m long")
    edges = spark.createDataFrame([(f"c{i % 50}", i % 3, i, i + 150) for i in range(150)], "colony string, m long, src long, dst long")
    fl.write_graph(path, nodes, edges)
    fl.write_graph(path, nodes.where("colony = 'c7' and m = 1"), edges.where("colony = 'c7' and m = 1 and src < 50"))
    assert sorted(r["tracklet"] for r in fl.read_graph(spark, path, "nodes", colonies=["c7", "c8"]).collect()) == [i for i in range(300) if i % 50 in (7, 8)]
    left = [i for i in range(150) if not (i % 50 == 7 and i % 3 == 1 and i >= 50)]
    assert sorted(r["src"] for r in fl.read_graph(spark, path, "edges").collect()) == left
    assert len(list((tmp_path / "graph" / "nodes").rglob("*.parquet"))) <= 3 * fl.FOLDERS


def test_pieces_hold_every_frame_once(spark):
    """Frames of a span in their own blocks, and the frame before a block once more in it; spans may begin and end at borders."""
    spans = [(1, 1, 0, 9), (2, 1, 9, 10), (3, 1, 10, 10), (4, 2, 5, 31), (5, 2, 29, 29), (6, 2, 30, 30), (7, 3, 8, 7)]
    df = spark.createDataFrame(spans, "tracklet long, colony long, fi long, ff long")
    for before in (0, 1):
        got = [tuple(r) for r in blocks.pieces(df, "colony", before=before, block=10).selectExpr("tracklet", "__b", "explode(sequence(fi, ff)) as frame").collect()]
        want = [(t, b, f) for t, _, lo, hi in spans for f in range(lo, hi + 1) for b in range(f // 10, (f + before) // 10 + 1)]
        assert sorted(got) == sorted(want)


def test_features_over_blocks(spark, monkeypatch):
    """Speeds at the first frame of a block look at the block before, and medians there at all of its tracklets."""
    want = plans.queries()["jaaba_features"](spark, SMALL).toPandas().sort_values(["tracklet", "frame"]).reset_index(drop=True)
    monkeypatch.setitem(blocks.pieces.__kwdefaults__, "block", 7)
    monkeypatch.setattr(uq, "SPAN", 7)
    got = plans.queries()["jaaba_features"](spark, SMALL).toPandas().sort_values(["tracklet", "frame"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_pose_meets_rows_where_they_are(spark):
    """Rows and pose that are dealt out by tracklet are not sent again; rows found twice stay, and parts that are missing are null."""
    t = spark.range(300).selectExpr("id as tracklet", "10 * id as fi", "if(id % 3 = 0, 'A1', 'Unknown') as label").repartition(6, "tracklet")
    rows = t.selectExpr("tracklet", "explode(sequence(fi, fi + 4)) as frame", "label")
    pose = t.selectExpr("tracklet", "explode(sequence(0L, 3L)) as ix").selectExpr("tracklet", "ix", "explode(array('head', 'tail')) as bodypart").selectExpr("*", "tracklet + ix / 8D as x", "if(bodypart = 'head', 1D, 2D) as y")
    pose = pose.where("not (bodypart = 'tail' and ix = 2)")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ps.frame_tracklet_data(rows.drop("label"), t, t.select("tracklet", "label"), pose, ants=["A1"], only_ants=True)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")
        got = {(r["tracklet"], r["frame"]): r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(got) == [(i, 10 * i + k) for i in range(0, 300, 3) for k in range(5)]
    for (i, f), r in got.items():
        k = f - 10 * i
        assert (r["frameix"], r["autoid"], r["x_head"], r["y_head"]) == (k, "A1", i + k / 8 if k < 4 else None, 1.0 if k < 4 else None)
        assert (r["x_tail"], r["y_tail"]) == ((i + k / 8, 2.0) if k < 4 and k != 2 else (None, None))
    twice = ps.frame_tracklet_data(rows.drop("label").union(rows.drop("label").where("tracklet = 3")), t, t.select("tracklet", "label"), pose)
    assert twice.where("tracklet = 3").count() == 10 and twice.count() == 1505
    with pytest.raises(ValueError):
        ps.assert_unique(twice, ["tracklet", "frame"])


def test_gaps_are_filled_without_frames_between(spark):
    """fill_gaps on rows of known places against interpolate_gaps on all frames, whole and in blocks with the frames ahead of them."""
    rng = random.Random(2)
    kept = [(a, f, rng.random(), rng.random(), rng.randint(1, 4), float(f)) for a in "ab" for f in range(1, 200) if rng.random() < 0.35 and not 60 < f < 75]
    schema = "ant string, frame long, x double, y double, ass_type int, area double"
    rows = spark.createDataFrame(kept, schema)
    seen = {k[:2] for k in kept}
    dense = spark.createDataFrame(kept + [(a, f, None, None, None, None) for a in "ab" for f in range(1, 200) if (a, f) not in seen], schema)
    want = sorted(map(tuple, tr.interpolate_gaps(dense, max_frames=4, max_distance=0.6).where("x is not null").collect()))
    assert sorted(map(tuple, tr.fill_gaps(rows, max_frames=4, max_distance=0.6).collect())) == want and len(want) > len(kept)
    pieces = blocks.with_halo(rows, 5, 0, 7)
    got = tr.fill_gaps(pieces, max_frames=4, max_distance=0.6, key=("ant", "__b"), block=7)
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == want


def test_exported_rows_are_not_sent(planned):
    plan = planned("export_xy")
    assert "Exchange" not in plan[: plan.index("explode(sequence(fi")]
