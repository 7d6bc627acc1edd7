"""What is read, sorted and sent again must not grow with the number of rounds, nor rows per frame be sorted for a join with their tracklets."""

import pandas as pd
import pytest

from tests.oracle import SMALL, check
from trailmark import plans
from trailmark.operators import blocks
from trailmark.operators import export as ex
from trailmark.operators import graph as gr
from trailmark.operators import solve as sv
from trailmark.sources import files as fl


@pytest.fixture
def planned(spark):
    """The physical plan of a query whose tables are too large to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: plans.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_links_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    links = spark.range(20).selectExpr("id as src", "id + 1 as dst").mapInPandas(counted, "src long, dst long")
    assert gr.hop_distance(links, 5).count() == 20 + 19 + 18 + 17 + 16
    assert seen.value <= 40  # a checkpoint evaluates its rows twice at most


def test_pruning_works_links_out_once(spark, monkeypatch):
    from trailmark.plans import graph_queries as gq

    made = []
    monkeypatch.setattr(gr, "weak_components", lambda t, e: made.append(e) or t.selectExpr("tracklet", "tracklet as component"))
    monkeypatch.setattr(gr, "prune_components", lambda parts, t, e: e)
    gq.cc_prune(spark, SMALL)
    assert "Join" not in made[0]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["scan_pose", "export_untagged"])
def test_rows_are_not_sorted_for_their_tracklets(planned, name):
    assert "ShuffledHashJoin" in planned(name)


def test_first_positions_only(planned):
    assert planned("nearest_blob").count("SortMergeJoin") <= 1


@pytest.mark.parametrize("name", ["weighted_mean", "weighted_median", "nest_untagged", "export_trx", "collective_measures"])
def test_rows_are_dealt_out_by_number(planned, name):
    assert "REPARTITION_BY_NUM" in planned(name)


def test_ant_frames_over_blocks(spark, monkeypatch):
    """No dense axis is joined; blocks without a row, rows outside the axis and a row at a block's first frame."""
    monkeypatch.setattr(ex, "BLOCK", 10, raising=False)
    monkeypatch.setattr(ex, "block_of", lambda c: blocks.block_of(c, 10), raising=False)
    table = spark.createDataFrame([("a", 1, 0, 10, True), ("a", 2, 30, 31, False), ("b", 3, 90, 95, True)], "ant string, tracklet long, fi long, ff long, single boolean")
    rows = spark.createDataFrame([(t, f, f / 10, 0.0, 5.0) for t, lo, hi in ((1, 0, 10), (2, 30, 31), (3, 90, 95)) for f in range(lo, hi + 1)], "tracklet long, frame long, x double, y double, area double")
    df = ex.ant_frames(3, 45, table, rows)
    assert "Join LeftOuter" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["ant"], r["frame"]): r["x"] for r in df.collect()}
    assert sorted(got) == [(a, f) for a in "ab" for f in range(3, 46)]
    assert {k: v for k, v in got.items() if v is not None} == {("a", f): f / 10 for f in (*range(3, 11), 30, 31)}


def test_folders_not_asked_for_are_not_listed(spark, tmp_path):
    path = str(tmp_path / "xy")
    fl.write_xy(spark.createDataFrame([(1, "final", 1, 0.5), (2, "final", 1, 0.6), (2, "untagged", 3, 0.7)], "colony long, type string, m long, x double"), path)
    stray = tmp_path / "xy" / "type=untagged" / "other=1" / "deep=2"
    stray.mkdir(parents=True)
    (stray / "part-0.parquet").write_bytes(b"not a table")
    assert [(r["colony"], r["m"], r["x"]) for r in fl.read_xy(spark, path, colony=2, movies=[1, 7]).collect()] == [(2, 1, 0.6)]


def test_none_of_the_folders(spark, tmp_path):
    path = str(tmp_path / "xy")
    fl.write_xy(spark.createDataFrame([(1, "final", 1, 0.5)], "colony long, type string, m long, x double"), path)
    assert fl.read_xy(spark, path, colony=9).count() == 0


def test_components_in_node_order():
    nodes = pd.DataFrame({"tracklet": [7, 3, 5], "fi": [0, 0, 4], "ff": [3, 3, 6]})
    c = sv.Colony(nodes, pd.DataFrame({"src": [7], "dst": [5]}), ["A"])
    assert sorted(c.components(0)) == [[0], [1, 2]]


@pytest.mark.parametrize("name", ["ant_frames", "collective_measures", "weighted_mean", "nest_untagged"])
def test_at_sf001(spark, name):
    check(spark, plans.queries()[name], plans.oracle_sql()[name], "/root/testdata/sf0.01")


def test_soft_assignment_joins_no_rows_of_frames_and_no_whole_state(planned):
    plan = planned("soft_assign")
    assert "explode" not in plan and plan.count("sequence(") == 0


def test_solver_reads_written_links(spark, monkeypatch):
    from trailmark.plans import graph_queries as gq

    made = []
    monkeypatch.setattr(gr, "bottleneck_pairs", lambda t, e: made.extend([t, e]) or e)
    gq._to_solve(spark, SMALL)
    assert all("Join" not in d._jdf.queryExecution().optimizedPlan().toString() for d in made)


def test_bottlenecks_join_frames_once(spark, monkeypatch):
    from trailmark.operators import graph

    calls = []
    join = graph.overlap_join
    monkeypatch.setattr(graph, "overlap_join", lambda *a, **k: calls.append(1) or join(*a, **k))
    t = spark.createDataFrame([(i, 0, 3 * i, 3 * i + 2) for i in range(6)], "tracklet long, colony long, fi long, ff long")
    gr.bottleneck_pairs(t, spark.createDataFrame([(i, i + 1) for i in range(5)] + [(0, 2)], "src long, dst long"))
    assert len(calls) == 1 and not hasattr(graph, "overlaps")
