"""Operators that work in blocks of frames give the same whatever the size of a block."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import blocks, intervals, sampling
from trailmark.operators import sampling as sm
from trailmark.operators import trajectory as tr
from trailmark.operators import untagged as ug
from trailmark.streaming.lifecycle import tracking_dt


@pytest.fixture
def dense(spark):
    r = np.random.default_rng(5)
    rows = []
    for ant in ("a", "b"):
        x = np.cumsum(r.normal(size=(60, 2)), axis=0)
        gone = (r.random(60) < 0.4) | (np.arange(60) > 54)
        rows += [(ant, i + 1, *(None if gone[i] else float(v) for v in x[i]), bool(r.random() < 0.5)) for i in range(60)]
    return spark.createDataFrame(rows, "ant string, frame long, x double, y double, outside boolean")


JOBS = {
    "speed": lambda d: tr.step_speed(d),
    "inside": lambda d: tr.interpolate(d),
    "clamped": lambda d: tr.interpolate(d, ends="clamp"),
    "gaps": lambda d: tr.interpolate_gaps(d.withColumn("ass_type", F.lit(1)), max_frames=4, max_distance=3.0),
    "kinematics": lambda d: tr.kinematics(tr.interpolate(d), dt=0.5),
    "stops": lambda d: tr.stops(tr.step_speed(tr.interpolate(d)), 4, 1.5),
    "segments": lambda d: tr.segments(d, "outside"),
    "onsets": lambda d: tr.onsets(d.where("ant = 'a'"), F.col("x") > 0),
    "smooth": lambda d: tr.smooth_by_movie(tr.nest(d), ["nest_x"], 5),
    "power": lambda d: tr.antenna_power(tr.interpolate(d).select("ant", "frame", F.col("x").alias("a1"), F.col("y").alias("a2")), 5),
    "dt": lambda d: tracking_dt(d.where("ant = 'b' and frame % 3 > 0").select("frame", F.col("x").alias("timestamp"), F.col("y").alias("dt")), fps=10.0),
    "movies": lambda d: intervals.frame_to_movie(d.where("ant = 'a'").select("frame"), d.sparkSession.createDataFrame([(1, 3), (2, 30), (3, 57)], "m long, fi long"), open_end=True),
}


def rows(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_blocks_do_not_show(dense, monkeypatch, name):
    want = rows(JOBS[name](dense))
    for f in (blocks.block_of, blocks.with_halo, blocks.own_rows, blocks.known_neighbours, blocks.running_count):
        monkeypatch.setattr(f, "__defaults__", tuple(7 if v == blocks.BLOCK else v for v in f.__defaults__))
    monkeypatch.setattr("trailmark.streaming.lifecycle.BLOCK", 7)
    assert rows(JOBS[name](dense)) == want and want


def test_no_plan_gathers_all_rows(dense, capsys):
    """Keyless windows stand over one row per block only."""
    for name in ("onsets", "smooth"):
        JOBS[name](dense).explain()
        assert "SinglePartition" not in capsys.readouterr().out


def test_speed_against_numpy(dense):
    d = dense.where("ant = 'a'").orderBy("frame").toPandas()
    v = np.hypot(d["x"].diff(), d["y"].diff()).to_numpy()
    got = np.array([np.nan if r["v"] is None else r["v"] for r in tr.step_speed(dense).where("ant = 'a'").orderBy("frame").collect()])
    assert np.allclose(got, v, equal_nan=True)


def test_global_difference_orders_by_another_column(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 3.0), (40, 9.0), (41, None), (90, 1.0)], "frame long, t double")
    got = [r["dt"] for r in sampling.global_difference(d, "t", "frame", 10, order="frame").orderBy("frame").collect()]
    assert got == [None, -2.0, 6.0, None, None]


def test_ranks_inside_a_hot_key(spark):
    """Carried ranks and sums equal those of one window over each group, with null keys, ties, null sizes and a group of most rows."""
    rows = [("hot" if i % 3 else "b" if i % 6 else None, None if i % 97 == 0 else i // 2 if i % 5 == 0 else i, None if i % 11 == 0 else i % 13, i) for i in range(6000)]
    d = spark.createDataFrame(rows, "g string, i long, n long, row long")
    order = sm.shuffled("i")
    ties = d.groupBy("g", "i").agg(F.max("n").alias("n"))  # one row per place, so that running sums are defined
    whole = Window.partitionBy("g").orderBy(*order)
    cum = F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    want = ties.withColumn("cum", cum).where(F.col("cum") - F.col("n") < 900)
    assert sorted(map(tuple, sm.sample_until(ties, ["g"], "i", "n", 900).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    want = d.withColumn("train", F.percent_rank().over(whole) < 0.8)
    assert sorted(map(tuple, sm.split_share(d, ["g"], "i", 0.8).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    r = F.row_number().over(Window.partitionBy("g").orderBy("row"))
    want = d.withColumn("r", r).where("r >= 4 and (r - 4) % 7 = 0").drop("r")
    assert sorted(map(tuple, sm.stride(d, ["g"], "row", first=4, skip=7, block=50).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    z = {x["row"]: x["z"] for x in ug.zscore(d, "n", ["g"]).collect()}
    for x in d.withColumn("z", F.try_divide(F.col("n") - F.avg("n").over(Window.partitionBy("g")), F.stddev_pop("n").over(Window.partitionBy("g")))).collect():
        assert (z[x["row"]] is None) == (x["z"] is None) and (x["z"] is None or abs(z[x["row"]] - x["z"]) < 1e-9)
    none = d.limit(0)
    assert sm.sample_until(none, ["g"], "i", "n", 5).count() == sm.split_share(none, ["g"], "i", 0.5).count() == sm.stride(none, ["g"], "row", first=1, skip=2).count() == 0


def test_tables_per_frame_are_not_broadcast(spark):
    """The planner sees one row where an explode makes many; joins with such a table keep it out of broadcasts."""
    from trailmark.operators import intervals as iv
    from trailmark.operators import pose as ps
    from trailmark.operators import solve as sv
    from trailmark.operators import tracks as tk
    from trailmark.operators import untagged as ug

    t = spark.range(40).selectExpr("id as tracklet", "id % 3 as colony", "id + 1 as fi", "id + 9 as ff", "'A1' as label", "true as single", "true as source", "true as assigned", "true as exported", "'A1' as id")
    rows = t.selectExpr("tracklet", "colony", "explode(sequence(fi, ff)) as frame").selectExpr("*", "tracklet / 50D as x", "frame / 50D as y")
    points = t.selectExpr("tracklet", "fi + 3 as frame")
    pose = rows.join(t.select("tracklet", "fi"), "tracklet").selectExpr("tracklet", "frame - fi as ix", "'head' as bodypart", "x", "y")
    found = {
        "value_at": tk.value_at(rows, points, "x"),
        "positions_at": tk.positions_at(rows.withColumnRenamed("tracklet", "target"), points.selectExpr("tracklet as target", "frame", "2 as offset"), ["x"]),
        "dyadic_join": iv.dyadic_join(t.select("tracklet", "colony", "fi", "ff"), t.selectExpr("colony", "fi", "ff + 500 as ff"), ["colony"]),
        "overlaps": iv.overlaps(t),
        "blob_mates": ug.blob_mates(rows, near=0.1, scale=1.0, key=("colony", "frame")),
    }
    for name, df in found.items():
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
        assert df.count() > 0
    # here small tables are joined too, and may be sent
    found = {
        "export_xy": (1, sv.export_xy(t.select("tracklet", "colony", "id", "assigned", "exported"), t.select("tracklet", "fi", "single", "source"), rows)),
        "frame_tracklet_data": (2, ps.frame_tracklet_data(rows.select("tracklet", "frame"), t, t.select("tracklet", "label"), pose)),
    }
    for name, (least, df) in found.items():
        assert df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [") >= least, name
        assert df.count() > 0


def test_blob_mates_meet_over_cells(spark):
    """Counts against all pairs, with places on the borders of cells, missing places, and frames of one animal."""
    import itertools
    import math

    from trailmark.operators import untagged as ug

    at = [(i, 1, i % 4, None if i % 17 == 0 else (i * 37 % 50) / 20 - 1, (i * 11 % 40) / 20 - 1) for i in range(120)] + [(900, 2, 1, 0.4, 0.4)]
    rows = spark.createDataFrame(at, "tracklet long, colony long, frame long, x double, y double")
    got = {r["tracklet"]: (r["n_in_blob"], r["frac_in_blob"]) for r in ug.blob_mates(rows, near=0.1, scale=1.0, key=("colony", "frame")).collect()}
    n, of = dict.fromkeys(got, 0), dict.fromkeys(got, 0)
    for a, b in itertools.product(at, at):
        if a[1:3] == b[1:3]:
            of[a[0]] += 1
            n[a[0]] += a[3] is not None and b[3] is not None and math.hypot(a[3] - b[3], a[4] - b[4]) < 0.1
    assert len(got) == len(at) and all(got[k] == (n[k], n[k] / of[k]) for k in got)


def test_orientation_of_many_tracklets_at_once(spark):
    """Sequences of all lengths, with missing values, beside one at a time; batches end inside tracklets, and ids may be null."""
    import numpy as np

    from trailmark.operators import kernels as kn

    rng = np.random.default_rng(3)
    size = rng.integers(1, 40, 60)
    first, n = np.r_[0, np.cumsum(size)[:-1]], int(size.sum())
    orient, ecc, speed, move = rng.uniform(-3, 3, n), rng.uniform(0, 1, n), rng.uniform(0, 0.01, n), rng.uniform(-3, 3, n)
    speed[first] = move[first] = np.nan
    orient[rng.integers(0, n, 20)] = np.nan
    many = kn.fix_orientation_many(orient, ecc, speed, move, first)
    one = np.concatenate([kn.fix_orientation(*(v[a : a + s] for v in (orient, ecc, speed, move))) for a, s in zip(first, size, strict=True)])
    assert np.array_equal(many, one, equal_nan=True)

    rows = spark.range(300).selectExpr("if(id % 6 = 0, null, id % 6) as tracklet", "id as frame", "id * 37 % 50 / 50D as x", "id * 11 % 50 / 50D as y", "id % 7 - 3D as orient", "id % 10 / 10D as eccentricity", "100D as dt")
    whole = sorted(kn.fix_orientations(rows).collect(), key=str)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(kn.fix_orientations(rows).collect(), key=str) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(whole) == 300 and sum(r["tracklet"] is None for r in whole) == 50


def test_arena_features_shuffle_positions_only(spark):
    """Two shuffles, by frame and by tracklet, neither of which carries a feature or is joined back."""
    from trailmark.operators import untagged as ug

    rows = spark.range(200).selectExpr("id % 20 as tracklet", "id % 2 as colony", "id div 20 as frame", "id * 37 % 50 / 50D as x", "id * 11 % 50 / 50D as y", "1D as area", "0D as theta", "0.1D as dt")
    grid = spark.range(1).selectExpr("id as cx", "id as cy", "1D as wall", "0D as wall_angle", "1D as openwall", "0D as openwall_angle")
    f = ug.derivative_features(ug.arena_features(rows, grid, cell=1.0, centre=(0.5, 0.5), scale=0.02, key=("colony", "frame")), ["dist_median", "angle_center"])
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan
    assert f.count() == 200


def test_frame_loop_takes_rows_as_lists(spark, monkeypatch):
    """No table is made or sorted per frame; few points are clustered as many are."""
    import numpy as np
    import pandas as pd

    from trailmark.streaming import tracking as tf

    rng = np.random.default_rng(5)
    frame = np.repeat(np.arange(400), 6)
    rows = pd.DataFrame({"frame": frame, "blob": np.tile(np.arange(6)[::-1], 400), "x": rng.uniform(0, 1, 2400), "y": rng.uniform(0, 1, 2400), "area": 1.0, "dt": 1.0, "boundary": rng.integers(0, 2, 2400) == 1})
    rules = tf.Rules(max_speed=0.1, reach=0.15, area=0.5, longest=9, open_boundary=True)
    sorts, plain = [], pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda self, *a, **k: sorts.append(1) or plain(self, *a, **k))
    few = tf.run_frames(tf.Movie(), rows, rules, to_the_end=True)
    assert len(sorts) <= 1 and sum(r[-1] for r in few if r[0] == "tracklet") == len(rows)
    monkeypatch.setattr(tf, "FEW", 0)
    assert tf.run_frames(tf.Movie(), rows, rules, to_the_end=True) == few
