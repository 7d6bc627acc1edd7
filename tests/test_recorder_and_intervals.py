"""Recorder archives as a table, a stream and back; interval joins over a tree against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import intervals as iv
from trailmark.sources import files as fl
from trailmark.sources import recorder as rc


def test_cover_nodes_hold_the_range_once(spark):
    rng = random.Random(2)
    rows = [(lo, lo + rng.randint(0, 70)) for lo in range(-40, 41)] + [(0, 127), (-128, 127), (5, 5)]
    d = spark.createDataFrame(rows, "lo long, hi long").withColumn("c", iv.cover_nodes(F.col("lo"), F.col("hi"), 10))
    for r in d.collect():
        held = sorted(x for n in r["c"] for x in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert held == list(range(r["lo"], r["hi"] + 1)) and len(r["c"]) <= 16


@pytest.mark.parametrize("leaf", [1, 8, 500])
def test_dyadic_join_against_all_pairs(spark, leaf):
    rng = random.Random(leaf)
    span = lambda longest: (lambda f: (f, f + rng.randint(0, longest)))(rng.randint(-300, 900))
    a = [(i, rng.choice("xy"), *span(rng.choice([0, 5, 900]))) for i in range(80)] + [(90, "x", 10, 9), (91, "x", None, 5), (92, None, 1, 5)]
    b = [(i, rng.choice("xy"), *span(rng.choice([0, 30, 2000]))) for i in range(60)] + [(0, "x", 0, 5), (90, "y", 7, 6)]
    df = [spark.createDataFrame(t, "id long, k string, fi long, ff long") for t in (a, b)]
    got = sorted((r["id_a"], r["id_b"], r["fi_b"]) for r in iv.dyadic_join(*df, ["k"], leaf=leaf).collect())
    ok = lambda t: [r for r in t if None not in r and r[2] <= r[3]]
    assert got == sorted((p[0], q[0], q[2]) for p in ok(a) for q in ok(b) if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert iv.dyadic_join(df[0].where("false"), df[1], ["k"]).count() == 0 and iv.dyadic_join(df[0], df[1].where("false"), ["k"]).count() == 0


def test_long_intervals_cost_few_rows(spark):
    d = spark.createDataFrame([(0, 10_000_000)], "fi long, ff long")
    assert d.select(F.size(iv.cover_nodes(F.col("fi"), F.col("ff"), 24))).first()[0] < 48


FRAMES = [(3, 10, 0.0), (3, 11, 0.5), (3, 12, 1.5), (4, 13, 4.0), (7, 20, 9.0), (7, 21, 9.25)]


def test_recorder_round_trip(spark, tmp_path):
    at = f"file://{tmp_path}/raw"
    rc.write_archives(spark.createDataFrame(FRAMES, "m long, framenum long, timestamp double"), at, "cam_a")
    got = sorted(tuple(r) for r in rc.frame_steps(rc.read_recorder(spark, at)).collect())
    assert got == [(1, 1, 10, 0.0, 0.5), (1, 2, 11, 0.5, 0.5), (1, 3, 12, 1.5, 1.0), (2, 4, 13, 4.0, 2.5), (5, 5, 20, 9.0, 5.0), (5, 6, 21, 9.25, 0.25)]
    some = rc.read_recorder(spark, at, movies=[4, 7])
    assert sorted((r["file"], r["framenum"], r["dt"]) for r in some.collect()) == [(4, 13, None), (7, 20, None), (7, 21, 0.25)]
    out = rc.frame_steps(rc.read_recorder(spark, at))
    folders = rc.movie_folders(out.select("m").distinct(), fps=1.0, frames_per_file=43_200)
    rc.write_dat(out.join(folders, "m"), f"file://{tmp_path}/videos", "exp")
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("videos/*/*.dat")) == ["videos/1_2/exp_1.dat", "videos/1_2/exp_2.dat", "videos/5_5/exp_5.dat"]
    back = fl.read_dat(spark, f"file://{tmp_path}/videos/*/exp_*.dat")
    assert sorted((r["frame"], r["timestamp"], r["dt"]) for r in back.collect()) == [(n, t, s) for _, _, n, t, s in got]


def test_recorder_as_a_stream(spark, tmp_path):
    at = f"file://{tmp_path}/raw"
    rows = spark.createDataFrame(FRAMES, "m long, framenum long, timestamp double")
    rc.write_archives(rows.where("m = 3"), at, "cam")
    q = None
    for more in (None, rows.where("m > 3")):
        if more is not None:
            rc.write_archives(more, at, "cam")
        q = rc.read_recorder(spark, at, stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
    assert sorted((r["file"], r["framenum"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(m, n) for m, n, _ in FRAMES]


def test_recorder_refuses_arrays_of_two_lengths(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "1.npz", frame_number=np.arange(3), frame_time=np.arange(2.0))
    with pytest.raises(Exception, match="differ in length"):
        rc.read_recorder(spark, f"file://{tmp_path}").collect()
    np.savez(tmp_path / "1.npz", frame_number=np.arange(0), frame_time=np.arange(0.0))
    assert rc.read_recorder(spark, f"file://{tmp_path}").count() == 0


def test_folders_and_files_of_parts(spark, tmp_path):
    for name, rows in (("t_2_p1.csv", "1"), ("t_2_p2.csv", "2"), ("t_11_p1.csv", "3")):
        (tmp_path / name).write_text(f"v\n{rows}\n")
    assert sorted(tuple(r) for r in fl.read_parts(spark, f"file://{tmp_path}/*.csv", "v long").collect()) == [(1, 2, 1), (2, 2, 2), (3, 11, 1)]


def test_commands_are_appended_and_read(spark, tmp_path):
    at = f"file://{tmp_path}/commands"
    for command, tracklet, value in (("setID", "a_1", "RR"), ("setSingle", "a_2", True), ("setSingle", "a_2", False)):
        fl.append_command(spark, at, command, tracklet, value)
    assert sorted(r[0] for r in spark.read.text(at).collect()) == ["setID a_1 RR", "setSingle a_2 0", "setSingle a_2 1"]
