"""The frame loop: the rules of one frame, and a stream in micro-batches of any size against the table."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark.streaming import tracking as tr

KINDS = "movie long, frame long, blob long, x double, y double, area double, dt double, boundary boolean"
RULES = tr.Rules(fps=1.0, max_speed=1.5, radius=1.0, reach=2.0, area=1.0, longest=9)


def frame(f, xs, dt=1.0, area=1.0, boundary=False):
    return [(f, i, float(x), 0.0, area, dt, boundary) for i, x in enumerate(xs)]


def run(rows, rules=RULES):
    df = pd.DataFrame([r for part in rows for r in part], columns=tr.BLOB)
    return tr.run_frames(tr.Movie(), df, rules, to_the_end=True)


def of(out, kind):
    return sorted(r[1:] for r in out if r[0] == kind)


def test_merge_and_split_give_links():
    out = run([frame(1, [0, 10]), frame(2, [4, 6]), frame(3, [5]), frame(4, [4, 6])], tr.Rules(max_speed=5, reach=4.5))
    # two animals go on, meet in one blob and part again; the least free numbers are used anew
    assert of(out, "link") == [(0, 2, 3, None, None), (1, 2, 3, None, None), (2, 3, 4, None, None), (2, 4, 4, None, None)]
    assert of(out, "tracklet") == [(0, 1, 1, 2, 2), (1, 2, 1, 2, 2), (2, 1, 3, 3, 1), (3, 1, 4, 4, 1), (4, 2, 4, 4, 1)]


def test_long_tracklets_are_cut_and_linked():
    out = run([frame(f, [0]) for f in range(1, 21)])
    assert of(out, "tracklet") == [(0, 1, 1, 9, 9), (1, 1, 10, 18, 9), (2, 1, 19, 20, 2)]
    assert of(out, "link") == [(0, 1, 10, None, None), (1, 2, 19, None, None)]


@pytest.mark.parametrize("dt, links", [(2.0, 0), (3.0, 1), (4.0, 0)])
def test_pauses_part_tracklets(dt, links):
    out = run([frame(1, [0]), frame(2, [0], dt)])
    assert (len(of(out, "tracklet")), len(of(out, "link"))) == (1 if dt == 2.0 else 2, links)


def test_frames_without_blobs_and_the_boundary():
    assert of(run([frame(1, [0]), frame(3, [0])]), "link") == []
    out = run([frame(1, [0]), frame(2, [0], boundary=True)], tr.Rules(max_speed=1, open_boundary=True))
    assert len(of(out, "tracklet")) == 2 and len(of(out, "link")) == 1


def test_what_is_left_alone_in_a_crowd():
    prev = [(0, 0.0, 0.0, 1.0, False), (1, 3.0, 0.0, 1.0, False)]
    now = pd.DataFrame(frame(2, [0.2]), columns=tr.BLOB).assign(area=3.0)
    assert tr.link_frames(prev, now, tr.Rules(max_speed=2, reach=0.5, area=0.9)).tolist() == [[True], [True]]
    assert tr.link_frames(prev, now.assign(area=1.5), tr.Rules(max_speed=2, reach=0.5, area=0.9)).tolist() == [[True], [False]]


def test_clusters_like_all_pairs():
    r = np.random.default_rng(3)
    xy = r.random((80, 2)) * 10
    near = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) <= 1.0
    while not np.array_equal(near, wider := near @ near):
        near = wider
    assert tr.clusters(xy, 0.5).tolist() == near.argmax(axis=1).tolist()


def walk(seed, movies=3, frames=30):
    r = np.random.default_rng(seed)
    rows = []
    for m in range(movies):
        at = r.random((5, 2)) * 12
        for f in range(1, frames + 1):
            at = at + r.normal(0, 0.6, at.shape)
            seen = np.flatnonzero(r.random(5) < 0.93)
            dt = 1.0 if r.random() < 0.95 else 3.0
            rows += [(m, f, i, *map(float, at[b]), 1.0 + float(r.random()), dt, bool(at[b][0] < 1)) for i, b in enumerate(seen) if r.random() < 0.98 or i == 0]
    return rows


def told(rows):
    return sorted((r["movie"], r["kind"], r["serial"], r["other"], r["fi"], r["ff"] or -1, r["n"] or -1) for r in rows)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def drained(spark, folder, arrived, size, **options):
    """What the stream gives of these rows, ``size`` of them in a file and a file in a micro-batch."""
    kinds = KINDS + ", ts timestamp" if len(arrived[0]) == 9 else KINDS
    for n, a in enumerate(range(0, len(arrived), size)):
        spark.createDataFrame(arrived[a : a + size], kinds).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={n:05d}")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = tr.stream_frames(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    ended = q.awaitTermination(150)
    q.stop()
    assert ended and q.exception() is None
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("size", [61, 150, 1000])
def test_stream_like_table(spark, rocksdb, tmp_path, size):
    rules = tr.Rules(max_speed=1.2, reach=1.5, longest=12, open_boundary=True)
    rows = walk(size)
    batch = tr.batch_frames(spark.createDataFrame(rows, KINDS).repartition(3), rules).collect()
    # frames far behind: the second takes up the first, which closes what was open
    ends = [(m, f, 0, 0.0, 0.0, 1.0, 1.0, False) for f in (10_000, 20_000) for m in range(3)]
    out = drained(spark, tmp_path, sorted(rows, key=lambda x: (x[1], x[0], x[2])) + ends, size, rules=rules)
    assert told(out.where("not (kind = 'tracklet' and fi = 10000)").collect()) == told(batch)
    assert len({r["kind"] for r in batch}) == 2


def test_a_silent_movie_is_closed(spark, rocksdb, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(0, f, 0, 0.0, 0.0, 1.0, 1.0, False, at(f)) for f in range(1, 6)] + [(1, f, 0, 0.0, 0.0, 1.0, 1.0, False, at(600 * f)) for f in range(1, 4)]
    out = drained(spark, tmp_path, rows, 5, rules=RULES, ts="ts", late="1 second", silent_ms=10_000)
    assert (0, "tracklet", 0, 1, 1, 5, 5) in told(out.collect())


def test_late_rows_of_a_finished_frame_are_left_out(spark):
    out = tr.batch_frames(spark.createDataFrame(walk(1), KINDS).where(F.lit(False)), RULES)
    assert out.collect() == []
