"""The toxicity classifier on planted texts, held-out labels and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.llm import toxicity
from trailmark.llm.queries import op12_toxicity

SCHEMA = "doc_id long, text string, lang string, score double, label string"


def planted(n=600, seed=4):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(["an", "be", "co", "du", "er", "fi"], k=3)) for _ in range(120)]
    docs, labels = [], []
    for i in range(n):
        w, toxic = r.choices(vocabulary, k=r.randrange(20, 90)), int(i % 6 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["grobian", "Unhold!", "wretch,"]))
        docs.append((i, " ".join(w), "en" if i % 2 else "de", 0.5, "l"))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = planted()
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = toxicity.score_documents(docs, labels, usable=F.col("doc_id") % 4 != 2).where("doc_id % 4 = 2").collect()
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 6 == 0) for r in out]
    assert np.mean(right) > 0.97
    assert np.mean([r["flagged"] == (r["doc_id"] % 6 == 0) for r in out]) > 0.95


def test_scores_see_neither_held_out_labels_nor_other_columns(tables):
    docs, labels = tables
    usable = F.col("doc_id") % 4 != 2
    one = scores(toxicity.score_documents(docs, labels, usable=usable))
    turned = labels.withColumn("toxic", F.when(usable, F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert scores(toxicity.score_documents(docs.withColumn("lang", F.lit(None).cast("string")), turned, usable=usable)) == one


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = [(-1, None), (-2, ""), (-3, " \n!"), (-4, "grobian unhold wretch " * 30_000), (-5, "anbeco"), (-5, "anbeco"), (None, "wretch"), (-6, "é日\x85")]
    rows = docs.unionByName(spark.createDataFrame([(k, t, None, 0.0, "l") for k, t in odd], SCHEMA))
    out = [tuple(r) for r in toxicity.score_documents(rows, labels.union(spark.createDataFrame([(3, None), (10**9, 1), (None, 1)], labels.schema))).collect()]
    assert len(out) == 600 + len(odd)
    got = {k: s for k, _, s, _ in out if k is None or k < 0}
    assert got[-1] == got[-2] == got[-3] < 0.3 <= got[-4] and got[None] >= 0
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []
    assert {s for s in scores(toxicity.score_documents(docs, labels.where("toxic = 0"))).values()} == {0.0}
    assert {s for s in scores(toxicity.score_documents(docs, labels.limit(0))).values()} == {0.0}


def test_a_cut_into_batches_does_not_show():
    docs, labels = planted(60)
    texts = [d[1] for d in docs] + ["", None, "wretch"]
    slots = [toxicity.word_slots(pa.array([t]))[0] for t in texts[:60]]
    model, _, _ = toxicity.fit(slots, np.array([x for _, x in labels]))
    whole = toxicity.scores(model, pa.array(texts))
    assert np.allclose(whole, np.concatenate([toxicity.scores(model, pa.array([t], pa.string())) for t in texts]), atol=2e-6)


def test_query_on_the_small_table(spark):
    out = op12_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_labels_past_any_number_are_learnt_from(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices(["an", "be", "co", "du", "er", "fi"], k=3)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(vocabulary, k=8)), "en", 0.5, "l") for i in range(7000)], SCHEMA)
    late = {x["doc_id"]: k for k, x in enumerate(docs.orderBy(F.xxhash64("doc_id")).select("doc_id").collect())}
    # the last thousand in hash order hold a word of their own, half of them toxic
    toxic = {i for i, k in late.items() if k >= 6000 and k % 2} | {i for i, k in late.items() if k < 6000 and k % 9 == 0}
    insult = F.when(F.col("doc_id").isin(*[i for i in toxic if late[i] >= 6000]), "grobian").when(F.col("doc_id").isin(*toxic), "unhold").otherwise("")
    labels = docs.select("doc_id", F.col("doc_id").isin(*toxic).cast("int").alias("toxic"))
    rows = docs.withColumn("text", F.concat_ws(" ", "text", insult)).union(spark.createDataFrame([(-1, "beco " * 4 + "grobian", "en", 0.5, "l"), (-2, "beco " * 5, "en", 0.5, "l")], SCHEMA))
    got = scores(toxicity.score_documents(rows, labels).where("doc_id < 0"))
    assert got[-1] >= 0.3 > got[-2]


def test_shares_in_any_order(spark, tables, monkeypatch):
    docs, labels = tables
    monkeypatch.setattr(toxicity, "SHARE_BYTES", 60_000)
    usable = F.col("doc_id") % 4 != 2
    rows = toxicity.score_documents(docs, labels, usable=usable).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 6 == 0) for r in rows if r["doc_id"] % 4 == 2]) > 0.97
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 10)
    assert scores(toxicity.score_documents(docs.repartition(5), labels.repartition(2), usable=usable)) == {r["doc_id"]: r["score"] for r in rows}
