"""The queries and stages that SQL cannot say, against plain Python over the small tables."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tests.oracle import SMALL, connect
from trailmark.llm import mixing
from trailmark.llm.oracles import OP2
from trailmark.llm.pieces import processor
from trailmark.llm.queries import MIX_WEIGHTS, op7_mixing, tokenizer_path

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def posterior(text, model):
    """(tokens, posterior) of a text under a fitted model, in the features' own words."""
    weights, theta = model
    slots = {}
    for h, w in weights:
        slots.setdefault(h % mixing.SLOTS, (h, w))
    words = WORD.findall(text)
    signed = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w.encode(), seed=42)).astype(np.int64))
    distinct = {signed(w) for w in WORD.findall(text.lower())} or {signed("")}
    sums = np.zeros(len(theta) - 1)
    for h in distinct:
        found = slots.get(h % mixing.SLOTS)
        if found and found[0] == h:
            sums += found[1]
    inked = max(len(text) - sum(text.count(c) for c in WS), 1)
    style = [math.log1p(50.0 * sum(text.count(c) for c in cs) / inked) for cs in (mixing.SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?")]
    squash = lambda x, y: x / (1 + np.abs(x) / y)
    f = [1.0, *squash(sums, 20.0), *squash(sums / math.sqrt(len(distinct)), 2.0), *style, math.log1p(len(words)), math.log((len(words) + 1) / (len(distinct) + 1))]
    s = np.array(theta) @ np.array(f)
    e = np.exp(s - s.max())
    return len(words), e / e.sum()


def test_mixing_query(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit_classifier(docs.select("doc_id", "text"), mixing.label_domains(labels), 3)
    got = {r["doc_id"]: r for r in op7_mixing(spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    want = {k: posterior(t, model) for k, t in texts.items()}
    for k, (n, p) in want.items():
        assert got[k]["n_tokens"] == n
        assert np.allclose([got[k][f"p_{d}"] for d in ("good", "poor", "toxic")], p, atol=2e-6), k
    # the least change of nonnegative rates that meets the targets: rates are 1 + p @ m, clipped, for one m per domain
    ids = sorted(want)
    p, rate = np.array([want[k][1] for k in ids]), np.array([got[k]["rate"] for k in ids])
    a = np.array([want[k][0] for k in ids])[:, None] * p
    target = np.array(MIX_WEIGHTS) / sum(MIX_WEIGHTS) * a.sum()
    assert np.allclose(a.T @ rate, target, rtol=1e-3) and (rate >= 0).all() and (rate <= mixing.CEILING).all()
    free = (rate > 1e-4) & (rate < mixing.CEILING - 1e-4)
    m = np.linalg.lstsq(p[free], rate[free] - 1, rcond=None)[0]
    assert free.sum() > 3 and np.allclose(np.clip(1 + p @ m, 0, mixing.CEILING), rate, atol=5e-3)
    assert all(abs(got[k]["copies"] - got[k]["rate"]) < 1 for k in ids)


def dedup(rows):
    """Lines held by three documents or more stay in the largest of them."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(WS).translate(low)
    holders = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(k)
    gone = {h: max(s) for h, s in holders.items() if len(s) >= 3}
    return [(k, None if t is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), k) == k)) for k, t in rows]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        out.append((name, docs))
    return {name: (df.columns, [r.asDict() for r in df.collect()]) for name, df in out}


def test_pipeline_quality(stages):
    kept = {r[0] for r in connect().execute(f"SELECT doc_id FROM ({OP2}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in stages["quality_rules"][1]} == kept


def pairs(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_pipeline_lines(stages):
    assert pairs(stages["line_dedup"][1]) == sorted(dedup(pairs(stages["quality_rules"][1])))
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages["line_dedup"][1])


def test_pipeline_near_duplicates(stages):
    before = pairs(stages["line_dedup"][1])
    kept = {k for k, _, c in brute(before) if k == c}
    assert pairs(stages["near_duplicates"][1]) == [x for x in before if x[0] in kept]


def test_pipeline_mix_and_tokens(spark, stages):
    before, after = pairs(stages["near_duplicates"][1]), pairs(stages["mix_domains"][1])
    assert set(after) == set(before)  # each document once or more
    docs = spark.createDataFrame(before, "doc_id long, text string")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    mixed, report = mixing.mix(docs, labels, corpus_pipeline.MIX_WEIGHTS, floor=1.0, ceiling=2.0, widest=8.0)
    copies = {r["doc_id"]: r["__m_copies"] for r in mixed.select("doc_id", "__m_copies").collect()}
    assert sorted(after) == sorted(x for x in before for _ in range(copies[x[0]]))
    share = np.array(report["reached"]) / sum(report["reached"])
    assert not report["met"] or np.allclose(share, corpus_pipeline.MIX_WEIGHTS, atol=1e-4)
    sp = processor(tokenizer_path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((k, len(i := sp.encode(t or "")), sha(",".join(map(str, i))), sha(sp.decode(i) if i else "")) for k, t in after)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["encode_pieces"][1]) == want


def test_run_chains_the_stages(spark, stages):
    rows = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    columns, want = stages["encode_pieces"]
    assert rows == sorted(tuple(r[c] for c in columns) for r in want)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
