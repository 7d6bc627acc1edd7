"""Queries over the small tables against their SQL, and the pipeline's stages against what they promise."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.oracle import SMALL, check
from trailmark.llm.oracles import oracle_sql
from trailmark.llm.pieces import processor
from trailmark.llm.queries import queries, tokenizer_path
from trailmark.llm.tokenfile import tokenizer


@pytest.mark.parametrize("name", sorted(oracle_sql().keys() - {"op8_ngram_join"}))
def test_against_sql(spark, name):
    check(spark, queries()[name], oracle_sql()[name])


def texts_of(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


def test_pieces_against_the_library(spark):
    sp = processor(tokenizer_path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(k, len(i := sp.encode(t)), sha(",".join(map(str, i))), sha(sp.decode(i) if i else "")) for k, t in texts_of(spark)]
    assert sorted(tuple(r) for r in queries()["op5_sentencepiece"](spark, SMALL).collect()) == want


def test_token_files_against_the_library(spark):
    tk, start, want = tokenizer(tokenizer_path("byte_bpe_50k.json")), 0, []
    for k, t in texts_of(spark):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries()["op6_token_files"](spark, SMALL).collect()) == want


def test_shards(spark):
    rows = queries()["op9_hilbert_shards"](spark, SMALL).collect()
    want = {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts_of(spark)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want and len(rows) == len(want)
    per = {s: sorted((r["slot"], r["hilbert"], r["doc_id"]) for r in rows if r["shard"] == s) for s in range(8)}
    assert all([x[0] for x in v] == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    order = [x[1:] for s in range(8) for x in per[s]]
    assert order == sorted(order)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SMALL)
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "encode_pieces":
            assert sorted(after) == sorted(texts)
            break
        assert docs.columns == columns
        assert set(after) <= before
        if name == "line_dedup":
            assert sorted(after) == sorted(before)
        if name == "mix_domains":
            assert set(after) == before
        texts = after
