"""Each training-data operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import embeddings, hilbert, lines, mixing, pieces, quality, tokenfile, toolcalls, warc
from trailmark.llm.common import shared_dir
from trailmark.llm.files import as_uri
from trailmark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, label string"
LINE = "A line that many documents hold"
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\n"), (4, f"{LINE}\nown words of four"), (5, f"  {LINE.upper()} \nx"), (6, LINE), (6, LINE),
    (7, f"{LINE}\n{LINE}\nlast"), (8, "word " * 40_000), (9, " ".join(f"w{i}" for i in range(80))), (10, "é▁ü  日本\x85 <|endoftext|> a"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, t, None if k == 4 else "en", "s", len(t or ""), "k", "l") for k, t in TEXTS], DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(9, 1, 0), (9, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [9]  # the others are short or repeat themselves
    assert quality.keep_good(none, labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 1


def test_cutoffs_keep_their_promise(spark):
    rows = spark.createDataFrame([("en", 2000, "symbols", 0.1, 5), ("en", 2000, "symbols", 0.05, 40), ("de", 20, "symbols", 0.1, 0)], "stratum string, n long, rule string, cutoff double, k long")
    assert [tuple(r) for r in quality.select_cutoffs(rows).collect()] == [("en", "symbols", 0.1)]


def test_lines(docs, none):
    out = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(docs).collect()}
    # documents 4 to 7 hold the line; it stays in 7 alone, twice
    assert out == {(1, None), (2, ""), (3, " \t\n\n"), (4, "own words of four"), (5, "x"), (6, ""), *[(k, t) for k, t in TEXTS if k >= 7]}
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(none).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a b", big), (2, None, big), (3, "", None), (4, "u\r\nX: y", "short"), (5, "u", "short"), (6, "u", big + "é")]
    pages = spark.createDataFrame([(*r, "payload") for r in rows], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert [(k, got[k]["record_type"], got[k]["refers_to"]) for k in sorted(got)] == [(1, "revisit", 2), *[(k, "response", None) for k in range(2, 7)]]
    for k, _, html in rows:
        body = (html or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
    assert warc.round_trip(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.write_archives(pages.withColumn("page_id", F.lit(None).cast("long")), as_uri(shared_dir(spark, "null-id")))


def test_every_archive_begins_with_a_dictionary():
    """One record, a few, equal ones, empty ones: each is decoded by the dictionary in front and not without it."""
    import struct

    import zstandard

    for n, body in ((1, b""), (1, b"<html>" * 5000), (6, b"abc"), (7, b""), (300, b"x"), (20, b"page " * 300)):
        whole = b"".join(warc.frames(iter([warc.record(i, "u", body, None) for i in range(n)])))
        magic, size = struct.unpack_from("<II", whole)
        assert magic == warc.SKIPPABLE and size > 0
        assert [(r["page_id"], r["payload"]) for r in warc.read_archive(whole)] == [(i, body) for i in range(n)]
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompressobj().decompress(whole[8 + size :])


def test_archives_with_faults_are_refused():
    whole = b"".join(warc.frames(iter([warc.record(i, "u", b"payload %d" % i * 40, None) for i in range(20)])))
    assert [r["page_id"] for r in warc.read_archive(whole)] == list(range(20))
    with pytest.raises(ValueError):
        list(warc.read_archive(whole[:-5]))
    good = warc.record(1, "u", b"abc", None)
    for bad in (good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC-Date", b"WARC-Dato"), good.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_pieces(docs, none):
    sp = pieces.processor(tokenizer_path("piece_bpe_32k.model"))
    want = sorted((k, len(i := sp.encode(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((sp.decode(i) if i else "").encode()).hexdigest()) for k, t in TEXTS)
    assert sorted(tuple(r) for r in pieces.encode_texts(docs, tokenizer_path("piece_bpe_32k.model")).collect()) == want
    assert pieces.encode_texts(none, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_token_files(spark, docs, none):
    path = tokenizer_path("byte_bpe_50k.json")
    tk, start, want = tokenfile.tokenizer(path), 0, []
    for k, t in TEXTS:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokenfile.round_trip(docs, path).collect()) == want
    assert tokenfile.round_trip(none, path).count() == 0
    with pytest.raises(ValueError):
        tokenfile.round_trip(docs.withColumn("doc_id", F.lit(None).cast("long")), path)


def test_byte_code_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    control, data = tokenfile.encode_ranks(ranks)
    assert (tokenfile.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)) == ranks).all()
    for top in (0, 255, 256, 65535, 65536, 1 << 24):
        few = np.array([top, 0, top, 1, 2][: 5 if top else 0], np.uint32)
        control, data = (np.frombuffer(x, np.uint8) for x in tokenfile.encode_ranks(few))
        assert tokenfile.decode_ranks(control, data, len(few)).tolist() == few.tolist()
    with pytest.raises(IndexError):  # data cut short is no zeros
        tokenfile.decode_ranks(control, data[:-1], len(few))


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(9, 1, 0), (4, 0, 0), (5, 1, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    out = mixing.repeat(docs, labels, (0.8, 0.1, 0.1))
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {k for k, _ in TEXTS}  # the floor keeps each
    assert mixing.repeat(none, labels, (0.8, 0.1, 0.1)).count() == 0
    assert mixing.rates(docs, labels.limit(0), (0.8, 0.1, 0.1)).count() == len(TEXTS)


def test_rates_reach_their_targets(spark):
    rows = [(i, 100, [0.9, 0.1] if i % 4 else [0.1, 0.9]) for i in range(400)]
    soft = spark.createDataFrame(rows, "doc_id long, __m_tokens long, __m_p array<double>")
    _, report = mixing.fit_rates(soft, (0.5, 0.5), rounds=60)
    assert np.allclose(report["reached"], report["target"], rtol=0.01)
    assert all(b <= a + 1e-9 for a, b in zip(report["errors"], report["errors"][1:]))


SIZE = "octet_length(coalesce(text, '')) + 1"


def test_hilbert(spark, docs, none):
    from trailmark.llm import common

    tied = docs.withColumns({"tie": F.xxhash64("text"), "slice": F.lit(1), "value": F.lit("v"), "k": F.lit(2)})
    path = common.shared_dir(spark, "shards")
    d = hilbert.hilbert_shards(tied, ["lang", "source", "n_chars", "doc_id"], ["doc_id", "tie"], size=F.expr(SIZE), path=path)
    rows = d.collect()
    per = {s: sorted((r["__slot"], r["__h"], r["doc_id"]) for r in rows if r["__shard"] == s) for s in range(8)}
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((k, t or "") for k, t in TEXTS)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all([x[0] for x in v] == list(range(len(v))) for v in per.values())
    order = [x[1:] for s in range(8) for x in per[s]]
    assert order == sorted(order)  # the shards are runs of the curve
    assert set(d.columns) == {*tied.columns, "__h", "__slot", "__shard"}
    assert hilbert.hilbert_shards(none.withColumn("tie", F.lit(0)), ["lang", "n_chars"], ["doc_id", "tie"], size=F.expr(SIZE)).count() == 0
    nulls = docs.withColumns({"doc_id": F.lit(None).cast("long"), "tie": F.xxhash64("text"), "lang": F.lit(None).cast("string")})
    found = hilbert.hilbert_shards(nulls, ["lang", "doc_id"], ["doc_id", "tie"], size=F.expr(SIZE)).collect()
    assert sorted(r["__slot"] + 100 * r["__shard"] for r in found) == sorted(s + 100 * k for k, v in per.items() for s, _, _ in v)


def test_text_cells_follow_the_rows(spark):
    """Values that begin alike fall into cells of their own, by their share of the rows."""
    df = spark.createDataFrame([(f"https://common-head.example/{i:03d}",) for i in range(64) for _ in range(1 + 63 * (i == 0))], "url string")
    cell = hilbert.cells(df, ["url"], 4)["__c0"]
    got = {r["url"][-3:]: r["c"] for r in df.select("url", cell.alias("c")).distinct().collect()}
    assert got["000"] == 0 and got["001"] >= 8 and got["063"] == 15
    assert [got[k] for k in sorted(got)] == sorted(got.values())


def test_files_prune_on_each_dimension(spark):
    """A file of a shard spans a part of every dimension, so a filter on any of them skips most files."""
    from trailmark.llm import common

    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1000)).alias("b"), F.col("id").alias("tie"))
    path = common.shared_dir(spark, "shards")
    d = hilbert.hilbert_shards(df, ["a", "b"], ["tie"], size=F.lit(1), n_shards=16, path=path)
    span = d.groupBy(F.input_file_name()).agg(*[(F.max(c) - F.min(c)).alias(c) for c in "ab"]).collect()
    assert len(span) >= 16 and all(sum(r[c] for r in span) / len(span) < 500 for c in "ab")


def test_hilbert_neighbours_touch(spark):
    grid = spark.range(64).select((F.col("id") % 8).cast("int").alias("a"), (F.col("id") / 8).cast("int").alias("b"))
    walk = [(r["a"], r["b"]) for r in hilbert.with_hilbert(grid, ["a", "b"], 3).orderBy("__h").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(12, 16))
    vecs = np.concatenate([base + r.normal(size=base.shape) * s for s in (0, 0.15, 0.3, 0.4)])
    rows = [(i, int(i % 3), [float(x) for x in v]) for i, v in enumerate(vecs)] + [(100, 1, None), (101, 1, [0.0] * 16), (102, 1, [float("nan")] * 16), (103, None, [1.0] * 16), (104, 0, [None] * 16), (105, 0, []), (106, 1, [1.0] * 16), (107, 1, [2.0] * 16), (108, 1, [2.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rep", F.lit(1))
    sound = {i: (k, np.array(v)) for i, k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: {j for j, (m, w) in sound.items() if j != i and m == k and v @ w / np.sqrt(v @ v * (w @ w)) >= 0.93} for i, (k, v) in sound.items()}
    comp = {i: i for i, *_ in rows}
    for _ in rows:
        comp = {i: min([comp[i], *(comp[j] for j in near.get(i, ()))]) for i in comp}
    want = sorted((i, len(near.get(i, ())), comp[i], comp[i] == i) for i in comp)
    for tile in (4, 1024):
        assert sorted(tuple(x) for x in embeddings.near_duplicates(df, tile=tile).collect()) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_labels_of_any_type(spark):
    from datetime import date

    same = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [0.0, 1.0])]
    for kind, a, b in (("string", "animal, wild", "7a"), ("double", 0.5, float("nan")), ("date", date(2020, 1, 1), date(2020, 1, 2)), ("boolean", True, False)):
        rows = [(i, a if i % 2 else b, v) for i, v in same] + [(60, None, [1.0, 0.0])]
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>")).collect()}
        assert got == {i: (19, i % 2) for i in range(40)} | {50: (0, 50), 60: (0, 60)}


def test_embeddings_with_repeated_ids(spark):
    """Rows of one vec_id under two labels, or with two vectors, are separate vectors; sure and doubtful pairs add up."""
    far, turn = [0.0, 1.0, 0.0], lambda c: [c, float(np.sqrt(1 - c * c)), 0.0]
    rows = [(5, 0, [1.0, 0.0, 0.0]), (1, 0, [1.0, 0.01, 0.0]), (5, 1, [1.0, 0.0, 0.0]), (2, 1, [1.0, 0.02, 0.0]), (3, 1, turn(0.9301)), (5, 1, far), (4, 1, turn(0.9299))]
    out = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect())
    assert out == [(1, 1, 1, True), (2, 3, 2, True), (3, 3, 2, False), (4, 2, 2, False), (5, 0, 5, True), (5, 1, 1, False), (5, 2, 2, False)]


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", None, "search", '{"words": 3, "query_md5": "x"}'), (1, 2, "b", "a", "search", "no json"), (1, 4, "c", "d", "rank", "{}"), (1, 6, "d", "c", "rank", None),
         (1, 8, "a", None, "search", "{}"), (2, 0, "e", "lost", "other", "{}"), (None, 0, "f", None, None, None), (2, 2, None, None, "search", "{}")],
        "conv long, turn int, call string, parent string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, 1, "a", "r"), (1, 3, "b", None), (2, 1, "z", "q"), (1, 5, "b", "s")], "conv long, turn int, call string, content string")
    out = toolcalls.link_tool_calls(calls, results, toolcalls.schema_table(spark)).collect()
    first = {(r["conv"], r["call"]): r for r in out if r["status"] != "duplicate"}
    status = {k: r["status"] for k, r in first.items()}
    assert status == {(1, "a"): "linked", (1, "b"): "linked", (1, "c"): "cycle", (1, "d"): "cycle", (2, "e"): "no_result", (2, "z"): "orphan_result", (None, "f"): "no_result", (2, None): "no_result"}
    assert first[1, "b"]["depth"] == 1 and first[1, "b"]["errors"] == ["malformed"]
    assert first[2, "e"]["errors"] == ["parent:lost", "tool:other"]
    assert first[1, "a"]["canonical"] == '{"arguments":{"query_md5":"x","words":3},"call_id":"a","name":"search","result":"r"}'
    assert sum(r["status"] == "duplicate" for r in out) == 2
    assert toolcalls.link_tool_calls(calls.limit(0), results.limit(0), toolcalls.schema_table(spark)).count() == 0


CLASH = ["key", "n", "label", "stratum", "rule", "rep", "node", "h", "range", "first", "docs", "last", "k", "slice", "rows", "copies", "c", "doc", "pos", "version"]


def clashing(df):
    """df with columns that bear the names of what operators make on the way."""
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


def test_columns_of_any_name(spark, docs):
    """Results do not depend on what other columns are called, and stages return them unchanged."""
    labels = spark.createDataFrame([(9, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    wide, same = clashing(docs), lambda d: sorted((r["doc_id"], r["text"] or "") for r in d.collect())
    for stage in (lambda d: quality.keep_good(d, labels), lines.dedup_lines, lambda d: mixing.repeat(d, labels, (0.8, 0.1, 0.1))):
        out = stage(wide)
        assert out.columns == wide.columns and same(out) == same(stage(docs))
        assert all(r["rule"] == 7 for r in out.select("rule").collect())
    model = tokenizer_path("piece_bpe_32k.model")
    assert sorted(map(tuple, pieces.encode_texts(wide, model).collect())) == sorted(map(tuple, pieces.encode_texts(docs, model).collect()))
    tied = wide.withColumn("tie", F.xxhash64("text"))
    out = hilbert.hilbert_shards(tied, ["lang", "n_chars"], ["doc_id", "tie"], size=F.expr(SIZE))
    assert out.count() == len(TEXTS) and {r["slice"] for r in out.select("slice").collect()} == {7}


def test_missing_keys(spark, docs):
    """A row without a key is handled by itself: it holds no line, and keeps its ids."""
    gone = docs.withColumn("doc_id", F.when(F.col("doc_id") < 6, F.col("doc_id")))
    out = sorted((r["doc_id"] or 0, r["text"] or "") for r in lines.dedup_lines(gone).collect())
    assert out == sorted((k if k < 6 else 0, t or "") for k, t in TEXTS)  # the line is left with two holders
    model = tokenizer_path("piece_bpe_32k.model")
    n = sorted(r["n_tokens"] for r in pieces.encode_texts(docs, model).collect())
    assert sorted(r["n_tokens"] for r in pieces.encode_texts(gone, model).collect()) == n


def test_very_long_values(spark):
    r = np.random.default_rng(2)
    page = "<p>" + "word " * 600_000
    got = {x["page_id"]: x for x in warc.round_trip(spark.createDataFrame([(1, "u", page), (2, "u", page)], "page_id long, url string, html string")).collect()}
    assert got[2]["payload_bytes"] == len(page) and got[1]["refers_to"] == 2
    base = r.normal(size=5000)
    rows = [(i, 0, [float(x) for x in base + r.normal(size=5000) * s]) for i, s in enumerate((0.0, 0.1, 2.0))]
    out = sorted(tuple(x) for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert out == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]
    long = "x" * 300_000
    calls = spark.createDataFrame([(1, 0, "a", None, "search", '{"words": 3, "query_md5": "%s"}' % long)], "conv long, turn int, call string, parent string, name string, arguments string")
    results = spark.createDataFrame([(1, 1, "a", long)], "conv long, turn int, call string, content string")
    (x,) = toolcalls.link_tool_calls(clashing(calls), clashing(results), toolcalls.schema_table(spark)).collect()
    assert x["status"] == "linked" and x["errors"] == [] and len(x["canonical"]) > 600_000
    assert [r["doc_id"] for r in quality.keep_good(spark.createDataFrame([(1, "en", " ".join(f"w{i}" for i in range(200_000)))], "doc_id long, lang string, text string"), spark.createDataFrame([], "doc_id long, quality int")).collect()] == [1]


def test_ties(spark):
    """Equal scores and equal posteriors get equal verdicts and rates."""
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, "en", text) for i in range(40)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(df, labels).count() == 40
    rates = mixing.rates(df, labels, (0.8, 0.1, 0.1)).select("posterior", "rate").distinct().collect()
    assert len(rates) == 1
    assert quality.holdout_counts(quality.with_metrics(df), labels.limit(0), "lang").count() == 0
