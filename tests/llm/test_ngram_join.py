"""The n-gram Jaccard join against brute force and against its SQL."""

import random
import re

from tests.oracle import check
from trailmark.llm import ngram_join
from trailmark.llm.oracles import OP8
from trailmark.llm.queries import op8_ngram_join

SCHEMA = "doc_id long, text string, key string, n long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {}
    for k, t in rows:
        if len(shingles(t)) >= len(sets.get(k, ())):
            sets[k] = shingles(t)
    ids = sorted(k for k in sets if k is not None)
    comp = {k: k for k in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and 100 * len(x & y) >= 80 * len(x | y) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    return sorted((k, len(shingles(t)), comp.get(k)) for k, t in rows if k is not None)


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA).repartition(partitions)
    return sorted(tuple(r) for r in ngram_join.jaccard_components(df).collect() if r[0] is not None)


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_of_all_degrees(spark):
    r = random.Random(3)
    rows = []
    for g in range(4):
        base = [f"w{r.randrange(900)}" for _ in range(120)]
        rows += [(100 * g + i, edited(r, base, r.randrange(7))) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(8 + i % 9))) for i in range(40)]
    rows += [(2000 + i, rows[7][1]) for i in range(5)]
    assert run(spark, rows) == brute(rows)


def test_common_shingles_go_around_the_block(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, edited(r, base, 1 + i % 5)) for i in range(260)]
    assert run(spark, rows, 2) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (9, "a " * 30_000), (10, "a " * 50), (None, "a b c d e"), (11, "é ü\x85x")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one_of_each(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2), (3, None, "z", 3), (None, "a b c d e f", "n", 4)], SCHEMA)
    out = ngram_join.keep_one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r["key"] for r in out.collect()) == ["n", "x", "z"]


def test_against_sql(spark):
    check(spark, op8_ngram_join, OP8, "/root/testdata/sf0.001")
