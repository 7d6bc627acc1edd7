"""Phrase mining against brute force over texts, with ranges and parts of a few keys."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, chunk int"


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found[lang, w] = (a, left, right, score)
    out = []
    for lang in n:
        own = {w: x for (g, w), x in found.items() if g == lang}
        kept = [w for w, x in own.items() if len(w) == 3 or not any(w in (v[:2], v[1:]) and 100 * y[0] >= 50 * x[0] for v, y in own.items() if len(v) == 3)]
        kept.sort(key=lambda w: (-own[w][3], -own[w][0], " ".join(w).encode()))
        out += [(lang, i + 1, " ".join(w), *own[w][:3], n[lang], own[w][3]) for i, w in enumerate(kept[:top])]
    return sorted(out)


def run(spark, rows, least, top=2000, parts=3):
    df = spark.createDataFrame([(i, t, g, "x", 1, 2) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(df, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in ("w", "É", "日") for i in range(12)] + ["A", "\x1cx", "b\x85", "\xa0"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = [("".join(x + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r"]) for x in r.choices(vocabulary, weights, k=r.randrange(60))), r.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return [*out, *out[:5], (None, "en"), ("", "fr"), (" \n", None), ("new york city hall " * 300, "en"), ("Of, the" * 40, "de")]


@pytest.mark.parametrize("keys", [40, 1 << 20])
def test_against_brute_force(spark, monkeypatch, keys):
    monkeypatch.setattr(collocations, "RANGE_KEYS", keys)
    rows = texts(keys)
    assert run(spark, rows, 4) == brute(rows, 4)


def test_only_the_first_of_a_language(spark):
    rows = texts(9, 30)
    assert run(spark, rows, 2, top=7) == brute(rows, 2, 7)


def test_empty(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [(None, "en"), ("one", None), (".", "de")], 1) == []


def test_counts_past_64_bits(spark):
    big = 4_000_000_000
    words = spark.createDataFrame([(1, "en", "x", 5 * big), (2, "en", "y", 3 * big)], "id long, lang string, word string, f long")
    phrases = spark.createDataFrame([(1, 2, 0, 2 * big + 1)], "a long, b long, c long, f long")
    sizes = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    count, collocations.count_phrases = collocations.count_phrases, lambda *a, **k: (words, phrases, sizes)
    try:
        row = collocations.collocations(phrases, text="f", lang="f").first()
    finally:
        collocations.count_phrases = count
    assert row["score"] == 10**6 * (2 * big + 1) ** 2 // (15 * big * big)


def test_radix_order_is_stable_and_ascending():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 40, 500).astype(np.uint64) >> np.uint64(30), rng.integers(0, 3, 500).astype(np.uint32)
    assert collocations.radix_order([a, b]).tolist() == np.lexsort((np.arange(500), b, a)).tolist()
    assert collocations.radix_order([a[:0], b[:0]]).tolist() == []
