"""The mixing classifier on texts of all lengths."""

import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import mixing


def made(spark, n=1500):
    r = np.random.default_rng(3)
    bad, docs, labels = [f"bad{i}" for i in range(10)], [], []
    for i in range(n):
        kind = (0, 0, 0, 0, 0, 0, 1, 2)[i % 8]
        size = int(r.choice([30, 150, 500, 1800]))
        w = [f"w{x}" for x in r.integers(0, 60_000, size)]
        if kind == 1:
            w = [f"{x}&&&" for x in w]
        if kind == 2:
            for x in r.choice(bad, 6, replace=False):
                w.insert(int(r.integers(0, len(w))), str(x))
        docs.append((i, " ".join(w)))
        if r.random() < 0.6:
            labels.append((i, int(kind != 1), int(kind == 2)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, labels, np.array([(0, 0, 0, 0, 0, 0, 1, 2)[i % 8] for i in range(n)])


def test_length_is_no_domain(spark):
    docs, labels, kind = made(spark)
    rows = mixing.rates(docs, labels, (0.80, 0.15, 0.05)).orderBy("doc_id").collect()
    p, tokens = np.array([r["posterior"] for r in rows]), np.array([r["n_tokens"] for r in rows])
    assert p[(kind == 0) & (tokens > 1000), 2].mean() < 0.05
    for d in range(3):
        assert (p[kind == d].argmax(1) == d).mean() > 0.95
        assert abs((tokens * p[:, d]).sum() - tokens[kind == d].sum()) < 0.02 * tokens.sum()
    reached = (np.array([r["rate"] for r in rows]) * tokens) @ p
    assert np.allclose(reached / reached.sum(), (0.80, 0.15, 0.05), atol=1e-4)


def test_posteriors_part_few_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit_classifier(docs.select("doc_id", "text"), mixing.label_domains(labels), 3)
    soft = mixing.with_posteriors(docs, model).join(mixing.label_domains(labels).distinct(), "doc_id")
    mean = soft.groupBy("domain").agg(*[F.avg(F.get("__m_p", F.lit(i))).alias(str(i)) for i in range(3)]).collect()
    assert len(mean) == 3
    for r in mean:
        assert max(range(3), key=lambda i: r[str(i)]) == r["domain"] and r[str(r["domain"])] > 0.6


def projected_gradient(tokens, p, share, floor, ceiling, steps=4000):
    """The least distance of the totals from their targets, by plain steps on every document's rate."""
    q, target = (p - share, 0.0) if floor > 0 else (p, share * tokens.sum())
    size = np.linalg.eigvalsh((tokens[:, None] * q).T @ q).max()
    x = z = np.ones(len(p))
    t = 1.0
    for _ in range(steps):
        y = np.clip(z - q @ ((z * tokens) @ q - target) / size, floor, ceiling)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        again = (z - y) @ (y - x) > 0
        z, x, t = (y, y, 1.0) if again else (y + (t - 1) / after * (y - x), y, after)
    return np.linalg.norm((x * tokens) @ q - target)


def test_closest_fit(spark):
    r = np.random.default_rng(11)
    tokens, p = r.integers(1, 900, 400), r.dirichlet((3, 0.4, 0.3), 400)
    soft = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "__m_tokens long, __m_p array<double>").cache()
    for weights, floor, ceiling, met in (((0.7, 0.2, 0.1), 0.0, 4.0, True), ((0.05, 0.05, 0.9), 0.0, 4.0, False), ((0.3, 0.2, 0.5), 1.0, 2.0, False), ((0.8, 0.1, 0.1), 1.0, 8.0, True)):
        rate, report = mixing.fit_rates(soft, weights, floor=floor, ceiling=ceiling)
        assert report["met"] == met
        now, target = np.array(report["reached"]), np.array(report["target"])
        least = projected_gradient(tokens, p, np.array(weights), floor, ceiling)
        assert np.linalg.norm(now - target) <= least + 1e-3 * tokens.sum()
        rates = np.array([x[0] for x in soft.select(rate).collect()])
        assert rates.min() >= floor and rates.max() <= ceiling
        assert np.allclose((rates * tokens) @ p, now, rtol=1e-6)
