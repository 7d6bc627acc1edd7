"""Mixing to target weights with soft domain membership.

A classifier fitted on a bounded number of labelled documents gives every document a posterior over
the domains of the label table. On one half of the labels, words whose log odds between domains are
significant get these as weights; no two words share a weight. On the other half a softmax over a
document's summed weights, the same by length, and shares of symbols, capitals, exclamation marks
and repeats is fitted, each document weighing as its tokens, so that there the expected token totals
are the labelled ones, whatever the length of the texts.

Rates between floor and ceiling (repeats of a document) are the least squares fit of the expected token
totals, sum of rate * tokens * posterior, to the targets, by projected gradient in its lazy form: the
gradient at a document is its posterior times the misfit of each domain, so that all steps add up to
one vector of pulls, one per domain, and a document's rate is 1 - sum of pull * posterior, projected
onto the bounds. Steps are scaled by the inverse of the curvature of the documents off the bounds, and
their length is found by halving. A round is one aggregation to a few sums, and no state moves. The change
of the rates is part of what is made least, with a weight that falls to almost nothing, so that of all
fits as close the one with the least change is found. Where no
rates within the bounds meet the targets, a warning gives the targets and the totals of the closest
fit, and the report holds them.

Defined results: a null or empty text has no tokens, the prior as posterior and takes part at its rate.
Labels that are null or of unknown documents are not used; of repeated labels the largest domain
counts. Without labels all posteriors are equal. Repeated rows are mixed as separate rows, ties alike. A very long text is handled
whole in its row. An empty table gives no rows. Internal columns begin with ``__m_``; those of docs may have any other name.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import WS_CHARS, stored, words

SLOTS, MAX_WORDS, MAX_LABELLED, SIGNIFICANT, ROUNDS, CEILING = 1 << 15, 4096, 20_000, 4.0, 60, 4.0
#: falling weights, per token, of the change of the rates against the misfit
SOFTEN = (1e-1, 1e-3, 1e-5, 1e-7, 1e-9)
SYMBOLS = "#*$%&|<>"


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the label table: 0 good, 1 poor, 2 toxic."""
    d = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.select("doc_id", d.alias("domain")).where("domain is not null and doc_id is not null")


def _hashes(lower_words: Column) -> Column:
    return F.array_distinct(F.transform(lower_words, lambda w: F.xxhash64(w)))


def _lower_words(text: str) -> Column:
    return words(F.lower(F.coalesce(F.col(text), F.lit(""))))


def _word_weights(docs: DataFrame, n_domains: int, text: str) -> list[tuple[int, list[float]]]:
    """(hash of a word, log odds per domain relative to domain 0) of the most significant words. docs have ``__m_domain``."""
    size = {r["__m_domain"]: r["count"] for r in docs.groupBy("__m_domain").count().collect()}
    per = [F.count(F.when(F.col("__m_domain") == d, 1)) for d in range(n_domains)]
    met = docs.select("__m_domain", F.explode(_hashes(_lower_words(text))).alias("h")).groupBy("h").agg(*[n.alias(f"n{d}") for d, n in enumerate(per)])
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    odds, sure = [], []
    for d in range(1, n_domains):
        a, b, na, nb = F.col(f"n{d}").cast("double"), F.col("n0").cast("double"), size.get(d, 0), size.get(0, 0)
        w = F.log((a + 0.5) / (na + 1)) - F.log((b + 0.5) / (nb + 1))
        both = (a + b) / max(na + nb, 1)  # share of documents with the word if domains did not differ
        ratio = part(a, na * both) + part(b, nb * both) + part(na - a, na * (1 - both)) + part(nb - b, nb * (1 - both))
        z = F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))  # of a likelihood ratio, which holds for words that one domain lacks
        odds.append(F.when(z > SIGNIFICANT, F.round(w, 4)).otherwise(0.0))
        sure.append(z)
    found = met.withColumns({"w": F.array(*odds), "z": F.greatest(F.lit(0.0), F.lit(0.0), *sure)})
    best = found.where(F.col("z") > SIGNIFICANT).orderBy(F.desc("z"), "h").limit(MAX_WORDS).select("h", "w").collect()
    return [(r["h"], list(r["w"])) for r in best]


def _with_features(docs: DataFrame, weights: list[tuple[int, list[float]]], n_domains: int, text: str) -> DataFrame:
    """docs with ``__m_tokens`` and ``__m_f``, what the softmax takes."""
    slots: dict[int, tuple[int, list[float]]] = {}
    for h, w in weights:  # the more significant of two words in one slot comes first
        slots.setdefault(h % SLOTS, (h, w))

    def table(values: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), kind)  # a constant array, so that a word is one lookup

    ids = table([slots[i][0] if i in slots else 0 for i in range(SLOTS)], "array<bigint>")
    slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
    # words are split once: lower case changes neither their number nor the space between them
    d = docs.withColumns({"__m_text": F.coalesce(F.col(text), F.lit("")), "__m_w": _lower_words(text)})
    d = d.withColumn("__m_h", _hashes(F.col("__m_w")))
    t, w = F.col("__m_text"), F.col("__m_w")
    tokens = F.when(F.get(w, F.lit(0)) == "", F.lit(0)).otherwise(F.size(w))
    less = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    inked = F.greatest(F.length(F.translate(t, WS_CHARS, "")), F.lit(1))
    d = d.withColumns({
        "__m_tokens": tokens.cast("long"),
        "__m_distinct": F.size("__m_h"),
        "__m_style": F.array(*[F.log1p(50.0 * less(c) / inked) for c in (SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?")]),
        "__m_h": F.filter("__m_h", lambda h: F.get(ids, slot(h)) == h),
    }).drop("__m_text", "__m_w")

    def summed(k: int) -> Column:
        odds = table([slots[i][1][k] if i in slots else 0.0 for i in range(SLOTS)], "array<double>")
        return F.aggregate("__m_h", F.lit(0.0), lambda s, h: s + F.get(odds, slot(h)))

    d = d.withColumn("__m_sums", F.array(*map(summed, range(n_domains - 1))).cast("array<double>"))
    squash = lambda x, y: x / (1.0 + F.abs(x) / y)
    n = F.sqrt(F.col("__m_distinct").cast("double"))
    shape = F.array(F.log1p(F.col("__m_tokens").cast("double")), F.log((F.col("__m_tokens") + 1.0) / (F.col("__m_distinct") + 1.0)))
    f = F.concat(F.array(F.lit(1.0)), F.transform("__m_sums", lambda x: squash(x, 20.0)), F.transform("__m_sums", lambda x: squash(x / n, 2.0)), "__m_style", shape)
    return d.withColumn("__m_f", f).drop("__m_h", "__m_distinct", "__m_style", "__m_sums")


def _softmax(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_domains: int, *, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (domain, feature), those of domain 0 being 0, by Newton's method; the first feature is the constant 1."""
    n, m, k = *x.shape, n_domains - 1
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd = 0.0, np.where(sd > 1e-9, sd, 1.0)
    sd[0] = 1.0
    z, hot = (x - mean) / sd, np.eye(n_domains)[y]
    theta, keep = np.zeros((k, m)), np.full((k, m), ridge * weight.sum())
    keep[:, 0] = 0.0

    def loss(th: np.ndarray) -> tuple[float, np.ndarray]:
        s = np.concatenate([np.zeros((n, 1)), z @ th.T], 1)
        s -= s.max(1, keepdims=True)
        e = np.exp(s)
        norm = e.sum(1, keepdims=True)
        return float((weight * (np.log(norm[:, 0]) - (s * hot).sum(1))).sum() + (keep * th * th).sum() / 2), e / norm

    now, p = loss(theta)
    for _ in range(50):
        grad = ((weight[:, None] * (p - hot))[:, 1:].T @ z + keep * theta).ravel()
        curve = np.diag(keep.ravel() + 1e-9 * weight.sum())
        for a in range(k):
            for b in range(k):
                r = weight * p[:, a + 1] * ((a == b) - p[:, b + 1])
                curve[a * m : a * m + m, b * m : b * m + m] += (z * r[:, None]).T @ z
        step, size = np.linalg.solve(curve, grad).reshape(k, m), 1.0
        while size > 1e-6 and (there := loss(theta - size * step))[0] > now:
            size /= 2
        if size <= 1e-6:
            break
        theta, done, (now, p) = theta - size * step, now - there[0] < 1e-10 * weight.sum(), there
        if done:
            break
    theta = theta / sd
    theta[:, 0] -= theta[:, 1:] @ mean[1:]
    return np.concatenate([np.zeros((1, m)), theta]).round(6)


Model = tuple[list[tuple[int, list[float]]], list[list[float]]]


def fit_classifier(docs: DataFrame, domains: DataFrame, n_domains: int, *, max_labelled: int = MAX_LABELLED, text: str = "text") -> Model:
    """(weights of words, coefficients of the softmax per domain).

    At most ``max_labelled`` labelled documents, in hash order, are read. What reaches the driver is
    ``MAX_WORDS`` words of one half and a dozen numbers for each document of the other.
    """
    one = domains.where(F.col("domain").between(0, n_domains - 1)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    held = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("__m_id"), F.col("domain").alias("__m_domain"))
    found = docs.select("doc_id", text).join(F.broadcast(held), F.col("doc_id") == F.col("__m_id"))  # bounded: max_labelled rows
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    weights = _word_weights(found.where(half == 0), n_domains, text)
    rows = _with_features(found.where(half == 1), weights, n_domains, text).select("__m_domain", "__m_tokens", "__m_f").collect()
    if not rows:
        return weights, np.zeros((n_domains, 6 + 2 * (n_domains - 1))).tolist()
    rows.sort(key=lambda r: (r["__m_domain"], r["__m_tokens"], r["__m_f"]))
    x = np.array([r["__m_f"] for r in rows], float)
    # half a mean document of each domain, as a domain may have no labels
    x = np.concatenate([x, np.repeat(x.mean(0, keepdims=True), n_domains, 0)])
    y = np.array([*(r["__m_domain"] for r in rows), *range(n_domains)])
    tokens = np.array([r["__m_tokens"] for r in rows], float)
    weight = np.concatenate([tokens / max(tokens.mean(), 1.0), np.full(n_domains, 0.5)])
    return weights, _softmax(x, y, weight, n_domains).tolist()


def with_posteriors(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with ``__m_tokens`` (words) and ``__m_p`` (posterior per domain)."""
    weights, theta = model
    d = _with_features(docs, weights, len(theta), text)

    def score(row: list[float]) -> Column:
        s = F.lit(0.0)
        for i, c in enumerate(row):
            s = s + F.get("__m_f", F.lit(i)) * F.lit(float(c))
        return s

    d = d.withColumn("__m_s", F.array(*map(score, theta)))
    d = d.withColumn("__m_e", F.transform("__m_s", lambda s: F.exp(s - F.array_max("__m_s"))))
    d = d.withColumn("__m_p", F.transform("__m_e", lambda e: e / F.aggregate("__m_e", F.lit(0.0), lambda a, b: a + b)))
    return d.drop("__m_f", "__m_s", "__m_e")


def fit_rates(soft: DataFrame, weights: Sequence[float], *, floor: float = 0.0, ceiling: float = CEILING, rounds: int = ROUNDS, tolerance: float = 1e-6) -> tuple[Column, dict]:
    """(rate expression over ``__m_p``, report) so that expected token totals stand in the ratio ``weights``.

    The total is kept with floor 0; with a higher floor the ratio alone is asked for, and the total
    grows as far as it needs. No document is taken more than ``ceiling`` times. The report's ``gap`` is
    the summed distance of the totals from their targets over the total; where it is above
    ``tolerance``, the targets were not met.
    """
    k = len(weights)
    share = np.array(weights, float) / sum(weights)
    p, t = [F.get("__m_p", F.lit(i)) for i in range(k)], F.col("__m_tokens")
    q = [x - F.lit(float(s)) if floor > 0 else x for x, s in zip(p, share, strict=True)]
    # a decimal sum does not depend on the order of its terms
    exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")

    def rate(pull: np.ndarray) -> tuple[Column, Column]:
        free = F.lit(1.0)
        for m, x in zip(pull, q, strict=True):
            free = free - F.lit(float(m)) * x
        return F.least(F.lit(float(ceiling)), F.greatest(F.lit(float(floor)), free)), free

    def totals(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token totals by domain, and how fast the misfit changes: products over the documents off the bounds."""
        r, free = rate(pull)
        moving = F.when((free >= floor) & (free <= ceiling), t).otherwise(0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = [x or 0.0 for x in soft.agg(*[exact(r * t * x) for x in p], *[exact(moving * q[i] * q[j]) for i, j in pairs]).first()]
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:], strict=True):
            curve[i, j] = curve[j, i] = x
        return np.array(row[:k]), curve

    pull = np.zeros(k)
    now, curve = totals(pull)
    kept = max(now.sum(), 1.0)
    target = lambda x: share * (x.sum() if floor > 0 else kept)
    error = lambda x: float(np.abs(x - target(x)).sum() / max(x.sum() if floor > 0 else kept, 1.0))
    errors, looks, best = [error(now)], 1, (now, pull)
    for part in SOFTEN:
        soften, before = part * kept, errors[-1]
        down = lambda x, m: x - target(x) - soften * m  # noqa: B023, E731
        start = slope = down(now, pull)
        while looks < rounds and np.linalg.norm(slope) > max(1e-3 * np.linalg.norm(start), 1e-9 * kept):
            step = np.linalg.solve(curve + soften * np.eye(k), slope)
            # along a line the slope only falls: the stretch in which it passes zero is narrowed until little of it is left
            low, high, size = 0.0, math.inf, 1.0
            while True:
                there = pull + size * step
                then, curve_then = totals(there)
                looks += 1
                left = float(down(then, there) @ step) / float(slope @ step)
                if abs(left) <= 0.5 or looks >= rounds:
                    break
                low, high = (size, high) if left > 0 else (low, size)
                size = 4 * size if high == math.inf else (low + high) / 2 if low > 0 else high / 4
            pull, now, curve, slope = there, then, curve_then, down(then, there)
        errors.append(error(now))
        if errors[-1] < error(best[0]):
            best = now, pull
        # softening that matters no more: the targets are met, or no rates come closer
        if errors[-1] <= tolerance or looks >= rounds or (len(errors) > 3 and errors[-1] > 0.9 * before):
            break
    now, pull = best
    errors.append(error(now))
    report = {"target": target(now).tolist(), "reached": now.tolist(), "errors": errors, "gap": errors[-1], "met": errors[-1] <= tolerance, "ceiling": ceiling}
    return rate(pull)[0], report


def warn_unmet(report: dict) -> dict:
    """The report; a warning tells of targets that no rates within the bounds meet."""
    if not report["met"]:
        parts = [f"{x:.0f} of {t:.0f}" for x, t in zip(report["reached"], report["target"], strict=True)]
        warnings.warn(f"mixing targets not met, gap {report['gap']:.4f}: tokens {', '.join(parts)}", stacklevel=2)
    return report


def copies(rate: Column, key: Column) -> Column:
    """Whole copies with mean ``rate``: the fraction is decided by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: Sequence[float], *, floor: float = 0.0, ceiling: float = CEILING, widest: float = 0.0) -> tuple[DataFrame, dict]:
    """(docs with __m_tokens, __m_p, __m_rate, __m_copies; report). Posteriors are stored once; text stays where it is.

    While the targets are not met, the ceiling is doubled, up to ``widest``.
    """
    model = fit_classifier(docs, label_domains(labels), len(weights))
    soft = stored(with_posteriors(docs, model).select("__m_tokens", "__m_p"), "posteriors")
    rate, report = fit_rates(soft, weights, floor=floor, ceiling=ceiling)
    while not report["met"] and (ceiling := 2 * ceiling) <= widest:
        rate, report = fit_rates(soft, weights, floor=floor, ceiling=ceiling)
    warn_unmet(report)
    out = with_posteriors(docs, model).withColumn("__m_rate", F.round(rate, 6))
    return out.withColumn("__m_copies", copies(F.col("__m_rate"), F.col("doc_id"))), report


def rates(docs: DataFrame, labels: DataFrame, weights: Sequence[float], *, floor: float = 0.0) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies), without the texts."""
    model = fit_classifier(docs, label_domains(labels), len(weights))
    soft = stored(with_posteriors(docs, model).select("doc_id", "__m_tokens", "__m_p"), "posteriors")
    rate, report = fit_rates(soft, weights, floor=floor)
    warn_unmet(report)
    d = soft.withColumn("rate", F.round(rate, 6))
    return d.select("doc_id", F.col("__m_tokens").alias("n_tokens"), F.transform("__m_p", lambda x: F.round(x, 6)).alias("posterior"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def repeat(docs: DataFrame, labels: DataFrame, weights: Sequence[float], *, floor: float = 1.0, ceiling: float = 2.0, widest: float = 8.0) -> DataFrame:
    """docs, each row as often as the mix asks for, columns as before; a warning tells of targets not met."""
    mixed, _ = mix(docs, labels, weights, floor=floor, ceiling=ceiling, widest=widest)
    return mixed.withColumn("__m_i", F.explode(F.array_repeat(F.lit(0), F.col("__m_copies")))).select(*docs.columns)
