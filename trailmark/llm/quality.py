"""Quality rules with risk-controlled cutoffs.

A rule is a score that grows with badness and a list of candidate cutoffs. On labelled
documents that are known to be good (the holdout: no cutoff was fitted on them) each
stratum counts, for every rule and cutoff, how many good documents the rule would reject.
The exact lower binomial tail P(Bin(n, alpha) <= k) is the p-value of "this cutoff rejects
more than alpha of the good documents"; a cutoff counts as safe if it stays below delta
divided by the number of tests (strata x rules x cutoffs). The lowest safe cutoff of each
rule and stratum is used. With alpha split over the rules, all rules together reject at
most ``alpha`` of a stratum's good documents, with probability 1 - delta in all strata at
once. A stratum with too few labelled documents gets no cutoff, and nothing of it is
rejected beyond the base rule.

Everything is a column expression or an aggregate. One row is one document; the words of a
document are handled inside its row, so a text must fit in memory once.

Defined results: a null or empty text has no words and fails the base rule. Null strata form
one stratum. A label that is null or of an unknown document is not used; of several labels of
one document the lowest counts. Repeated documents are judged alike. Without labels only the
base rule acts. Columns of the input never clash with the internal ones (prefix ``__q_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import WS_CHARS, stored, words

SYMBOLS = "#*$%&|<>"
#: rule -> (score over the metric columns, candidate cutoffs from strict to lax)
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "repeats": ("n_repeat_words / n_words", (0.1, 0.2, 0.3, 0.4, 0.45)),
    "dup_lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.5, 0.7)),
    "capitals": ("n_capitals / word_chars", (0.1, 0.2, 0.3, 0.5, 0.7)),
    "bangs": ("n_bangs / n_words", (0.05, 0.1, 0.2, 0.5, 1.0)),
}
ALPHA, DELTA = 0.05, 0.05
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(w: str, n: str) -> list[dict[str, Column]]:
    """Steps that count the words covered by 3-word windows found twice or more.

    Each window becomes one long: 33 hash bits above its position. After a sort of longs,
    windows with equal hash bits are neighbours; only those are compared word by word.
    """
    word, pos = F.col(w), lambda k: F.col(k).bitwiseAND(0x7FFFFFFF).cast("int")
    keys = F.transform(
        F.slice(word, 1, F.greatest(F.col(n) - 2, F.lit(0)).cast("int")),
        lambda x, i: F.shiftleft(F.xxhash64(x, F.get(word, i + 1), F.get(word, i + 2)), 31).bitwiseOR(i.cast("long")),
    )
    top = lambda k: F.shiftright(k, 31)
    like = lambda s: F.filter(
        F.col(s), lambda k, i: F.coalesce(top(k) == top(F.get(F.col(s), i - 1)), F.lit(False)) | F.coalesce(top(k) == top(F.get(F.col(s), i + 1)), F.lit(False))
    )
    windows = F.array_sort(
        F.transform(
            F.transform(F.col("__q_like"), lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int")),
            lambda p: F.struct(F.get(word, p).alias("a"), F.get(word, p + 1).alias("b"), F.get(word, p + 2).alias("c"), p.alias("p")),
        )
    )
    s = F.col("__q_windows")
    same = lambda x, y: F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))
    places = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x.p))
    p = F.col("__q_places")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return [
        {"__q_keys": F.sort_array(keys)},
        {"__q_like": like("__q_keys")},
        {"__q_windows": windows},
        {"__q_places": places},
        {"__q_n_repeat_words": covered.cast("long")},
    ]


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the metric columns ``__q_<metric>``."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, lines = F.col("__q_w"), F.col("__q_l")
    df = df.withColumns(
        {"__q_w": words(F.col(text)), "__q_l": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")}
    )
    bare = _without(t, WS_CHARS)
    df = df.withColumns(
        {
            "__q_n_words": F.when(F.get(w, F.lit(0)) == "", F.lit(0)).otherwise(F.size(w)).cast("long"),
            "__q_word_chars": bare.cast("long"),
            "__q_n_symbols": (F.length(t) - _without(t, SYMBOLS)).cast("long"),
            "__q_n_lines": F.size(lines).cast("long"),
            "__q_n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "__q_n_capitals": (F.length(t) - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
            "__q_n_bangs": (F.length(t) - _without(t, "!?")).cast("long"),
        }
    )
    for step in _repeat_words("__q_w", "__q_n_words"):
        df = df.withColumns(step)
    return df.drop("__q_w", "__q_l", "__q_keys", "__q_like", "__q_windows", "__q_places")


def base_failed() -> Column:
    n, r = F.col("__q_n_words"), F.col("__q_n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def score(rule: str) -> Column:
    """A rule's score; null where its denominator is 0, and null is never above a cutoff."""
    over, under = RULES[rule][0].split(" / ")
    return F.try_divide(F.col(f"__q_{over}").cast("double"), F.col(f"__q_{under}").cast("double"))


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), summed term by term from the logarithm of the first."""
    step = F.log(F.lit(alpha)) - F.log(F.lit(1 - alpha))
    first = n * F.log(F.lit(1 - alpha))
    sums = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, n)),
        F.struct(first.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a.term + F.when(j < n, F.log((n - j) / (j + 1))).otherwise(0.0) + step).alias("term"), (a["sum"] + F.exp(a.term)).alias("sum")),
    )
    return F.least(sums["sum"], F.lit(1.0))


def holdout_counts(measured: DataFrame, labels: DataFrame, stratum: str, *, doc_id: str = "doc_id") -> DataFrame:
    """Per stratum, rule and cutoff: n good labelled documents, k of them above the cutoff."""
    good = labels.groupBy(F.col(doc_id).alias("__q_id")).agg(F.min("quality").alias("__q_label")).where("__q_label = 1")
    pairs = [(r, c) for r, (_, cuts) in RULES.items() for c in cuts]
    d = measured.join(good, F.col(doc_id) == F.col("__q_id"), "left_semi").where(~base_failed())
    counted = d.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce((score(r) > c).cast("long"), F.lit(0))).alias(f"k{i}") for i, (r, c) in enumerate(pairs)]
    )
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(pairs)])
    return counted.select("stratum", "n", F.explode(each).alias("x")).select("stratum", "n", "x.rule", "x.cutoff", "x.k")


def select_cutoffs(counts: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The lowest safe cutoff per stratum and rule; rows only where there is one."""
    strata = counts.select(F.count_distinct(F.struct("stratum"))).scalar()
    tests = sum(len(c) for _, c in RULES.values())
    tested = counts.withColumns({"p": binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)), "s": strata})
    return tested.where(F.col("p") <= delta / (F.col("s") * tests)).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def with_verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured (see with_metrics), ``__q_base_failed`` and ``__q_kept``."""
    # a stratum has cutoffs only if it holds enough labelled documents, so there are few
    per = cutoffs.groupBy(F.col("stratum").alias("__q_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__q_cutoffs"))
    df = measured.join(F.broadcast(per), F.col(stratum).eqNullSafe(F.col("__q_stratum")), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(score(r) > F.col("__q_cutoffs")[r], F.lit(False))
    df = df.withColumns({"__q_base_failed": base_failed(), "__q_kept": ~base_failed() & ~rejected})
    return df.drop("__q_stratum", "__q_cutoffs")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", *, text: str = "text", doc_id: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs without the documents that the rules reject, columns as before.

    The metrics are computed once and stored beside the documents; the cutoffs come from all labelled good ones.
    """
    measured = stored(with_metrics(docs, text), "measured")
    held = labels.groupBy(doc_id).agg(F.min("quality").alias("quality"))
    cutoffs = stored(select_cutoffs(holdout_counts(measured, held, stratum, doc_id=doc_id), alpha, delta), "cutoffs")
    return with_verdict(measured, cutoffs, stratum).where("__q_kept").select(*docs.columns)
