"""Toxicity by a convolutional text classifier over hashed word embeddings, with thresholds calibrated by language.

A word (a run of letters, digits and non-ASCII characters, A-Z lower-cased), its first six bytes and its last six are hashed to slots. A slot's embedding is its smoothed
log odds between the labels and the evidence behind them. While filters are trained, a document's own label is taken out of its words' embeddings, or every rare
word would give its document away. Filters of several widths run over the whole text; of each filter the largest answer in the text and the mean of the
largest answers in ``PARTS`` equal parts of it go to a logistic layer. A last step fits the score's slope and level on
documents kept from training, so that a score is a probability. Per language, the threshold with the best F1 on these documents is kept, where there are
enough of them, and the overall one elsewhere.

The model learns from all labelled documents. They are dealt out by hash into shares of about ``SHARE_BYTES`` of text and stored as slot numbers. Slots are counted by
tasks and added up. In each epoch a task takes the weights through its share by Adam, in numpy, and the shares' weights and moments are averaged, by
documents and in decimals, so that their order does not show. Slope, level and thresholds come from sums over all documents kept from training. What meets on the
driver is a few hundred weights and a table of ``SLOTS`` rows, whatever the corpus. Scores see the text alone.

Defined results: a null or empty text, or one without words, scores as a text without any hit. A text of any length is scored whole. Repeated rows score alike. Labels that are null or of unknown
documents are not used; of repeated labels the largest counts. Without labels of both kinds the score is the share of toxic labels (0 without labels). An empty table gives no rows.
Internal columns begin with ``__t_``; those of docs may have any other name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import small_batches, stored
from trailmark.llm.shingles import BASE, INVERSE, _mix, chunks

SHARE_BYTES, RUN_WORDS, BATCH_WORDS, MOST_BROADCAST = 8_000_000, 2_000_000, 200_000, 2_000_000
SLOT_BITS, AFFIX, CHANNELS = 17, 6, 6
SLOTS = 1 << SLOT_BITS
WIDTHS, FILTERS, PARTS = (1, 2, 3, 5), 6, 8
EPOCHS, BATCH, RATE, FEWEST = 12, 32, 0.01, 20
FEATURES = 2 * FILTERS * len(WIDTHS)
LABELLED = ("share", "kept", "toxic", "lang")
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots of word, beginning and end: three per word; first word of each text and the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].copy()
    off = off - off[0]
    buf[(buf >= 65) & (buf <= 90)] += 32
    solid = WORD_BYTES[buf]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]  # a word ends with its text
    starts[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(s):
        return np.zeros((0, 3), np.int32), np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(buf), BASE, np.uint64))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        power = np.cumprod(np.full(len(buf), INVERSE, np.uint64))
        out = np.empty((len(s), 3), np.int32)
        for k, (a, b) in enumerate(((s, e), (s, np.minimum(e, s + AFFIX)), (np.maximum(s, e - AFFIX), e))):
            h = _mix(((total[b] - total[a]) * power[a]) ^ np.uint64(k))
            out[:, k] = h % np.uint64(SLOTS)
    return out, np.searchsorted(s, off)


@dataclass
class Model:
    table: np.ndarray  # (slot, 2): log odds and evidence
    filters: list[np.ndarray]  # per width (width, channel, filter)
    bias: np.ndarray
    head: np.ndarray
    level: float
    slope: float = 1.0
    offset: float = 0.0


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic, n_clean) -> np.ndarray:
    """(log odds of a slot, smoothed by one document at the labels' share, and how many standard errors they are from 0), scaled to about one."""
    n = n_toxic + n_clean
    share = min(max(n_toxic / n, 1 / (n + 2)), 1 - 1 / (n + 2))
    w = np.log((toxic + share) / (n_toxic + 1)) - np.log((clean + 1 - share) / (n_clean + 1))
    z = w / np.sqrt(1 / (toxic + share) + 1 / (clean + 1 - share))
    return np.stack([w / 3, z / 3], -1).astype(np.float32).clip(-3, 3)


def convolve(x: np.ndarray, at: np.ndarray, filters: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Answers (word, filter) at least 0; a window that would leave its text answers 0. x: (word, channel)."""
    last = np.repeat(at[1:], np.diff(at)) - np.arange(len(x))  # words from here to the end of the text
    out = np.empty((len(x), len(bias)), np.float32)
    for k, w in enumerate(filters):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        y = np.broadcast_to(bias[cols], (len(x), FILTERS)).astype(np.float32)
        for j in range(min(len(w), len(x))):
            y[: len(x) - j] += x[j:] @ w[j]
        np.maximum(y, 0, out=y)
        y[last < len(w)] = 0
        out[:, cols] = y
    return out


def part_starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each part of each text, words of each part)."""
    n = np.diff(at)
    edge = at[:-1, None] + n[:, None] * np.arange(PARTS + 1)[None, :] // PARTS
    return edge[:, :-1].ravel(), np.diff(edge, axis=1).ravel()


def pooled(answers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each text: largest answers, then the mean of the parts' largest; largest answers per part)."""
    starts, n = part_starts(at)
    padded = np.concatenate([answers, np.zeros((1, answers.shape[1]), np.float32)])
    most = np.maximum.reduceat(padded, starts, axis=0) if len(starts) else np.zeros((0, answers.shape[1]), np.float32)
    most[n == 0] = 0
    most = most.reshape(-1, PARTS, answers.shape[1])
    filled = np.maximum((n.reshape(-1, PARTS) > 0).sum(axis=1), 1)[:, None]
    return np.concatenate([most.max(axis=1), most.sum(axis=1) / filled], axis=1), most


def _gradient(model: Model, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the filters, their bias, the layer and its level for one batch, and the loss."""
    answers = convolve(x, at, model.filters, model.bias)
    f, most = pooled(answers, at)
    p = 1 / (1 + np.exp(-(f @ model.head + model.level)))
    wrong = ((p - y) / len(y)).astype(np.float32)
    into = wrong[:, None] * model.head[None, :]
    half = len(model.bias)
    of_part = np.repeat(into[:, None, half:], PARTS, axis=1)
    starts, n = part_starts(at)
    filled = np.maximum((n.reshape(-1, PARTS) > 0).sum(axis=1), 1)
    of_part = of_part / filled[:, None, None]
    leads = np.argmax(most, axis=1)  # the part that holds the text's largest answer
    rows, cols = np.indices(leads.shape)
    np.add.at(of_part, (rows, leads, cols), into[:, :half])
    of_part = of_part.reshape(-1, half)
    of_part[n == 0] = 0
    flat = most.reshape(-1, half)
    # the first word of each part at which a filter gives its largest answer there
    part_of = np.repeat(np.arange(len(n)), n)
    word, col = np.nonzero((answers > 0) & (answers == flat[part_of]))
    key, first = np.unique(part_of[word] * half + col, return_index=True)
    word, col, g = word[first], col[first], of_part.ravel()[key].astype(np.float32)
    bias, filters = np.bincount(col, g, half).astype(np.float32), [np.zeros_like(w) for w in model.filters]
    for c in range(half):
        at_c, g_c = word[col == c], g[col == c]
        for j in range(WIDTHS[c // FILTERS]):
            filters[c // FILTERS][j][:, c % FILTERS] = g_c @ x[at_c + j]
    loss = float(-np.log(np.where(y > 0, p, 1 - p).clip(1e-9)).mean())
    return [*filters, bias, f.T @ wrong, np.array(wrong.sum())], loss


def _tables(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings of all slots; those without the label of one clean or one toxic document). toxic, clean: documents of each slot, the three kinds apart."""
    own = [_odds(toxic, np.maximum(clean - 1, 0), n_toxic, n_clean - 1), _odds(np.maximum(toxic - 1, 0), clean, n_toxic - 1, n_clean)]
    return _odds(toxic, clean, n_toxic, n_clean).reshape(3, SLOTS, 2), np.stack(own).reshape(2, 3, SLOTS, 2)


def _kinds_apart(slots: np.ndarray) -> np.ndarray:
    """Each slot once a document."""
    return np.unique(slots + np.arange(3, dtype=np.int32) * SLOTS)


@dataclass
class Training:
    """Weights on their way, with Adam's moments and steps."""

    params: list[np.ndarray]  # filters, bias, head, level
    first: list[np.ndarray]
    second: list[np.ndarray]
    steps: float = 0.0

    @staticmethod
    def begin(n_toxic: float, n_clean: float, seed: int = 7) -> Training:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.5 / np.sqrt(w * CHANNELS), (w, CHANNELS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for w in filters:  # the first filter of each width begins as a mean of all channels
            w[:, :, 0] = 1 / (len(w) * 3)
        level = np.array(np.log((n_toxic + 0.5) / (n_clean + 0.5)), np.float32)
        params = [*filters, np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FEATURES, 0.1, np.float32), level]
        return Training(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])

    def numbers(self) -> np.ndarray:
        return np.concatenate([np.ravel(p) for p in (*self.params, *self.first, *self.second)] + [[self.steps]]).astype(float)

    def of(self, numbers: np.ndarray) -> Training:
        """These numbers in the shapes of this one."""
        like = [*self.params, *self.first, *self.second]
        ends = np.cumsum([p.size for p in like])
        made = [x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(numbers, ends)[:-1], like, strict=True)]
        k = len(self.params)
        return Training(made[:k], made[k : 2 * k], made[2 * k :], float(numbers[-1]))

    def model(self, table: np.ndarray) -> Model:
        return Model(table, self.params[:-3], self.params[-3], self.params[-2], float(self.params[-1]))

    def epoch(self, docs: list[np.ndarray], y: np.ndarray, own: np.ndarray, pace: float, rng: np.random.Generator) -> None:
        """Once over docs, the slots of each, in random order."""
        order, lo = rng.permutation(len(docs)), 0
        while lo < len(docs):
            words = np.cumsum([len(docs[i]) for i in order[lo : lo + BATCH]])
            rows = order[lo : lo + max(1, int(np.searchsorted(words, BATCH_WORDS, "right")))]
            lo += len(rows)
            x = np.concatenate([embedded(own[int(y[i])], docs[i]) for i in rows])
            if not len(x):
                continue
            grads, _ = _gradient(self.model(own), x, np.r_[0, np.cumsum([len(docs[i]) for i in rows])], y[rows].astype(np.float32))
            self.steps += 1
            for p, g, m, v in zip(self.params, grads, self.first, self.second, strict=True):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)).astype(np.float32)


def _newton(sums) -> tuple[float, float]:
    """(slope, level) of labels over x by Newton's method; the slope is kept positive. sums(slope, level): sums over all documents of (p - y) x, p - y, r x x, r x and r, where r = p (1 - p)."""
    slope, level = 1.0, 0.0
    for _ in range(30):
        wrong_x, wrong, rxx, rx, r = sums(slope, level)
        step = np.linalg.solve(np.array([[rxx + 0.01, rx], [rx, r + 1e-3]]), np.array([wrong_x + 0.01 * (slope - 1), wrong]))
        before = slope, level
        slope, level = max(float(slope - step[0]), 0.05), float(level - step[1])
        if max(abs(slope - before[0]), abs(level - before[1])) < 1e-9:
            break
    return slope, level


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> tuple[Model, np.ndarray, np.ndarray]:
    """One share in memory: (model, documents kept for calibration, their scores). docs: slots (word, 3) of each document; y: its label, 0 or 1."""
    kept = np.arange(len(docs)) % 5 == 4
    counts = np.zeros((2, 3 * SLOTS))
    for d, label in zip(docs, y, strict=True):
        counts[int(label)][_kinds_apart(d)] += 1
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    table, own = _tables(counts[1], counts[0], n1, n0)
    train, hold, state = np.flatnonzero(~kept), np.flatnonzero(kept), Training.begin(n1, n0, seed)
    for epoch in range(EPOCHS):
        state.epoch([docs[i] for i in train], y[train], own, RATE * (1 - epoch / EPOCHS), np.random.default_rng((seed, epoch)))
    model = state.model(table)
    raw = np.array([_raw(model, embedded(own[int(y[i])], docs[i]), np.array([0, len(docs[i])]))[0] for i in hold])

    def sums(slope: float, level: float) -> tuple[float, ...]:
        p = 1 / (1 + np.exp(-(slope * raw + level)))
        wrong, r = p - y[hold], p * (1 - p)
        return (wrong * raw).sum(), wrong.sum(), (r * raw * raw).sum(), (r * raw).sum(), r.sum()

    model.slope, model.offset = _newton(sums)
    return model, hold, 1 / (1 + np.exp(-(model.slope * raw + model.offset)))


def _raw(model: Model, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    f, _ = pooled(convolve(x, at, model.filters, model.bias), at)
    return f @ model.head + model.level


def embedded(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return np.concatenate([table[k][slots[:, k]] for k in range(3)], axis=1)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probabilities of label 1, rounded so that the cut into batches does not show."""
    slots, at = word_slots(texts)
    raw = _raw(model, embedded(model.table, slots), at)
    return np.round(1 / (1 + np.exp(-(model.slope * raw + model.offset))), 6)


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch.column("text")):
            part = batch.slice(a, b - a)
            slots, at = word_slots(part.column("text"))
            packed = slots[:, 0] | slots[:, 1].astype(np.int64) << SLOT_BITS | slots[:, 2].astype(np.int64) << 2 * SLOT_BITS
            cells = [packed[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in LABELLED), pa.array(cells, pa.binary())], [*LABELLED, "slots"])


def _unpacked(cell: bytes) -> np.ndarray:
    packed = np.frombuffer(cell, np.int64)
    return (packed[:, None] >> np.arange(0, 3 * SLOT_BITS, SLOT_BITS) & SLOTS - 1).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 3 * SLOTS), np.int64)
    for batch in batches:
        for label, cell in zip(batch.column("toxic").to_pylist(), batch.column("slots"), strict=True):
            counts[label][_kinds_apart(_unpacked(cell.as_py()))] += 1
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1][at]), pa.array(counts[0][at])], ["slot", "toxic", "clean"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(share, slots of documents, labels) of rows that follow each other in one share, about RUN_WORDS words at a time."""
    share, docs, y, words = None, [], [], 0
    for batch in batches:
        for k, label, cell in zip(batch.column("share").to_pylist(), batch.column("toxic").to_pylist(), batch.column("slots"), strict=True):
            if docs and (k != share or words > RUN_WORDS):
                yield share, docs, np.array(y)
                docs, y, words = [], [], 0
            share = k
            docs.append(_unpacked(cell.as_py()))
            y.append(label)
            words += len(docs[-1])
    if docs:
        yield share, docs, np.array(y)


def _labelled(docs: DataFrame, labels: DataFrame, usable: Column | None, key: str, text: str, lang: str) -> DataFrame:
    """(share, kept from training, toxic, lang, slots) of all labelled documents, a share in one order in one place."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & (F.lit(True) if usable is None else usable))
    one = stored(known.groupBy(F.col(key).alias("__t_key")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("__t_key")), "toxic-labels")
    few = one.count() <= MOST_BROADCAST  # a key and a label a row; where they are more, both sides are shuffled
    found = docs.select(F.col(key).alias("__t_doc"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).join(F.broadcast(one) if few else one, F.col("__t_doc") == F.col("__t_key"))
    size = found.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    shares = max(1, -(-size // SHARE_BYTES))
    found = found.select(F.pmod("h", F.lit(shares)).cast("int").alias("share"), (F.pmod(F.shiftright("h", 32), F.lit(5)) == 4).alias("kept"), "toxic", "lang", "h", "text")
    dealt = found.repartitionByRange(shares, "share").sortWithinPartitions("share", "h", "toxic", "text").drop("h")
    with small_batches(docs.sparkSession):
        return stored(dealt.mapInArrow(_slots_of, "share int, kept boolean, toxic int, lang string, slots binary"), "toxic-slots")


def _trained(slots: DataFrame, state: Training, own) -> Training:
    """The weights after ``EPOCHS`` epochs of all shares. own: a broadcast."""
    learnt = slots.where(~F.col("kept")).select("share", "toxic", "slots")
    for epoch in range(EPOCHS):

        def work(batches: Iterator[pa.RecordBatch], epoch=epoch, begin=state.numbers()) -> Iterator[pa.RecordBatch]:
            shape, at, now, n = Training.begin(1, 1), None, None, 0

            def out() -> pa.RecordBatch:
                v = np.append(now.numbers(), 1.0) * n
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], ["i", "v"])

            for share, docs, y in _runs(batches):
                if share != at:
                    if n:
                        yield out()
                    at, now, n, rng = share, shape.of(begin), 0, np.random.default_rng((7, epoch, share))
                now.epoch(docs, y, own.value, RATE * (1 - epoch / EPOCHS), rng)
                n += len(docs)
            if n:
                yield out()

        with small_batches(slots.sparkSession):
            sums = learnt.mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,18)")).cast("double").alias("v")).orderBy("i").collect()  # a number per weight
        if not sums:
            return state
        v = np.array([r["v"] for r in sums])
        state = state.of(v[:-1] / v[-1])
    return state


def _thresholds(held: DataFrame, p: Column) -> dict[str | None, float]:
    """The score from which F1 is largest per language with FEWEST toxic documents, and overall (0.5 without toxic ones)."""
    rows = held.select(F.explode(F.array(F.coalesce("lang", F.lit("")), F.lit(None).cast("string"))).alias("lang"), F.round(p, 6).alias("p"), "toxic")
    at = rows.groupBy("lang", "p").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"))  # a million values of p at most
    w = Window.partitionBy("lang")
    down = w.orderBy(F.desc("p"))
    f1 = at.select("lang", "p", F.sum("hits").over(w).alias("all"), F.sum("hits").over(down).alias("caught"), F.sum("n").over(down).alias("n"))
    best = f1.groupBy("lang").agg(F.max(F.struct(2 * F.col("caught") / (F.col("n") + F.col("all")), "p")).alias("b"), F.max("all").alias("all"))
    found = {r["lang"]: r["p"] for r in best.where((F.col("all") >= FEWEST) | (F.col("lang").isNull() & (F.col("all") > 0))).select("lang", "b.p").collect()}
    return {None: 0.5} | found


def fit_model(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[Model | float, dict[str | None, float]]:
    """(model, or the share of toxic labels where these are of one kind; thresholds per language, that of ``None`` being the overall one).

    labels: (key, toxic). ``usable``, a condition on the key, says which labels may be learnt from.
    """
    spark = docs.sparkSession
    slots = _labelled(docs, labels, usable, key, text, lang)
    n, n1 = slots.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n < 5 or n1 in (0, n):
        return n1 / n if n else 0.0, {None: 0.5}
    with small_batches(spark):
        counts = slots.select("toxic", "slots").mapInArrow(_counted, "slot long, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()  # a row per slot
    of_slot = np.zeros((2, 3 * SLOTS))
    of_slot[:, counts["slot"].to_numpy()] = counts["clean"].to_numpy(), counts["toxic"].to_numpy()
    table, own = _tables(of_slot[1], of_slot[0], n1, n - n1)
    shared = spark.sparkContext.broadcast(own)
    model = _trained(slots, Training.begin(n1, n - n1), shared).model(table)
    weights = Model(np.zeros(0), model.filters, model.bias, model.head, model.level)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, cells = batch.column("toxic").to_pylist(), [_unpacked(c.as_py()) for c in batch.column("slots")]
            r = [float(_raw(weights, embedded(shared.value[k], d), np.array([0, len(d)]))[0]) for k, d in zip(y, cells, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("lang"), pa.array(r, pa.float64())], ["toxic", "lang", "raw"])

    with small_batches(spark):
        held = stored(slots.where("kept").select("toxic", "lang", "slots").mapInArrow(raw, "toxic int, lang string, raw double"), "toxic-held")

    def p(slope: float, level: float) -> Column:
        return 1 / (1 + F.exp(-(F.col("raw") * slope + level)))

    def sums(slope: float, level: float) -> list[float]:
        d = held.select("raw", (p(slope, level) - F.col("toxic")).alias("wrong"), (p(slope, level) * (1 - p(slope, level))).alias("r"))
        terms = ("wrong * raw", "wrong", "r * raw * raw", "r * raw", "r")
        return [x or 0.0 for x in d.agg(*(F.sum(F.expr(t)) for t in terms)).first()]

    model.slope, model.offset = _newton(sums)
    return model, _thresholds(held, p(model.slope, model.offset))


def with_scores(docs: DataFrame, model: Model | float, columns: list[str], *, text: str = "text") -> DataFrame:
    """``columns`` of docs and ``__t_score``."""
    d = docs.select(*columns, F.col(text).cast("string").alias("__t_text"))
    if isinstance(model, float):
        return d.drop("__t_text").withColumn("__t_score", F.lit(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                p = scores(model, part.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], [*columns, "__t_score"])

    kinds = d.drop("__t_text").schema.add("__t_score", "double")
    return d.mapInArrow(work, kinds)


def score_documents(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, score, flagged): flagged where the score reaches the threshold of the document's language."""
    model, thresholds = fit_model(docs, labels, usable=usable, key=key, text=text, lang=lang)
    scored = with_scores(docs, model, [key, lang], text=text)
    own = {x: at for x, at in thresholds.items() if x is not None}  # a language with FEWEST toxic labels each
    cut = F.lit(thresholds[None])
    if own:
        cut = F.coalesce(F.create_map(*(F.lit(v) for x in own.items() for v in x))[F.coalesce(lang, F.lit(""))], cut)
    return scored.select(key, lang, F.col("__t_score").alias("score"), (F.col("__t_score") >= cut).alias("flagged"))
