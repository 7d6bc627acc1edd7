"""Phrase collocation mining: frequent words get ids, n-grams of ids become fixed-width keys, sorted by range and counted by runs.

1. Texts are cut into chunks of one language. A chunk holds its distinct words once, and its sequence of words as numbers
   into these, with breaks between pieces. So what is counted and joined per chunk is a row per distinct word, not per word.
2. Words found often enough, the dictionary, are numbered by language, then frequency. A chunk's words meet the dictionary in a
   join; the sequence is renumbered, and rarer words become breaks as well, since no frequent phrase holds them.
3. A position with two words at least gives one key of twelve bytes: three ids, or two and a zero before a break. Keys of a
   chunk are sorted by radix and counted by runs, so a frequent phrase leaves a chunk once.
4. Keys are dealt out by range. A key's place between 0 and 1 is that of arithmetic coding with the words' frequencies, which
   follows the order of keys and gives ranges of like size. A range that is larger all the same, as words attract each other, is
   split by chunk into parts of bounded size. A part is sorted by radix and counted by runs; counts of a phrase from several parts, or of a pair whose
   keys cross the border of a range, are added up.
5. Phrases are joined with the counts of their parts, scored in exact decimals, and ranked per language.

Defined results: a null text is empty and gives nothing; a null language is ``und``. A text of any length is handled whole. Repeated rows count as often as they stand there. Phrases of equal
score and count follow each other by their bytes. Scores are exact for counts up to 10**15, whose products decimals of 38 digits hold. An empty table gives no
rows. Other columns of documents are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import shuffle_partitions, small_batches, stored

#: Bytes of text of a chunk (a longer text is a chunk alone), and keys of a range.
CHUNK, RANGE_KEYS = 1 << 22, 1 << 20
#: Where a piece ends, and what divides its words. 0xFF is no byte of UTF-8, so it can stand for a break.
ENDS, BREAK = b".,;:!?\n\x0b\x0c\r", b"\xff"
TO_BREAKS = bytes.maketrans(ENDS, BREAK * len(ENDS))

CHUNKS = "chunk long, lang string, words array<string>, counts array<long>, seq binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("seq", pa.binary())])
RUNS = "range int, chunk long, n long, pairs binary, thirds binary, counts binary"
RUN_SCHEMA = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("pairs", "thirds", "counts")]])
COUNTS = "pair long, third int, n long"
COUNT_SCHEMA = pa.schema([("pair", pa.int64()), ("third", pa.int32()), ("n", pa.int64())])


def cut_words(texts: list[bytes]) -> list[bytes]:
    """Words of the texts with A-Z lower-cased, and BREAK where a piece ends."""
    return (b" " + BREAK + b" ").join(texts).lower().translate(TO_BREAKS).replace(BREAK, b" " + BREAK + b" ").split()


def _chunk_of(texts: list[bytes], lang: str, number: int) -> pa.RecordBatch | None:
    found = pa.array(cut_words(texts), pa.binary()).dictionary_encode()
    words, seq = found.dictionary, found.indices.to_numpy()
    counts = np.bincount(seq, minlength=len(words))
    stop = pc.index(words, pa.scalar(BREAK)).as_py()
    if stop >= 0:
        counts[stop] = 0
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    if not len(order):
        return None
    to = np.full(len(words), -1, np.int32)  # the break keeps -1
    to[order] = np.arange(len(order))
    words, counts = words.take(pa.array(order)).cast(pa.string()), counts[order]
    cells = [pa.array([number]), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts)), pa.array([to[seq].tobytes()])]
    return pa.RecordBatch.from_arrays(cells, schema=CHUNK_SCHEMA)


def _cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a language are gathered over batches until they make a chunk; what is gathered of all languages together is bounded too."""
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        size.pop(lang)
        out = _chunk_of(held.pop(lang), lang, number)
        number += 1
        if out is not None:
            yield out

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            if lang in size and size[lang] + len(text) > CHUNK:
                yield from flush(lang)
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
        while sum(size.values()) > 2 * CHUNK:
            yield from flush(max(size, key=size.get))
    for lang in list(held):
        yield from flush(lang)


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable ascending order of rows of unsigned integers, most significant column first, by digits of 16 bits, lowest first."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        top = int(c.max()) if len(c) else 0
        for shift in range(0, max(top.bit_length(), 1), 16):
            digit = ((c >> c.dtype.type(shift)) & c.dtype.type(0xFFFF)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16 bits by radix
    return order


def run_lengths(pairs: np.ndarray, thirds: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, third) in ascending order and how often each stands there."""
    order = radix_order([pairs, thirds])
    pairs, thirds = pairs[order], thirds[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]) | (thirds[1:] != thirds[:-1])
    at = np.flatnonzero(fresh)
    if counts is None:
        total = np.diff(np.r_[at, len(pairs)])
    else:
        total = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return pairs[at], thirds[at], total


def _chunk_runs(ranges: int):
    """The keys of a chunk, from its sequence and its words' ids and shares, by range."""

    def work(chunk: pa.Table, known: pa.Table) -> pa.Table:
        if not chunk.num_rows or not known.num_rows:
            return RUN_SCHEMA.empty_table()
        seq = np.frombuffer(chunk.column("seq")[0].as_py(), np.int32)
        size = int(seq.max()) + 2
        local = known.column("local").to_numpy()
        ids, share = np.zeros(size, np.uint32), np.zeros((4, size))  # -1 is the last entry, which stays 0
        ids[local] = known.column("id").to_numpy()
        for row, c in zip(share, ("low", "wide", "low_in", "wide_in"), strict=True):
            row[local] = known.column(c).to_numpy()
        g = ids[seq]
        at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0))
        if not len(at):
            return RUN_SCHEMA.empty_table()
        follow = np.r_[g, np.uint32(0)][at + 2]
        pairs, thirds, counts = run_lengths((g[at].astype(np.uint64) << np.uint64(32)) | g[at + 1], follow)
        back = np.zeros(int(ids.max()) + 1 if ids.max() < 1 << 24 else 0, np.int64)
        if len(back):  # the entry that has an id
            back[ids[local]] = local
            where = lambda x: back[x]
        else:
            by_id = local[np.argsort(ids[local])]
            where = lambda x: by_id[np.minimum(np.searchsorted(ids[by_id], x), len(by_id) - 1)]
        one, two = where((pairs >> np.uint64(32)).astype(np.int64)), where((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
        low3 = np.where(thirds > 0, share[2][where(thirds.astype(np.int64))], 0.0)
        place = share[0][one] + share[1][one] * (share[2][two] + share[3][two] * low3)
        dealt = np.minimum((place * ranges).astype(np.int32), ranges - 1)
        cuts = np.r_[0, np.flatnonzero(np.diff(dealt)) + 1, len(dealt)]
        counts = counts.astype(np.uint32)
        cell = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        n = len(cuts) - 1
        cells = [pa.array(dealt[cuts[:-1]]), pa.array(np.full(n, chunk.column("chunk")[0].as_py())), pa.array(np.diff(cuts)), cell(pairs), cell(thirds), cell(counts)]
        return pa.Table.from_arrays(cells, schema=RUN_SCHEMA)

    return work


def _range_counts(least: int):
    """Counts of a part of a range. Where it is the range's only part, only what reaches ``least`` or may go on in the next range leaves it."""

    def work(table: pa.Table) -> pa.Table:
        whole = table.column("parts")[0].as_py() == 1
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        pairs, thirds, counts = run_lengths(joined("pairs", np.uint64), joined("thirds", np.uint32), joined("counts", np.uint32).astype(np.int64))
        at = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        of_pair = np.add.reduceat(counts, at)
        frequent = (of_pair >= least) | (not whole)
        frequent[[0, -1]] = True  # these two may have keys in the ranges beside
        keep = (thirds > 0) & ((counts >= least) | (not whole))
        out = [np.r_[pairs[at][frequent], pairs[keep]].astype(np.int64), np.r_[np.zeros(np.count_nonzero(frequent), np.int32), thirds[keep].astype(np.int32)], np.r_[of_pair[frequent], counts[keep]]]
        return pa.Table.from_arrays([pa.array(x) for x in out], schema=COUNT_SCHEMA)

    return work


def count_phrases(docs: DataFrame, least: int = 10, *, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, sizes) with at least ``least`` occurrences per language.

    words: (id, lang, word, f); phrases: (a, b, c, f) of ids, c being 0 for two words; sizes: (lang, n).
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    with small_batches(spark):
        chunks = stored(d.mapInArrow(_cut_chunks, CHUNKS), "chunks", "zstd")
    each = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "x")).select("chunk", "lang", "local", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    frequent = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    order = ["lang", F.desc("f"), "word"]
    words = stored(frequent.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "words")
    # one row per range of words: their number is a parameter
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(ahead), F.lit(0))
    parts = words.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.sum("f").alias("s")).select("part", before("k").alias("k0"), before("s").alias("s0"))
    inside = Window.partitionBy("part").orderBy(*order)
    words = words.withColumns({"k": F.row_number().over(inside), "s": F.sum("f").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(F.broadcast(parts), "part")
    words = stored(words.select((F.col("k0") + F.col("k")).alias("id"), "lang", "word", "f", (F.col("s0") + F.col("s") - F.col("f")).alias("low")), "dictionary")
    total, top = words.agg(F.sum("f"), F.max("id")).first()
    if (top or 0) >= 1 << 31:
        raise ValueError("more frequent words than ids of 31 bits")
    total, ranges = total or 1, max(1, -(-(total or 1) // RANGE_KEYS))
    of_lang = words.groupBy("lang").agg(F.min("low").alias("low0"), F.sum("f").alias("f0"))
    share = lambda x, y: x.cast("double") / y
    shares = words.join(of_lang, "lang").select(
        "lang", "word", "id", share(F.col("low"), F.lit(float(total))).alias("low"), share(F.col("f"), F.lit(float(total))).alias("wide"),
        share(F.col("low") - F.col("low0"), F.col("f0")).alias("low_in"), share(F.col("f"), F.col("f0")).alias("wide_in"),
    )
    known = each.select("chunk", "lang", "local", "word").join(shares, ["lang", "word"]).drop("lang", "word").withColumnRenamed("chunk", "of")
    sequences = chunks.select("chunk", "seq")
    runs = stored(sequences.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_chunk_runs(ranges), RUNS), "runs", "zstd")
    cut = runs.groupBy("range").agg(F.ceil(F.sum("n") / RANGE_KEYS).cast("int").alias("parts"))
    dealt = runs.join(cut, "range").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int"))
    partial = dealt.drop("chunk", "n").groupBy("range", "part").applyInArrow(_range_counts(least), COUNTS)
    phrases = partial.groupBy("pair", "third").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    phrases = phrases.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), F.col("third").cast("long").alias("c"), "f")
    return words.select("id", "lang", "word", "f"), stored(phrases, "phrases"), sizes


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two or three words.

    a, l and r are the counts of a phrase and of its two parts at the cut with the lowest score, floor(10**6 a a / (l r)). A phrase within a longer one that has at least
    ``inside`` per cent of its count is left out.
    """
    words, phrases, sizes = count_phrases(docs, least, text=text, lang=lang)
    pairs = phrases.where("c = 0").select("a", "b", F.col("f").alias("f2"))
    triples = phrases.where("c > 0")
    word = lambda s: words.select(F.col("id").alias(s), F.col("word").alias(f"w{s}"), F.col("f").alias(f"f{s}"))
    exact = lambda x: F.col(x).cast("decimal(19,0)")

    def score(part: str, rest: str):
        # a <= l and a <= r, so that the quotient is at most 10**6
        over, under = exact("f") * exact("f"), exact(part) * exact(rest)
        return F.call_function("div", (over * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), under.cast("decimal(38,0)"))

    # a pair within triples: the largest count at either end
    around = triples.select("a", "b", "f").union(triples.select("b", "c", "f")).groupBy("a", "b").agg(F.max("f").alias("longest"))
    alone = pairs.join(around, ["a", "b"], "left").where(F.coalesce(100 * F.col("longest") < inside * F.col("f2"), F.lit(True)))
    two = alone.join(word("a").join(words.select(F.col("id").alias("a"), "lang"), "a"), "a").join(word("b"), "b").withColumnRenamed("f2", "f")
    two = two.select("lang", F.concat_ws(" ", "wa", "wb").alias("phrase"), F.col("f").alias("a"), F.col("fa").alias("l"), F.col("fb").alias("r"), score("fa", "fb").alias("score"))
    front = pairs.withColumnRenamed("f2", "f_ab")
    back = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f2").alias("f_bc"))
    three = triples.join(front, ["a", "b"]).join(back, ["b", "c"]).join(word("a").join(words.select(F.col("id").alias("a"), "lang"), "a"), "a").join(word("b"), "b").join(word("c"), "c")
    cut = F.least(F.struct(score("fa", "f_bc").alias("s"), F.lit(1).alias("k"), F.col("fa").alias("l"), F.col("f_bc").alias("r")), F.struct(score("f_ab", "fc").alias("s"), F.lit(2).alias("k"), F.col("f_ab").alias("l"), F.col("fc").alias("r")))
    three = three.withColumn("cut", cut).select("lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", F.col("cut.s").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each part of a language, then of these, so that no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    each = two.unionByName(three).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
