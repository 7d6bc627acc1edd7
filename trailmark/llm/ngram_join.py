"""Exact Jaccard self join of documents on word shingles, as a blocked sparse matrix product.

The incidence matrix (documents x shingles) is never held as rows. Its columns are cut into
blocks by hash; tasks send each block one packed message per batch of documents. A block
counts in how many documents each of its shingles is found and forgets those found once. Per
document the shared shingles meet again, and size bounds discard it unless it shares at least
ceil(t * n) of its n shingles. Columns are ordered by rarity; two documents with similarity t share
one of their first n - ceil(t * n) + 1 columns (prefix), so only these columns are multiplied.

A column with m documents has m * m / 2 products, so before any pairs are made documents are
compared with a few pivots of their columns and joined into components: first with the document that
has the fewest shingles of its own (an original rather than an edited copy), then, round by round, those
outside a column's largest component with random ones. Rounds end when the products between components
that are left are a few per column entry, or when they no longer shrink. From then on a column
only gives pairs that lie in different components: those of documents outside its largest
component, multiplied in blocks of bounded size. A pair is dropped where its sizes without columns held by one document alone, or the parity
bitmaps of its columns (each differing column flips one bit), show too small an overlap. The others' overlaps in
the prefix are added up over columns: outside both prefixes a pair shares less than need(n) columns, so
those whose sum cannot reach the bound are dropped, and the rest is computed in full. No pair of the threshold is lost: it either
lies in one component already or is compared.

The products add up the overlap in the prefixes only, as all columns of a pair would be many times the rows; the overlap
that decides is counted from the two sets of the few pairs that are left.

Frequent shingles: one found 64 times or more in one batch sends its block only a count, and the
documents' rows go around the block, spread by batch. All such shingles come last in the order.

Defined results: null or empty texts have no shingles and link with nothing. Texts with equal
shingle sets are one class. A row without doc_id has a null component and links with nothing. Rows that
repeat a doc_id are one node of the graph (with the largest of their sets); each row is returned
with its own n_shingles. A very long text is one set, handled in a batch of its own. An empty table gives no rows. Other
columns of docs are not read, so their names cannot clash. Hashes of 64 bits tell shingles apart, 48 of them in comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import shuffle_partitions, small_batches, stored
from trailmark.llm.components import connected_components
from trailmark.llm.shingles import chunks, digests, shingle_sets

BITS, FREQUENT, FLUSH, LAST = 48, 64, 1_000_000, (1 << 31) - 1
META = "key long, n long, d1 long, d2 long"
COLD, COUNTS, AROUND = 0, 1, 2
#: Random pivots of a column in a round; products per column entry at which rounds end.
PIVOTS, ENOUGH = 8, 2
#: Rows of a column on either side of a block of its last products; parts into which a class of equal sets is dealt.
BLOCK, SALTS = 2048, 16


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays, byte plane by byte plane, compressed; ascending ones as differences."""
    import zstandard

    out = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        d = a.astype(np.uint64)
        rising = bool((d[1:] >= d[:-1]).all())
        if rising:
            d = np.diff(d, prepend=np.uint64(0))
        width = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
        planes = d.view(np.uint8).reshape(-1, 8)[:, :width].T
        out += [np.array([len(a), width, rising], np.uint32).tobytes(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4, []
    for _ in range(int(np.frombuffer(raw, np.uint32, 1)[0])):
        n, width, rising = map(int, np.frombuffer(raw, np.uint32, 3, at))
        d = np.zeros((n, 8), np.uint8)
        d[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 12).reshape(width, n).T
        d = d.view(np.uint64).ravel()
        out.append(np.cumsum(d, dtype=np.uint64) if rising else d)
        at += 12 + n * width
    return out


def need(n, percent: int):
    """ceil(t * n): the least overlap that a set of n can have with a similar one."""
    return -(-n * percent // 100)


def shingle_meta(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(key, n, d1, d2): size and digest of each row's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                h, begin = shingle_sets(batch.column(1).slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(begin)), *map(pa.array, digests(h, begin))], ["key", "n", "d1", "d2"])

    return docs.select(F.col(doc_id).cast("long").alias("key"), text).mapInArrow(work, META)


def incidence(docs: DataFrame, bits: int, *, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(block, kind, blob): packed columns of the incidence matrix, one message per block and batch."""
    schema = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

    def messages(held: list) -> Iterator[pa.RecordBatch]:
        keys, ns = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        h, doc = np.concatenate([x[2] for x in held]) >> np.uint64(64 - BITS), np.repeat(np.arange(len(keys)), ns)
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[first, len(h)])
        common = np.repeat(n >= FREQUENT, n)
        rows: list[tuple[int, int, bytes]] = []
        place = np.zeros(len(keys), np.int64)
        if common.any():
            ch, cd = h[common], doc[common]
            by = np.lexsort((ch, cd))
            used, local = np.unique(cd[by], return_inverse=True)
            rows.append((int(keys[0]) % (1 << bits), AROUND, pack(keys[used], ns[used], local, ch[by])))
        for k, hs, ds in ((COLD, h[~common], doc[~common]), (COUNTS, h[first[n >= FREQUENT]], n[n >= FREQUENT])):
            if not len(hs):
                continue
            block = (hs >> np.uint64(BITS - bits)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(block)], strict=True):
                if k == COLD:
                    used = np.flatnonzero(np.bincount(ds[a:b], minlength=len(keys)))
                    place[used] = np.arange(len(used))
                    local = place[ds[a:b]]
                    rows.append((int(block[a]), k, pack(keys[used], ns[used], local, hs[a:b])))
                else:
                    rows.append((int(block[a]), k, pack(hs[a:b], ds[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n = set(), [], 0
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                h, begin = shingle_sets(batch.column(1).slice(a, b - a), size)
                keys, marks = batch.column(0).slice(a, b - a).to_pylist(), zip(np.diff(begin).tolist(), *(d.tolist() for d in digests(h, begin)), strict=True)
                take = np.zeros(len(keys), bool)
                for i, (k, m) in enumerate(zip(keys, marks, strict=True)):
                    # of equal sets of a batch one is sent; their digests link the others to it
                    if k is not None and m[0] > 0 and m not in seen:
                        take[i] = True
                        seen.add(m)
                ns = np.diff(begin)
                held.append((np.array([k for k, t in zip(keys, take, strict=True) if t], np.int64), ns[take], h[np.repeat(take, ns)]))
                n += int(ns[take].sum())
                if n >= FLUSH:
                    yield from messages(held)
                    seen, held, n = set(), [], 0
        if n:
            yield from messages(held)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(work, "block int, kind int, blob binary")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


SENT = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _shared_columns(buckets: int):
    """A block: document frequency of each of its shingles, and the rows of those found twice or more."""

    def work(table: pa.Table) -> pa.Table:
        hs, keys, ns, marked, around = [], [], [], [np.zeros(0, np.uint64)], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind == COUNTS:
                marked.append(unpack(blob)[0])
                continue
            k, n, local, h = unpack(blob)
            local = local.astype(np.int64)
            if kind == COLD:
                keys.append(k[local].astype(np.int64)), ns.append(n[local].astype(np.int64)), hs.append(h)
            else:
                around.append((k[local].astype(np.int64), n[local].astype(np.int64), h, np.full(len(h), LAST, np.int64)))
        parts = around
        if hs:
            h, key, n = np.concatenate(hs), np.concatenate(keys), np.concatenate(ns)
            order = np.argsort(h)
            h, key, n = h[order], key[order], n[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            common = np.isin(h[first], np.concatenate(marked))
            df = np.repeat(np.where(common, LAST, size), size)
            parts = [*around, (key[df > 1], n[df > 1], h[df > 1], df[df > 1])]
        if not parts or not sum(len(p[0]) for p in parts):
            return SENT.empty_table()
        key, n, h, df = (np.concatenate(c) for c in zip(*parts, strict=True))
        to = _bucket(key, buckets)
        order = np.lexsort((h, key, to))
        key, n, h, df, to = key[order], n[order], h[order], df[order], to[order]
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        ends = np.r_[cut[1:], len(to)]
        return pa.Table.from_arrays([pa.array(to[cut], pa.int32()), pa.array([pack(key[a:b], n[a:b], h[a:b], df[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], schema=SENT)

    return work


KEPT = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("columns", pa.binary())])


def _survivors(percent: int):
    """A bucket of documents: those that share enough, with their shared columns from rare to frequent."""

    def work(table: pa.Table) -> pa.Table:
        key, n, h, df = (np.concatenate(c) for c in zip(*map(unpack, table.column("blob").to_pylist()), strict=True))
        key, n = key.astype(np.int64), n.astype(np.int64)
        order = np.lexsort((h, df, -n, key))
        key, n, h, df = key[order], n[order], h[order], df[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (h[1:] != h[:-1])]  # sent by two batches
        key, n, h = key[fresh], n[fresh], h[fresh]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out = []
        for a, b in zip(cut, np.r_[cut[1:], len(key)], strict=True):
            b = a + int(np.searchsorted(-n[a:b], -n[a], "right"))  # of a repeated key the largest set
            if b - a >= need(n[a], percent):
                out.append((int(key[a]), int(n[a]), int(max(0, n[a] - (b - a))), h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()))
        if not out:
            return KEPT.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), KEPT, strict=True)], schema=KEPT)

    return work


def _columns(blob: bytes) -> np.ndarray:
    w = BITS // 8
    out = np.zeros((len(blob) // w, 8), np.uint8)
    out[:, :w] = np.frombuffer(blob, np.uint8).reshape(-1, w)
    return out.view(np.uint64).ravel().astype(np.int64)


def _prefixes(percent: int):
    """(column, key, n, alone) for the columns of each document's prefix; columns held by it alone come first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, at = [], []
            for i, (n, alone, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "alone", "columns")), strict=True)):
                h = _columns(blob)[: max(0, n - need(n, percent) + 1 - alone)]
                hs.append(h)
                at.append(np.full(len(h), i))
            if hs:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), *(batch.column(c).take(take) for c in ("key", "n", "alone"))], ["h", "key", "n", "alone"])

    return work


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, s0..s3): of each of 256 classes of columns, whether a document holds an odd number of them."""
    for batch in batches:
        odd = np.zeros((batch.num_rows, 256), np.uint8)
        for i, blob in enumerate(batch.column("columns").to_pylist()):
            odd[i] = np.bincount(_columns(blob) & 255, minlength=256) & 1
        s = np.packbits(odd, axis=1).view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(4))], ["key", "s0", "s1", "s2", "s3"])


def _similar(percent: int):
    """The pairs whose sets have 100 * overlap >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, n, x, m, y in zip(*(batch.column(c).to_pylist() for c in ("a", "na", "ca", "nb", "cb")), strict=True):
                if a not in known:
                    known = {a: np.sort(_columns(x))}
                both = len(np.intersect1d(known[a], np.sort(_columns(y)), assume_unique=True))
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b)."""
    x = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("columns").alias("ca"))
    y = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("columns").alias("cb"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "na", "ca", "b", "nb", "cb").mapInArrow(_similar(percent), "a long, b long")


def _labelled(prefix: DataFrame, links: list[DataFrame]) -> DataFrame:
    """prefix with each document's component so far."""
    if not links:
        return prefix.withColumn("c", F.col("key"))
    known = links[0]
    for x in links[1:]:
        known = known.union(x)
    comp = connected_components(known)
    joined = prefix.join(comp, F.col("key") == F.col("node"), "left").select("h", "key", "n", "alone", F.coalesce("component", "key").alias("c"))
    return stored(joined, "labelled")


def _leads(p: DataFrame, orders: list[Column]) -> DataFrame:
    """Per column that joins components: its largest one, its entries in and outside it, and the first document of each order."""
    first = [F.min(F.struct(o.alias("o"), "key", "n", "alone", "c")) for o in orders]
    each = p.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), *[x.alias(f"v{i}") for i, x in enumerate(first)])
    main = each.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("parts"), F.array(*[F.min(f"v{i}") for i in range(len(orders))]).alias("pivots"))
    return main.where("parts > 1").drop("parts")


def _possible(n: Column, alone: Column, m: Column, also_alone: Column, percent: int) -> Column:
    """Whether sets of n and m, of which so many are in no other set, can be similar at all."""
    return (100 + percent) * F.least(n - alone, m - also_alone) >= percent * (n + m)


def _pivot_pairs(p: DataFrame, leads: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): documents outside their column's largest component and the pivots they share most columns with.

    What the limit of ``most`` leaves out is met by later rounds or by the exact rest.
    """
    met = p.join(leads.select("h", "main", "pivots"), "h").where("c <> main")
    pivots = F.array_distinct(F.transform("pivots", lambda v: F.struct(v.key.alias("key"), v.n.alias("n"), v.alone.alias("alone"), v.c.alias("c"))))
    met = met.select("key", F.explode(F.filter(pivots, lambda v: (v.c != F.col("c")) & _possible(v.n, v.alone, F.col("n"), F.col("alone"), percent))).alias("v"))
    count = met.groupBy("key", F.col("v.key").alias("pivot")).agg(F.count(F.lit(1)).alias("k"))
    best = count.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "pivot")), False), 1, most).alias("best"))
    return best.select(F.col("key").alias("a"), F.explode("best.pivot").alias("b"))


def similar_links(docs: DataFrame, percent: int = 80, *, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """Links (a, b) that join all documents of similarity percent / 100 or more into their components.

    Texts with equal sets may be missing from the links; their digests tell them.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bits = max(2, (2 * parts - 1).bit_length())
    sent = incidence(docs, bits, doc_id=doc_id, text=text, size=size).groupBy("block").applyInArrow(_shared_columns(parts), "bucket int, blob binary")
    with small_batches(spark):
        sets = stored(sent.groupBy("bucket").applyInArrow(_survivors(percent), "key long, n long, alone long, columns binary"), "shingle-sets")
        prefix = stored(sets.mapInArrow(_prefixes(percent), "h long, key long, n long, alone long"), "prefixes")
    links: list[DataFrame] = []
    entries = prefix.count()
    p, before, turn = _labelled(prefix, links), math.inf, 0
    while True:
        seeds = [F.xxhash64(F.lit(turn * PIVOTS + i), "key") for i in range(PIVOTS)] if turn else [F.try_divide("alone", "n"), F.xxhash64("key")]
        leads = stored(_leads(p, seeds), "leads")
        left = leads.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0]
        if not left or turn and (left <= ENOUGH * entries or left > 0.9 * before):
            break
        with small_batches(spark):
            links.append(stored(verify(_pivot_pairs(p, leads, percent, len(seeds)), sets, percent), "pivot-links"))
        p, before, turn = _labelled(prefix, links), left if turn else math.inf, turn + 1
    marks = sets.mapInArrow(_bitmaps, "key long, s0 long, s1 long, s2 long, s3 long")
    # a column's products are cut into blocks of BLOCK rows a side, so that none is one task's
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    wide = leads.select("h", "main", blocks(F.col("all") - F.col("most")).alias("xs"), blocks(F.col("all")).alias("ys"))
    with small_batches(spark):
        rest = stored(p.join(wide, "h").join(marks, "key"), "rest")
    part = ("key", "n", "alone", "c", "s0", "s1", "s2", "s3")
    own = lambda count: F.pmod(F.xxhash64("key"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    x = rest.where("c <> main").select("h", "main", own("xs").alias("i"), every("ys").alias("j"), F.struct(*part).alias("x"))
    y = rest.select("h", every("xs").alias("i"), own("ys").alias("j"), F.struct(*part).alias("y"))
    n, m = F.col("x.n"), F.col("y.n")
    differ = F.col("x.alone") + F.col("y.alone")
    for k in range(4):
        differ = differ + F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}")))
    # sets that differ in d have an overlap of (n + m - d) / 2; a pair outside its main component is met from either side
    fits = _possible(n, F.col("x.alone"), m, F.col("y.alone"), percent) & ((100 + percent) * (n + m - differ) >= 2 * percent * (n + m))
    once = (F.col("y.c") == F.col("main")) | (F.col("x.key") < F.col("y.key"))
    met = x.join(y, ["h", "i", "j"]).where((F.col("x.c") != F.col("y.c")) & once & fits)
    count = met.groupBy(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.max(F.greatest(n, m)).alias("n"), F.max(n + m).alias("both"))
    pairs = count.where((100 + percent) * (F.col("k") + F.ceil(F.col("n") * percent / 100) - 1) >= percent * F.col("both"))
    with small_batches(spark):
        links.append(stored(verify(pairs, sets, percent), "pair-links"))
    out = links[0]
    for e in links[1:]:
        out = out.union(e)
    return out


def jaccard_components(docs: DataFrame, percent: int = 80, *, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs."""
    with small_batches(docs.sparkSession):
        meta = stored(shingle_meta(docs, doc_id=doc_id, text=text, size=size), "shingle-meta")
    full = meta.where("n > 0 and key is not null")
    # a class may hold a third of all rows: they meet its least document in parts
    part = ["n", "d1", "d2", "salt"]
    classes = stored(full.groupBy("n", "d1", "d2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "classes")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = full.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    equal = salted.join(classes, part).select(F.col("key").alias("a"), F.col("rep").alias("b"))
    links = similar_links(docs, percent, doc_id=doc_id, text=text, size=size).union(equal)
    parts = connected_components(links)
    out = meta.join(parts, F.col("key") == F.col("node"), "left")
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the least doc_id. Repeated rows count as one."""
    parts = jaccard_components(docs, percent).where("component_id = doc_id").select(F.col("doc_id").alias("__j_id")).distinct()
    kept = docs.join(parts, F.col("doc_id") == F.col("__j_id"), "left_semi")
    return kept.unionByName(docs.where("doc_id is null"))
