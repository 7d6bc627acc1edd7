"""Hard-negative mining by product quantisation with stored residual norms, then an exact integer rerank.

Vectors of whole numbers are cut into runs of ``SUB`` components; each run is coded as the nearest of at most 256 whole-number centroids, and the
length of what is left is stored. An anchor's product with a centroid is one entry of a table, so the sum of a row's entries is the product with the coded vector, and the
true one is within sum |anchor run| * |residual run| of it. Rows whose bounds cannot reach the places asked for are left out; what may
reach them is computed in 64-bit integers.

Rows are dealt into tiles of bounded size, the rows of one label into neighbouring tiles, and anchors into blocks. Positives: a block meets the tiles of its labels. Negatives:
a block, with the windows that its positives give, meets every tile. A block and a tile leave a few rows per anchor at most, and the first of these over all tiles
are taken by a window, which Spark limits before its shuffle.

The centroids are fitted on ``SAMPLE`` rows (the first by a hash); they change the work, not the result.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of different length do not meet. Repeated rows are
rows of their own: an anchor that stands there twice has its results twice and is its own positive; equal scores and ids are alike. A label may be of any type and is compared as text. Scaled components beyond
2**20 are an error, as sums could pass 64 bits. An anchor without positives, or a window without negatives, gives no rows, and so does an empty table. Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import small_batches, stored

#: Rows of a tile, anchors of a block, rows on which centroids are fitted, and centroids and components of a run.
TILE, BLOCK, SAMPLE, CENTROIDS, SUB = 16_384, 512, 4_096, 256, 2
LARGEST = 1 << 20
TILE_KINDS = "dim int, t int, labels array<string>, ids binary, nodes binary, q binary, codes binary, left binary"
BLOCK_KINDS = "dim int, b long, a_labels array<string>, a_ids binary, a_nodes binary, a_q binary, a_scores array<array<long>>"


def runs_of(q: np.ndarray) -> np.ndarray:
    """(row, run, component), the last run filled up with zeros."""
    n, dim = q.shape
    m = -(-dim // SUB)
    return np.pad(q, ((0, 0), (0, m * SUB - dim))).reshape(n, m, SUB)


def fit_centroids(rows: list[list[int]], rounds: int = 8) -> np.ndarray:
    """(run, centroid, component): whole-number centroids of each run, by Lloyd's rounds. Runs that no row has get zeros."""
    longest = max(map(len, rows), default=0)
    out = np.zeros((-(-longest // SUB), CENTROIDS, SUB), np.int64)
    for m in range(len(out)):
        x = np.array([(r[m * SUB : (m + 1) * SUB] + [0] * SUB)[:SUB] for r in rows if len(r) > m * SUB], np.int64)
        distinct = np.unique(x, axis=0)
        c = distinct[np.unique(np.linspace(0, len(distinct) - 1, CENTROIDS).astype(int))].astype(float)
        for _ in range(rounds if len(distinct) > CENTROIDS else 0):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            for k in range(SUB):
                c[:, k] = np.where(n > 0, np.bincount(near, x[:, k], len(c)) / np.maximum(n, 1), c[:, k])
        out[m, : len(c)] = np.rint(c)
        out[m, len(c) :] = out[m, 0]
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2.0 * x @ c.T, axis=1)


def coded(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths of the residuals, rounded up), each (run, row)."""
    runs = runs_of(q)
    codes, left = np.zeros(runs.shape[1::-1], np.uint8), np.zeros(runs.shape[1::-1], np.float32)
    for m in range(len(codes)):
        c = centroids[m] if m < len(centroids) else np.zeros((1, SUB), np.int64)
        codes[m] = _nearest(runs[:, m], c.astype(float))
        away = np.sqrt(((runs[:, m] - c[codes[m]]) ** 2).sum(axis=1))
        left[m] = np.where(away > 0, np.nextafter((away * (1 + 1e-12)).astype(np.float32), np.float32(np.inf)), 0)
    return codes, left


def _pack(table: pa.Table) -> dict[str, np.ndarray]:
    dim = table.column("dim")[0].as_py()
    q = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(table.num_rows, dim)
    return {"ids": table.column("vec").to_numpy(), "nodes": table.column("node").to_numpy(), "q": q}


def _tile_of(centroids: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("dim", pa.int32()), ("t", pa.int32()), ("labels", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("ids", "nodes", "q", "codes", "left")]])

    def work(table: pa.Table) -> pa.Table:
        x = _pack(table)
        codes, left = coded(x["q"].astype(np.int64), centroids)
        row = {c: table.column(c)[0].as_py() for c in ("dim", "t")} | {"labels": table.column("label").to_pylist(), "codes": codes.tobytes(), "left": left.tobytes()}
        return pa.Table.from_pylist([row | {c: v.tobytes() for c, v in x.items()}], schema=schema)

    return work


def _block_of(table: pa.Table) -> pa.Table:
    schema = pa.schema([("dim", pa.int32()), ("b", pa.int64()), ("a_labels", pa.list_(pa.string())), *[(f"a_{c}", pa.binary()) for c in ("ids", "nodes", "q")], ("a_scores", pa.list_(pa.list_(pa.int64())))])
    row = {c: table.column(c)[0].as_py() for c in ("dim", "b")} | {"a_labels": table.column("label").to_pylist(), "a_scores": table.column("scores").to_pylist()}
    return pa.Table.from_pylist([row | {f"a_{c}": v.tobytes() for c, v in _pack(table).items()}], schema=schema)


class Met:
    """A block of anchors and a tile: bounds of an anchor's products with the tile's rows, and exact ones of the rows chosen."""

    def __init__(self, row: dict, centroids: np.ndarray):
        dim, read = row["dim"], np.frombuffer
        self.ids, self.nodes = read(row["ids"], np.int64), read(row["nodes"], np.int64)
        self.q, self.a = read(row["q"], np.int32).reshape(len(self.ids), dim), read(row["a_q"], np.int32).reshape(len(row["a_labels"]), dim).astype(np.int64)
        n, runs = len(self.ids), runs_of(self.a)
        m = runs.shape[1]
        self.codes, self.left = read(row["codes"], np.uint8).reshape(m, n), read(row["left"], np.float32).reshape(m, n)
        self.a_ids, self.a_nodes, self.a_scores = read(row["a_ids"], np.int64), read(row["a_nodes"], np.int64), row["a_scores"]
        numbers = {x: i for i, x in enumerate(dict.fromkeys(row["labels"]))}
        self.label = np.array([numbers[x] for x in row["labels"]], np.int64)
        self.a_label = [numbers.get(x, -1) for x in row["a_labels"]]
        full = np.zeros((m, CENTROIDS, SUB), np.int64)
        full[: len(centroids)] = centroids[:m]
        self.tables = np.einsum("ams,mks->amk", runs, full).astype(np.float64)  # whole numbers far below 2**53
        self.lengths = np.sqrt((runs * runs).sum(axis=2)) * (1 + 1e-9)
        self.seen = 0

    def bounds(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.zeros(len(self.ids))
        for table, codes in zip(self.tables[i], self.codes, strict=True):
            near += table[codes]
        slack = (self.lengths[i] @ self.left) * (1 + 1e-6)
        return np.ceil(near - slack), np.floor(near + slack)

    def first(self, i: int, may: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, products) of the first k of these rows by falling product, then rising id."""
        at = np.flatnonzero(may)
        self.seen += len(at)
        score = self.q[at].astype(np.int64) @ self.a[i]
        if low is not None:
            inside = (score >= low) & (score <= high)
            at, score = at[inside], score[inside]
        order = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][order], score[order]


def _kth(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def positives_of(met: Met, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, ids, products) of the first k other rows of its label in the tile."""
    for i, label in enumerate(met.a_label):
        same = (met.label == label) & (met.nodes != met.a_nodes[i])
        if label >= 0 and same.any():
            lower, upper = met.bounds(i)
            yield i, *met.first(i, same & (upper >= _kth(lower[same], k)), k)


def negatives_of(met: Met, k: int, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, positive, ids, products) of the first k rows of other labels whose product is low to high per cent of the positive's."""
    for i, label in enumerate(met.a_label):
        other = met.label != label
        if not other.any() or not met.a_scores[i]:
            continue
        lower, upper = met.bounds(i)
        for j, s in enumerate(met.a_scores[i]):
            least, most = -(-low * s // 100), high * s // 100
            if least > most:
                continue
            sure = other & (lower >= least) & (upper <= most)
            may = other & (upper >= max(least, _kth(lower[sure], k))) & (lower <= most)
            if may.any():
                ids, scores = met.first(i, may, k, least, most)
                if len(ids):
                    yield i, j, ids, scores


def _met_rows(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[Met]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Met(row, centroids)


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` chooses rows of ``vectors``. See the module's text."""
    v = F.col(vector)
    sound = v.isNotNull() & F.col(label).isNotNull() & F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec"), F.col(label).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("q")
    )
    fits = F.forall("q", lambda x: F.abs(x) <= LARGEST)
    d = d.withColumn("q", F.when(fits, F.col("q")).otherwise(F.raise_error(F.lit(f"scaled components beyond {LARGEST}")).cast("array<bigint>")))
    d = stored(d.withColumns({"dim": F.size("q"), "node": F.monotonically_increasing_id()}), "vectors")
    sample = d.orderBy(F.xxhash64("q", "vec"), "node").limit(SAMPLE).select("q").collect()  # bounded: SAMPLE rows
    centroids = fit_centroids([r["q"] for r in sample])
    # a label's rows are in one group of tiles, a large label's group has many
    groups = d.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("groups"))
    d = d.join(groups, "dim").withColumn("g", F.pmod(F.xxhash64("label"), F.col("groups")).cast("int"))
    sizes = d.groupBy("dim", "g").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.ceil(F.count(F.when(F.col("anchor"), 1)) / block).cast("int").alias("blocks"))
    per_dim = Window.partitionBy("dim").orderBy("g")  # a row per group of tiles
    sizes = sizes.withColumns({"t0": F.sum("tiles").over(per_dim) - F.col("tiles"), "b0": F.sum("blocks").over(per_dim) - F.col("blocks"), "total": F.sum("tiles").over(Window.partitionBy("dim"))})
    sizes = stored(sizes, "vector-groups")
    dealt = d.join(sizes, ["dim", "g"])
    deal = lambda first, n: (F.col(first) + F.pmod(F.xxhash64("node"), F.col(n))).cast("int")
    tiles = dealt.select("dim", deal("t0", "tiles").alias("t"), "label", "vec", "node", "q")
    tiles = stored(tiles.groupBy("dim", "t").applyInArrow(_tile_of(centroids), TILE_KINDS), "vector-tiles")
    asked = dealt.where("anchor").select("dim", deal("b0", "blocks").cast("long").alias("b"), "label", "vec", "node", "q", "t0", "tiles", "total")

    def meet(blocks: DataFrame, work, kinds: str, name: str) -> DataFrame:
        """Blocks, repeated for the tiles ``ts`` that they meet, and these tiles."""
        pairs = blocks.withColumn("t", F.explode("ts")).drop("ts").join(tiles, ["dim", "t"])
        with small_batches(d.sparkSession, 1):  # a block and a tile at a time
            return stored(pairs.mapInArrow(work, kinds), name)

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _met_rows(batches, centroids):
            out = [(met.a_nodes[i], met.a_ids[i], ids, scores) for i, ids, scores in positives_of(met, positives)]
            n = [len(x[2]) for x in out]
            cols = [np.repeat([x[0] for x in out], n), np.repeat([x[1] for x in out], n), *(np.concatenate([[], *[x[c] for x in out]]) for c in (2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["anchor", "anchor_id", "positive_id", "score"])

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _met_rows(batches, centroids):
            out = [(met.a_nodes[i], j, ids, scores) for i, j, ids, scores in negatives_of(met, negatives, low, high)]
            n = [len(x[2]) for x in out]
            cols = [np.repeat([x[0] for x in out], n), np.repeat([x[1] for x in out], n), *(np.concatenate([[], *[x[c] for x in out]]) for c in (2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["anchor", "place", "negative_id", "negative_score"])

    def first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int, name: str) -> DataFrame:
        best = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
        return rows.withColumn(name, F.row_number().over(best)).where(F.col(name) <= k)

    def blocks_of(rows: DataFrame, ts: Column) -> DataFrame:
        kept = rows.groupBy("dim", "b").agg(F.min(F.struct(ts.getItem(0), ts.getItem(1))).alias("x"), F.first("dim").alias("_"))
        span = kept.select("dim", "b", F.sequence(F.col("x.col1"), F.col("x.col2")).alias("ts"))
        packed = rows.select("dim", "b", "label", "vec", "node", "q", "scores").groupBy("dim", "b").applyInArrow(_block_of, BLOCK_KINDS)
        return packed.join(span, ["dim", "b"])

    nothing = F.array().cast("array<bigint>")
    own = blocks_of(asked.withColumn("scores", nothing), F.array(F.col("t0").cast("int"), (F.col("t0") + F.col("tiles") - 1).cast("int")))
    found = meet(own, find_positives, "anchor long, anchor_id long, positive_id long, score long", "positives")
    found = stored(first(found, ["anchor"], "score", "positive_id", positives, "place"), "first-positives")
    scores = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("x"))  # at most ``positives`` of them
    windows = asked.join(scores.select(F.col("anchor").alias("node"), F.transform("x", lambda y: y["score"]).alias("scores")), "node")
    every = blocks_of(windows, F.array(F.lit(0), (F.col("total") - 1).cast("int")))
    met = meet(every, find_negatives, "anchor long, place long, negative_id long, negative_score long", "negatives")
    met = first(met, ["anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    named = found.select("anchor", "anchor_id", (F.col("place") - 1).cast("long").alias("place"), "positive_id", F.col("score").alias("positive_score"))
    return met.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
