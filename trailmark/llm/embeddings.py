"""Near-duplicate embeddings: int8 tile products with a rigorous bound, then exact recomputation.

Vectors are scaled to length 1 and rounded to int8 with one step width each; the length of
what rounding took away is kept. For unit vectors u, v with roundings U, V and errors e:
|u.v - U.V| <= e_u * |v| + |U| * e_v. A pair whose rounded product less that bound reaches the threshold is
linked; one whose product plus the bound stays below it is not; only pairs in between are computed again in
double precision, from the full vectors, which are joined to these pairs alone.

Equal vectors of one label form a class and are compared once. Each label's classes are dealt
into tiles of bounded size, and a task multiplies two tiles, of which int8 components, a step and an error per
vector travel. From a tile pair come, per class, the number of certain links and the least class it reaches
there, and the uncertain pairs. A label's work grows with the square of its distinct vectors, as all of its pairs
are asked for; it is spread over its pairs of tiles, and each tile travels once per tile of its label.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors without label, link with nothing. Labels of any type are equal when their texts are. Vectors of different length do not link. Rows that
repeat a vec_id are separate vectors, in one label or several; a component's id is the least vec_id of its rows, of
which all rows with that vec_id are kept. A row without vec_id is dropped from the links, and is its
own row with null component. Vectors of any length are compared whole. An empty table gives no rows. Other
columns of vectors are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import stored
from trailmark.llm.components import connected_components, forest

#: Vectors of a tile, and rows of one tile whose products are held at a time.
TILE, STRIP = 4096, 512
#: Parts in which the rows of equal vectors meet their class.
SALTS = 16
#: Slack for double rounding of norms, products and bounds; far above what 1e6 components can add up to.
SLACK = 1e-9
TILE_NAMES = ["label", "dim", "tile", "tiles", "nodes", "copies", "q", "step", "error"]
TILE_KINDS = "label string, dim int, tile int, tiles int, nodes binary, copies binary, q binary, step binary, error binary"
TILE_SCHEMA = pa.schema([("label", pa.string()), *[(c, pa.int32()) for c in TILE_NAMES[1:4]], *[(c, pa.binary()) for c in TILE_NAMES[4:]]])
#: sure rows: a class, its certain links and the least class it reaches by them; the others: two classes in doubt
LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("sure", pa.bool_())])


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 roundings of the unit vectors, step widths, lengths of what rounding took away)"""
    u = _units(v)
    step = np.abs(u).max(axis=1) / 127
    q = np.rint(u / step[:, None]).astype(np.int8)
    return q, step, np.linalg.norm(u - q * step[:, None], axis=1) + SLACK


def _tile_of(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    v = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    cells = [np.ascontiguousarray(x).tobytes() for x in (table.column("node").to_numpy(), table.column("copies").to_numpy(), *quantise(v))]
    return pa.Table.from_pylist([dict(zip(TILE_NAMES, [table.column(c)[0].as_py() for c in TILE_NAMES[:4]] + cells, strict=True))], schema=TILE_SCHEMA)


def _opened(row: dict) -> dict:
    kinds = {"nodes": np.int64, "copies": np.int64, "q": np.int8, "step": np.float64, "error": np.float64}
    out = {c: np.frombuffer(row[c], t) for c, t in kinds.items()}
    return out | {"q": out["q"].reshape(-1, row["dim"])}


def tile_pairs(x: dict, y: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of two tiles that may be linked, each unordered pair once, and which of them surely are."""
    exact = np.float32 if x["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64  # in which int8 products add up exactly
    right, found = y["q"].astype(exact).T, []
    for at in range(0, len(x["q"]), STRIP):
        e, s = x["error"][at : at + STRIP, None], x["step"][at : at + STRIP, None]
        near = (x["q"][at : at + STRIP].astype(exact) @ right).astype(np.float64) * s * y["step"][None, :]
        slack = e + (1 + e) * y["error"][None, :]
        may = near + slack >= threshold
        if same:
            may &= np.arange(at, at + len(may))[:, None] < np.arange(len(y["q"]))[None, :]
        i, j = np.nonzero(may)
        found.append((i + at, j, near[i, j] - slack[i, j] >= threshold))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _links_of(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        same = rows[0]["i"] == rows[0]["j"]
        tiles = [_opened(r) for r in rows]
        x, y = (tiles[0], tiles[0]) if same else tiles
        i, j, sure = tile_pairs(x, y, same, threshold)
        doubt = [x["nodes"][i[~sure]], y["nodes"][j[~sure]]]
        i, j = i[sure], j[sure]
        nodes, at = np.unique(np.concatenate([x["nodes"][i], y["nodes"][j]]), return_inverse=True)
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, at, np.concatenate([y["copies"][j], x["copies"][i]]))
        root = nodes
        if len(nodes):
            known, least = forest(x["nodes"][i], y["nodes"][j])
            root = least[np.searchsorted(known, nodes)]
        n = len(doubt[0])
        cols = [np.concatenate([nodes, doubt[0]]), np.concatenate([root, doubt[1]]), np.concatenate([links, np.zeros(n, np.int64)])]
        return pa.Table.from_arrays([*map(pa.array, cols), pa.array(np.arange(len(nodes) + n) < len(nodes))], schema=LINK_SCHEMA)

    return work


def _exactly(threshold: float):
    """The pairs whose cosine in double precision reaches the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.float64) if batch.num_rows else np.zeros((0, 1)) for c in ("va", "vb"))
            keep = (_units(v) * _units(w)).sum(axis=1) >= threshold if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return work


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector; see the module's text."""
    v = F.col(vector)
    sound = v.isNotNull() & F.col(label).isNotNull() & F.col(vec_id).isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.select(F.col(vec_id).alias("vec"), F.col(label).cast("string").alias("label"), F.when(F.coalesce(sound, F.lit(False)), v.cast("array<double>")).alias("vector"))
    d = d.withColumns({"c1": F.xxhash64("vector"), "c2": F.xxhash64(F.lit(1), "vector")})
    key = ["label", "c1", "c2"]
    classes = d.where("vector is not null").groupBy(*key).agg(F.min("vec").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    # a class has a number of its own, as several may hold one vec_id
    classes = stored(classes.withColumns({"dim": F.size("vector"), "node": F.monotonically_increasing_id()}), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = stored(dealt.select("label", "dim", "tile", "tiles", "node", "copies", "vector").groupBy("label", "dim", "tile").applyInArrow(_tile_of, TILE_KINDS), "tiles")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = tiles.withColumn("o", other).withColumns({"i": F.least("tile", "o"), "j": F.greatest("tile", "o")}).drop("o")
    met = stored(pairs.groupBy("label", "dim", "i", "j").applyInArrow(_links_of(threshold), "a long, b long, links long, sure boolean"), "vector-links")
    side = lambda s: classes.select(F.col("node").alias(s), F.col("vector").alias(f"v{s}"), F.col("copies").alias(f"n{s}"))
    doubt = met.where("not sure").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "va", "vb")
    more = stored(doubt.mapInArrow(_exactly(threshold), "a long, b long, na long, nb long"), "vector-doubts")
    sure = met.where("sure")
    linked = sure.select(F.col("a").alias("node"), "links").union(more.select("a", "nb")).union(more.select("b", "na")).groupBy("node").agg(F.sum("links").alias("links"))
    parts = stored(connected_components(sure.select("a", "b").union(more.select("a", "b"))).withColumnRenamed("component", "part"), "vector-parts")
    per = classes.select(*key, "rep", "copies", "node").join(linked, "node", "left").join(parts, "node", "left")
    per = stored(per.withColumn("part", F.coalesce("part", "node")), "vector-classes-linked")
    least = per.groupBy("part").agg(F.min("rep").alias("component"))
    # a class of equal vectors may hold a third of all rows: they meet it in parts; a class of one row goes to that row's part alone
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    parts_of = F.when(F.col("copies") == 1, F.array(part("rep"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    per = per.join(least, "part").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component", F.explode(parts_of).alias("salt"))
    rows = d.select("vec", *key, F.col("vector").isNotNull().alias("sound"), part("vec").alias("salt"))
    out = rows.where("sound").join(per, [*key, "salt"]).select("vec", "n_links", "component").unionByName(
        rows.where("not sound").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    )
    return out.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"))
