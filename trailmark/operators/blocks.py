"""Sequences cut into blocks of frames, so that a long recording is many tasks and not one per individual.

Tables hold one row per key and frame. Where an operator looks a bounded number of rows back or ahead, each
block also gets these rows of its neighbours (a halo). Where it looks back without bound, each block says in one
small row what it hands on, and these rows are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK, TASK_ROWS = 20_000, 500_000
#: Frames of a block that holds all individuals of a colony.
SPAN = 600


def block_of(frame: Column | str, block: int = BLOCK) -> Column:
    return F.floor((F.col(frame) if isinstance(frame, str) else frame) / block).cast("long")


def with_halo(df: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """df with ``__b``: each row in its own block, and in those that look at it from up to before rows later or after rows earlier."""
    return df.withColumn("__b", F.explode(F.sequence(block_of(F.col("frame") - after, block), block_of(F.col("frame") + before, block))))


def own_rows(df: DataFrame, block: int = BLOCK) -> DataFrame:
    return df.where(F.col("__b") == block_of("frame", block)).drop("__b")


def per_frame(df: DataFrame) -> DataFrame:
    """df, of a row per frame or block, kept out of broadcasts: the planner's size of an exploded table is that of the table before it."""
    return df.hint("merge")


def by_tracklet(df: DataFrame) -> DataFrame:
    """df, of a row per tracklet, as the side that tasks hold in a join with a row per frame, whose many rows are then not sorted."""
    return df.hint("shuffle_hash")


def dealt_out(df: DataFrame, *key: str, rows: int | None = None) -> DataFrame:
    """df dealt out by key to as many tasks of about ``rows`` rows as it asks for; it is counted first.

    Rows of a frame each shrink so well on their way that the planner puts many millions of them into one task, where a sort unpacks them.
    """
    return df.repartition(max(1, -(-df.count() // (rows or TASK_ROWS))), *key)


def pieces(spans: DataFrame, *key: str, before: int = 0, block: int = SPAN) -> DataFrame:
    """spans (fi, ff, ...) cut at blocks of frames and dealt out by key and block (``__b``) before there is a row per frame, so that these are not sent.

    A piece's fi and ff are those of its frames that lie in the block or up to ``before`` frames ahead of it, as rows that the block's look back at.
    """
    d = spans.withColumn("__b", F.explode(F.sequence(block_of("fi", block), block_of(F.col("ff") + before, block))))
    cut = {"fi": F.greatest("fi", F.col("__b") * block - before), "ff": F.least("ff", (F.col("__b") + 1) * block - 1)}
    return dealt_out(d.withColumns(cut).where("fi <= ff"), *key, "__b", rows=TASK_ROWS // 15)


def in_block(*key: str) -> WindowSpec:
    return Window.partitionBy(*key, "__b").orderBy("frame")


def known_neighbours(df: DataFrame, columns: Sequence[str], key: Sequence[str], block: int = BLOCK) -> DataFrame:
    """df with ``__<c>0`` and ``__<c>1`` per column: struct (frame, v) of the last known value at or before a row, the first at or after it."""
    d = df.withColumn("__b", block_of("frame", block))
    known = {c: F.when(F.col(c).isNotNull(), F.struct("frame", F.col(c).alias("v"))) for c in columns}
    run = lambda *by: Window.partitionBy(*key, "__b").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    back, ahead = run("frame"), run(F.desc("frame"))
    ends = d.groupBy(*key, "__b").agg(*[f(known[c]).alias(f"__{c}{k}") for c in columns for k, f in ((0, F.max), (1, F.min))])
    # a row per key and block
    other = lambda *by: Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, "__b", *[F.last(f"__{c}{k}", True).over(other(F.desc("__b") if k else "__b")).alias(f"__{c}{k}c") for c in columns for k in (0, 1)])
    d = d.withColumns({f"__{c}{k}": F.last(known[c], True).over(ahead if k else back) for c in columns for k in (0, 1)})
    d = d.join(carried, [*key, "__b"])
    return d.withColumns({f"__{c}{k}": F.coalesce(f"__{c}{k}", f"__{c}{k}c") for c in columns for k in (0, 1)}).drop("__b", *[f"__{c}{k}c" for c in columns for k in (0, 1)])


def running_count(df: DataFrame, flag: Column, name: str, key: Sequence[str], block: int = BLOCK) -> DataFrame:
    """df with ``name``: how many rows up to this one, of its key, carry the flag."""
    d = df.withColumns({"__b": block_of("frame", block), "__flag": flag.cast("long")})
    sums = d.groupBy(*key, "__b").agg(F.sum("__flag").alias("__n"))
    ahead = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and block
    sums = sums.select(*key, "__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    here = in_block(*key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(name, F.sum("__flag").over(here)).join(sums, [*key, "__b"])
    return d.withColumn(name, F.col(name) + F.col("__before")).drop("__b", "__flag", "__before")


def with_carry(df: DataFrame, key: Sequence[str], block: Column, value: Column) -> DataFrame:
    """df with ``__b`` (the block), ``__before`` and ``__total``: sums of value over earlier blocks of the key and over the whole key.

    The block must not fall along the order that is meant, so that a window inside a block and what
    earlier blocks hand on give a rank or a running sum inside a key, however many rows the key holds.
    Keys and blocks may be null; a null block comes first, as nulls do in an ascending order.
    """
    d = df.withColumn("__b", block)
    names = [f"__k{i}" for i in range(len(key))]
    sums = d.groupBy(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], F.col("__b").alias("__kb")).agg(F.sum(value).alias("__n"))
    # a row per key and block
    all_of, ahead = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "__kb", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), F.sum("__n").over(all_of).alias("__total"))
    on = F.col("__b").eqNullSafe(F.col("__kb"))
    for c, n in zip(key, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return d.join(sums, on).drop("__kb", *names)
