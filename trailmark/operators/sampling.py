"""Ranks, deterministic samples, splits and set operations.

Samples are ordered by md5 of the key's text, so every engine and every run picks the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trailmark.operators.blocks import BLOCK, block_of, with_carry


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per group; Spark cuts each partition to n rows before the shuffle."""
    return ranked(df, by, order).where(F.col("rank") <= n).drop("rank")


def shuffled(key: str) -> list[Column]:
    return [F.md5(F.col(key).cast("string")), F.col(key)]


def sample_n(df: DataFrame, by: Sequence[str], key: str, n: int) -> DataFrame:
    return first_n(df, by, shuffled(key), n)


#: digits of md5 that name a block of a sample's order: 4,096 blocks in each group
DIGITS = 3


def _md5_block(key: str) -> Column:
    return F.substring(F.md5(F.col(key).cast("string")), 1, DIGITS)


def _in_block(by: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*by, "__b").orderBy(*order)


def sample_until(df: DataFrame, by: Sequence[str], key: str, size: str, least: int) -> DataFrame:
    """Rows in sample order until their sizes add up to ``least``; cum is the running sum.

    A group's order is cut into blocks by the first digits of md5, so no task holds a whole group, and
    blocks that begin beyond ``least`` are left out before any row is sorted. Sizes are not negative.
    """
    d = with_carry(df, by, _md5_block(key), F.col(size)).where((F.col("__before") < least) | F.col("__before").isNull())
    here = F.sum(size).over(_in_block(by, shuffled(key)).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("cum", here + F.col("__before")).where(F.col("cum") - F.col(size) < least).drop("__b", "__before", "__total")


def split_share(df: DataFrame, by: Sequence[str], key: str, share: float) -> DataFrame:
    """df with train: whether a row is among the first ``share`` of its group in sample order; blocks as in sample_until."""
    d = with_carry(df, by, _md5_block(key), F.lit(1))
    ahead = F.col("__before") + F.rank().over(_in_block(by, shuffled(key))) - 1
    place = F.when(F.col("__total") > 1, ahead / (F.col("__total") - 1)).otherwise(0.0)
    return d.withColumn("train", place < share).drop("__b", "__before", "__total")


def stride(df: DataFrame, by: Sequence[str], order: str, *, first: int, skip: int, block: int = BLOCK) -> DataFrame:
    """Every ``skip``-th row of each group from the ``first`` on, in the order of a number; blocks are ranges of that number."""
    d = with_carry(df, by, block_of(order, block), F.lit(1))
    d = d.withColumn("__r", F.col("__before") + F.row_number().over(_in_block(by, [F.col(order)])))
    return d.where((F.col("__r") >= first) & (F.pmod(F.col("__r") - first, F.lit(skip)) == 0)).drop("__r", "__b", "__before", "__total")


def divide(df: DataFrame, order: str, k: int) -> DataFrame:
    """k parts of consecutive rows whose sizes differ by at most one; for dimension tables such as movies."""
    return df.withColumn("part", F.ntile(k).over(Window.orderBy(order)))


def downsample(df: DataFrame, order: str, every: int) -> DataFrame:
    """Each ``every``-th of consecutive numbers, from the first on."""
    return df.where(F.pmod(F.col(order) - 1, F.lit(every)) == 0)


def random_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in an order that is random but the same in every run; each partition hands on n rows at most."""
    return df.orderBy(*shuffled(key)).limit(n)


def solve_groups(movies: DataFrame, size: int) -> DataFrame:
    """(grp, first_m, last_m, movies): movies that are solved together."""
    g = movies.groupBy(F.floor(F.col("m") / size).cast("long").alias("grp"))
    return g.agg(F.min("m").alias("first_m"), F.max("m").alias("last_m"), F.array_sort(F.collect_list("m")).alias("movies"))


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(colony, other, same) for rows joined by colony: whether ids and ids2 hold the same elements."""
    j = a.join(b, "colony")
    return j.select("colony", "other", ((F.size(F.array_except("ids", "ids2")) == 0) & (F.size(F.array_except("ids2", "ids")) == 0)).alias("same"))


def merge_later(tables: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows by key; where tables share a key the later table's row counts."""
    every = tables[0].withColumn("__i", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.withColumn("__i", F.lit(i)))
    rest = [c for c in tables[0].columns if c not in key]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), "__i").alias("__v")).select(*key, "__v.*")


def global_difference(df: DataFrame, value: str, tie: str, block: int = 3_600_000_000, order: str | None = None) -> DataFrame:
    """df with dt: the difference to the previous row in the order of (order, tie) over the whole table; order is the value itself unless given.

    Rows are cut into blocks of the order; inside a block a window does it, and a block's first row
    takes the last value of the nearest earlier block, found over one row per block.
    """
    order = order or value
    d = df.withColumn("__b", F.floor(F.col(order) / block).cast("long"))
    w = Window.partitionBy("__b").orderBy(order, tie)
    tops = d.groupBy("__b").agg(F.max_by(value, F.struct(order, tie)).alias("__top"))
    before = tops.select("__b", F.lag("__top").over(Window.orderBy("__b")).alias("__before"))
    first = F.lag(F.lit(1)).over(w).isNull()
    d = d.withColumns({"dt": F.col(value) - F.lag(value).over(w), "__first": first}).join(before, "__b")
    return d.withColumn("dt", F.when(F.col("__first"), F.col(value) - F.col("__before")).otherwise(F.col("dt"))).drop("__b", "__before", "__first")
