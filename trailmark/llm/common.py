"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.operators.components import local_dir

WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a local master (tests, notebooks) gets a local folder; on a cluster, whose executors would
    not see it, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else local_dir(spark)
    return f"{base.rstrip('/')}/trailmark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, whole texts go to Python workers by so many rows at a time, which bounds the buffers on both sides; jobs must run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space ([''] if there are none)."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS)), WS_CLASS + "+")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Number all rows 0..N-1 in the order of the columns ``order``, without one global task.

    Rows are dealt out by range, sorted inside each range, numbered there, stored, and the
    sizes of the ranges are summed up: one small row per range. ``order`` should end in
    columns that tell rows apart, so that a frequent value spreads over several ranges.
    Returns (rows with the long column __rank, one row per range with its first rank).
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    cols = [F.col(c) for c in order]
    there = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    there = there.withColumn("__mid", F.monotonically_increasing_id())
    kept = stored(
        there.withColumns(
            {"__range": F.shiftright("__mid", 33).cast("int"), "__in": F.col("__mid").bitwiseAND((1 << 33) - 1)}
        ).drop("__mid"),
        name,
    )
    sizes = kept.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # a row per range: their number is a parameter, not the number of documents
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__first"))
    ranked = kept.join(F.broadcast(first), "__range").withColumn("__rank", F.col("__first") + F.col("__in"))
    return ranked.drop("__range", "__in", "__first"), first
