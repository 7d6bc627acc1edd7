"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouping by node that keeps the minimum, so a node with very many links is
combined before the shuffle, and the joins back on it may be split by adaptive execution. Each task
first replaces its links by a spanning forest. Steps are written out, which cuts the lineage;
nothing is gathered at the driver but two totals a round.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_dir(spark: SparkSession) -> str:
    """A fresh folder of this machine, for a local master only: executors of a cluster would not see it."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="trailmark-")


def cut(df: DataFrame, name: str = "") -> DataFrame:
    """Write df to the checkpoint folder that the cluster names, which ends its lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or local_dir(spark))
    return df.checkpoint()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b) and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(a):
            nodes, root = forest(a, b)
            off = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(root[off])], ["a", "b"])


def connected_components(links: DataFrame, max_rounds: int = 60, keep: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """(node, component) for every node of links (a, b: integers); component is the least node reached.

    keep writes a step and returns it for reading.
    """
    pairs = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    e = keep(pairs.where("a <> b").mapInArrow(_local_forest, "a long, b long").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "large-star")
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b")))
        e = keep(small.where("a <> b").distinct(), "small-star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
