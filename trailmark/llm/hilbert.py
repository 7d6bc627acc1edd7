"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into 2**bits cells that hold about equal numbers of rows: numbers and times at
approximate quantiles (one mergeable sketch over all rows), text at the distinct values by which the
cumulated rows pass each share. The cells' coordinates become a position on the Hilbert curve. Only the
narrow columns of the order and the sizes of the rows are sorted first; from them come cuts between
slices of about equal bytes and the number of rows before each slice. Then the rows themselves are dealt
out by those cuts, once, sorted in their slice, numbered, and written as files of a folder per shard. The
ordered run of rows is cut into shards whose counts differ by at most one. Rows near in every dimension share
a file, so the minima and maxima in the files' footers prune on any of the dimensions.

Defined results: a null value is the lowest cell of its dimension; a null text has size 1 and the
checksum of the empty string. Rows tied on the curve are ordered by ``ties``, nulls first, so equal rows are
neighbours and stay in one slice. A very long text is a slice of its own at most. With fewer rows than shards some
shards are empty; an empty table gives no rows. Internal columns begin with ``__``; those of the input may have
any other name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import shared_dir, shuffle_partitions, stored


def weighted_cuts(rows: DataFrame, order: Sequence[str], weight: str, n: int, name: str) -> DataFrame:
    """(k, cut): the first row of each of n slices of about equal weight of the rows sorted by ``order``.

    Rows are dealt out by range and sorted there; weights are summed within ranges and the sums of the ranges, one small
    row each, are added up. At most n rows come out.
    """
    cols = [F.col(c) for c in order]
    there = rows.select(*order, weight).repartitionByRange(shuffle_partitions(rows.sparkSession), *cols).sortWithinPartitions(*cols)
    kept = stored(there.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)
    sums = kept.groupBy("__range").agg(F.sum(weight).alias("__w"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    first = sums.select("__range", F.coalesce(F.sum("__w").over(ahead), F.lit(0)).alias("__first"))
    within = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = kept.withColumn("__sum", F.sum(weight).over(within) - F.col(weight)).join(F.broadcast(first), "__range")
    total = kept.select(F.sum(weight)).scalar()
    k = F.least(F.floor((F.col("__first") + F.col("__sum")).cast("double") * n / total), F.lit(n - 1)).cast("int")
    return d.groupBy(k.alias("k")).agg(F.min(F.struct(*order)).alias("cut"))


MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _sorted(cuts: DataFrame) -> Column:
    """The cuts (k, cut) as a constant array in order; their number is a parameter."""
    kind = cuts.schema["cut"].dataType.simpleString()
    each = cuts.select("k", F.to_json(F.struct("cut", "k"), MICROS).alias("x")).collect()
    return F.from_json(F.lit("[" + ",".join(r["x"] for r in sorted(each)) + "]"), f"array<struct<cut:{kind},k:int>>", MICROS)


def _position(cuts: Column, n: int, value: Column) -> Column:
    """How many of at most n sorted cuts are no greater than value, by halving."""
    steps = [1 << i for i in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when(((at + step) <= F.size(cuts)) & (F.get(cuts, at + step - 1)["cut"] <= value), at + step).otherwise(at),
    )


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, as a generated row: the planner does not write them into what is computed from them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def cells(df: DataFrame, dims: Sequence[str], bits: int) -> dict[str, Column]:
    """``__c<i>`` -> the cell of each dimension as an expression; its cuts come from all rows of df."""
    n = 1 << bits
    kinds = {c: df.schema[c].dataType for c in dims}
    number = {c: F.col(c).cast("double") for c, t in kinds.items() if isinstance(t, T.NumericType)}
    number |= {c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") for c, t in kinds.items() if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    share = [(i + 1) / n for i in range(n - 1)]
    edges = df.agg(*[F.percentile_approx(v, share, 2000).alias(c) for c, v in number.items()]).first() if number else {}
    out = {}
    for i, c in enumerate(dims):
        if c in number:
            # without any value one edge that none exceeds: a constant cell would be folded through all steps of the curve
            cuts = F.lit([float(e) for e in edges[c] or [float("inf")]]).cast("array<double>")
            at = F.size(F.filter(cuts, lambda e: e < number[c]))  # noqa: B023
        else:
            value = F.col(c).cast("string").alias("value")
            seen = df.select(value).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
            cuts = _sorted(weighted_cuts(seen, ["value"], "rows", n, f"values-{i}"))
            at = F.coalesce(F.get(cuts, _position(cuts, n, F.struct(value)) - 1)["k"], F.lit(0))
        out[f"__c{i}"] = F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.least(at, F.lit(n - 1)))
    return out


def with_hilbert(df: DataFrame, axes: Sequence[str], bits: int, name: str = "__h") -> DataFrame:
    """Add the position on the Hilbert curve of the integer columns ``axes``, each in 0..2**bits-1.

    The transposed form of the index is made bit by bit from the most significant: where an
    axis has the bit set, the lower bits of the first axis are inverted, else they are exchanged
    with the first axis'; a Gray code over all axes ends it (Skilling's formulation).
    """
    k = len(axes)
    x = [f"__x{i}" for i in range(k)]
    df = df.withColumns({x[i]: F.col(a).cast("int") for i, a in enumerate(axes)})
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(k):
            there = F.col(x[i]).bitwiseAND(1 << b) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(low)
            step = {x[0]: F.when(there, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))}
            if i:
                step[x[i]] = F.when(there, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))
            df = df.withColumns(step)
    for i in range(1, k):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn: Column = F.lit(0)
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[k - 1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__t", turn)
    index: Column = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(k):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("__t")), b).bitwiseAND(1).cast("long")
            index = F.shiftleft(index, 1).bitwiseOR(bit)
    return df.withColumn(name, index).drop("__t", *x)


def write_shards(df: DataFrame, dims: Sequence[str], ties: Sequence[str], path: str, *, size: Column, n_shards: int = 8, bits: int = 6) -> None:
    """Write df with ``__slot`` (0.. in the shard) and ``__h`` as files of a folder ``__shard=<i>`` per shard, rows in slot order.

    ``ties`` are columns that order rows at one place of the curve; ``size`` is a row's bytes. There are as many
    slices as shuffle partitions, and a task holds one of them.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    order = ["__h", *ties]
    narrow = df.select(*dict.fromkeys([*dims, *ties]), size.cast("long").alias("__size"))
    cell = cells(narrow, dims, bits)

    def placed(d: DataFrame) -> DataFrame:
        curve = with_hilbert(_computed(d, cell), list(cell), bits, "__curve")
        return _computed(curve, {"__h": F.col("__curve")}).drop("__curve", *cell)

    keys = stored(placed(narrow).select(*order, "__size"), "curve")
    cuts = _sorted(weighted_cuts(keys, order, "__size", n, "curve-run"))
    here = F.greatest(_position(cuts, n, F.struct(*order)) - 1, F.lit(0))
    counts = stored(keys.groupBy(here.alias("slice")).agg(F.count(F.lit(1)).alias("rows")), "slice-rows")
    ahead = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    first = counts.select("slice", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("first"))
    before = first.select(F.map_from_entries(F.collect_list(F.struct("slice", "first")))).scalar()
    total = counts.select(F.sum("rows")).scalar()
    run = placed(df).withColumn("__slice", here).repartitionById(n, F.col("__slice")).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranked = run.withColumns({"__rank": before[F.col("__slice")] + inside, "__n": total})
    ranked = ranked.withColumn("__shard", F.expr(f"cast(__rank * {n_shards} div __n as int)"))
    start = F.expr(f"(cast(__shard as bigint) * __n + {n_shards - 1}) div {n_shards}")
    out = ranked.withColumn("__slot", F.col("__rank") - start).drop("__rank", "__n", "__slice")
    out.sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)


def hilbert_shards(df: DataFrame, dims: Sequence[str], ties: Sequence[str], *, size: Column, n_shards: int = 8, bits: int = 6, path: str | None = None) -> DataFrame:
    """df with ``__shard``, ``__slot`` and ``__h``, read back from the shards' files (see write_shards)."""
    path = path or shared_dir(df.sparkSession, "shards")
    write_shards(df, dims, ties, path, size=size, n_shards=n_shards, bits=bits)
    kinds = T.StructType([*df.schema.fields, T.StructField("__h", T.LongType()), T.StructField("__slot", T.LongType()), T.StructField("__shard", T.IntegerType())])
    return df.sparkSession.read.schema(kinds).parquet(path)
