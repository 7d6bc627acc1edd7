"""Line deduplication over hashed line keys; only keep bitmaps move, never text.

Every line becomes a 128-bit hash of its key with document and position. These rows are dealt
out by ranges of (hash, document), sorted by (hash, document, position), and streamed: the
first row of a (hash, document) run stands for the document, and each line's documents are counted inside
its range. A frequent line spreads over several ranges, because the document takes part in the range;
such lines, at the ends of ranges, are counted again over all of them as one partial row per task. The
result is a run-length coded keep bitmap per document that loses lines.

Defined results: a null or empty text is one empty line. A row without doc_id neither loses
lines nor holds a key. Rows that repeat a doc_id are versions of one document: they count as one
holder and each has its own bitmap. Of a line that a document repeats, all copies go or all stay. A very long
text or line is handled whole in its row. An empty table gives no rows. Internal columns begin with ``__l_``; those
of docs may have any other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import WS_CHARS, shuffle_partitions, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN_END = (1 << 31) - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _version(text: Column) -> Column:
    return F.xxhash64(text)


def line_rows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc, version, pos) for each line whose key has at least ``min_chars`` code points."""
    d = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc"), _version(F.col(text)).alias("version"), F.posexplode(_lines(F.col(text))).alias("pos", "line")
    )
    d = d.where(F.length("line") >= min_chars).select("doc", "version", "pos", F.translate(F.btrim("line", F.lit(WS_CHARS)), UPPER, LOWER).alias("key"))
    return d.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "version", "pos"
    )


def held_lines(rows: DataFrame) -> DataFrame:
    """rows (range, h1, h2, doc, first, ...) with docs, the documents that hold the line, and last, the largest of them.

    A line whose rows lie inside one range is counted there. Only the first and the last line of a range can go on in
    another; these, two per range at most, are counted over all ranges and sent to every task.
    """
    n = shuffle_partitions(rows.sparkSession)
    one = F.col("first").cast("long")
    key = F.struct("h1", "h2")
    ends = rows.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select(F.explode(F.array("low", "high")).alias("k")).select("k.h1", "k.h2").distinct()
    across = rows.where("first").join(F.broadcast(ends), ["h1", "h2"])  # bounded: two lines per range
    across = stored(across.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("all_docs"), F.max("doc").alias("all_last")), "lines-across")
    here = Window.partitionBy("range", "h1", "h2")
    d = rows.repartitionById(n, F.col("range")).withColumns({"docs": F.sum(one).over(here), "last": F.max("doc").over(here)})
    d = d.join(F.broadcast(across), ["h1", "h2"], "left")
    return d.withColumns({"docs": F.coalesce("all_docs", "docs"), "last": F.coalesce("all_last", "last")}).drop("all_docs", "all_last")


def keep_bitmaps(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, version, dropped, keep): documents that lose lines; keep lists the kept runs [start, stop)."""
    keys = ["h1", "h2", "doc"]
    dealt = line_rows(docs, text=text, doc_id=doc_id, min_chars=min_chars).repartitionByRange(shuffle_partitions(docs.sparkSession), *keys)
    run = Window.partitionBy(*keys).orderBy("version", "pos")
    rows = stored(dealt.withColumns({"first": F.row_number().over(run) == 1, "range": F.spark_partition_id()}), "lines")
    lost = held_lines(rows).where((F.col("docs") >= min_docs) & (F.col("doc") < F.col("last")))
    per = lost.groupBy("doc", "version").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    gone = F.col("gone")
    runs = F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda i: F.struct(F.coalesce(F.get(gone, i - 1) + 1, F.lit(0)).alias("start"), F.coalesce(F.get(gone, i), F.lit(OPEN_END)).alias("stop")),
    )
    return per.select("doc", "version", F.size(gone).alias("dropped"), F.filter(runs, lambda r: r.stop > r.start).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with ``__l_n_lines``, ``__l_n_dropped`` and ``__l_text``, the kept lines joined by \\n."""
    b = bitmaps.select(F.col("doc").alias("__l_doc"), F.col("version").alias("__l_version"), F.col("dropped").alias("__l_dropped"), F.col("keep").alias("__l_keep"))
    d = docs.join(b, (F.col(doc_id) == F.col("__l_doc")) & (_version(F.col(text)) == F.col("__l_version")), "left")
    d = d.withColumn("__l_lines", _lines(F.col(text)))
    lines = F.col("__l_lines")
    kept = F.flatten(F.transform("__l_keep", lambda r: F.slice(lines, r.start + 1, F.least(r.stop, F.size(lines)) - r.start)))
    whole = F.coalesce(F.col(text), F.lit(""))
    return d.withColumns(
        {
            "__l_n_lines": F.size(lines).cast("long"),
            "__l_n_dropped": F.coalesce(F.col("__l_dropped"), F.lit(0)).cast("long"),
            "__l_text": F.when(F.col("__l_keep").isNull(), whole).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("__l_doc", "__l_version", "__l_dropped", "__l_keep", "__l_lines")


def dedup_lines(docs: DataFrame, **params: int) -> DataFrame:
    """docs with repeated lines taken out of the text; columns as before, n_chars follows the text."""
    d = apply_bitmaps(docs, keep_bitmaps(docs, **params))
    changed = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("__l_text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__l_n_dropped") > 0, F.length("__l_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return d.withColumns(changed).select(*docs.columns)
