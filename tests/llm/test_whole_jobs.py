"""Cases in which a bound on rows or repeats would show."""

import json

from pyspark.sql import functions as F

from trailmark.llm import quality, toolcalls


def test_cutoffs_use_all_good_labels(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("w"), i.cast("string"), F.lit("x"), F.col("doc_id").cast("string"))), " ")
    good = spark.range(1000).withColumnRenamed("id", "doc_id").withColumns({"lang": F.lit("en"), "text": words})
    bad = good.where("doc_id = 0").withColumns({"doc_id": F.lit(5_000_000).cast("long"), "text": F.replace("text", F.lit(" "), F.lit("## "))})
    labels = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    kept = {r["doc_id"] for r in quality.keep_good(good.union(bad), labels).collect()}
    assert kept == set(range(1000))


def test_repeated_identifiers_keep_their_rows(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", None, "search", '{"words": 3, "query_md5": "x"}'), (1, 4, "a", "lost", "rank", '{"query_md5": 5, "top": 0}'), (1, 4, "a", "lost", "rank", '{"query_md5": 5, "top": 0}'),
         (1, None, "b", None, "rank", "no json"), (1, 2, "b", None, "search", '{"words": 4, "query_md5": "y"}')],
        "conv long, turn int, call string, parent string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, 1, "a", "r"), (1, 5, "a", "s"), (1, 1, "a", "r")], "conv long, turn int, call string, content string")
    out = toolcalls.link_tool_calls(calls, results, toolcalls.schema_table(spark)).collect()
    assert sorted(r["position"] for r in out) == list(range(7))
    dup = [r for r in sorted(out, key=lambda r: r["position"]) if r["status"] == "duplicate"]
    said = [(r["call"], r["name"], r["errors"], json.loads(r["canonical"])["arguments"], json.loads(r["canonical"])["result"]) for r in dup]
    rank = ("a", "rank", ["parent:lost", "range:top", "type:query_md5"], {"query_md5": 5, "top": 0}, None)
    assert said == [("a", None, [], None, "r"), ("b", "search", [], {"query_md5": "y", "words": 4}, None), rank, rank, ("a", None, [], None, "s")]
