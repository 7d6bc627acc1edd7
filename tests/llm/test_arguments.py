"""Odd arguments of tool calls, and a conversation that holds most rows."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.llm import toolcalls

SCHEMA = [("t", "a", "integer", False, 0.0, 10.0, None), ("t", "o", "object", False, None, None, None), ("t", "l", "array", False, None, None, None), ("t", "e", "string", False, None, None, ["x", "y"])]
KINDS = "name string, param string, type string, required boolean, low double, high double, allowed array<string>"
BIG = "1" * 50

CASES = [
    ('{"a":1,"a":2}', ["malformed"], None),
    ('{"o":{"b":1,"b":2}}', ["malformed"], None),
    ('{"a":1} x', ["malformed"], None),
    ('{"a":1},{"a":2}', ["malformed"], None),
    ('{"a":1}] , [', ["malformed"], None),
    ('{"a":1}} , ', ["malformed"], None),
    ("[1]", ["malformed"], None),
    ("", ["malformed"], None),
    ('{"a":1e400}', ["number"], None),
    ('{"a":%s}' % BIG, ["number"], None),
    ('{"e":"1e400 %s \\" y"}' % BIG, ["enum:e"], '{"e":"1e400 %s \\" y"}' % BIG),
    (' {"l":[1], "a" : 3 } ', [], '{"a":3,"l":[1]}'),
    ('{"a":3.5,"o":[],"l":{},"e":"z","q":null}', ["enum:e", "type:a", "type:l", "type:o", "unknown:q"], '{"a":3.5,"e":"z","l":{},"o":[],"q":null}'),
    ('{"a":11,"e":"y"}', ["range:a"], '{"a":11,"e":"y"}'),
    ('{"a":12345678901234567890}', ["range:a"], '{"a":12345678901234567890}'),
]


@pytest.fixture(scope="module")
def linked(spark):
    calls = spark.createDataFrame([(1, i, f"c{i:02d}", None, "t", a) for i, (a, _, _) in enumerate(CASES)], "conv long, turn int, call string, parent string, name string, arguments string")
    results = spark.createDataFrame([], "conv long, turn int, call string, content string")
    return {r["call"]: r for r in toolcalls.link_tool_calls(calls, results, spark.createDataFrame(SCHEMA, KINDS)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_arguments(linked, i):
    said, errors, kept = CASES[i]
    row = linked[f"c{i:02d}"]
    assert row["errors"] == errors
    assert row["canonical"].startswith('{"arguments":' + (kept if kept is not None else "") + ("," if kept is not None else ""))
    if kept is None:
        assert json.loads(row["canonical"])["arguments"] == said


def test_positions_in_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(toolcalls, "RUN_BITS", 3)
    calls = spark.range(300).select(F.when(F.col("id") < 200, F.lit(5)).otherwise(F.col("id")).cast("long").alias("conv"), F.col("id").cast("int").alias("turn"), F.format_string("c%04d", "id").alias("call"), F.lit(None).cast("string").alias("parent"), F.lit("t").alias("name"), F.lit("{}").alias("arguments"))
    results = spark.createDataFrame([(None, 1, "z", "r")], "conv long, turn int, call string, content string")
    out = toolcalls.link_tool_calls(calls, results, spark.createDataFrame(SCHEMA, KINDS)).collect()
    assert sorted(r["position"] for r in out if r["conv"] == 5) == list(range(200))
    assert [r["position"] for r in sorted(out, key=lambda r: r["call"]) if r["conv"] == 5] == list(range(200))
    assert {r["position"] for r in out if r["conv"] != 5} == {0} and len(out) == 301
