"""Tool-call linking: calls and results joined by identifier, ordered, validated, serialised.

Calls and results meet in a hash join on (conversation, call id). A call may wait for one earlier
call (its parent); its depth in that forest comes from pointer doubling, so a chain of n calls
takes log2(n) rounds, and a call on a cycle, or behind one, is found because no round frees it.
Calls are numbered by (depth, turn, call id), a topological order, by ranges over all
conversations, so a conversation of any length is no single task. Arguments are parsed to variants
and checked against the tool's schema by a join on the tool's name; canonical JSON
is the variant's own rendering: sorted keys at every level, no white space.

Defined results (status): ``linked``; ``no_result``; ``orphan_result`` (a result without call);
``duplicate`` (a later call or result with an identifier that is taken; the first by turn, then by
content, counts, and the later one keeps its own turn, name, arguments, errors and content); ``cycle``. Missing identifiers link with nothing: a call is ``no_result``, a result
``orphan_result``. A parent that is unknown is no parent but an error ``parent:<id>``.
Errors are sorted texts: ``malformed`` (not exactly one JSON object: another value, a key twice in one object, text behind it), ``number`` (a
number that no type holds as written: over 38 digits, or an exponent that a double cannot hold), ``tool:<name>`` (no such schema),
``missing:<arg>``, ``type:<arg>``, ``range:<arg>``, ``enum:<arg>`` (none of the values allowed), ``unknown:<arg>``. With either of the first two
the row keeps the arguments as they were written, as a JSON text, and no argument is looked at.
Arguments and results of any length are handled whole in their row. Empty tables give no rows. Other columns of calls and results
are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import global_rank, stored

MAX_ROUNDS = 40
#: Bits of a rank within a run of rows that are joined together.
RUN_BITS = 14
ID = ["conv", "call"]


def _first(df: DataFrame, *ties: str) -> DataFrame:
    """The first row per identifier, by an aggregate, so that a frequent identifier is combined before the shuffle."""
    rest = [c for c in df.columns if c not in ID]  # with the ties, which tell the first from the others
    return df.groupBy(*ID).agg(F.min_by(F.struct(*rest), F.struct(*ties)).alias("x"), F.count(F.lit(1)).alias("same")).select(*ID, "x.*", "same")


def _repeats(df: DataFrame, first: DataFrame, turn: str, same: str) -> DataFrame:
    """Rows of df behind the first of their identifier, each with its own columns, and ``again`` that tells equal rows apart."""
    head = first.where(F.col(same) > 1).select(*ID, F.col(turn).alias("f_turn"), F.col("tie").alias("f_tie"))
    each = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).join(head, ID)
    is_first = F.col("turn").eqNullSafe(F.col("f_turn")) & F.col("tie").eqNullSafe(F.col("f_tie"))
    left = each.withColumn("n", F.col("n") - is_first.cast("long")).where("n > 0")
    return left.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "f_turn", "f_tie")


def depths(calls: DataFrame) -> DataFrame:
    """(conv, call, depth): 0 without parent, null on or behind a cycle. calls: (conv, call, parent), identifiers distinct."""
    known = calls.select("conv", F.col("call").alias("up"))
    up = calls.join(known.withColumnRenamed("up", "parent").withColumn("there", F.lit(True)), ["conv", "parent"], "left")
    d = stored(up.select("conv", "call", F.when(F.col("there"), F.col("parent")).alias("jump"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")), "depths")
    if not d.where("jump is not null").limit(1).count():
        return d.select("conv", "call", "depth")
    for _ in range(MAX_ROUNDS):
        above = d.select("conv", F.col("call").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        waiting = d.where("jump is not null").join(above, ["conv", "jump"]).select("conv", "call", F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"))
        done = d.where("jump is null").select("conv", "call", "jump", "depth")
        d = stored(done.union(waiting), "depths")
        left, total, deepest = d.agg(F.count("jump"), F.count(F.lit(1)), F.max("depth")).first()
        if not left or deepest > total:  # a chain longer than there are calls runs in a circle
            break
    return d.select("conv", "call", F.when(F.col("jump").isNull(), F.col("depth")).alias("depth"))


def one_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else. The parser stops behind a first value; within an array and within an object, text behind it cannot hide."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.coalesce(is_object & named.isNotNull() & inside.isNotNull() & F.try_variant_get(inside, "$[1]", "variant").isNull(), F.lit(False))


def inexact_number(text: Column) -> Column:
    """Whether a JSON text has a number of over 38 digits, of over 17 before an exponent, or with an exponent of three digits. Texts within it do not count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    return F.coalesce(F.regexp_like(bare, F.lit(r"[0-9][0-9.]{39,}|[0-9]{39,}|[0-9.]{19,}[eE]|[eE][+-]?0*[1-9][0-9]{2,}")), F.lit(False))


def argument_errors(calls: DataFrame, schemas: DataFrame, key: list[str] = ID) -> DataFrame:
    """(conv, call, errors), or other columns that tell calls apart in place of the first two, for calls whose arguments break their schema.

    schemas: (name, param, type, required, low, high[, allowed]), type one of string, integer, number, boolean, object, array; allowed, the texts that a
    string may be, or null.
    """
    text = F.col("arguments")
    fault = F.when(~one_object(text), "malformed").when(inexact_number(text), "number")
    args = calls.select(*key, "name", fault.alias("broken"), F.when(fault.isNull(), F.from_json(text, "map<string,variant>")).alias("args"))
    tools = schemas.groupBy("name").agg(F.collect_set("param").alias("params"))
    bad = F.col("args").isNull()
    d = args.join(tools, "name", "left")
    shape = d.select(
        *key,
        F.explode(
            F.when(bad, F.array(F.coalesce("broken", F.lit("malformed"))))
            .when(F.col("params").isNull(), F.array(F.concat(F.lit("tool:"), F.coalesce("name", F.lit("")))))
            .otherwise(F.transform(F.array_except(F.map_keys("args"), "params"), lambda k: F.concat(F.lit("unknown:"), k)))
        ).alias("e"),
    )
    value = F.element_at("args", F.col("param"))
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    number = F.try_variant_get(value, "$", "double")
    fits = (
        F.when(F.col("type") == "string", kind == "STRING")
        .when(F.col("type") == "integer", kind.isin("BIGINT") | (kind.isin("DECIMAL", "DOUBLE") & (number % 1 == 0)))
        .when(F.col("type") == "number", kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"))
        .when(F.col("type") == "boolean", kind == "BOOLEAN")
        .when(F.col("type") == "object", kind == "OBJECT")
        .when(F.col("type") == "array", kind == "ARRAY")
        .otherwise(F.lit(True))
    )
    there = F.array_contains(F.map_keys("args"), F.col("param"))
    fault: Column = (
        F.when(~there, F.when(F.col("required"), F.lit("missing:")))
        .when(~fits, F.lit("type:"))
        .when(F.coalesce(number < F.col("low"), F.lit(False)) | F.coalesce(number > F.col("high"), F.lit(False)), F.lit("range:"))
    )
    if "allowed" in schemas.columns:
        fault = F.coalesce(fault, F.when(there & F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.try_variant_get(value, "$", "string")), F.lit("enum:")))
    values = args.where("args is not null").join(schemas, "name").withColumn("fault", fault).where("fault is not null")
    each = shape.unionByName(values.select(*key, F.concat("fault", "param").alias("e")))
    return each.groupBy(*key).agg(F.array_sort(F.collect_set("e")).alias("errors"))


def canonical(arguments: Column) -> Column:
    """Sorted keys, no white space; what is no single object, or holds a number that would change, as the text it is."""
    as_text = F.to_json(F.struct(arguments.alias("a")))  # {"a":"..."}
    as_text = F.substr(as_text, F.lit(6), F.length(as_text) - 6)
    return F.when(one_object(arguments) & ~inexact_number(arguments), F.to_json(F.try_parse_json(arguments))).when(arguments.isNotNull(), as_text)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per orphaned or duplicate result; see the module's text.

    calls: (conv, turn, call, parent, name, arguments); results: (conv, turn, call, content).
    Returns (conv, call, position, depth, name, status, errors, canonical).
    """
    sound = F.col("conv").isNotNull() & F.col("call").isNotNull()
    calls = calls.select(*ID, F.col("turn").cast("long").alias("turn"), "parent", "name", "arguments")
    results = results.select(*ID, F.col("turn").cast("long").alias("turn"), "content")
    tie = F.xxhash64("parent", "name", "arguments")
    asked, answered = calls.where(sound).withColumn("tie", tie), results.where(sound).withColumn("tie", F.xxhash64("content"))
    first = stored(_first(asked, "turn", "tie"), "calls")
    answer = _first(answered, "turn", "tie").select(*ID, F.col("turn").alias("r_turn"), "content", F.col("same").alias("r_same"), "tie")
    met = first.drop("tie").hint("shuffle_hash").join(answer.drop("tie"), ID, "full")
    d = met.join(depths(first.select(*ID, "parent")), ID, "left").join(argument_errors(first, schemas), ID, "left")
    is_call = F.col("same").isNotNull()
    known = first.select("conv", F.col("call").alias("parent"), F.lit(True).alias("known"))
    d = d.join(known, ["conv", "parent"], "left")
    lost = F.when(F.col("parent").isNotNull() & F.col("known").isNull(), F.array(F.concat(F.lit("parent:"), "parent"))).otherwise(F.array())
    row = d.select(
        *ID,
        F.coalesce("turn", "r_turn").alias("turn"),
        "depth",
        "name",
        F.when(~is_call, "orphan_result").when(F.col("depth").isNull(), "cycle").when(F.col("r_same").isNull(), "no_result").otherwise("linked").alias("status"),
        F.array_sort(F.concat(F.coalesce("errors", F.array().cast("array<string>")), lost.cast("array<string>"))).alias("errors"),
        "arguments",
        "content",
        F.lit(0).alias("again"),
    )
    # what repeats an identifier keeps its own row
    more = stored(_repeats(asked, first, "turn", "same").withColumn("dup", F.monotonically_increasing_id()), "repeats")
    faults = argument_errors(more, schemas, ["dup"])
    more = more.join(faults, "dup", "left").join(known, ["conv", "parent"], "left")
    more = more.withColumn("errors", F.array_sort(F.concat(F.coalesce("errors", F.array().cast("array<string>")), lost.cast("array<string>"))))
    more = more.select(*ID, "turn", "name", "errors", "arguments", "tie", "again").unionByName(
        _repeats(answered, answer, "r_turn", "r_same").select(*ID, "turn", "content", "tie", "again"), allowMissingColumns=True
    )
    row = row.unionByName(more.withColumn("status", F.lit("duplicate")), allowMissingColumns=True)
    loose = calls.where(~sound).select(*ID, "turn", "name", F.lit("no_result").alias("status"), "arguments").unionByName(
        results.where(~sound).select(*ID, "turn", F.lit("orphan_result").alias("status"), "content"), allowMissingColumns=True
    )
    row = row.unionByName(loose, allowMissingColumns=True)
    row = row.withColumns({"errors": F.coalesce("errors", F.array().cast("array<string>")), "o_depth": F.coalesce("depth", F.lit(1 << 40)), "o_status": F.when(F.col("status") == "linked", 0).otherwise(1)})
    ranked, _ = global_rank(row, ["conv", "o_depth", "turn", "call", "o_status", "status", "tie", "again"], "tool-calls")
    # a conversation's first rank, once per run of ranks, so that a long conversation is joined in parts
    run = F.shiftright("__rank", RUN_BITS)
    parts = ranked.groupBy("conv", run.alias("s_run")).agg(F.min("__rank").alias("start"))
    start = parts.withColumn("start", F.min("start").over(Window.partitionBy("conv"))).withColumnRenamed("conv", "s_conv")
    out = ranked.join(start, F.col("conv").eqNullSafe(F.col("s_conv")) & (run == F.col("s_run")))
    # keys in sorted order: arguments stand before all others
    rest = F.to_json(F.struct(F.col("call").alias("call_id"), "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))
    return out.select("conv", "call", (F.col("__rank") - F.col("start")).alias("position"), "depth", "name", "status", "errors", text.alias("canonical"))


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) read from plain conversations.

    The table holds no tool traffic, so every user turn counts as a call of the tool that its length
    names, with the text's checksum and word count as arguments; the call waits for the conversation's
    previous user turn. The assistant turn behind it is its result.
    """
    c = conversations.where("role in ('user', 'assistant')").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"))
    call = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    at = F.pmod(F.length("t"), F.lit(4))
    kind = F.when(at == 0, "search").when(at == 1, "translate").when(at == 2, "rank").otherwise("browse")
    users = c.where("role = 'user'")
    args = F.format_string('{"words": %d, "query_md5": "%s"}', F.size(F.split("t", " ")), F.md5("t"))
    calls = users.select(F.col("conv_id").alias("conv"), "turn", call(F.col("turn")).alias("call"), F.when(F.col("turn") >= 2, call(F.col("turn") - 2)).alias("parent"), kind.alias("name"), args.alias("arguments"))
    results = c.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), "turn", call(F.col("turn") - 1).alias("call"), F.md5("t").alias("content"))
    return calls, results


#: Tools of the query on plain conversations: name, param, type, required, low, high.
SCHEMAS = [
    ("search", "query_md5", "string", True, None, None),
    ("search", "words", "integer", True, 1.0, 200.0),
    ("translate", "query_md5", "string", True, None, None),
    ("translate", "words", "string", False, None, None),
    ("rank", "query_md5", "string", True, None, None),
    ("rank", "top", "integer", True, 1.0, None),
]


def schema_table(spark, rows=SCHEMAS) -> DataFrame:
    return spark.createDataFrame(rows, "name string, param string, type string, required boolean, low double, high double")
