"""Queries over the whole tables of a folder, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import collocations, embeddings, hilbert, lines, mixing, negatives, ngram_join, pieces, quality, tokenfile, toolcalls, toxicity, warc
from trailmark.llm.common import stored

#: Domains are good, poor and toxic documents of the label table.
MIX_WEIGHTS = (0.80, 0.15, 0.05)


def tokenizer_path(name: str) -> str:
    """Where the registered queries find a public tokenizer; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.calls_of_conversations(_read(spark, sf_dir, "conversations"))
    out = toolcalls.link_tool_calls(calls, results, toolcalls.schema_table(spark))
    return out.withColumn("errors", F.array_join("errors", ",")).withColumnRenamed("conv", "conv_id").withColumnRenamed("call", "call_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    d = stored(quality.with_metrics(docs.select("doc_id", "lang", "text")).drop("text"), "metrics")
    held = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cutoffs = quality.select_cutoffs(quality.holdout_counts(d, held, "lang"))
    judged = quality.with_verdict(d, cutoffs, "lang")
    return judged.select("doc_id", *[F.col(f"__q_{m}").alias(m) for m in quality.METRICS], F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    d = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return d.select("doc_id", F.col("__l_n_lines").alias("n_lines"), F.col("__l_n_dropped").alias("n_dropped"), F.sha2("__l_text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokenfile.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return d.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    d = mixing.rates(docs.select("doc_id", "text"), labels, MIX_WEIGHTS)
    return d.select("doc_id", "n_tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(("good", "poor", "toxic"))], "rate", "copies")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumn("tie", F.xxhash64("text"))
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    d = hilbert.hilbert_shards(docs, ["lang", "source", "n_chars", "doc_id"], ["doc_id", "tie"], size=size)
    return d.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("__h").alias("hilbert"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    d = toxicity.score_documents(docs, labels, usable=~held_out)
    return d.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(v, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tool_calls, op2_quality_rules, op3_line_dedup, op4_warc, op5_sentencepiece, op6_token_files, op7_mixing, op8_ngram_join, op9_hilbert_shards, op10_embeddings, op11_collocations, op12_toxicity, op13_hard_negatives)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES
