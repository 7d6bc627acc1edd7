"""Corpus pipeline: quality rules, line dedup, near duplicates, mixing, tokens.

Each stage takes all documents that the one before it kept, written as Parquet, and returns the
columns of documents; the last returns token counts and checksums per row.

Defined results of all stages: a null text counts as empty and stays null; a row without doc_id is a document of its own that holds no
line and links with nothing; repeated rows and ties are treated alike; texts are handled whole, however long; empty tables
give empty results with the same columns; columns of other names go through unchanged (names that begin with ``__`` are the
operators' own).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import lines, mixing, ngram_join, pieces, quality
from trailmark.llm.common import shared_dir
from trailmark.llm.queries import tokenizer_path

#: Shares of good, poor and toxic tokens after the quality rules; no document is left out, and none is taken more than
#: twice unless the shares need it. A warning tells of shares that are not met.
MIX_WEIGHTS = (0.88, 0.04, 0.08)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go; null, empty and short texts are among them."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the last of them only; a document may be left empty, but none goes."""
    return lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of Jaccard similarity 0.8, the one with the least doc_id stays; empty ones link with nothing."""
    return ngram_join.keep_one_of_each(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once or more, as the target weights of the domains ask for; without labels each once."""
    return mixing.repeat(docs, _labels(spark, sf_dir), MIX_WEIGHTS, floor=1.0)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row: doc_id, n_tokens, ids_sha256, decoded_sha256; an empty text has no ids."""
    return pieces.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_domains", mix_domains),
    ("encode_pieces", encode_pieces),
]

#: SQL cannot express the classifier of the mixing stage and the tokenizer; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stage's rows written before the next begins. See the module's text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = shared_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
