"""The corpus pipeline: five stages in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm import bpe, classifier, decontam, line_dedup, simhash
from brightwell.llm.shared import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one, exactly or nearly."""
    return line_dedup.dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark text go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens, and whether decoding these gives the text again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs, path).select("row.*", F.col("found.ids").alias("token_ids"))
    back = bpe.decode(coded, path, "token_ids")
    return back.select("row.*", F.size("row.token_ids").cast("long").alias("n_tokens"), (F.coalesce("row.text", F.lit("")) == F.col("found.decoded")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: Perplexities, union-find and token merges are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
