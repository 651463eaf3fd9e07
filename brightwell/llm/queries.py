"""The registered query of each operator, over whole tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwell.llm import quality_rules
from brightwell.llm.shared import shared_path, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("found.matches", lambda m: m["license"])))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("found.n_blocks").alias("n_blocks"), F.size("found.matches").cast("long").alias("n_matches"), F.concat_ws(",", names).alias("licenses"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.classifier import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "lang", "perplexity", "threshold", "worst", "worst_threshold", "kept")


def op4_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.decontam import find_spans

    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_sort(F.coalesce("found.items", F.array().cast("array<string>")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", items), "UTF-8"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from brightwell.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select(F.col("row.doc_id").alias("doc_id"), F.col("found.ids").alias("ids"))
    back = decode(coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.concat_ws(",", F.col("ids").cast("array<string>")), "UTF-8"), 256).alias("ids_sha256")), path)
    return back.select("row.doc_id", "row.n_tokens", "row.ids_sha256", F.sha2(F.encode("found.decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4, seed=42)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), folds=7, held_fold=2)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.warc import read_archives, write_archives

    folder = shared_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightwell.llm.quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents"), keep=F.col("doc_id"))
    return judged.select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_karmarkar_karp": op4_karmarkar_karp,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {"op10_quality_rules": quality_rules.ORACLE}
