"""The queries of this subpackage by name, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.llm import decontam, line_dedup, matroska, mixing, near_dedup, quality_rules, secrets, substring_dedup, toxicity, warc
from packspark.llm.common import fold
from packspark.session import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_spans", "text")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1), "toxic")
    scored = toxicity.with_score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", toxicity.decided(F.col("score"), 0.7).alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("k1", "k2")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0), "quality")
    scored = quality_rules.with_score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_dups(table(spark, sf_dir, "documents"), 85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash": op9_minhash,
    "op10_media_matroska": op10_media_matroska,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_source_mix": mixing.SQL,
}
