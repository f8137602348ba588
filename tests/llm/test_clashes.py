"""Columns that are called like the operators' own helpers come through as they are; each registered
query runs over its whole table."""

import pytest
from pyspark.sql import functions as F

from packspark.llm import decontam, line_dedup, matroska, mixing, near_dedup, quality_rules, secrets, substring_dedup, toxicity, warc
from packspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["_k1", "_k2", "_removed", "_stats", "_rows", "_place", "_sha", "_first", "_copies", "_nth", "_hot_w1", "_need", "k1", "W1", "at", "fp", "n", "h"]


def odd(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").withColumns({c: F.concat(F.lit(f"mine {c} "), F.col("doc_id").cast("string")) for c in ODD})


def same(got, frame, rows=True):
    assert set(frame.columns) <= set(got.columns)
    found = got.select("doc_id", *ODD).collect()
    assert all(r[c] == f"mine {c} {r['doc_id']}" for r in found for c in ODD)
    if rows:
        assert len(found) == frame.count()


def test_columns_pass_through(spark):
    frame = odd(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    same(line_dedup.dedup_lines(frame), frame)
    same(mixing.mix(frame), frame, rows=False)
    same(quality_rules.with_score(frame, quality_rules.fit(frame, labels)), frame)
    same(toxicity.with_score(frame, toxicity.fit(frame, labels)), frame)
    same(decontam.decontaminate(frame, spark.read.parquet(f"{SF}/benchmark.parquet")), frame, rows=False)
    same(secrets.with_secrets(frame), frame)
    same(matroska.with_media(frame.withColumn("raw", F.encode("text", "UTF-8")), "raw"), frame)
    assert near_dedup.near_dups(frame).count() == substring_dedup.dedup_substrings(frame).count() == mixing.decide(frame).count() == frame.count()
    pages = frame.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    assert warc.round_trip(pages).count() == frame.count()


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_cover_their_tables(spark, name):
    got = QUERIES[name](spark, SF)
    ids = [r[0] for r in got.select(got.columns[0]).collect()]
    if name == "op6_decontamination":
        assert ids and got.columns[:2] == ["doc_id", "item_id"]
        return
    table, key = ("pages", "page_id") if name == "op4_warc" else ("documents", "doc_id")
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
