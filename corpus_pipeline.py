"""From raw documents to a training mix: five stages, each one operator of ``packspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``; the last
returns them too, each row as often as the mix takes its document. Extra columns pass through every
stage, whatever they are called; null ids, texts and sources, empty and very long texts and repeated
rows are handled as the operators state; an empty table comes through empty. Ties (equal scores, repeated
rows, equal keys) are decided by hashes of the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.llm import decontam, line_dedup, mixing, near_dedup, quality_rules
from packspark.llm.common import new_dir, release, row_key, stash, unused
from packspark.session import table

#: Documents that score below this are rejected.
LEAST_QUALITY = 0.3
#: Documents whose shingle sets reach this Jaccard similarity, in hundredths, are near copies, as in op9.
NEAR = 85


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rule ensemble, fitted on the labelled ones, takes for good. Null and
    empty texts get the score that the rules give for statistics of 0."""
    model = quality_rules.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "quality")
    (score,) = unused(docs, "_score")
    release(spark)
    return quality_rules.with_score(docs, model, out=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated windows of three lines; n_chars follows the text, and documents that had text
    and lose all of it go. Null texts stay null."""
    names = ["n_lines", "n_removed", "n_spans"]
    own = {c: n for c, n in zip(docs.columns, unused(docs, *[f"_own_{c}" for c in docs.columns]), strict=True) if c.lower() in names}
    cut = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    emptied = (F.col("n_removed") > 0) & (F.col("text") == "")
    left = cut.filter(~emptied).withColumn("n_chars", chars).drop(*names)
    return left.withColumnsRenamed({n: c for c, n in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the first by doc_id (null last), then by a hash of
    its text; of rows equal in both the one with the least hash of the whole row. Documents without words
    are near nothing and stay, once a doc_id and text."""
    i, a, b, n = unused(docs, "_id", "_t1", "_t2", "_n")
    found = near_dedup.near_dups(docs, NEAR).filter("representative")
    kept = stash(found.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).toDF(i, a, b, n), "kept")
    t1, t2 = row_key("text")
    x1, x2 = unused(docs, "_x1", "_x2")
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(x1) == F.col(a)) & (F.col(x2) == F.col(b))
    left = docs.withColumns({x1: t1, x2: t2}).join(kept, same, "left_semi")
    if not kept.filter(F.col(n) > 1).isEmpty():  # repeated rows: one of them stays
        h1, h2 = unused(left, "_h1", "_h2")
        whole = dict(zip((h1, h2), row_key(*[F.col(f"`{c}`") for c in docs.columns]), strict=True))
        least = left.withColumns(whole).groupBy("doc_id", x1, x2).agg(F.min(F.struct(h1, h2)).alias("h")).select(F.col(f"h.{h1}").alias(h1), F.col(f"h.{h2}").alias(h2)).distinct()
        left = left.withColumns(whole).join(least, [h1, h2], "left_semi").dropDuplicates([h1, h2])
    return left.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; those without words hold none."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the weighted mix takes them: those without words as often as their place
    in their source's order says."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mix", mixture),
]

#: The fitted rules, latent vectors and signatures have no SQL form; tests compare run() with a
#: plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
