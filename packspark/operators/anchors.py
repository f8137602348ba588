"""Anchors: files that a query mentions, or that its keyword hits point to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.settings import Settings


#: Characters of the longest file name that a mention of one part can end.
LONGEST_NAME = 4_096


def resolve_mentions(mentions: DataFrame, files: DataFrame, empty_matches_all: bool = True) -> DataFrame:
    """(query_id, path) of files that a mention (query_id, mention) names: the path ends with it, or
    the names are equal.

    Leading dots and slashes of a mention are dropped, all of them; a mention of only those is
    empty then and names every file, unless empty_matches_all is off. A path that ends with a mention
    of several parts has the mention's file name; one that ends with a mention of a single part has a
    name that does. So both rules are equi-joins: by name, and by the end of the name, at the lengths
    that mentions have.
    """
    m = mentions.select("query_id", F.regexp_replace(F.replace("mention", F.lit("\\"), F.lit("/")), r"^[./]+", "").alias("m")).distinct()
    if not empty_matches_all:
        m = m.filter("m <> ''")
    m = m.withColumn("m_name", F.element_at(F.split("m", "/"), -1))
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    by_name = f.join(m, F.col("name") == F.col("m_name")).select("query_id", "path")
    parts = m.filter(~F.contains("m", F.lit("/")))
    sizes = sorted(r["n"] for r in parts.select(F.length("m").alias("n")).distinct().filter(F.col("n") <= LONGEST_NAME).collect())
    if not sizes:
        return by_name.distinct()
    ends = f.select("path", "name", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")).filter(F.length("name") >= F.col("n"))
    by_end = ends.withColumn("m", F.expr("substring(name, length(name) - n + 1, n)")).join(parts, "m").select("query_id", "path")
    return by_name.unionByName(by_end).distinct()


def rank_anchors(queries: DataFrame, found: DataFrame, limit: int, min_score: float) -> DataFrame:
    """The best files of each query by its candidates: query_id, path, score, reason, evidence, and
    place (from 1)."""
    per = found.groupBy("query_id", "path").agg(
        F.greatest(F.lit(0.0), F.max("keyword_match")).alias("kw"),
        F.count(F.lit(1)).alias("spans"),
        F.min_by("content", F.struct(-F.col("keyword_match"), "tier_rank", "start_line", "end_line")).alias("best"),
    )
    terms = queries.select("query_id", F.transform(T.keywords(F.coalesce("query", F.lit(""))), F.lower).alias("terms"))
    overlap = F.size(F.array_intersect("terms", T.path_words("path")))
    scored = per.join(terms, "query_id").withColumn("overlap", overlap).withColumn("raw", F.col("kw") + F.col("overlap") * 1.5 + F.least("spans", F.lit(3)) * 0.25)
    reason = F.concat_ws(", ", F.when(F.col("kw") != 0, "query keyword matches"), F.when(F.col("overlap") > 0, "path terms match query"))
    rows = scored.filter(F.col("raw") >= min_score).select(
        "query_id", "path", F.round("raw", 4).alias("score"), F.coalesce(F.nullif(reason, F.lit("")), F.lit("retrieval candidate")).alias("reason"),
        F.when(F.col("kw") > 0, T.evidence("best")).otherwise(F.lit("")).alias("evidence"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def discover(analysis: DataFrame, queries: DataFrame, files: DataFrame, grep_found: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, path, kind) of all anchors; kind is explicit or inferred. The limit on inferred
    anchors applies before those that are explicit too are left out."""
    mentions = analysis.select("query_id", F.explode("signals.mentioned_files").alias("mention"))
    explicit = resolve_mentions(mentions, files).withColumn("kind", F.lit("explicit"))
    if not settings.enable_anchor_inference:
        return explicit
    best = rank_anchors(queries, grep_found, settings.max_inferred_anchor_files, settings.inferred_anchor_min_score)
    inferred = best.select("query_id", "path").join(explicit, ["query_id", "path"], "left_anti").withColumn("kind", F.lit("inferred"))
    return explicit.unionByName(inferred)
