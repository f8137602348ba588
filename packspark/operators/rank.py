"""Scores of candidates: normalised features, weights, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.settings import Weights

ANCHOR_BOOST = 0.5


def with_features(found: DataFrame, mtimes: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """Set recency (modification time between the oldest and the newest file of the query's
    candidates) and the mention boost of candidates in anchor files."""
    w = Window.partitionBy("query_id")
    at = found.drop("recency").join(mtimes.select("path", "mtime"), "path", "left").withColumn("mtime", F.coalesce("mtime", F.lit(0.0)))
    least, most = F.min("mtime").over(w), F.max("mtime").over(w)
    spread = F.when(most > least, most - least).otherwise(1.0)
    out = at.withColumn("recency", (F.col("mtime") - least) / spread).drop("mtime")
    if anchors is not None:
        flagged = out.join(anchors.select("query_id", "path").distinct().withColumn("_a", F.lit(True)), ["query_id", "path"], "left")
        boosted = F.when(F.col("_a") & (F.col("path_mention") == 0), ANCHOR_BOOST).otherwise(F.col("path_mention"))
        out = flagged.withColumn("path_mention", boosted).drop("_a")
    return out.select(*found.columns)


def rank(found: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Add score (4 places) and reason; keywords count relative to the query's best candidate."""
    w = weights or Weights()
    best = F.max("keyword_match").over(Window.partitionBy("query_id"))
    kw = F.when(best > 0, F.col("keyword_match") / best).otherwise(0.0)
    one = lambda c: F.least(F.lit(1.0), F.col(c))
    score = w.keyword_match * kw + w.path_mention * one("path_mention") + w.import_proximity * one("import_proximity") + w.recency * one("recency")
    kind = lambda tier, say: F.when(F.col("tier") == tier, say)
    reason = F.concat_ws(
        ", ",
        F.when(F.col("path_mention") > 0, "explicitly mentioned path"),
        kind("symbol", "symbol slice"),
        kind("import", "import neighbor"),
        kind("inferred_anchor", "inferred anchor"),
        kind("skeleton", "project skeleton"),
        F.when((F.col("keyword_match") > 0) & (F.col("tier") == "grep"), "keyword match"),
        F.when((F.col("import_proximity") > 0) & (F.col("tier") != "import"), "near anchor in import graph"),
    )
    return found.withColumn("score", F.round(score, 4)).withColumn("reason", F.coalesce(F.nullif(reason, F.lit("")), F.lit("candidate")))
