"""The candidate relation that all retrieval operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of the tiers in which candidates are listed; ties in score fall back to (tier, path, lines).
TIERS = {"explicit": 0, "inferred_anchor": 1, "symbol": 2, "import": 3, "grep": 4, "embedding": 5}

COLUMNS = ("query_id", "tier_rank", "path", "start_line", "end_line", "content", "tier", "keyword_match", "path_mention", "import_proximity", "recency")


def candidates(df: DataFrame, rank: int, tier: str | Column, content: Column | str, keyword: Column | float = 0.0, mention: Column | float = 0.0, proximity: Column | float = 0.0) -> DataFrame:
    """Shape rows (query_id, path, start_line, end_line, …) as candidates; recency is set later."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "query_id",
        F.lit(rank).alias("tier_rank"),
        "path",
        F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"),
        (F.col(content) if isinstance(content, str) else content).alias("content"),
        lit(tier).alias("tier"),
        lit(keyword).cast("double").alias("keyword_match"),
        lit(mention).cast("double").alias("path_mention"),
        lit(proximity).cast("double").alias("import_proximity"),
        F.lit(0.0).alias("recency"),
    )
