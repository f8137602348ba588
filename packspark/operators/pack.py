"""Filling a bundle: which candidates are kept, and greedy packing under the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.settings import Settings

MUST_TIERS = ("anchor", "symbol", "inferred_anchor")
CHUNK = "path string, start_line int, end_line int, content string, score double, reason string, tokens int"
_ORDER = ["tier_rank", "path", "start_line", "end_line", "content"]


def is_must() -> Column:
    return (F.col("path_mention") >= 1.0) | F.col("tier").isin(*MUST_TIERS)


def keep(scored: DataFrame, caps: DataFrame, settings: Settings) -> DataFrame:
    """Scored candidates with is_must, kept; optional ones need the least score and a place among the
    query's cap (query_id, cap), which counts before overlaps and budget do."""
    marked = scored.withColumn("is_must", is_must())
    able = ~F.col("is_must") & (F.col("score") >= settings.min_chunk_score)
    w = Window.partitionBy("query_id", able).orderBy(F.desc("score"), *_ORDER)
    placed = marked.withColumn("_n", F.row_number().over(w)).join(caps, "query_id")
    return placed.withColumn("kept", F.col("is_must") | (able & (F.col("_n") <= F.col("cap")))).drop("_n", "cap")


def pack(kept: DataFrame, limits: DataFrame, factor: float = 1.5) -> DataFrame:
    """query_id, budget_limit, budget_used, chunks of each query of limits (query_id, budget_limit).

    Must chunks by score come first: each is taken unless it overlaps a taken one or, with something
    taken already, passes the ceiling of factor times the limit. Then the others by score: taken
    unless they overlap or pass the limit. A chunk that doesn't fit doesn't end the scan. The scan
    depends on its order, so it is a fold over each query's sorted array, inside the JVM.
    """
    item = F.struct(
        (~F.col("is_must")).cast("int").alias("late"), (-F.col("score")).alias("minus"), *[F.col(c) for c in _ORDER],
        F.col("score"), F.col("reason"), F.col("_tokens").alias("tokens"),
    )
    items = kept.withColumn("_tokens", T.tokens("content")).groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    chunk = lambda x: F.struct(*[x[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in CHUNK.split(", ")])
    empty = F.array().cast(f"array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>")
    start = F.struct(F.lit(0).alias("used"), empty.alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc["chosen"], lambda c: (c["path"] == x["path"]) & ~((x["end_line"] < c["start_line"]) | (x["start_line"] > c["end_line"])))
        after = acc["used"] + x["tokens"]
        over = F.when(x["late"] == 0, (F.size(acc["chosen"]) > 0) & (after > F.floor(F.col("budget_limit") * factor))).otherwise(after > F.col("budget_limit"))
        taken = F.struct(after.cast("int").alias("used"), F.concat(acc["chosen"], F.array(chunk(x))).alias("chosen"))
        return F.when(clash | over, acc).otherwise(taken)

    rows = limits.select("query_id", "budget_limit").join(items, "query_id", "left")
    folded = rows.withColumn("_acc", F.aggregate(F.coalesce("items", F.filter("items", lambda _: F.lit(False))), start, step))
    out = F.coalesce("_acc", start)
    return folded.select("query_id", "budget_limit", out["used"].alias("budget_used"), out["chosen"].alias("chunks"))
