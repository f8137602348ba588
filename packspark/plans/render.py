"""Bundles as Markdown, and as one row a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.plans.bundle import Bundles


def chunk_rows(bundles: DataFrame) -> DataFrame:
    """query_id, pos (from 1) and the chunk's fields, in the order of the bundle."""
    at = bundles.select("query_id", F.posexplode("chunks").alias("pos", "c"))
    return at.select("query_id", (F.col("pos") + 1).alias("pos"), "c.*")


def markdown(state: Bundles, workspace: str) -> DataFrame:
    """query_id and message: header, anchors, chunks and what was left out."""
    s = F.col("signals")
    b = state.bundles.join(state.analysis.select("query_id", "query", "confidence", "signals"), "query_id")
    named = F.concat(s["mentioned_files"], s["mentioned_symbols"])
    any_signal = (F.size(named) > 0) | (F.size(s["inferred_files"]) > 0)
    none = F.array().cast("array<string>")
    head = F.array(
        F.lit("# Budgeted codebase context"), F.lit(""),
        F.concat(F.lit("**Query:** "), F.col("query")),
        F.lit(f"**Workspace:** {workspace}"),
        F.concat(F.lit("**Intent:** "), F.col("intent"), F.lit(" (confidence "), F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%)")),
        F.format_string("**Budget:** %,d / %,d tokens (%d chunks)", "budget_used", "budget_limit", F.size("chunks")),
        F.concat(F.lit("**Bundle id:** `"), F.col("bundle_id"), F.lit("`")), F.lit(""),
        F.lit("Use only the chunks below to answer or continue the task."),
        F.lit("Do not read whole files unless a chunk is clearly insufficient."),
        F.concat(F.lit("If more context is needed, call `expand_context` with bundle id `"), F.col("bundle_id"), F.lit("`.")), F.lit(""),
    )
    anchors = F.concat(
        F.when(F.size(named) > 0, F.array(F.concat(F.lit("**Anchors:** "), F.array_join(named, ", ")))).otherwise(none),
        F.when(F.size(s["inferred_files"]) > 0, F.array(F.concat(F.lit("**Inferred anchors:** "), F.array_join(s["inferred_files"], ", ")))).otherwise(none),
        F.array(F.lit("")),
    )
    sections = F.transform(
        "chunks",
        lambda c, i: F.concat(
            F.format_string("## Chunk %d: `%s` L%d-L%d\n*score %.2f — %s (%d tokens)*\n\n```\n", i + 1, c["path"], c["start_line"], c["end_line"], c["score"], c["reason"], c["tokens"]),
            T.rstrip(c["content"]),
            F.lit("\n```\n"),
        ),
    )
    left = F.when(F.col("excluded_summary") != "", F.array(F.lit("## Excluded"), F.lit(""), F.col("excluded_summary"), F.lit(""))).otherwise(none)
    body = F.array_join(F.concat(head, F.when(any_signal, anchors).otherwise(none), sections, left), "\n")
    return b.select("query_id", F.concat(T.rstrip(body), F.lit("\n")).alias("message"))
