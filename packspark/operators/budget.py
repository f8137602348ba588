"""Token budgets: buckets, must-include estimates, fitting, the cap on optional chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.operators import symbols as S
from packspark.settings import Settings

#: The budgets that are ever given.
BUCKETS = (2000, 3000, 4000, 5000, 6000, 8000, 10000, 12000, 15000)
HEAD_LINES, IMPORT_HEAD_LINES = 40, 18


def _first_bucket(test) -> Column:  # noqa: ANN001
    fitting = F.filter(F.array(*[F.lit(b) for b in BUCKETS]), test)
    return F.coalesce(F.get(fitting, F.lit(0)), F.lit(BUCKETS[-1]))


def snap(tokens: Column) -> Column:
    """The least bucket that holds so many tokens, else the largest."""
    return _first_bucket(lambda b: b >= tokens)


def fit(limit: Column, must_tokens: Column, factor: float = 1.5) -> Column:
    """A limit whose ceiling (factor times it) holds the must-include tokens: itself, the next
    bucket that does, or the largest."""
    holds = lambda b: F.floor(b * factor) >= must_tokens
    return F.when(holds(limit), limit).otherwise(_first_bucket(lambda b: (b > limit) & holds(b)))


def optional_cap(limit: Column, anchors: Column, query_tokens: Column, floor: int = 1, upper: int = 4) -> Column:
    """How many optional chunks a bundle may have."""
    n = F.lit(2) + (limit >= 8000).cast("int") + (anchors >= 4).cast("int") + (query_tokens >= 40).cast("int")
    return T.clamp(F.when(limit < 6000, F.least(n, F.lit(2))).otherwise(n), floor, upper)


def must_tokens(anchors: DataFrame, analysis: DataFrame, files: DataFrame, symbol_table: DataFrame) -> DataFrame:
    """query_id, must_tokens: for each anchor the longest slice of a mentioned symbol, else its head."""
    wanted = analysis.select("query_id", F.explode("signals.mentioned_symbols").alias("symbol"))
    spans = S.lookup(symbol_table, anchors.select("query_id", "path").join(wanted, "query_id"))
    at = anchors.select("query_id", "path").distinct().join(files.select("path", "lines"), "path")
    sliced = at.join(spans, ["query_id", "path"], "left")
    size = T.tokens(T.snippet(F.col("lines"), F.col("start_line"), F.col("end_line")))
    head = T.tokens(F.array_join(F.slice("lines", 1, HEAD_LINES), "\n"))
    sized = sliced.select("query_id", "path", size.alias("slice"), head.alias("head"))
    per = sized.groupBy("query_id", "path").agg(F.max("slice").alias("slice"), F.max("head").alias("head"))
    return per.groupBy("query_id").agg(F.sum(F.coalesce(F.nullif("slice", F.lit(0)), "head")).cast("int").alias("must_tokens"))


def resolve(max_tokens: Column | None, predicted: Column | None, settings: Settings) -> tuple[Column, Column]:
    """(limit, source): the explicit maximum (0 too), else the model's, else the default's bucket."""
    given = F.lit(None).cast("int") if max_tokens is None else max_tokens.cast("int")
    model = F.lit(None).cast("int") if predicted is None else predicted.cast("int")
    limit = F.coalesce(given, model, snap(F.lit(settings.default_max_tokens)))
    return limit, F.when(given.isNotNull(), "explicit").when(model.isNotNull(), "rf").otherwise("fallback_default")
