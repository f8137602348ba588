"""What a query's text tells: mentions, error signs, intent, confidence, budget range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.settings import Settings

#: Suffixes of files that a query can mention.
MENTIONED = (
    "py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "go", "rs",
    "rb", "php", "c", "h", "cpp", "hpp", "cs", "kt", "swift", "scala", "sql",
    "json", "toml", "yaml", "yml", "md",
)
#: The words of each intent, which count wherever they stand, inside words too.
INTENT_WORDS = {
    "debug": ("fix", "bug", "error", "exception", "traceback", "fail", "failing", "crash", "broken", "stack trace", "throws", "regression", "not working"),
    "implement": ("add", "create", "implement", "build", "introduce", "new feature", "support", "write a", "generate", "scaffold"),
    "explain": ("how does", "what is", "explain", "why does", "walk me through", "understand", "describe", "what happens"),
    "refactor": ("refactor", "rename", "extract", "move", "clean up", "simplify", "restructure", "deduplicate", "split", "inline"),
    "review": ("review", "pr", "pull request", "audit", "security", "vulnerab", "lgtm", "code smell", "best practice"),
}
#: Which intent wins a tie, the first before the others.
TIE_ORDER = ("debug", "refactor", "review", "explain", "implement")
#: Patterns of mentions and error signs.
FILE = r"[\w./\\-]+\.(?:" + "|".join(MENTIONED) + r")\b"
BACKTICK = r"`([^`]+)`"
CAMEL = r"\b[a-z]+[A-Z][A-Za-z0-9]+\b"
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
STACK_TRACE = r"""(traceback \(most recent call last\)|file "[^"]+", line \d+|\bat [\w./\\-]+:\d+|\b\w*error\b|\bexception\b)"""
ERROR_WORD = r"\b(error|exception|traceback|typeerror|valueerror|keyerror|nullpointer|undefined|nameerror|attributeerror)\b"
FLAGS, UNICODE = "(?iU)", "(?U)"


def mentioned_files(query: Column) -> Column:
    """File mentions in order, with forward slashes."""
    found = F.regexp_extract_all(query, F.lit(FLAGS + FILE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit("\\"), F.lit("/"))))


def mentioned_symbols(query: Column) -> Column:
    """Backticked tokens, then lower camel case, then snake case; no file mentions."""
    ticked = F.transform(F.regexp_extract_all(query, F.lit(BACKTICK), F.lit(1)), T.strip)
    ticked = F.filter(ticked, lambda t: (t != "") & ~F.contains(t, F.lit(" ")) & ~t.rlike(f"{FLAGS}^(?:{FILE})$"))
    camel = F.regexp_extract_all(query, F.lit(UNICODE + CAMEL), F.lit(0))
    snake = F.filter(F.regexp_extract_all(query, F.lit(UNICODE + SNAKE), F.lit(0)), lambda s: F.length(s) >= 3)
    return F.array_except(F.concat(ticked, camel, snake), mentioned_files(query))


def intent_scores(query: Column) -> dict[str, Column]:
    low = F.lower(query)
    return {k: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for k, words in INTENT_WORDS.items()}


def budget_struct(intent: Column, settings: Settings) -> Column:
    """(recommended, min, max, source) of an intent; an unknown one gets implement's."""
    rows = settings.intent_budgets
    pick = lambda i: F.coalesce(*[F.when(intent == k, F.lit(int(v[i]))) for k, v in rows.items()], F.lit(int(rows["implement"][i])))
    return F.struct(pick(0).alias("recommended"), pick(1).alias("min"), pick(2).alias("max"), F.lit("fixed_intent_table").alias("source"))


def analyze(queries: DataFrame, settings: Settings | None = None) -> DataFrame:
    """queries (query_id, query, and optionally intent to override with) with intent, confidence,
    signals and budget. An override that is no intent is ignored; confidence stays as found."""
    settings = settings or Settings()
    q = F.coalesce(F.col("query"), F.lit(""))
    low = F.lower(q)
    override = F.col("intent") if "intent" in queries.columns else F.lit(None).cast("string")
    trace = low.rlike(FLAGS + STACK_TRACE)
    base = queries.select(
        "query_id",
        "query",
        *[c for c in queries.columns if c not in ("query_id", "query", "intent")],
        override.alias("_override"),
        F.struct(
            trace.alias("has_stack_trace"),
            mentioned_files(q).alias("mentioned_files"),
            F.array().cast("array<string>").alias("inferred_files"),
            mentioned_symbols(q).alias("mentioned_symbols"),
            low.rlike(FLAGS + ERROR_WORD).alias("has_error_token"),
            T.tokens(q).alias("query_tokens"),
        ).alias("signals"),
        F.struct(*[(s + (F.when(trace, 2).otherwise(0) if k == "debug" else F.lit(0))).alias(k) for k, s in intent_scores(q).items()]).alias("_s"),
    )
    best = F.array_max(F.array(*[F.struct(F.col(f"_s.{k}").alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("intent")) for i, k in enumerate(TIE_ORDER)]))
    total = sum((F.col(f"_s.{k}") for k in TIE_ORDER), F.lit(0))
    scored = base.withColumn("_best", best).withColumn("_total", total)
    none = F.col("_best.score") == 0
    found = F.when(none, F.lit("implement")).otherwise(F.col("_best.intent"))
    valid = F.col("_override").isin(*INTENT_WORDS)
    confidence = F.when(none, F.lit(0.3)).otherwise(F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.99), F.col("_best.score") / F.nullif(F.col("_total"), F.lit(0)))), 2))
    out = scored.withColumn("intent", F.when(valid, F.col("_override")).otherwise(found)).withColumn("confidence", confidence)
    return out.withColumn("budget", budget_struct(F.col("intent"), settings)).drop("_override", "_s", "_best", "_total")
