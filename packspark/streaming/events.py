"""The event log: what is recorded, how it is appended, and how it is read as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.plans.bundle import Bundles

EVENT_DDL = (
    "timestamp double, event string, query_id string, query_tokens int, intent string, intent_confidence double, budget_assigned int,"
    " budget_used int, chunk_count int, expansions int, features struct<mentioned_files: int, mentioned_symbols: int, inferred_files: int,"
    " has_stack_trace: boolean, has_error_token: boolean, grep_hits: int>, success boolean, budget_source string"
)


def event_id() -> Column:
    """A random id of 32 hex digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def _signal_features(extra: Column) -> Column:
    s = F.col("signals")
    size = lambda c: F.size(s[c]).alias(c)
    return F.struct(size("mentioned_files"), size("mentioned_symbols"), size("inferred_files"), s["has_stack_trace"].alias("has_stack_trace"), s["has_error_token"].alias("has_error_token"), extra.alias("grep_hits"))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", F.unix_micros(F.current_timestamp()) / 1e6).select("timestamp", "event", "query_id", "query_tokens", "intent", "intent_confidence", "budget_assigned", "budget_used", "chunk_count", "expansions", "features", F.lit(None).cast("boolean").alias("success"), "budget_source")


def analysis_events(analysis: DataFrame) -> DataFrame:
    return _shaped(
        analysis.select(
            F.lit("analyze_query").alias("event"), F.col("query_id").cast("string").alias("query_id"), F.col("signals.query_tokens").alias("query_tokens"), "intent",
            F.col("confidence").alias("intent_confidence"), F.col("budget.recommended").alias("budget_assigned"), F.lit(0).alias("budget_used"), F.lit(0).alias("chunk_count"),
            F.lit(0).alias("expansions"), _signal_features(F.lit(None).cast("int")).alias("features"), F.lit(None).cast("string").alias("budget_source"),
        )
    )


def bundle_events(state: Bundles) -> DataFrame:
    """One event a bundle; grep_hits counts candidates of all tiers, and the budget's source is only
    told for a bundle that wasn't expanded."""
    n = state.candidates.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    rows = state.bundles.drop("intent").join(state.analysis, "query_id").join(state.limits.select("query_id", F.col("budget_source").alias("_source")), "query_id").join(n, "query_id", "left")
    first = F.col("expansions") == 0
    return _shaped(
        rows.select(
            F.when(first, "get_context_bundle").otherwise("expand_context").alias("event"), F.col("bundle_id").alias("query_id"), F.col("signals.query_tokens").alias("query_tokens"), "intent",
            F.col("confidence").alias("intent_confidence"), F.col("budget_limit").alias("budget_assigned"), "budget_used", F.size("chunks").alias("chunk_count"), "expansions",
            _signal_features(F.coalesce("_n", F.lit(0))).alias("features"), F.when(first, F.col("_source")).alias("budget_source"),
        )
    )


def _of_files(error: object) -> bool:
    """Whether a Java exception comes from a file system, or one that doesn't exist."""
    while error is not None:
        if error.getClass().getName().startswith(("java.io.", "java.nio.", "org.apache.hadoop.")):
            return True
        error = error.getCause()
    return False


def append(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; a log that can't be written loses them without an error, while
    anything wrong with the events themselves is raised."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        events.write.mode("append").json(path)
    except OSError:
        pass
    except (PySparkException, Py4JJavaError) as e:
        if not _of_files(e.java_exception if isinstance(e, Py4JJavaError) else getattr(e, "_origin", None)):
            raise


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The events below path, in batches' folders too."""
    return spark.read.schema(EVENT_DDL).option("recursiveFileLookup", True).json(path)


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The log as a stream, with event time ts."""
    raw = spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")))


def tumbling(events: DataFrame, time: str, keys: list[str], width: str, lateness: str, value: str) -> DataFrame:
    """Count, sum and mean of value in windows of a fixed width; for batches and streams (which drop
    what comes later than lateness behind the newest event)."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, lateness) if events.isStreaming else timed
    out = timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """Sessions of each key: runs of events less than ``gap`` apart."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, lateness) if events.isStreaming else timed
    out = timed.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into an in-memory table, and return that."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def for_each_batch(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):  # noqa: ANN201
    """Write each micro-batch of a stream to a JSON log, in a folder of its own: a batch that is tried
    again replaces what it has written. read_log() reads all of them."""
    sink = lambda df, batch: transform(df).write.mode("overwrite").json(f"{path}/batch={batch}")
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
