"""From queries to context bundles: one lazy plan for a whole batch of queries."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packspark.functions import signals
from packspark.functions import text as T
from packspark.operators import anchors as A
from packspark.operators import budget as B
from packspark.operators import grep as G
from packspark.operators import imports as I
from packspark.operators import pack as P
from packspark.operators import rank as R
from packspark.operators import symbols as S
from packspark.operators.candidates import COLUMNS, TIERS, candidates
from packspark.session import scratch
from packspark.settings import Settings
from packspark.sources.workspace import Corpus


@dataclasses.dataclass(frozen=True)
class Index:
    """A corpus with the tables that many queries share; build it once and store or persist it."""

    corpus: Corpus
    symbols: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, corpus: Corpus) -> Index:
        return cls(corpus, S.symbols(corpus.files), I.import_edges(corpus.files))

    def store(self, path: str) -> Index:
        """Write the tables below path and go on with what is stored: parsing is done once."""
        self.corpus.files.write.mode("overwrite").parquet(f"{path}/files")
        stored = self.open(self.corpus.files.sparkSession, path, tables=False)
        Index.build(stored.corpus)._write(path)
        return self.open(self.corpus.files.sparkSession, path)

    def _write(self, path: str) -> None:
        self.symbols.write.mode("overwrite").parquet(f"{path}/symbols")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def open(cls, spark: SparkSession, path: str, tables: bool = True) -> Index:
        """A stored index."""
        corpus = Corpus(spark.read.parquet(f"{path}/files"))
        return cls(corpus, spark.read.parquet(f"{path}/symbols"), spark.read.parquet(f"{path}/edges")) if tables else cls.build(corpus)


@dataclasses.dataclass(frozen=True)
class Bundles:
    """The state of a batch: what later expansions start from."""

    analysis: DataFrame  # query_id, query, intent, confidence, signals, budget
    anchors: DataFrame  # query_id, path, kind
    candidates: DataFrame
    limits: DataFrame  # query_id, budget_limit, budget_source, anchor_count
    bundles: DataFrame


def _head(df: DataFrame, lines: int) -> DataFrame:
    """Add the first lines as content, start_line and end_line (1 at least)."""
    return df.withColumn("content", F.array_join(F.slice("lines", 1, lines), "\n")).withColumns({"start_line": F.lit(1), "end_line": F.greatest(F.lit(1), F.least(F.size("lines"), F.lit(lines)))})


def _sliced(spans: DataFrame, files: DataFrame) -> DataFrame:
    at = spans.join(files.select("path", "lines"), "path")
    return at.withColumn("content", T.snippet(F.col("lines"), F.col("start_line"), F.col("end_line")))


def build_candidates(analysis: DataFrame, anchors: DataFrame, grep_found: DataFrame, index: Index) -> DataFrame:
    """All tiers: explicit anchors by symbol or head, inferred anchors, symbols anywhere else, import
    neighbours, keyword hits; then recency and the anchor boost."""
    files = index.corpus.files
    wanted = analysis.select("query_id", F.explode("signals.mentioned_symbols").alias("symbol"))
    explicit = anchors.filter("kind = 'explicit'").select("query_id", "path")
    inferred = anchors.filter("kind = 'inferred'").select("query_id", "path")
    both = anchors.select("query_id", "path").distinct()

    spans = S.lookup(index.symbols, explicit.join(wanted, "query_id"))
    slices = candidates(_sliced(spans, files), TIERS["explicit"], "symbol", "content", keyword=1.0, mention=1.0)
    bare = explicit.join(spans.select("query_id", "path").distinct(), ["query_id", "path"], "left_anti").join(files.select("path", "lines"), "path")
    heads = candidates(_head(bare, B.HEAD_LINES), TIERS["explicit"], "anchor", "content", mention=1.0)
    guessed = candidates(_head(inferred.join(files.select("path", "lines"), "path"), B.HEAD_LINES), TIERS["inferred_anchor"], "inferred_anchor", "content", mention=0.75)
    elsewhere = S.lookup(index.symbols, wanted).join(both, ["query_id", "path"], "left_anti")
    globals_ = candidates(_sliced(elsewhere, files), TIERS["symbol"], "symbol", "content", keyword=1.0, proximity=0.5)
    near = I.neighbours(both, index.edges).join(files.select("path", "lines"), "path")
    imported = candidates(_head(near, B.IMPORT_HEAD_LINES), TIERS["import"], "import", "content", proximity=0.7)
    parts = [slices, heads, guessed, globals_, imported, grep_found.select(*COLUMNS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return R.with_features(out, files, both)


def assemble(analysis: DataFrame, found: DataFrame, limits: DataFrame, settings: Settings) -> DataFrame:
    """query_id, intent, budget_used, budget_limit, chunks, excluded_summary, optional_chunks_used."""
    scored = R.rank(found, settings.weights)
    facts = limits.join(analysis.select("query_id", F.col("signals.query_tokens").alias("_t")), "query_id")
    cap = F.lit(settings.max_optional_chunks) if settings.max_optional_chunks is not None else B.optional_cap(F.col("budget_limit"), F.col("anchor_count"), F.col("_t"), settings.max_optional_chunks_floor, settings.max_optional_chunks_upper)
    marked = P.keep(scored, facts.select("query_id", cap.alias("cap")), settings)
    packed = P.pack(marked.filter("kept"), limits, settings.hard_ceiling_factor)
    counts = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("kept") & ~F.col("is_must")).cast("int").alias("optional"))
    out = packed.join(counts, "query_id", "left").join(analysis.select("query_id", "intent"), "query_id")
    dropped = F.coalesce("all", F.lit(0)) - F.size("chunks")
    summary = F.concat(dropped.cast("string"), F.lit(" candidates dropped (below score threshold or over budget)"))
    return out.select("query_id", "intent", "budget_used", "budget_limit", "chunks", summary.alias("excluded_summary"), F.coalesce("optional", F.lit(0)).alias("optional_chunks_used"))


def keeper(spark: SparkSession, path: str | None) -> Callable[[DataFrame, str], DataFrame]:
    """How a state's tables are held: stored below path (without one, in the session's shared scratch
    folder) and read back. What is stored outlives lost executors, is computed once, and keeps the
    plans that build on it small."""
    base = path or scratch(spark, "state")

    def hold(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    return hold


STATE = ("analysis", "anchors", "candidates", "limits", "bundles")


def open_state(spark: SparkSession, path: str) -> Bundles:
    """The state that prepare() or expand() has stored below path."""
    return Bundles(*[spark.read.parquet(f"{path}/{name}") for name in STATE])


def prepare(
    queries: DataFrame, index: Index, settings: Settings | None = None, predicted: DataFrame | None = None, extra_hits: DataFrame | None = None, state_path: str | None = None
) -> Bundles:
    """Bundles for queries (query_id, query, optionally max_tokens and intent), their state stored
    below state_path (see keeper).

    predicted: query_id and predicted, budgets of a trained model. extra_hits: further candidates,
    such as those of vector search, merged behind the keyword hits.
    """
    settings, hold = settings or Settings(), keeper(index.corpus.files.sparkSession, state_path)
    analysis = hold(signals.analyze(queries, settings), "raw_analysis")
    found = G.grep(queries, index.corpus, settings)
    if extra_hits is not None:
        from packspark.operators.vectors import merge_hits

        order = [F.desc("keyword_match"), F.col("path"), F.col("start_line")]
        found = merge_hits(found, extra_hits, settings.max_grep_candidates, order).drop("merged_rank")
    # Keyword hits feed anchors and candidates; they are computed once.
    found = hold(found, "hits")
    anchors = hold(A.discover(analysis, queries, index.corpus.files, found, settings), "anchors")

    rows = analysis.select("query_id", *([F.col("max_tokens")] if "max_tokens" in analysis.columns else []))
    if predicted is not None:
        rows = rows.join(predicted.select("query_id", "predicted"), "query_id", "left")
    limit, source = B.resolve(F.col("max_tokens") if "max_tokens" in rows.columns else None, F.col("predicted") if predicted is not None else None, settings)
    must = B.must_tokens(anchors, analysis, index.corpus.files, index.symbols)
    number = anchors.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("anchor_count"))
    rows = rows.withColumns({"_limit": limit, "budget_source": source}).join(must, "query_id", "left").join(number, "query_id", "left")
    fitted = F.when((F.col("budget_source") == "explicit") | F.col("anchor_count").isNull(), F.col("_limit")).otherwise(B.fit(F.col("_limit"), F.coalesce("must_tokens", F.lit(0)), settings.hard_ceiling_factor))
    limits = hold(rows.select("query_id", fitted.alias("budget_limit"), "budget_source", F.coalesce("anchor_count", F.lit(0)).alias("anchor_count")), "limits")

    inferred = anchors.filter("kind = 'inferred'").groupBy("query_id").agg(F.sort_array(F.collect_set("path")).alias("_inferred"))
    filled = analysis.join(inferred, "query_id", "left").withColumn("signals", F.col("signals").withField("inferred_files", F.coalesce("_inferred", F.array().cast("array<string>")))).drop("_inferred")
    everything = hold(build_candidates(analysis, anchors, found, index), "candidates")
    bundles = with_id(assemble(analysis, everything, limits, settings)).withColumn("expansions", F.lit(0))
    return Bundles(hold(filled, "analysis"), anchors, everything, limits, hold(bundles, "bundles"))


def with_id(bundles: DataFrame) -> DataFrame:
    """Add bundle_id: the same for the same query, so that a plan that runs twice agrees with itself."""
    return bundles.withColumn("bundle_id", F.md5(F.concat_ws(":", F.lit("bundle"), F.col("query_id").cast("string")).cast("binary")))


def expand(state: Bundles, requests: DataFrame, index: Index, settings: Settings | None = None, state_path: str | None = None) -> Bundles:
    """The state after requests (query_id, focus, extra_tokens): more budget, the focus files whole,
    a second import hop; all candidates are ranked and packed again under the same bundle_id.

    extra_tokens that are null or 0 give half the limit. Queries without a request are left out. The
    new state is stored below state_path, which must not be the old one's.
    """
    settings, hold = settings or Settings(), keeper(index.corpus.files.sparkSession, state_path)
    files = index.corpus.files
    asked = requests.select("query_id", "focus", "extra_tokens")
    old = state.candidates.join(asked.select("query_id"), "query_id", "left_semi")
    focus = A.resolve_mentions(asked.filter("focus IS NOT NULL AND focus <> ''").select("query_id", F.col("focus").alias("mention")), files)
    whole = focus.join(files.select("path", "content", "lines"), "path").withColumns({"start_line": F.lit(1), "end_line": F.greatest(F.lit(1), F.size("lines"))})
    full = candidates(whole, TIERS["explicit"], "anchor", "content", mention=1.0)
    hop = I.hops(old.select("query_id", "path").distinct(), index.edges, 1).join(files.select("path", "lines"), "path")
    second = candidates(_head(hop, B.HEAD_LINES), TIERS["import"], "import", "content", proximity=0.4)
    key = ["query_id", "path", "start_line", "end_line"]
    # A focus file that is a second-hop neighbour too stays a focus file.
    first = F.row_number().over(Window.partitionBy(*key).orderBy("tier_rank", "content"))
    new = R.with_features(full.unionByName(second), files, None).withColumn("_nth", first).filter("_nth = 1").drop("_nth")
    everything = hold(old.unionByName(new.join(old.select(*key), key, "left_anti")), "candidates")

    extra = F.coalesce(F.nullif("extra_tokens", F.lit(0)), F.floor(F.col("budget_limit") * 0.5).cast("int"))
    count = F.size("signals.mentioned_files") + F.size("signals.inferred_files")
    rows = state.limits.drop("anchor_count").join(asked, "query_id").join(state.analysis.select("query_id", count.alias("anchor_count")), "query_id")
    limits = hold(rows.select("query_id", (F.col("budget_limit") + extra).cast("int").alias("budget_limit"), "budget_source", "anchor_count"), "limits")
    analysis = hold(state.analysis.join(asked.select("query_id"), "query_id", "left_semi"), "analysis")
    anchors = hold(state.anchors.join(asked.select("query_id"), "query_id", "left_semi"), "anchors")
    before = state.bundles.select("query_id", "bundle_id", (F.col("expansions") + 1).alias("expansions"))
    bundles = assemble(analysis, everything, limits, settings).join(before, "query_id")
    return Bundles(analysis, anchors, everything, limits, hold(bundles, "bundles"))
