"""The library's queries by name, over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark import api
from packspark.functions import signals
from packspark.functions import text as T
from packspark.operators import anchors as A
from packspark.operators import budget as B
from packspark.operators import budget_model as M
from packspark.operators import grep as G
from packspark.operators import imports as I
from packspark.operators import pack as P
from packspark.operators import rank as R
from packspark.operators import symbols as S
from packspark.operators import vectors as V
from packspark.plans import bundle as Bu
from packspark.plans import bundle_sql, demo, oracles, render
from packspark.retrievers import build_retriever
from packspark.session import scratch, table
from packspark.settings import Settings
from packspark.sources import workspace as W
from packspark.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.SQL | bundle_sql.SQL
DEFAULTS = Settings()


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# -- text and query analysis --------------------------------------------------------------------


@query
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").cast("long").alias("tokens"))


@query
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.newline_count("text").cast("long").alias("newline_count"), F.size(T.split_lines("text")).cast("long").alias("n_lines"))


@query
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.evidence("text").alias("evidence"))


@query
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.keywords("text")).alias("pos", "kw"))
    return turns.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("ord"), "kw")


@query
def path_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.path_words("url"), " ").alias("words"))


@query
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    found = signals.analyze(turns.unionByName(demo.batch(spark).withColumn("query_id", -F.col("query_id"))))
    return found.select("query_id", "intent", "confidence", F.col("budget.recommended").cast("long").alias("recommended"), F.col("budget.min").cast("long").alias("least"), F.col("budget.max").cast("long").alias("most"))


@query
def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch and all conversation turns mention."""
    s = F.col("signals")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    found = signals.analyze(turns.unionByName(demo.batch(spark).withColumn("query_id", -F.col("query_id"))))
    return found.select("query_id", F.array_join(s["mentioned_files"], " ").alias("files"), F.array_join(s["mentioned_symbols"], " ").alias("symbols"), s["has_stack_trace"].alias("stack_trace"), s["has_error_token"].alias("error_token"), s["query_tokens"].cast("long").alias("tokens"))


# -- keyword retrieval --------------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, W.Corpus]:
    corpus, words = demo.documents_corpus(spark, sf_dir), G.query_keywords(demo.batch(spark))
    hits = G.file_hits(corpus.files, words)
    return hits.select("query_id", "path", "total", F.explode("nums").alias("line_no")).distinct(), words, corpus


@query
def grep_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)[0].select("query_id", "path", F.col("line_no").cast("long").alias("line_no"))


@query
def grep_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = G.islands(_hits(spark, sf_dir)[0], DEFAULTS.grep_context_lines)
    return ranges.select("query_id", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query
def grep_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, words, corpus = _hits(spark, sf_dir)
    found = G.chunks(G.islands(hits, DEFAULTS.grep_context_lines), corpus.files, words)
    return found.select("query_id", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content", "keyword_match")


@query
def grep_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.grep(demo.batch(spark), demo.documents_corpus(spark, sf_dir))
    return found.select("query_id", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "keyword_match")


@query
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = signals.analyze(demo.batch(spark)).select("query_id", F.explode("signals.mentioned_files").alias("mention"))
    files = demo.documents_corpus(spark, sf_dir).files.select("path").unionByName(demo.code_corpus(spark, sf_dir).files.select("path"))
    return A.resolve_mentions(mentions, files)


@query
def anchor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.grep(demo.batch(spark), demo.documents_corpus(spark, sf_dir))
    best = A.rank_anchors(demo.batch(spark), found, DEFAULTS.max_inferred_anchor_files, DEFAULTS.inferred_anchor_min_score)
    return best.select("query_id", "path", "score", "reason", F.col("place").cast("long").alias("place"))


# -- source structure ---------------------------------------------------------------------------


def _spans(spark: SparkSession, sf_dir: str, like: str) -> DataFrame:
    found = S.symbols(demo.code_corpus(spark, sf_dir).files).filter(F.col("path").like(like))
    return found.select("path", *[F.col(c).cast("long").alias(c) for c in ("ord", "start_line", "end_line")], "name")


@query
def symbol_spans_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "%.py")


@query
def symbol_spans_brace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "%.ts")


@query
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = spark.createDataFrame(list(demo.SYMBOL_MENTIONS), "query_id long, symbol string")
    found = S.lookup(S.symbols(demo.code_corpus(spark, sf_dir).files), mentions)
    return found.select("query_id", "path", "symbol", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.import_edges(demo.code_corpus(spark, sf_dir).files).select("src", F.col("ord").cast("long").alias("ord"), "dst")


@query
def import_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = demo.code_corpus(spark, sf_dir).files
    sources = files.select(F.when(F.startswith("path", F.lit("web/p")), 1).otherwise(2).cast("long").alias("query_id"), "path").filter("path LIKE 'web/p%' OR path LIKE 'geo/n%'")
    return I.hops(sources, I.import_edges(files), 2).select("query_id", "path", F.col("hop").cast("long").alias("hop"))


# -- scores and budgets -------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with made-up features, one for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "n_chars")
    i = F.col("doc_id")
    found = docs.select(
        (F.col("n_chars") % 7).alias("query_id"), (i % 5).cast("int").alias("tier_rank"), "path", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("x").alias("content"),
        F.element_at(F.array(*map(F.lit, ("grep", "symbol", "import", "inferred_anchor"))), (i % 4 + 1).cast("int")).alias("tier"),
        (i % 11).cast("double").alias("keyword_match"), F.element_at(F.array(*map(F.lit, (0.0, 0.0, 0.75, 1.0))), (i % 4 + 1).cast("int")).alias("path_mention"),
        (i % 2 * 0.7).alias("import_proximity"), F.lit(0.0).alias("recency"),
    )
    anchors = docs.filter(i % 3 == 0).select((F.col("n_chars") % 7).alias("query_id"), "path")
    return R.rank(R.with_features(found, docs.select("path", i.cast("double").alias("mtime")), anchors))


@query
def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "path", "path_mention", F.round("recency", 9).alias("recency"), "score", "reason")


@query
def optional_cap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidates are kept: must ones, and the best optional ones up to a cap."""
    scored = _scored(spark, sf_dir)
    caps = scored.select("query_id").distinct().withColumn("cap", (F.col("query_id") % 4 + 1).cast("int"))
    return P.keep(scored, caps, DEFAULTS).select("query_id", "path", "is_must", "kept")


@query
def budget_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, fitted limit and optional cap for inputs derived from orders."""
    o = table(spark, sf_dir, "orders")
    must = (F.col("o_totalprice") / 16).cast("int")
    snapped = B.snap((F.col("o_orderkey") % 17000).cast("int"))
    cap = B.optional_cap(snapped, (F.col("o_custkey") % 6).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    return o.select("o_orderkey", snapped.cast("long").alias("bucket"), B.fit(snapped, must).cast("long").alias("fitted"), cap.cast("long").alias("cap"))


@query
def must_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the batch over the generated files: tokens of symbol slices or heads."""
    files = demo.code_corpus(spark, sf_dir).files
    analysis = signals.analyze(demo.batch(spark))
    anchors = A.resolve_mentions(analysis.select("query_id", F.explode("signals.mentioned_files").alias("mention")), files)
    return B.must_tokens(anchors, analysis, files, S.symbols(files)).select("query_id", F.col("must_tokens").cast("long").alias("must_tokens"))


@query
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each customer, filled with its orders."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kept = o.select(
        F.col("o_custkey").alias("query_id"), F.lit(0).alias("tier_rank"), F.concat(F.lit("p"), (key % 3).cast("string")).alias("path"),
        (key % 50 + 1).cast("int").alias("start_line"), (key % 50 + 6).cast("int").alias("end_line"), F.concat(F.lpad(key.cast("string"), 12, "0"), F.repeat(F.lit("x"), (key % 400 + 40).cast("int"))).alias("content"),
        F.round(F.col("o_totalprice") / 500000, 4).alias("score"), F.lit("candidate").alias("reason"), (F.col("o_orderstatus") == "F").alias("is_must"),
    )
    limits = o.select(F.col("o_custkey").alias("query_id")).distinct().withColumn("budget_limit", (F.col("query_id") % 300 + 120).cast("int"))
    packed = P.pack(kept, limits)
    keys = F.transform("chunks", lambda c: F.substring(c["content"], 1, 12))
    return packed.select("query_id", F.col("budget_limit").cast("long").alias("budget_limit"), F.col("budget_used").cast("long").alias("budget_used"), F.array_join(keys, ",").alias("chosen"))


@query
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model features of every conversation turn, with the documents as repository."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    stats = W.repo_stats(demo.documents_corpus(spark, sf_dir).files)
    return M.features(signals.analyze(turns), stats).select("query_id", *[F.round(f, 6).alias(f) for f in M.FEATURES])


@query
def budget_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest that learns a made-up budget from the features of all turns, and its predictions."""
    path = scratch(spark, "features")
    event_features(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    model = M.BudgetModel.train(rows.withColumn("budget", (F.col("query_tokens") * 60 + F.col("intent_budget") / 4).cast("int")))
    return model.predict(rows, legacy_floors=True)


# -- repositories -------------------------------------------------------------------------------


@query
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = W.repo_stats(demo.documents_corpus(spark, sf_dir).files)
    return stats.select("file_count", "total_lines", F.round("loc_log", 9).alias("loc_log"))


@query
def manifest_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the documents, of which some then changed, went or came."""
    files = demo.documents_corpus(spark, sf_dir).files.withColumn("mtime_ns", (F.col("mtime") * 1_000_000_000).cast("long"))
    number = F.col("mtime").cast("long")
    before = W.manifest(files.filter(number % 13 != 0))
    after = files.filter(number % 11 != 0).withColumn("mtime_ns", F.col("mtime_ns") + F.when(number % 7 == 0, 1).otherwise(0)).withColumn("size", F.col("size") + F.when(number % 5 == 0, 1).otherwise(0))
    return W.stale_entries(before, after, detect_new=True)


@query
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page paths would be scanned, at a size of their HTML."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(F.array(*map(F.lit, ("src", "dist", "build", "lib"))), (F.col("page_id") % 4 + 1).cast("int")), F.lit("/f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".PY", ".bin", ".md", "", ".ts"))), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"), (F.length("html") * 90).alias("size"))
    return pages.select("page_id", W.scannable(F.col("path"), F.col("size"), DEFAULTS).alias("scanned"))


@query
def manifest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of most documents, stored and loaded again, and the corpus that can be searched by it."""
    conf = Settings(workspace_root=scratch(spark, "workspace"))
    corpus = demo.documents_corpus(spark, sf_dir)
    files = corpus.files.withColumn("mtime_ns", (F.col("mtime") * 1_000_000_000).cast("long"))
    W.save_manifest(W.manifest(files.filter(F.col("mtime").cast("long") % 13 != 0)), conf)
    entries = W.entries_of(W.load_manifest(spark, conf))
    found = W.searchable(corpus, entries).files.select("path", F.size("lines").alias("n"))
    return entries.join(found, F.col("rel_path") == F.col("path")).select("path", "mtime_ns", "size", F.col("line_count").cast("long").alias("line_count"), F.col("n").cast("long").alias("n_lines"))


# -- vectors and merging ------------------------------------------------------------------------


@query
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.line_windows(demo.documents_corpus(spark, sf_dir).files)
    return found.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.length("content").cast("long").alias("chars"))


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors next to every fiftieth one, among all."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = V.top_similar(asked, e.select("vec_id", F.col("embedding").alias("vector")), ["vec_id"], 5)
    return near.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query
def merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of orders for each customer, merged."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 4).cast("string")).alias("path"), (F.col("o_orderkey") % 9).alias("start_line"), (F.col("o_orderkey") % 9).alias("end_line"), "o_orderkey", "o_totalprice")
    merged = V.merge_hits(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), 6, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return merged.select("query_id", F.col("merged_rank").cast("long").alias("merged_rank"), "o_orderkey")


def _letters(df: DataFrame, text: str) -> DataFrame:
    """A made-up encoder: how often some letters stand in a text."""
    count = lambda c: (F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("double")
    return df.withColumn("vector", F.array(*[count(c) for c in "aeinot"]))


@query
def composite_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits, then vector hits over the windows of the first files, by the plug-in retrievers."""
    found = build_retriever(Settings(enable_embedding_retriever=True), _letters).search(demo.batch(spark), demo.documents_corpus(spark, sf_dir), 20)
    return found.select("query_id", "tier", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.round("keyword_match", 6).alias("keyword_match"))


# -- bundles ------------------------------------------------------------------------------------


def _state(spark: SparkSession, sf_dir: str) -> tuple[Bu.Bundles, Bu.Index]:
    docs, code = demo.documents_corpus(spark, sf_dir).files, demo.code_corpus(spark, sf_dir).files
    index = Bu.Index.build(W.Corpus(docs.unionByName(code))).store(scratch(spark, "index"))
    return Bu.prepare(demo.batch(spark), index, state_path=scratch(spark, "state")), index


@query
def bundle_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context bundles of the batch over documents and generated sources, a row a chunk."""
    return render.chunk_rows(_state(spark, sf_dir)[0].bundles)


@query
def expand_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles after one expansion with a focus file and one without."""
    state, index = _state(spark, sf_dir)
    asked = spark.createDataFrame([(1, "src3/doc13.md", None), (8, None, 500)], "query_id long, focus string, extra_tokens int")
    return render.chunk_rows(Bu.expand(state, asked, index, state_path=scratch(spark, "expanded")).bundles)


@query
def render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.markdown(_state(spark, sf_dir)[0], "/workspace")


@query
def bundle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a batch leaves, without their time."""
    state, _ = _state(spark, sf_dir)
    events = E.analysis_events(state.analysis).unionByName(E.bundle_events(state))
    return events.drop("timestamp").select("*", "features.*").drop("features")


@query
def engine_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What single requests to an engine answer, as text."""
    corpus = W.Corpus(demo.documents_corpus(spark, sf_dir).files.unionByName(demo.code_corpus(spark, sf_dir).files))
    engines = api.Engines(spark)
    root = scratch(spark, "workspace")
    engine = engines.by_root[root] = api.Engine(spark, Settings(workspace_root=root), corpus, log=False)
    said = [("analyze", i, engine.analyze_query(q)["intent"]) for i, q in demo.BATCH[:4]]
    said += [("tokens", i, str(engines.estimate_tokens(q)["tokens"])) for i, q in demo.BATCH[:4]]
    shape = lambda b: f"{b['budget_used']}/{b['budget_limit']}/{len(b['chunks'])}/{b['expansions']}"
    first = engines.get(root).get_context_bundle(demo.BATCH[0][1])
    said += [("bundle", 1, shape(first)), ("files", 1, " ".join(engine.analysis_for_bundle(first["bundle_id"])["signals"]["mentioned_files"]))]
    said += [("estimate", 1, str(engines.estimate_tokens(bundle_id=first["bundle_id"])["tokens"])), ("owner", 1, str(engines.of_bundle(first["bundle_id"]) is engine).lower())]
    said += [("expand", 1, shape(engines.expand_context(first["bundle_id"], focus="src3/doc13.md"))), ("unknown", 1, engines.expand_context("none")["error"])]
    return spark.createDataFrame(said, "request string, query_id long, answer string")


# -- streams ------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run the events through a stream to its end, and read what it has written."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/event[s].parquet")
    out = scratch(spark, name)
    sink = lambda df, _: df.write.mode("overwrite").parquet(f"{out}/result")
    run = shape(stream).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/result")


@query
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _streamed(spark, sf_dir, lambda s: E.tumbling(s, "ts", ["event_type"], "1 hour", "10 minutes", "value"), "windows")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _streamed(spark, sf_dir, lambda s: E.sessions(s, "ts", ["user_id"], "30 minutes", "10 minutes"), "sessions")
    return done.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")
