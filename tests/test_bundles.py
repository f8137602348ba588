"""Scores, budgets, packing, bundles, expansion, rendering, events, manifests, the facade."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from packspark import api
from packspark.__main__ import answer, index
from packspark.operators import budget as B
from packspark.operators import budget_model as M
from packspark.operators import pack as P
from packspark.operators import rank as R
from packspark.plans import bundle as Bu
from packspark.plans import render
from packspark.settings import Settings
from packspark.sources import workspace as W
from packspark.streaming import events as E

ROW = "query_id long, tier_rank int, path string, start_line int, end_line int, content string, tier string, keyword_match double, path_mention double, import_proximity double, recency double"


def row(path, kw=0.0, pm=0.0, ip=0.0, rec=0.0, tier="grep", start=1, end=10, content="x" * 20, q=1):
    return (q, 4, path, start, end, content, tier, float(kw), float(pm), float(ip), float(rec))


def ranked(spark, *rows):
    return {r["path"]: r for r in R.rank(spark.createDataFrame(list(rows), ROW)).collect()}


def test_rank(spark):
    got = ranked(spark, row("a", 1, 1), row("b", 2), row("c", 0, 0, 0.7, 1.0, "import"), row("d", 0, 0.75, 0, 0, "inferred_anchor"), row("e", 0, 0, 0.5, 0, "symbol"))
    assert [got[k]["score"] for k in "abcde"] == [0.5, 0.4, 0.24, 0.225, 0.1]
    assert got["a"]["reason"] == "explicitly mentioned path, keyword match" and got["b"]["reason"] == "keyword match"
    assert got["c"]["reason"] == "import neighbor" and got["d"]["reason"] == "explicitly mentioned path, inferred anchor"
    assert got["e"]["reason"] == "symbol slice, near anchor in import graph"
    assert ranked(spark, row("a"))["a"]["reason"] == "candidate" and ranked(spark) == {}


def test_features(spark):
    times = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "path string, mtime double")
    anchors = spark.createDataFrame([(1, "a")], "query_id long, path string")
    got = {r["path"]: (r["recency"], r["path_mention"]) for r in R.with_features(spark.createDataFrame([row("a"), row("b"), row("c", pm=1.0)], ROW), times, anchors).collect()}
    assert got == {"a": (0.5, 0.5), "b": (1.0, 0.0), "c": (0.0, 1.0)}


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_budget_rules(spark):
    snap = lambda n: value(spark, B.snap(F.lit(n)))
    assert [snap(n) for n in (1, 2001, 7000, 20000)] == [2000, 3000, 8000, 15000]
    fit = lambda limit, must: value(spark, B.fit(F.lit(limit), F.lit(must)))
    assert [fit(8000, 100), fit(4000, 6001), fit(4000, 9001), fit(8000, 99_999)] == [8000, 5000, 8000, 15000]
    cap = lambda limit, anchors, tokens, low=1, high=4: value(spark, B.optional_cap(F.lit(limit), F.lit(anchors), F.lit(tokens), low, high))
    assert [cap(4000, 1, 10), cap(10000, 5, 50), cap(5000, 6, 60), cap(10000, 0, 0, 3, 3), cap(8000, 0, 0), cap(5999, 9, 99)] == [2, 4, 2, 3, 3, 2]


def plain_pack(items, limit, factor=1.5):
    """items: (must, score, seq, path, start, end, tokens)."""
    chosen, used = [], 0
    for must, _, _, path, start, end, tokens in sorted(items, key=lambda x: (not x[0], -x[1], x[2])):
        if any(p == path and not (end < a or start > b) for p, a, b in chosen):
            continue
        if (must and chosen and used + tokens > int(limit * factor)) or (not must and used + tokens > limit):
            continue
        chosen.append((path, start, end))
        used += tokens
    return chosen, used


def test_pack_against_plain(spark):
    rnd = random.Random(3)
    data, limits, want = [], [], {}
    for q in range(120):
        limit, items = rnd.choice([0, 10, 60, 150]), []
        for k in range(rnd.randint(0, 12)):
            start = rnd.randint(1, 30)
            seq = (4, rnd.choice("ab"), start, start + rnd.randint(0, 8))
            content = "y" * rnd.randint(0, 200) + f"{k:03d}"
            score, must = rnd.choice([0.1, 0.2, 0.2, 0.5]), rnd.random() < 0.4
            items.append((must, score, (*seq, content), seq[1], seq[2], seq[3], max(1, len(content) // 4)))
            data.append((q, *seq, content, score, "r", must))
        limits.append((q, limit))
        want[q] = plain_pack(items, limit)
    frame = spark.createDataFrame(data, "query_id long, tier_rank int, path string, start_line int, end_line int, content string, score double, reason string, is_must boolean")
    for parts in (1, 7):
        got = P.pack(frame.repartition(parts), spark.createDataFrame(limits, "query_id long, budget_limit int")).collect()
        assert {r["query_id"]: ([(c["path"], c["start_line"], c["end_line"]) for c in r["chunks"]], r["budget_used"]) for r in got} == want


def test_keep(spark):
    scored = R.rank(spark.createDataFrame([row(f"k{i}", kw=10.0 - i) for i in range(10)] + [row("m", pm=1.0), row("s", tier="symbol"), row("low", kw=0.1)], ROW))
    got = P.keep(scored, spark.createDataFrame([(1, 3)], "query_id long, cap int"), Settings()).filter("kept").collect()
    assert {r["path"] for r in got} == {"k0", "k1", "k2", "m", "s"}


FILLER = "\n".join(f"# padding line {i} of the module" for i in range(420))
REPO = {
    "src/auth/refresh.py": f"from src.auth import tokens\nimport src.auth.tokens\n\ndef refreshToken(user):\n    return tokens.issue(user)\n\ndef logout(user):\n    return None\n{FILLER}\n",
    "src/auth/tokens.py": "def issue(user):\n    return 'token'\n",
    **{f"src/noise/mod{i}.py": f"def noise{i}():\n    return {i}\n" + "\n".join(f"x{j} = {j}" for j in range(300)) + "\n" for i in range(5)},
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in REPO.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_text(text)
    return api.Engine(spark, Settings(workspace_root=str(root)))


def test_engine(engine):
    analysis = engine.analyze_query("Fix refreshToken in src/auth/refresh.py")
    assert analysis["intent"] == "debug" and analysis["signals"]["mentioned_files"] == ["src/auth/refresh.py"]
    got = engine.prepare_context("Fix refreshToken failing in src/auth/refresh.py after logout")
    bundle = got["bundle"]
    paths = [c["path"] for c in bundle["chunks"]]
    assert bundle["budget_limit"] == 8000 and bundle["budget_used"] <= 12000
    symbol = next(c for c in bundle["chunks"] if c["path"] == "src/auth/refresh.py")
    assert symbol["content"].startswith("def refreshToken") and symbol["end_line"] == 5 and "src/auth/tokens.py" in paths
    for a, b in itertools.combinations(bundle["chunks"], 2):
        assert a["path"] != b["path"] or a["end_line"] < b["start_line"] or a["start_line"] > b["end_line"]
    assert bundle["bundle_id"] in got["message"] and "**Anchors:** src/auth/refresh.py, refreshToken" in got["message"]
    assert got["message"].endswith("\n") and f"{bundle['budget_limit']:,}" in got["message"]
    assert engine.estimate_tokens(bundle_id=bundle["bundle_id"]) == {"tokens": bundle["budget_used"], "method": "chars/4"}
    assert engine.estimate_tokens("abcdefgh")["tokens"] == 2 and engine.estimate_bundle_tokens("none")["tokens"] == 0
    larger = engine.expand_context(bundle["bundle_id"], focus="src/auth/tokens.py", extra_tokens=500)
    assert larger["budget_limit"] == 8500 and larger["expansions"] == 1 and larger["bundle_id"] == bundle["bundle_id"]
    assert engine.expand_context(bundle["bundle_id"])["budget_limit"] == 12750
    with pytest.raises(KeyError):
        engine.expand_context("none")
    assert engine.analysis_for_bundle("none") is None and engine.analysis_for_bundle(bundle["bundle_id"])["intent"] == "debug"
    log = E.read_log(engine.spark, engine.settings.events).collect()
    assert [r["event"] for r in sorted(log, key=lambda r: r["timestamp"])] == ["analyze_query", "get_context_bundle", "expand_context", "expand_context"]
    assert {r["budget_source"] for r in log} == {None, "fallback_default"}


def test_explicit_budget_and_inference(engine):
    got = engine.get_context_bundle("where does the session logout happen", max_tokens=2000, intent="explain")
    assert got["budget_limit"] == 2000 and got["intent"] == "explain"
    inferred = engine.analysis_for_bundle(got["bundle_id"])["signals"]["inferred_files"]
    assert inferred == ["src/auth/refresh.py"]
    assert "Explore" in engine.context_prompt("  ")


def test_registry(spark, engine):
    engines = api.Engines(spark)
    engines.by_root[engine.settings.workspace_root] = engine
    assert engines.get(engine.settings.workspace_root) is engine
    known = next(iter(engine.held), None) or engine.get_context_bundle("explain the logout")["bundle_id"]
    assert engines.of_bundle(known) is engine and engines.expand_context("none") == {"error": "unknown bundle id"}
    assert answer(engines, {"tool": "estimate_tokens", "args": {"bundle_id": "none"}}) == {"error": "unknown bundle id"}
    assert answer(engines, {"tool": "analyze_query", "args": {"query": "explain this", "workspace_root": engine.settings.workspace_root}})["intent"] == "explain"
    assert "error" in answer(engines, {"tool": "sing"})


def test_manifest(spark, tmp_path):
    for path in ("src/alpha.py", "node_modules/x.js", "binary.bin", "pkg/__init__.py", "big.txt", "no_newline.MD", "build"):
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * 600_000 if path == "big.txt" else b"a\n\xff\nb")
    (tmp_path / "empty.py").write_text("")
    conf = Settings(workspace_root=str(tmp_path))
    files = W.scan(spark, conf)
    assert {r["path"]: r["content"] for r in files.collect()} == {"src/alpha.py": "a\n�\nb", "pkg/__init__.py": "a\n�\nb", "no_newline.MD": "a\n�\nb", "empty.py": ""}
    assert index(spark, str(tmp_path)) == 4
    stored = W.entries_of(W.load_manifest(spark, conf))
    assert {(r["rel_path"], r["line_count"]) for r in stored.collect()} == {("src/alpha.py", 3), ("pkg/__init__.py", 3), ("no_newline.MD", 3), ("empty.py", 0)}
    assert W.stale_entries(stored, files).isEmpty()
    (tmp_path / "src/alpha.py").write_text("changed")
    (tmp_path / "new.py").write_text("new")
    os.remove(tmp_path / "empty.py")
    now = W.scan(spark, conf)
    assert {r["rel_path"] for r in W.stale_entries(stored, now).collect()} == {"src/alpha.py", "empty.py"}
    assert ("new.py", "new") in {(r["rel_path"], r["reason"]) for r in W.stale_entries(stored, now, detect_new=True).collect()}
    assert W.current_manifest(spark, conf).count() == 4
    corpus = W.searchable(W.from_workspace(spark, conf), W.entries_of(W.load_manifest(spark, conf)))
    assert {r["path"] for r in corpus.files.collect()} == {"src/alpha.py", "pkg/__init__.py", "no_newline.MD", "new.py"}
    stats, again = W.repo_stats(now).first(), W.manifest_stats(W.entries_of(W.load_manifest(spark, conf))).first()
    assert stats["file_count"] == again["file_count"] == 4 and stats["loc_log"] == again["loc_log"]
    (tmp_path / ".packspark/manifest.json").rename(tmp_path / ".packspark/gone")
    assert W.load_manifest(spark, conf) is None


def test_state_is_stored(spark, tmp_path):
    corpus = W.from_table(spark.createDataFrame(list(REPO.items()), "path string, text string"), F.col("path"))
    ix = Bu.Index.build(corpus).store(f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "Fix refreshToken in src/auth/refresh.py"), (2, "noise3"), (3, "")], "query_id long, query string")
    Bu.prepare(asked, ix, state_path=f"file://{tmp_path}/one")
    state = Bu.open_state(spark, f"file://{tmp_path}/one")
    alone = Bu.prepare(asked, Bu.Index.build(corpus)).bundles
    shape = lambda df: sorted((r["query_id"], r["budget_used"], [c["path"] for c in r["chunks"]]) for r in df.collect())
    assert shape(state.bundles) == shape(alone) and len(shape(alone)) == 3
    more = Bu.expand(state, spark.createDataFrame([(2, None, 0)], "query_id long, focus string, extra_tokens int"), ix, state_path=f"file://{tmp_path}/two")
    assert more.bundles.select("query_id", "budget_limit", "expansions").collect()[0][:] == (2, 12000, 1)
    text = {r["query_id"]: r["message"] for r in render.markdown(state, "/w").collect()}
    assert "## Chunk 1: `" in text[1] and "**Anchors:**" in text[1] and "## Excluded" in text[3]


def test_model(spark, tmp_path):
    rows = spark.range(300).select("id", F.col("id").alias("query_id"), *[(F.col("id") % (i + 2)).cast("double").alias(f) for i, f in enumerate(M.FEATURES)])
    rows = rows.withColumn("budget", F.when(F.col("query_tokens") > 0, 12000).otherwise(3000))
    model = M.BudgetModel.train(rows, trees=5, depth=3)
    model.save(f"file://{tmp_path}/m")
    got = M.BudgetModel.load(spark, f"file://{tmp_path}/m").predict(rows)
    assert got.join(rows, "query_id").filter("predicted <> budget").count() == 0
    floors = model.predict(rows.withColumn("query_tokens", F.lit(60.0)).withColumn("budget", F.lit(0)), legacy_floors=True)
    assert floors.agg(F.min("predicted")).first()[0] >= 8000


def test_streams(spark, tmp_path):
    base = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:59:59")], "user long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("v", F.lit(1.5))
    base.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    done = E.run_to_table(E.tumbling(stream, "ts", ["user"], "1 hour", "1 minute", "v"), "windows_of_test", f"{tmp_path}/c1", "complete")
    assert {(r["user"], r["n"], r["total"]) for r in done.collect()} == {(1, 2, 3.0), (1, 1, 1.5), (2, 1, 1.5)}
    assert {(r["user"], r["n"]) for r in E.sessions(base, "ts", ["user"], "30 minutes", "1 minute").collect()} == {(1, 2), (1, 1), (2, 1)}
    closed = E.run_to_table(E.tumbling(stream, "ts", ["user"], "1 hour", "0 seconds", "v"), "closed_of_test", f"{tmp_path}/c2", "append")
    assert {(r["user"], r["n"]) for r in closed.collect()} == {(1, 2), (2, 1)}


def test_event_ids(spark):
    ids = [r[0] for r in spark.range(3).select(E.event_id()).collect()]
    assert len(set(ids)) == 3 and all(len(x) == 32 and int(x, 16) >= 0 for x in ids)
    E.append(spark.createDataFrame([(1,)], "a int"), "nofs://nowhere/x")  # lost without an error
