"""Text units and query analysis, with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from packspark import settings as S
from packspark.functions import signals
from packspark.functions import text as T


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1).select(column.alias("r")).collect()
    return [r["r"] for r in rows]


def test_lines_as_python_has_them(spark):
    rnd = random.Random(1)
    chars = ["a", "b", " ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", " ", " ", "é"]
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 12))) for _ in range(400)] + ["", "\n", "a\n", "\r\n\r\n"]
    assert one(spark, T.split_lines("x"), *texts) == [t.splitlines() for t in texts]
    assert one(spark, T.newline_count("x"), *texts) == [t.count("\n") + 1 if t else 0 for t in texts]


def test_tokens(spark):
    assert one(spark, T.tokens("x"), "", "a", "abcd", "a" * 9, "é" * 8, None) == [0, 1, 1, 2, 2, None]


def test_keywords(spark):
    got = one(spark, T.keywords("x"), "Why does refreshToken fail after logout?", "fixToken FIXTOKEN x1 ab", "", "the add using")
    assert got == [["refreshToken", "refresh", "Token", "fail", "logout"], ["fixToken", "fix", "Token"], [], []]
    extra = spark.createDataFrame([("look at userId", ["userId oneTwo", "b"])], "x string, e array<string>")
    assert extra.select(T.keywords("x", F.col("e"))).first()[0] == ["look", "userId", "user", "oneTwo", "one", "Two"]


def test_path_words(spark):
    assert one(spark, T.path_words("x"), "src/auth/refresh_token.py", "a/B1.test.ts", ".github/x.md", "Makefile", "src/auth/auth.py") == [["src", "auth", "refresh_token"], ["b1", "test"], ["github"], ["makefile"], ["src", "auth"]]


def test_evidence(spark):
    text = "  a \n\n\t b\x1f \n" + "c" * 300
    want = " ".join(x.strip() for x in text.splitlines() if x.strip())
    assert one(spark, T.evidence("x"), text, "", "x\n y ") == [want[:217].rstrip() + "...", "", "x y"]


def test_clamp_and_span(spark):
    assert spark.range(1).select(T.clamp(F.lit(9), 2, 5), T.clamp(F.lit(1), 2, 5), T.line_span(F.lit(5), F.lit(3)), T.line_span(F.lit(3), F.lit(5))).first()[:] == (5, 2, 0, 3)


def analyze(spark, query, **more):
    row = {"query_id": 1, "query": query} | more
    return signals.analyze(spark.createDataFrame([tuple(row.values())], ", ".join(["query_id long", "query string", *[f"{k} string" for k in more]]))).first()


@pytest.mark.parametrize(
    ("query", "intent", "confidence"),
    [
        ("Fix the TypeError thrown in auth/refresh.py", "debug", 0.99),
        ("the quick brown fox jumps over stuff", "implement", 0.3),
        ("Explain how does the cache work", "explain", 0.99),
        ("Rename and simplify the parser", "refactor", 0.99),
        ("Audit this pull request", "review", 0.99),
        ("Add a new feature flag", "implement", 0.99),
        ("express", "review", 0.99),
        ("refactor explain", "refactor", 0.5),
        (None, "implement", 0.3),
        ("", "implement", 0.3),
    ],
)
def test_intents(spark, query, intent, confidence):
    got = analyze(spark, query)
    assert (got["intent"], got["confidence"]) == (intent, confidence)
    assert tuple(got["budget"])[:3] == S.INTENT_BUDGETS[intent]


def test_override(spark):
    got = analyze(spark, "Fix the bug", intent="review")
    assert (got["intent"], got["budget"]["recommended"], got["confidence"]) == ("review", 5000, 0.99)
    assert analyze(spark, "Fix the bug", intent="dance")["intent"] == "debug"


def test_signals(spark):
    got = analyze(spark, "In `refreshToken` of src\\auth/refresh.py and refresh_token.py, again src/auth/refresh.py; `a b` `x.py` ` ok ` camelCase UPPER_case é_a1")["signals"]
    assert got["mentioned_files"] == ["src/auth/refresh.py", "refresh_token.py", "x.py"]
    assert got["mentioned_symbols"][:1] == ["refreshToken"] and {"ok", "camelCase", "refresh_token"} <= set(got["mentioned_symbols"])
    assert "a b" not in got["mentioned_symbols"] and "x.py" not in got["mentioned_symbols"]
    error = analyze(spark, "ValueError: boom")["signals"]
    assert error["has_stack_trace"] and error["has_error_token"]
    quiet = analyze(spark, "terrors are errorless")["signals"]
    assert not quiet["has_stack_trace"] and not quiet["has_error_token"]
    assert analyze(spark, "at src/a.ts:12")["signals"]["has_stack_trace"]


def test_settings(tmp_path, monkeypatch):
    assert S.load(str(tmp_path)) == S.Settings(workspace_root=str(tmp_path))
    (tmp_path / S.SETTINGS_FILE).write_text('[packspark]\ndefault_max_tokens = "5000"\nmin_chunk_score = 1\nenable_anchor_inference = "false"\nignore_globs = ["x"]\nevents_path = "no"\n[packspark.intent_budgets]\ndebug = [1, 2, 3]\n')
    got = S.load(str(tmp_path))
    assert (got.default_max_tokens, got.min_chunk_score, got.enable_anchor_inference, got.ignore_globs, got.events_path) == (5000, 1.0, True, ("x",), None)
    assert got.intent_budgets["debug"] == (1, 2, 3) and got.intent_budgets["review"] == (5000, 2500, 8000)
    (tmp_path / S.SETTINGS_FILE).write_text("not = [toml")
    assert S.load(str(tmp_path)).default_max_tokens == 8000
    monkeypatch.setenv(S.WORKSPACE_VARIABLE, str(tmp_path))
    assert S.resolve_workspace() == str(tmp_path) and S.resolve_workspace("/") == "/"
    assert got.events.endswith(".packspark/events.jsonl") and got.manifest_path.endswith("manifest.json")
