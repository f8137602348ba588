"""Keyword and vector retrieval, symbols, imports, anchors, on small sources."""

import pytest
from pyspark.sql import functions as F

from packspark.operators import anchors as A
from packspark.operators import grep as G
from packspark.operators import imports as I
from packspark.operators import symbols as S
from packspark.operators import vectors as V
from packspark.retrievers import CompositeRetriever, EmbeddingRetriever, GrepRetriever, Retriever, build_retriever
from packspark.settings import Settings
from packspark.sources.workspace import from_table


def corpus(spark, files):
    return from_table(spark.createDataFrame(list(files.items()), "path string, text string"), F.col("path"))


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "query_id long, query string")


def test_islands(spark):
    hits = spark.createDataFrame([(1, "a", n, 100) for n in (5, 22, 40, 99)] + [(2, "a", 1, 3)], "query_id long, path string, line_no int, total int")
    got = {(r["query_id"], r["start_line"], r["end_line"]) for r in G.islands(hits, 8).collect()}
    assert got == {(1, 1, 30), (1, 32, 48), (1, 91, 100), (2, 1, 3)}


def test_grep(spark):
    lines = ["x"] * 30
    lines[3], lines[4], lines[25] = "def refreshtoken():", "TOKEN again", "only Logout"
    c = corpus(spark, {"src/a.py": "\n".join(lines), "src/b.md": "nothing here", "src/c.py": "refreshToken logout", "empty.py": ""})
    rows = G.grep(ask(spark, "refreshToken after logout", "", "zebra"), c).orderBy("query_id", F.desc("keyword_match"), "path").collect()
    assert [(r["query_id"], r["path"], r["start_line"], r["end_line"], r["keyword_match"]) for r in rows] == [(1, "src/c.py", 1, 1, 4.0), (1, "src/a.py", 1, 13, 3.0), (1, "src/a.py", 18, 30, 1.0)]
    assert rows[0]["content"] == "refreshToken logout"
    assert G.grep(ask(spark, "refreshToken after logout"), c, limit=1).count() == 1
    strict = G.grep(ask(spark, "refreshToken after logout"), c, Settings(case_sensitive=True)).collect()
    assert {(r["path"], r["keyword_match"]) for r in strict} == {("src/a.py", 1.0), ("src/c.py", 4.0)}


def test_grep_batch_equals_single_runs(spark):
    c = corpus(spark, {f"d/f{i}.txt": f"alpha {i}\nbeta\n{'gamma' if i % 2 else 'delta'}" for i in range(20)})
    texts = ["alpha gamma", "delta", "beta and nothing"]
    whole = {(r["query_id"], r["path"], r["start_line"], r["keyword_match"]) for r in G.grep(ask(spark, *texts), c).collect()}
    single = {(i, r["path"], r["start_line"], r["keyword_match"]) for i, t in enumerate(texts, 1) for r in G.grep(ask(spark, t), c).collect()}
    assert whole == single


def test_keyword_blocks(spark, monkeypatch):
    c = corpus(spark, {"a.md": "one\ntwo\nthree\nfour"})
    words = G.query_keywords(ask(spark, "one two three four"))
    want = G.line_hits(c.lines, words).count()
    monkeypatch.setattr(G, "KEYWORD_BLOCK", 1)
    assert G.line_hits(c.lines, words).count() == want == 4


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [(1, 1)]), (24, [(1, 24)]), (25, [(1, 24), (13, 25)]), (48, [(1, 24), (13, 36), (25, 48)])])
def test_windows(spark, n, want):
    files = spark.createDataFrame([("p", [f"l{i}" for i in range(n)])], "path string, lines array<string>")
    assert sorted((r["start_line"], r["end_line"]) for r in V.line_windows(files).collect()) == want


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([2.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.7071067811865475), 0.0, -1.0]
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b"))).collect()


def test_vector_search_and_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "vec_id long, vector array<double>")
    asked = spark.createDataFrame([(q, [float(q), 0.0]) for q in range(3)], "query_id long, vector array<double>")
    want = V.top_similar(asked, vectors, ["vec_id"], 3).orderBy("query_id", "vec_id").collect()
    monkeypatch.setattr(V, "VECTOR_BLOCK", 1)
    assert V.top_similar(asked, vectors, ["vec_id"], 3).orderBy("query_id", "vec_id").collect() == want
    assert [r["vec_id"] for r in want] == [0, 1, 2, 5, 6, 7, 5, 6, 7]
    assert V.top_similar(asked, vectors, ["vec_id"], 0).count() == 0


def test_merge(spark):
    hit = lambda *rows: spark.createDataFrame(list(rows), "query_id long, path string, start_line int, end_line int, w double")
    primary = hit((1, "a", 1, 2, 9.0), (1, "a", 1, 2, 8.0), (1, "b", 1, 2, 7.0))
    second = hit((1, "b", 1, 2, 5.0), (1, "c", 1, 2, 4.0), (1, "d", 1, 2, 3.0), (2, "a", 1, 2, 1.0))
    got = V.merge_hits(primary, second, 4, [F.desc("w")]).orderBy("query_id", "merged_rank").collect()
    assert [(r["query_id"], r["path"], r["w"]) for r in got] == [(1, "a", 9.0), (1, "a", 8.0), (1, "b", 7.0), (1, "c", 4.0), (2, "a", 1.0)]


def test_retrievers(spark):
    c = corpus(spark, {"a.md": "alpha", "b.md": "beta"})
    encode = lambda df, col: df.withColumn("vector", F.array(F.length(col).cast("double"), F.lit(1.0)))
    assert isinstance(build_retriever(Settings()), Retriever) and isinstance(GrepRetriever(), Retriever)
    assert CompositeRetriever().search(ask(spark, "alpha"), c, 5).count() == 1
    both = CompositeRetriever(Settings(enable_embedding_retriever=True), encode).search(ask(spark, "alpha"), c, 5).collect()
    assert sorted(r["tier"] for r in both) == ["embedding", "grep"]
    assert EmbeddingRetriever().search(ask(spark, "alpha"), c, 5).count() == 0


PYTHON = "import os\n\n@a\n@b\nasync def outer(x):\n    def inner():\n        pass\n    return inner\n\nclass Shape:\n    def area(self):\n        return 1\n"
SCRIPT = "export async function load(a) {\n  if (a) {\n  }\n}\nconst go = async (x) => x;\nclass Open {\n"


def test_symbols(spark):
    c = corpus(spark, {"a.py": PYTHON, "b.ts": SCRIPT, "bad.py": "def x(:\n", "c.PY": "function f() {\n}"})
    got = {(r["path"], r["ord"]): (r["name"], r["start_line"], r["end_line"]) for r in S.symbols(c.files).collect()}
    assert [got["a.py", k] for k in range(4)] == [("outer", 3, 8), ("Shape", 10, 12), ("inner", 6, 7), ("area", 11, 12)]
    assert [got["b.ts", k] for k in range(4)] == [("load", 1, 4), ("if", 2, 3), ("go", 5, 6), ("Open", 6, 6)]
    assert got["c.PY", 0] == ("f", 1, 2) and ("bad.py", 0) not in got


def test_lookup_prefers_exact_case(spark):
    table = spark.createDataFrame([("p", 0, "foo", 1, 2), ("p", 1, "Foo", 3, 4), ("q", 0, "FOO", 5, 6), ("q", 1, "fOO", 7, 8)], S.SYMBOL_DDL)
    got = {(r["path"], r["name"], r["start_line"]) for r in S.lookup(table, spark.createDataFrame([(1, "Foo")], "query_id long, symbol string")).collect()}
    assert got == {("p", "Foo", 3), ("q", "FOO", 5)}


def test_imports(spark):
    files = {
        "pkg/__init__.py": "x = 1", "pkg/a.py": "import pkg.b\nfrom . import c\nfrom .. import top\nfrom .sub.d import e\nimport os\nimport pkg.a\nfrom pkg.b import z",
        "pkg/b.py": "y = 1", "pkg/sub/d.py": "from ..b import q", "__init__.py": "t = 1",
        "web/m.ts": "import { A } from './n';\nimport './o.js';\nconst k = require('../web/lib');\nimport x from 'react';\nexport { y } from './p';\nimport s from './a.service';",
        "web/n.tsx": "n = 1", "web/o.js": "o = 1", "web/lib/index.ts": "l = 1", "web/p.ts": "p = 1", "web/a.ts": "a = 1",
    }
    edges = I.import_edges(corpus(spark, files).files)
    got = [(r["src"], r["dst"]) for r in edges.orderBy("src", "ord").collect()]
    assert got == [
        ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "__init__.py"), ("pkg/a.py", "pkg/sub/d.py"), ("pkg/sub/d.py", "pkg/b.py"),
        ("web/m.ts", "web/n.tsx"), ("web/m.ts", "web/o.js"), ("web/m.ts", "web/lib/index.ts"), ("web/m.ts", "web/a.ts"),
    ]
    start = spark.createDataFrame([(1, "pkg/a.py"), (2, "pkg/sub/d.py")], "query_id long, path string")
    hops = {(r["query_id"], r["path"], r["hop"]) for r in I.hops(start, edges, 3).collect()}
    assert hops == {(1, "pkg/b.py", 1), (1, "pkg/__init__.py", 1), (1, "__init__.py", 1), (1, "pkg/sub/d.py", 1), (2, "pkg/b.py", 1)}


def test_mentions(spark):
    files = spark.createDataFrame([("src/auth/refresh.py",), ("lib/refresh.py",), ("x/prefresh.py",), (".github/w.md",)], "path string")
    resolve = lambda m, **k: {r["path"] for r in A.resolve_mentions(spark.createDataFrame([(1, m)], "query_id long, mention string"), files, **k).collect()}
    assert resolve("auth/refresh.py") == {"src/auth/refresh.py", "lib/refresh.py"}
    assert resolve("refresh.py") == {"src/auth/refresh.py", "lib/refresh.py", "x/prefresh.py"}
    assert resolve("..\\.github\\w.md") == {".github/w.md"}
    assert len(resolve(".")) == 4 and resolve(".", empty_matches_all=False) == set()


def test_anchor_rank(spark):
    found = spark.createDataFrame(
        [(1, 4, "src/auth/tokens.py", 1, 5, "tok", 1.0), (1, 4, "src/misc.py", 1, 5, "line\n\n two", 2.0), (1, 4, "src/misc.py", 9, 12, "other", 2.0), (1, 4, "z.py", 1, 2, "", 0.0)],
        "query_id long, tier_rank int, path string, start_line int, end_line int, content string, keyword_match double",
    )
    got = A.rank_anchors(ask(spark, "why do auth tokens expire"), found, 3, 1.0).orderBy("place").collect()
    assert [(r["path"], r["score"]) for r in got] == [("src/auth/tokens.py", 4.25), ("src/misc.py", 2.5)]
    assert got[0]["reason"] == "query keyword matches, path terms match query" and got[1]["evidence"] == "line two"
    assert A.rank_anchors(ask(spark, "why do auth tokens expire"), found, 1, 1.0).count() == 1
