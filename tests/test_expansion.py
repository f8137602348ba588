"""Expansions whose focus is a second-hop neighbour, and vector search among equal vectors."""

import pytest
from pyspark.sql import functions as F

from packspark.operators import grep as G
from packspark.operators import vectors as V
from packspark.plans import bundle as Bu
from packspark.sources import workspace as W


@pytest.mark.parametrize("parts", [1, 5])
def test_a_focus_file_stays_one(spark, parts):
    files = {"m/a.py": "import m.b\n\ndef start():\n    return 1\n", "m/b.py": "import m.c\n", "m/c.py": "value = 7\nother = 8\n"}
    corpus = W.from_table(spark.createDataFrame(list(files.items()), "path string, text string").repartition(parts), F.col("path"))
    index = Bu.Index.build(corpus)
    state = Bu.prepare(spark.createDataFrame([(1, "Explain m/a.py")], "query_id long, query string"), index)
    more = Bu.expand(state, spark.createDataFrame([(1, "m/c.py", None)], "query_id long, focus string, extra_tokens int"), index)
    rows = more.candidates.filter("path = 'm/c.py'").collect()
    assert [(r["tier"], r["path_mention"], r["start_line"], r["end_line"]) for r in rows] == [("anchor", 1.0, 1, 2)]
    assert "m/c.py" in {c["path"] for c in more.bundles.first()["chunks"]}


def test_equal_vectors_tie_by_key(spark):
    rows = spark.createDataFrame([(f"k{i % 7}{i:04d}", i, [1.0, 0.0] if i % 3 else [0.0, 0.0]) for i in range(900)] + [("z", 1, None)], "path string, at int, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<float>")
    got = sorted((r["query_id"], r["path"], r["similarity"]) for r in V.top_similar(asked, rows, ["path", "at"], 4).collect())
    paths = sorted((f"k{i % 7}{i:04d}", i % 3 > 0) for i in range(900))
    assert got == [(1, p, 1.0) for p, x in paths if x][:4] + [(2, p, 0.0) for p, _ in paths][:4]
    with pytest.raises(Exception, match="unequal"):
        V.top_similar(asked, spark.createDataFrame([("a", 1, [1.0])], rows.schema), ["path", "at"], 4).collect()


def test_file_hits_are_line_hits(spark, monkeypatch):
    texts = {f"f{i}": "\n".join(f"Alpha{k} beta" if (i * k) % 3 else "gamma ALPHA" for k in range(i)) + "\r\nlast" for i in range(9)}
    corpus = W.from_table(spark.createDataFrame(list(texts.items()), "path string, text string"), F.col("path"))
    words = G.query_keywords(spark.createDataFrame([(1, "alpha gamma"), (2, "Beta last delta"), (3, "")], "query_id long, query string"))
    want = {tuple(r) for r in G.line_hits(corpus.lines, words).select("query_id", "path", "line_no").collect()}
    for block in (2_000, 1):
        monkeypatch.setattr(G, "KEYWORD_BLOCK", block)
        got = G.file_hits(corpus.files, words)
        assert {tuple(r) for r in got.select("query_id", "path", F.explode("nums")).collect()} == want
    both = G.chunks(G.islands(G.line_hits(corpus.lines, words), 1), corpus.files, words).select("query_id", "path", "start_line", "end_line", "keyword_match")
    assert {tuple(r) for r in G.hit_ranges(got, 1).collect()} == {tuple(r) for r in both.collect()}
