"""The pipeline, each stage against a plain Python version on what its predecessor kept."""

import collections
import math
import re

import regex
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_lines

import corpus_pipeline
from packspark.llm import quality_rules

SF = "/root/testdata/sf0.001"
S = r" \t\n\x0b\f\r"


def plain_statistics(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines, n, chars = t.split("\n"), len(words), len(t)
    per = lambda a, b: a / b if b else 0.0
    count = lambda p: len(regex.findall(p, t))
    return {
        "words": float(n), "word_length": per(chars, n), "distinct_words": per(len(set(words)), n), "upper": per(count(r"\p{Lu}"), chars), "digits": per(count(r"\p{Nd}"), chars),
        "stops": per(count("[.,;:?]"), n), "marks": per(count(rf"[^\p{{L}}\p{{M}}\p{{Nd}}{S}.,;:?'\"()-]"), n), "bangs": per(count("!"), n),
        "loose_marks": per(count(rf"(?<=[{S}])[^\p{{L}}\p{{Nd}}{S}]+(?=[{S}])"), n), "words_a_line": per(n, len(lines)), "distinct_lines": per(len(set(lines)), len(lines)),
    }


def plain_score(model, t):
    if model.constant is not None:
        return model.constant
    x = plain_statistics(t)
    hit = lambda rule: all(x[quality_rules.NAMES[f]] > c if up else x[quality_rules.NAMES[f]] <= c for f, c, up in rule)
    return 1 / (1 + math.exp(-(model.intercept + sum(w for rule, w in model.rules if hit(rule)))))


def plain_targets(size):
    order = sorted((s for s in size if s is not None), key=str.encode) + [s for s in size if s is None]
    weight, left, target = {s: i % 3 + 1 for i, s in enumerate(order)}, float(sum(size.values())), {}
    while len(target) < len(order):
        open_ = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else share[s]
        left -= sum(target[s] for s in full)
    return target


def test_stages(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "source mix"]
    model = quality_rules.fit(docs.select("doc_id", "text"), labels)
    before = docs.collect()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        now = docs.collect()
        text = {r["doc_id"]: r["text"] for r in now}
        if k == 0:
            assert set(text) == {r["doc_id"] for r in before if plain_score(model, r["text"]) >= 0.3} and len(now) < len(before)
        elif k == 1:
            want = {d: v[3] for (d, t), v in plain_lines([(r["doc_id"], r["text"]) for r in before]).items()}
            assert text == {d: t for d, t in want.items() if t or not next(r["text"] for r in before if r["doc_id"] == d)}
            assert all(r["n_chars"] == len(r["text"]) for r in now)
        elif k == 2:
            found = plain_components([(r["doc_id"], r["text"]) for r in before])
            assert set(text) == {d for d, _, _, kept in found if kept}
        elif k == 3:
            split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w]
            items = [split(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            runs = {r["doc_id"]: " ".join(split(r["text"])) for r in before}
            dirty = {d for d, t in runs.items() if any(f" {' '.join(i)} " in f" {t} " for i in items)}
            assert set(text) == {r["doc_id"] for r in before} - dirty
        else:
            count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            size, taken, times = collections.Counter(), collections.Counter(), collections.Counter(r["doc_id"] for r in now)
            for r in before:
                size[r["source"]] += count(r["text"])
            for r in now:
                taken[r["source"]] += count(r["text"])
            assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in before}
            for s, target in plain_targets(size).items():
                assert abs(taken[s] - target) <= max(count(r["text"]) for r in before if r["source"] == s) / 2 + 1
        before = now


def test_stages_bear_odd_documents(spark, tmp_path):
    """Nulls, repeats, extra columns; an empty table comes through all stages."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", "en", "src1", 0), (None, "no id but some clean words, in a line. And one more.", "en", "src1", 5)], base.schema)
    docs = base.unionByName(base.filter("doc_id < 5")).unionByName(extra).withColumns({"score": F.lit("mine"), "size": F.lit(1), "target": F.lit(2.0), "n_removed": F.lit("x"), "fp": F.lit(0)})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {"doc_id", "text", "lang", "source", "n_chars", "score", "size", "target", "n_removed", "fp"} <= set(docs.columns)
        assert {r["score"] for r in docs.collect()} == {"mine"}
        if k == 2:
            assert docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    docs = base.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
