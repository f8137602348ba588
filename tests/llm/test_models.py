"""Classifiers by held-out accuracy, the mix by its targets, decontamination by planted items."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from packspark.llm import decontam, mixing, quality_rules, toxicity
from packspark.llm.common import fold

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, source string, size string, score int"


def docs(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def held_out(scored, labels, label):
    rows = scored.join(labels, "doc_id").select("score", label).collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_held_out(spark):
    labels = docs(spark, "labels")
    model = toxicity.fit(docs(spark), labels.filter(fold("doc_id", 3) != 1))
    score, y = held_out(toxicity.with_score(docs(spark).filter(fold("doc_id", 3) == 1), model), labels, "toxic")
    hit = score >= 0.7
    assert auc(score, y) > 0.97
    assert hit[y == 1].mean() > 0.75 and (~hit)[y == 0].mean() > 0.98


def test_quality_held_out(spark):
    labels = docs(spark, "labels")
    model = quality_rules.fit(docs(spark), labels.filter(fold("doc_id", 5) != 0))
    scored = quality_rules.with_score(docs(spark).filter(fold("doc_id", 5) == 0), model)
    assert not re.search("Python|Arrow", scored._jdf.queryExecution().executedPlan().toString())
    score, y = held_out(scored, labels, "quality")
    good = score >= 0.3
    assert auc(score, y) > 0.98
    assert good[y == 1].mean() > 0.99 and (~good)[y == 0].mean() > 0.9
    assert all(0 < abs(w) for _, w in model.rules) and model.describe()


@pytest.mark.parametrize("module", [toxicity, quality_rules])
def test_classifiers_without_labels(spark, module):
    label = "toxic" if module is toxicity else "quality"
    few = spark.createDataFrame([(1, None, "a", "x", 3), (2, "", None, "x", 3), (None, "some text", "a", "x", 3), (2, "", None, "x", 3)], DOCS)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    for labels, want in ((none, 0.5), (spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], none.schema), 1.0)):
        model = module.fit(few, labels, label)
        got = module.with_score(few, model).collect()
        assert [r["score"] for r in got] == [want] * 4 and got[0]["size"] == "x"
    assert module.with_score(few.limit(0), module.fit(few.limit(0), none, label)).count() == 0


def test_scores_of_empty_and_long_texts(spark):
    labels = docs(spark, "labels")
    data = spark.createDataFrame([(1, None, "a", "", 0), (2, "", "a", "", 0), (3, "idiot moron scum trash loser clown " * 20_000, "a", "", 0)], DOCS)
    tox = [r["score"] for r in toxicity.with_score(data, toxicity.fit(docs(spark), labels)).orderBy("doc_id").collect()]
    assert tox[0] == tox[1] < 0.5 and all(0 <= s <= 1 for s in tox)
    good = [r["score"] for r in quality_rules.with_score(data, quality_rules.fit(docs(spark), labels)).orderBy("doc_id").collect()]
    assert good[0] == good[1] and all(0 <= s <= 1 for s in good)


def test_rules_hold_as_columns(spark):
    """The compiled expression gives what the rules give on arrays."""
    rnd = np.random.default_rng(3)
    x = rnd.random((400, len(quality_rules.NAMES)))
    y = ((x[:, 1] > 0.4) & (x[:, 2] <= 0.7)).astype(float)
    model = quality_rules.fit_arrays(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in quality_rules.NAMES))
    got = [r[0] for r in frame.select(quality_rules.score_column(model, {n: F.col(n) for n in quality_rules.NAMES})).collect()]
    want = 1 / (1 + np.exp(-(model.intercept + sum(w * quality_rules.holds(rule, x) for rule, w in model.rules))))
    assert np.allclose(sorted(got), sorted(want)) and ((want > 0.5) == y).mean() > 0.97


def mixed(spark, data, bin_rows):
    return mixing.decide(spark.createDataFrame(data, DOCS).repartition(3), bin_rows=bin_rows).collect()


def some_docs(seed=1, n=400):
    rnd = random.Random(seed)
    source = ["b", "a", None, "", "é", "z"]
    data = [(i, " ".join(["word"] * rnd.randint(0, 60)) + (" 1!2" if i % 3 else ""), source[min(5, int(rnd.expovariate(1)))], "x", 1) for i in range(n)]
    return [*data, (n, None, "a", "x", 1), (n + 1, "", None, "x", 1), data[5], data[5], (None, "null id", "b", "x", 1)]


@pytest.mark.parametrize("bin_rows", [5, 100_000])
def test_mix_targets(spark, bin_rows):
    data = some_docs()
    got = mixed(spark, data, bin_rows)
    assert len(got) == len(data)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"]
        assert r["size"] >= 0
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    size = {s: sum(r["size"] for r in v) for s, v in by.items()}
    left, target = float(sum(size.values())), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    while True:  # hand the rest out by weight, fix those at their cap, go on
        open_ = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else share[s]
            left -= target[s]
        if not full:
            break
    for s, v in by.items():
        assert {r["source_size"] for r in v} == {size[s]}
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in v)
        assert abs(sum(r["taken"] for r in v) - target[s]) <= max(r["size"] for r in v) / 2 + 1
        assert max(r["copies"] for r in v) - min(r["copies"] for r in v) <= 1


def test_mix_reruns_and_bins_agree(spark):
    data = some_docs(2)
    pick = lambda rows: sorted((str(r["doc_id"]), r["_k1"], r["taken"]) for r in rows)
    assert pick(mixed(spark, data, 5)) == pick(mixed(spark, data, 100_000)) == pick(mixed(spark, data[::-1], 7))


def test_mix_rows(spark):
    data = some_docs(3)
    frame = spark.createDataFrame(data, DOCS)
    want = collections.Counter()
    for r in mixing.decide(frame).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = mixing.mix(frame)
    assert got.columns == frame.columns
    found = collections.Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in got.collect())
    assert found == +want
    assert mixing.mix(frame.limit(0)).count() == 0


def test_weights_come_first(spark):
    """Heavier documents are taken more often when a source is taken in part."""
    data = [(i, ("clean words only here " if i % 2 else "1234 5678 9012 3456 ") * 5, "a" if i < 2000 else "b", "x", 1) for i in range(7000)]
    assert all(abs(r["target"] - (140_000 / 3 if r["source"] == "a" else 280_000 / 3)) < 1e-6 for r in mixed(spark, data, 500))
    tied = [(i, "one two three", "ab"[i % 2], "x", 1) for i in range(12)]
    assert {(r["source"], r["target"]) for r in mixed(spark, [*tied[:12:2], *tied[1:6:2]], 5)} == {("a", 9.0), ("b", 18.0)}
    got = [r for r in mixed(spark, data, 500) if r["source"] == "b"]
    clean, junk = (np.mean([r["copies"] for r in got if r["doc_id"] % 2 == k]) for k in (1, 0))
    assert clean > junk


VOCABULARY = [a + b + c for a in ("on", "the", "er", "ti", "wh", "in") for b in ("a", "e", "ou", "ing") for c in ("d", "sh", "ble", "r", "nt", "st")]


def test_decontamination(spark):
    rnd = random.Random(9)
    words = lambda n: [rnd.choice(VOCABULARY) + rnd.choice(VOCABULARY) if rnd.random() < 0.6 else rnd.choice(["the", "of", "and", "is"]) for _ in range(n)]
    items = {i: words(rnd.randint(14, 60)) for i in range(30)} | {30: words(200)}
    data, planted = [], set()
    for d in range(400):
        w = words(rnd.randint(0, 300))
        if d % 8 == 0:
            i = rnd.randrange(31)
            bad = list(items[i])
            if d % 16 == 0:  # a paraphrase: one word in seven replaced, one in twelve dropped
                bad = [rnd.choice(VOCABULARY) if k % 7 == 3 else x for k, x in enumerate(bad) if k % 12 != 5]
            at = rnd.randint(0, len(w))
            w[at:at] = bad
            planted.add((d, i))
        data.append((d, " ".join(x.upper() if k % 5 == 0 else x + "," * (k % 9 == 0) for k, x in enumerate(w)), "s", "x", 1))
    data += [(400, None, "s", "x", 1), (401, "", "s", "x", 1), (None, " ".join(items[0]), "s", "x", 1), data[8], (8, "other text", "s", "x", 1)]
    frame = spark.createDataFrame(data, DOCS).repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (None, "a b c d e f g h i j"), (91, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(frame, bench).collect()}
    assert got == planted | {(None, 0)}
    left = decontam.decontaminate(frame, bench)
    assert left.columns == frame.columns
    dirty = {d for d, _ in planted}
    assert sorted(r["doc_id"] for r in left.collect() if r["text"] != "other text") == sorted(r[0] for r in data[:402] if r[0] not in dirty)
    assert decontam.matches(frame, bench.limit(0)).count() == 0
    assert decontam.matches(frame.limit(0), bench).count() == 0


def test_lcs():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 30))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontam.lcs(masks, len(a), b) == table[-1][-1]


def test_folds_match_crc32(spark):
    got = spark.range(50).select("id", fold("id", 3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_source_mix"])
def test_oracles(spark, name):
    from packspark.llm.queries import ORACLES, QUERIES

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, path).select(*want.columns)
    shape = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert shape(got.collect()) == shape(want.fetchall())
