"""The mix on rows that differ in little, on weights that crowd the keys, and beside odd columns."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from packspark.llm import mixing

DOCS = "doc_id long, text string, source string, lang string, _k1 string, _copies int, _rows map<string,int>"


def rows(seed=1, n=300):
    rnd = random.Random(seed)
    out = [(i, "word " * rnd.randint(1, 30) + "1 " * rnd.choice([0, 0, 60]), rnd.choice(["a", "b", "c", None]), "en", "mine", 7, {"x": i}) for i in range(n)]
    same = "some words that stand twice"
    out += [(900, same, "a", "en", "mine", 7, {"x": 1}), (900, same, "b", "en", "mine", 7, {"x": 1}), (900, same, "b", "de", "mine", 7, {"x": 1})]
    return out + [(901, same, "c", "en", "mine", 7, None)] * 3


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_no_row_stands_for_another(spark, parts):
    frame = spark.createDataFrame(rows(), DOCS).repartition(parts)
    want = collections.Counter()
    for r in mixing.decide(frame, bin_rows=10).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = mixing.mix(frame, bin_rows=25)
    assert got.columns == frame.columns
    found = collections.Counter((r["doc_id"], r["source"]) for r in got.collect())
    assert found == +want
    assert all(r["_k1"] == "mine" and r["_copies"] == 7 for r in got.collect())
    assert want[900, "a"] and want[900, "b"]  # rows of the same id and text count each for their source
    pick = lambda df: sorted(map(str, df.select("doc_id", "text", "source", "lang").collect()))
    assert pick(got) == pick(mixing.mix(frame.repartition(2)))


@pytest.mark.parametrize("weight", [0.05, 0.5, 1.0, 50.0])
def test_budgets_end_in_small_ranges(spark, weight):
    """Whatever the weights, the range that is ordered has at most bin_rows rows."""
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    keyed = keys.select("doc_id", F.lit(1).cast("long").alias("size"), mixing.place_of(mixing.exponential_key(F.lit(weight), "doc_id")).alias("_place_of_key"), F.lit(False).alias("_none"), F.col("source").alias("_source"))
    plan = spark.createDataFrame([(False, "small", 2_000, 777.5), (False, "large", 18_000, 17_000.25), (False, "none", 5, 0.0)], "_none boolean, _source string, _rows long, rest double")
    ends = {r["_source"]: r for r in mixing.budget_ends(keyed, plan, 50).collect()}
    assert set(ends) == {"small", "large", "none"} and ends["none"]["rest"] == 0
    for s in ("small", "large"):
        e = ends[s]
        here = [r["p"] >> e["_shift"] for r in keyed.filter(F.col("_source") == s).select(F.col("_place_of_key").alias("p")).collect()]
        assert here.count(e["_prefix"]) == e["inside"] <= 50
        before = sum(h < e["_prefix"] for h in here)
        assert math.isclose(before + e["rest"], {"small": 777.5, "large": 17_000.25}[s]) and 0 < e["rest"] <= e["inside"]


def test_equal_keys_end_too(spark):
    """Rows that are all alike can't be told apart by their key: the cutting stops at one place."""
    data = [(1, "one two three", "a")] * 120 + [(i, "one two three", "b") for i in range(2, 200)]
    got = mixing.decide(spark.createDataFrame(data, "doc_id long, text string, source string"), bin_rows=10).collect()
    assert len(got) == len(data)
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2
