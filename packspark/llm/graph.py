"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import discard, join_facts, release, stash


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for all nodes that have an edge.

    edges: two columns of one type; order, direction, repeats and loops don't matter. Every round
    is a few aggregations by node, which combine before the shuffle, and joins in which the
    neighbours of a node with very many of them are dealt to several places.
    Rounds are stored in the shared folder: the lineage stays short, and lost executors cost no
    earlier round. Only the last round's table stays.
    """
    a, b = (F.col(c) for c in edges.columns)
    pairs = edges.filter(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    now = stash(pairs, "edges")
    mark = _fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("_rows")).select("v", F.least("v", "m").alias("m"), "_rows")
        least = stash(least, "least")
        large = join_facts(both.filter("u > v"), least, ["v"]).select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u")
        first = stash(large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("_rows")), "first")
        small = join_facts(large, first, ["v"])
        after = small.select("v", F.col("m").alias("u")).unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("u"))).filter("v <> u").distinct()
        old, now = now, stash(after, "edges")
        before, mark = mark, _fingerprint(now)
        discard(old, least, first)
        release(edges.sparkSession)
        if mark == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
