"""Budget prediction: features of a query, and a random forest over the buckets."""

from __future__ import annotations

import dataclasses

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.operators.budget import BUCKETS

#: The features in the order in which models take them.
FEATURES = (
    "query_tokens", "query_token_log", "mentioned_files", "mentioned_symbols", "retrieval_signal_count",
    "has_stack_trace", "has_error_token", "intent_confidence", "intent_budget", "repo_file_count",
    "repo_loc_log", "discovered_anchor_count", "must_include_token_estimate",
    "intent_debug", "intent_implement", "intent_explain", "intent_refactor", "intent_review",
)
#: Least bucket from a query length on, for the legacy floors.
LENGTH_FLOORS = ((75, 10000), (55, 8000), (35, 5000))


def features(analysis: DataFrame, stats: DataFrame, anchor_count: Column | int = 0, must_tokens: Column | int = 0) -> DataFrame:
    """query_id and the feature columns; stats is the one row of repository statistics.

    Where a bundle's budget is set, anchors aren't known yet: both last numbers are 0 by default.
    """
    s, lit = F.col("signals"), lambda x: x if isinstance(x, Column) else F.lit(x)
    size = lambda c: F.size(s[c])
    values = {
        "query_tokens": s["query_tokens"], "query_token_log": F.log10(s["query_tokens"] + 1.0),
        "mentioned_files": size("mentioned_files"), "mentioned_symbols": size("mentioned_symbols"),
        "retrieval_signal_count": size("mentioned_files") + size("mentioned_symbols") + size("inferred_files"),
        "has_stack_trace": s["has_stack_trace"].cast("int"), "has_error_token": s["has_error_token"].cast("int"),
        "intent_confidence": F.col("confidence"), "intent_budget": F.col("budget.recommended"),
        "repo_file_count": F.col("file_count"), "repo_loc_log": F.col("loc_log"),
        "discovered_anchor_count": lit(anchor_count), "must_include_token_estimate": lit(must_tokens),
    } | {f: (F.col("intent") == f.removeprefix("intent_")).cast("int") for f in FEATURES[-5:]}
    one = F.broadcast(stats.select("file_count", "loc_log"))  # an aggregate without groups: one row
    return analysis.join(one).select("query_id", *[values[f].cast("double").alias(f) for f in FEATURES])


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


@dataclasses.dataclass
class BudgetModel:
    """A forest whose class i is the bucket BUCKETS[i]."""

    forest: RandomForestClassificationModel

    @classmethod
    def train(cls, rows: DataFrame, label: str = "budget", trees: int = 40, depth: int = 8, seed: int = 1) -> BudgetModel:
        """Fit on rows with the feature columns and a budget, which is snapped to its bucket."""
        number = sum((F.when(F.col(label) > b, 1).otherwise(0) for b in BUCKETS[:-1]), F.lit(0)).cast("double")
        data = assembled(rows.withColumn("label", number))
        return cls(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data))

    def predict(self, rows: DataFrame, legacy_floors: bool = False) -> DataFrame:
        """query_id, predicted, raw_bucket, model_confidence, source."""
        out = self.forest.transform(assembled(rows)).withColumn("_p", vector_to_array("probability"))
        best = F.array_position("_p", F.array_max("_p")) - 1  # the first of equal ones
        raw = F.get(F.array(*[F.lit(b) for b in BUCKETS]), best.cast("int"))
        budget = raw
        if legacy_floors:
            floor = F.coalesce(*[F.when(F.col("query_tokens") >= n, F.lit(b)) for n, b in LENGTH_FLOORS], F.lit(0))
            budget = F.greatest(raw, floor)
        return out.select("query_id", T.clamp(budget, BUCKETS[0], BUCKETS[-1]).alias("predicted"), raw.alias("raw_bucket"), F.round(F.array_max("_p"), 4).alias("model_confidence"), F.lit("rf").alias("source"))

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BudgetModel:
        return cls(RandomForestClassificationModel.load(path))
