"""Engines: sessions over one corpus that answer single requests, batches of one query each.

Batches of many queries go through ``plans.bundle`` directly; this facade gives each request as
plain values.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.functions import signals
from packspark.functions import text as T
from packspark.operators import budget_model as M
from packspark.plans import bundle as B
from packspark.plans import render
from packspark.session import scratch
from packspark.settings import Settings, load, resolve_workspace
from packspark.sources import workspace as W
from packspark.streaming import events as E

EXPLORATION_TASK = "Explore this codebase: what are the main modules and how do they fit together?"
UNKNOWN = {"error": "unknown bundle id"}


@dataclasses.dataclass
class Held:
    """What the engine remembers of a bundle."""

    state: B.Bundles
    query: str


class Engine:
    """Analysis, bundles and expansions over one workspace or corpus."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, corpus: W.Corpus | None = None, log: bool = True):
        self.spark, self.settings = spark, settings or Settings()
        self._corpus, self._index, self._model = corpus, None, None
        self.log = log
        self.held: dict[str, Held] = {}

    @property
    def index(self) -> B.Index:
        """Files (those of the manifest), symbols and imports, held for all requests."""
        if self._index is None:
            corpus = self._corpus
            if corpus is None:
                entries = W.current_manifest(self.spark, self.settings)
                corpus = W.searchable(W.from_workspace(self.spark, self.settings), entries)
            self._index = B.Index.build(corpus).store(scratch(self.spark, "index"))
        return self._index

    def refresh(self) -> None:
        """Forget the index, so that the next request sees changed files."""
        self._index = None

    def _one(self, query: str, max_tokens: int | None = None, intent: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(0, query, max_tokens, intent)], "query_id long, query string, max_tokens int, intent string")

    def _record(self, rows: DataFrame) -> None:
        if self.log:
            E.append(rows, self.settings.events)

    def _predicted(self, queries: DataFrame) -> DataFrame | None:
        """The trained model's budget; None where no model is stored."""
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import AnalysisException

        if self._model is None:
            try:
                self._model = M.BudgetModel.load(self.spark, self.settings.model_path)
            except (AnalysisException, Py4JJavaError):
                self._model = False
        if not self._model:
            return None
        rows = M.features(signals.analyze(queries, self.settings), W.repo_stats(self.index.corpus.files))
        return self._model.predict(rows, self.settings.legacy_query_length_floors)

    def analyze_query(self, query: str) -> dict:
        found = signals.analyze(self._one(query), self.settings)
        self._record(E.analysis_events(found))
        return found.drop("query_id", "max_tokens").first().asDict(recursive=True)

    def estimate_tokens(self, text: str | None = None, bundle_id: str | None = None) -> dict:
        """Tokens of a text or of a bundle's chunks."""
        if text is not None:
            return {"tokens": self.spark.range(1).select(T.tokens(F.lit(text))).first()[0], "method": T.token_method()}
        if bundle_id in self.held:
            return {"tokens": self._bundle(bundle_id)["budget_used"], "method": T.token_method()}
        return dict(UNKNOWN)

    def estimate_bundle_tokens(self, bundle_id: str) -> dict:
        return {"tokens": self._bundle(bundle_id)["budget_used"] if bundle_id in self.held else 0, "method": T.token_method()}

    def analysis_for_bundle(self, bundle_id: str) -> dict | None:
        held = self.held.get(bundle_id)
        return held.state.analysis.drop("query_id", "max_tokens").first().asDict(recursive=True) if held else None

    def _bundle(self, bundle_id: str) -> dict:
        row = self.held[bundle_id].state.bundles.first().asDict(recursive=True)
        return {k: v for k, v in row.items() if k != "query_id"} | {"bundle_id": bundle_id}

    def get_context_bundle(self, query: str, max_tokens: int | None = None, intent: str | None = None) -> dict:
        asked = self._one(query, max_tokens, intent)
        predicted = self._predicted(asked) if max_tokens is None else None
        state = B.prepare(asked, self.index, self.settings, predicted)
        bundle_id = uuid.uuid4().hex
        state = dataclasses.replace(state, bundles=state.bundles.withColumn("bundle_id", F.lit(bundle_id)))
        self.held[bundle_id] = Held(state, query)
        self._record(E.bundle_events(state))
        return self._bundle(bundle_id)

    def expand_context(self, bundle_id: str, focus: str | None = None, extra_tokens: int | None = None) -> dict:
        """A larger bundle under the same id; a KeyError if it isn't known."""
        held = self.held[bundle_id]
        asked = self.spark.createDataFrame([(0, focus, extra_tokens)], "query_id long, focus string, extra_tokens int")
        state = B.expand(held.state, asked, self.index, self.settings)
        self.held[bundle_id] = Held(state, held.query)
        self._record(E.bundle_events(state))
        return self._bundle(bundle_id)

    def prepare_context(self, query: str, max_tokens: int | None = None, intent: str | None = None) -> dict:
        """Bundle, analysis and the message in one."""
        bundle = self.get_context_bundle(query, max_tokens, intent)
        held = self.held[bundle["bundle_id"]]
        message = render.markdown(held.state, self.settings.workspace_root).first()["message"]
        return {"bundle": bundle, "analysis": self.analysis_for_bundle(bundle["bundle_id"]), "message": message}

    def context_prompt(self, query: str = "") -> str:
        """The message alone; a blank query asks for a tour."""
        return self.prepare_context(query if query.strip() else EXPLORATION_TASK)["message"]


class Engines:
    """One engine for each workspace, and which of them a bundle belongs to."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_root: dict[str, Engine] = {}

    def get(self, root: str | None = None) -> Engine:
        where = resolve_workspace(root)
        if where not in self.by_root:
            self.by_root[where] = Engine(self.spark, load(where))
        return self.by_root[where]

    def of_bundle(self, bundle_id: str) -> Engine | None:
        return next((e for e in self.by_root.values() if bundle_id in e.held), None)

    def expand_context(self, bundle_id: str, focus: str | None = None, extra_tokens: int | None = None) -> dict:
        engine = self.of_bundle(bundle_id)
        return engine.expand_context(bundle_id, focus, extra_tokens) if engine else dict(UNKNOWN)

    def estimate_tokens(self, text: str | None = None, bundle_id: str | None = None) -> dict:
        engine = self.of_bundle(bundle_id) if text is None and bundle_id else self.get()
        return engine.estimate_tokens(text, bundle_id) if engine else dict(UNKNOWN)
