"""The plug-in point: retrievers, which turn queries and a corpus into candidates."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.operators import grep as G
from packspark.operators import vectors as V
from packspark.settings import Settings
from packspark.sources.workspace import Corpus


@runtime_checkable
class Retriever(Protocol):
    """Anything that finds candidates for queries (query_id, query)."""

    def search(self, queries: DataFrame, corpus: Corpus, limit: int) -> DataFrame: ...


class GrepRetriever:
    """Keyword search."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def search(self, queries: DataFrame, corpus: Corpus, limit: int) -> DataFrame:
        return G.grep(queries, corpus, self.settings, limit)


class EmbeddingRetriever:
    """Vector search over line windows of the first files by path.

    encode takes a DataFrame and its text column and adds a column vector; without one, nothing is
    found, as when a model can't be loaded.
    """

    def __init__(self, settings: Settings | None = None, encode: Callable[[DataFrame, str], DataFrame] | None = None, max_files: int = V.MAX_FILES):
        self.settings, self.encode, self.max_files = settings or Settings(), encode, max_files

    def search(self, queries: DataFrame, corpus: Corpus, limit: int) -> DataFrame:
        if limit <= 0 or self.encode is None:
            return G.grep(queries, corpus, self.settings, 0)
        windows = self.encode(V.line_windows(V.first_files(corpus.files, self.max_files)), "content")
        asked = self.encode(queries.filter(F.trim("query") != ""), "query").select("query_id", "vector")
        return V.vector_search(asked, windows, limit)


class CompositeRetriever:
    """Keyword hits first, then vector hits at places that are new, if the settings want them."""

    def __init__(self, settings: Settings | None = None, encode: Callable[[DataFrame, str], DataFrame] | None = None):
        self.settings = settings or Settings()
        self.grep = GrepRetriever(self.settings)
        self.embedding = EmbeddingRetriever(self.settings, encode) if self.settings.enable_embedding_retriever else None

    def search(self, queries: DataFrame, corpus: Corpus, limit: int) -> DataFrame:
        found = self.grep.search(queries, corpus, limit)
        if self.embedding is None:
            return found
        order = [F.desc("keyword_match"), F.col("path"), F.col("start_line")]
        return V.merge_hits(found, self.embedding.search(queries, corpus, limit), limit, order).drop("merged_rank")


def build_retriever(settings: Settings, encode: Callable[[DataFrame, str], DataFrame] | None = None) -> Retriever:
    return CompositeRetriever(settings, encode)
