"""Vector retrieval: line windows, cosine similarity, the best of each query."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from packspark.functions import text as T
from packspark.operators.candidates import TIERS, candidates

WINDOW_LINES, STRIDE_LINES, MAX_FILES = 24, 12, 80
#: Query vectors that are sent to every task; more of them go in several passes.
VECTOR_BLOCK = 1_000


def line_windows(files: DataFrame, size: int = WINDOW_LINES, stride: int = STRIDE_LINES) -> DataFrame:
    """(path, start_line, end_line, content) of sliding windows that aren't blank; one window for a
    file of at most ``size`` lines, and none after the one that reaches the last line."""
    n = F.size("lines")
    last = F.greatest(F.lit(1), (F.ceil((n - size) / stride) * stride + 1).cast("int"))
    at = files.filter(n >= 1).select("path", "lines", F.explode(F.sequence(F.lit(1), last, F.lit(stride))).alias("start_line"))
    cut = at.withColumn("end_line", F.least(F.size("lines"), F.col("start_line") + size - 1))
    return cut.select("path", "start_line", "end_line", T.snippet(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("content")).filter(F.col("content").rlike(T.SOLID))


def first_files(files: DataFrame, limit: int = MAX_FILES) -> DataFrame:
    """The first files by path: the bounded embedding scan."""
    return files.orderBy("path").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if one has no length; unequal sizes are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    sized = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal size"))).otherwise(F.lit(0.0))
    return F.when(norm == 0, sized).otherwise(sized + dot(a, b) / norm)


def top_similar(query_vectors: DataFrame, vectors: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The ``limit`` rows of vectors (key columns, vector) next to each query vector (query_id,
    vector): query_id, key columns, similarity; ties (to 12 places) by key. Rows without a vector are
    next to nothing.

    Query vectors are a stated batch and meet the rows in blocks: each task multiplies its batches of
    rows, normalised once, with a block's matrix and keeps the best of each batch before anything is
    shuffled.
    """
    spark = vectors.sparkSession
    rows = vectors.select(*key, "vector").filter("vector IS NOT NULL")
    schema = _similar_schema(query_vectors, rows, key)
    found = spark.createDataFrame([], schema)
    if limit <= 0:
        return found
    source = query_vectors.select("query_id", "vector").filter("vector IS NOT NULL").toLocalIterator()
    while block := list(itertools.islice(source, VECTOR_BLOCK)):
        found = found.unionByName(rows.mapInArrow(_best_of_batches(block, key, limit, schema), schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *key)
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def _similar_schema(query_vectors: DataFrame, rows: DataFrame, key: list[str]) -> StructType:
    return StructType([query_vectors.schema["query_id"], *[rows.schema[k] for k in key], StructField("similarity", DoubleType())])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best_of_batches(block: list[tuple], key: list[str], limit: int, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = len(block[0][1])
    if any(len(r[1]) != width for r in block):
        raise ValueError("vectors of unequal size")
    ids, asked = [r[0] for r in block], _unit(np.array([r[1] for r in block], float))
    kind = schema["query_id"].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            column = batch.column(len(key))
            flat, ends = np.asarray(column.flatten(), float), np.asarray(column.offsets)
            if len(batch) and (np.diff(ends) != width).any():
                raise ValueError("vectors of unequal size")
            near = np.round(_unit(flat.reshape(len(batch), width)) @ asked.T, 12)
            if len(batch) > limit:
                place = np.empty(len(batch), np.int64)  # by key, which decides ties
                place[np.asarray(pc.sort_indices(batch, sort_keys=[(batch.schema.names[i], "ascending") for i in range(len(key))]))] = np.arange(len(batch))
                least = np.partition(near, len(batch) - limit, axis=0)[len(batch) - limit]
                rows = [np.flatnonzero(near[:, k] >= least[k]) for k in range(len(ids))]
                rows = [r if len(r) <= limit else r[np.lexsort((place[r], -near[r, k]))[:limit]] for k, r in enumerate(rows)]
                row, q = np.concatenate(rows), np.repeat(np.arange(len(ids)), [len(r) for r in rows])
            else:
                row, q = np.nonzero(near > -np.inf)
            query = pa.array([ids[k] for k in q.tolist()], types.get(kind))
            yield pa.RecordBatch.from_arrays([query, *[batch.column(i).take(pa.array(row)) for i in range(len(key))], pa.array(near[row, q])], names=["query_id", *key, "similarity"])

    return best


def vector_search(query_vectors: DataFrame, windows: DataFrame, limit: int) -> DataFrame:
    """Candidates of tier embedding among windows (path, start_line, end_line, content, vector)."""
    near = top_similar(query_vectors, windows, ["path", "start_line", "end_line", "content"], limit)
    return candidates(near, TIERS["embedding"], "embedding", "content", keyword=F.col("similarity"))


def merge_hits(primary: DataFrame, secondary: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """Primary hits, then secondary ones at new places, ``limit`` of each query; each side in the
    given order. Repeats within primary stay."""
    key = ["query_id", "path", "start_line", "end_line"]
    ranked = lambda df, side: df.withColumn("_side", F.lit(side)).withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    both = ranked(primary, 0).unionByName(ranked(secondary, 1))
    nth = Window.partitionBy(*key).orderBy("_side", "_at")
    fresh = both.withColumn("_nth", F.row_number().over(nth)).filter((F.col("_side") == 0) | (F.col("_nth") == 1))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("_side", "_at"))
    return fresh.withColumn("merged_rank", n).filter(F.col("merged_rank") <= limit).drop("_side", "_at", "_nth")
