"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct n-grams of 3 to 6 characters of its lower-cased text with
blanks folded, hashed to 2^BITS buckets. From the labelled rows come r = log of the ratio of the
two classes' smoothed, normalised document counts; the buckets whose counts tell the classes
apart best are kept; each feature is its r, and an L2 logistic regression weighs them.

Fitting uses at most ``max_rows`` labelled rows, those with the smallest hash of their id; the
counts and the design matrix are made on the executors. Scoring covers every whole text.

Null and empty texts have no features and get the score of the intercept. Without labelled rows of
both classes every score is the share of label 1 (0.5 without any). A document with several labels
counts as 1 if their mean is at least a half; labels that are null are ignored; of labelled documents
with the same id the least text counts. Equal texts get equal scores, and so do repeated rows; very long
texts are read whole, one at a time; an empty table gives an empty table. Columns other than text and
the score pass through, whatever they are called.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import arrow_udf, stash

BITS = 20
ORDERS = (3, 4, 5, 6)
MAX_ROWS = 20_000
FEATURES = 3_000
SMOOTHING = 1.0
PENALTY = 1.0
FIT_PARTS = 6


def buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram of a text (with repeats)."""
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    found, h = [], c
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B1) + c[n - 1 :]
        if n in ORDERS:
            found.append(((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.uint32))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclasses.dataclass
class Model:
    """value: what a bucket adds to the log-odds (0 where it isn't a feature)."""

    intercept: float
    ids: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.weights
        return out


def scores(texts: Iterator[str | None], model: Model, table: np.ndarray) -> Iterator[float]:
    used = table != 0
    for text in texts:
        if model.constant is not None:
            yield model.constant
            continue
        b = buckets(text or "")
        b = np.unique(b[used[b]])
        yield float(1 / (1 + np.exp(-np.clip(model.intercept + table[b].sum(dtype=np.float64), -500, 500))))


def logistic(x: list[np.ndarray], values: np.ndarray, y: np.ndarray, penalty: float, positive: float = 1.0, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L2 logistic regression on sparse rows of feature numbers whose
    value is values[feature], by accelerated gradient descent; a row of class 1 counts as ``positive``."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x) if len(x) else np.zeros(0, np.int64)
    n, k = len(x), len(values)
    weight = np.where(y > 0, positive, 1.0)
    weight /= weight.mean()
    base = np.log(((weight * y).mean() + 1e-9) / ((weight * (1 - y)).mean() + 1e-9))
    w, b, vw, vb = np.zeros(k), base, np.zeros(k), base
    # A bound of the largest eigenvalue of X'X/n by power iteration.
    v = np.ones(k) / max(1.0, np.sqrt(k))
    top = 1.0
    for _ in range(20):
        u = np.bincount(rows, (v * values)[cols], n) * weight
        v = np.bincount(cols, u[rows], k) * values / n
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * (top + weight.max()) + penalty / n)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(rows, (vw * values)[cols], n), -500, 500)))
        e = weight * (p - y) / n
        nw, nb = vw - step * (np.bincount(cols, e[rows], k) * values + penalty / n * vw), vb - step * e.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


def select(counts: np.ndarray, n: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that tell the classes apart best, and their log-count ratios r.

    counts: documents of class 0 and 1 that have each bucket; the measure is the gap of the two
    shares in units of its standard error.
    """
    share = counts / np.maximum(n[:, None], 1)
    pooled = counts.sum(0) / n.sum()
    gap = (share[1] - share[0]) / np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / max(n[0], 1) + 1 / max(n[1], 1)), 1e-12))
    seen = np.flatnonzero(counts.sum(0) >= 3)
    ids = np.sort(seen[np.argsort(-np.abs(gap[seen]), kind="stable")[:features]])
    smooth = counts[:, ids] + SMOOTHING
    smooth = smooth / (n[:, None] + 2 * SMOOTHING)
    return ids, np.log(smooth[1] / smooth[0])


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most max_rows rows (text, y): whole texts of documents with a label (of documents with the
    same id, the least text)."""
    y = (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y")
    order = F.xxhash64("doc_id")
    chosen = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(y).orderBy(order, "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds what is broadcast
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, features: int = FEATURES, penalty: float = PENALTY) -> Model:
    """Fit on docs (doc_id, text) that labels (doc_id, label) covers."""
    rows = stash(labelled(docs, labels, label, max_rows).repartition(FIT_PARTS), "toxicity-rows")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                total[y, np.unique(buckets(text or ""))] += 1
                n[y] += 1
        yield pd.DataFrame({"n0": [n[0]], "n1": [n[1]], "counts": [total.tobytes()]})

    counts, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for r in rows.mapInPandas(count, "n0 long, n1 long, counts binary").toLocalIterator():
        counts += np.frombuffer(r["counts"], np.int32).reshape(2, -1)
        n += np.array([r["n0"], r["n1"]])
    if min(n) == 0:
        return Model(0.0, np.zeros(0, int), np.zeros(0), 0.5 if n.sum() == 0 else float(n[1] / n.sum()))
    ids, ratio = select(counts, n, features)

    def design(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.full(1 << BITS, -1, np.int32)
        number[ids] = np.arange(len(ids))
        for batch in batches:
            found = []
            for text in batch["text"]:
                x = np.unique(number[buckets(text or "")])
                found.append(x[x >= 0].tobytes())
            yield pd.DataFrame({"y": batch["y"], "x": found})

    x, y = [], []
    for r in rows.mapInPandas(design, "y int, x binary").collect():
        x.append(np.frombuffer(r["x"], np.int32))
        y.append(r["y"])
    intercept, w = logistic(x, ratio, np.array(y, float), penalty, positive=n[0] / n[1])  # both classes weigh the same
    return Model(intercept, ids, (w * ratio).astype(np.float32))


def with_score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is toxic."""

    @arrow_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = model.table()
        for texts in batches:
            yield pd.Series(list(scores(texts, model, table)), dtype=float)

    return df.withColumn(out, score(F.col(text)))


def decided(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")
