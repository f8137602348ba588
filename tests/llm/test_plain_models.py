"""Toxicity's features and scores, and near-dedup's recall at the threshold, against plain versions."""

import math
import random

import numpy as np
import pytest

from packspark.llm import near_dedup, toxicity

M64 = (1 << 64) - 1


def plain_buckets(text):
    """The bucket of every n-gram, one character at a time."""
    chars = [ord(c) for c in " " + " ".join(text.lower().split()) + " "]
    out = []
    for n in toxicity.ORDERS:
        for i in range(len(chars) - n + 1):
            h = chars[i]
            for c in chars[i + 1 : i + n]:
                h = (h * 0x9E3779B1 + c) & M64
            out.append(((h + n) * 0x9E3779B97F4A7C15 & M64) >> (64 - toxicity.BITS))
    return out


def test_buckets_and_scores():
    rnd = random.Random(1)
    texts = ["", "a", "Ab  c\n d", "é" * 9, "𝔘nicode mixes", *["".join(rnd.choice("abcdeé \n") for _ in range(rnd.randint(0, 60))) for _ in range(60)]]
    for t in texts:
        assert sorted(toxicity.buckets(t).tolist()) == sorted(plain_buckets(t))
    ids = np.array(sorted({b for t in texts[5:25] for b in plain_buckets(t)}))
    model = toxicity.Model(-0.3, ids, np.array([rnd.gauss(0, 0.2) for _ in ids]))
    weight = dict(zip(ids.tolist(), model.weights.astype(np.float32).astype(float).tolist(), strict=True))
    for t, got in zip([*texts, None], toxicity.scores(iter([*texts, None]), model, model.table()), strict=True):
        total = model.intercept + sum(weight.get(b, 0.0) for b in set(plain_buckets(t or "")))
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-6)


def test_log_count_ratios():
    """r is the logarithm of the ratio of smoothed shares, and the logistic fit minimises its loss."""
    counts = np.array([[10, 0, 4, 5], [1, 6, 4, 0]])
    n = np.array([20, 8])
    ids, r = toxicity.select(counts, n, 3)
    for k, i in enumerate(ids.tolist()):
        assert math.isclose(r[k], math.log(((counts[1, i] + 1) / (8 + 2)) / ((counts[0, i] + 1) / (20 + 2))))
    assert 2 not in ids.tolist() or abs(4 / 8 - 4 / 20) > abs(5 / 20)
    rnd = np.random.default_rng(3)
    rows = [np.flatnonzero(rnd.random(6) < 0.5) for _ in range(80)]
    y = np.array([float((0 in x) ^ (rnd.random() < 0.1)) for x in rows])
    values = rnd.normal(size=6)
    b, w = toxicity.logistic(rows, values, y, 0.5)

    def loss(b, w):
        m = np.array([b + sum(w[j] * values[j] for j in x) for x in rows])
        return np.mean(np.logaddexp(0, m) - y * m) + 0.5 * 0.5 / len(y) * (w**2).sum()

    best = loss(b, w)
    for _ in range(50):
        assert best <= loss(b + rnd.normal() * 0.02, w + rnd.normal(size=6) * 0.02) + 1e-9


@pytest.mark.parametrize("size", [7, 12, 25, 60, 150, 400, 1000])
def test_recall_at_the_threshold(size):
    """Pairs whose similarity is just 0.85 share a bucket: none of 1,500 is missed."""
    rnd = np.random.default_rng(size)
    for _ in range(3):
        pairs = []
        for _ in range(500):
            both = size
            apart = math.floor(both * 15 / 85)
            pool = np.unique(rnd.integers(0, 1 << 63, 4 * (both + apart) + 8, dtype=np.uint64) << np.uint64(1))
            rnd.shuffle(pool)
            left = rnd.integers(0, apart + 1)
            pairs.append((np.sort(pool[: both + left]), np.sort(np.concatenate((pool[:both], pool[both + left : both + apart])))))
        for a, b in pairs:
            assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        x, y = (near_dedup.bands(near_dedup.signatures([p[k] for p in pairs])) for k in (0, 1))
        assert (x == y).any(1).all()
