"""Decontamination's search against plain checks of every window, without Spark."""

import numpy as np

from packspark.llm import decontam as D


def plain_find(ids, starts, pieces):
    """All windows that pass the answer check and the LCS, whatever their cosine."""
    out = set()
    for d in range(len(starts) - 1):
        n = starts[d + 1] - starts[d]
        cells = -(-n // D.CELL)
        for scale in D.SCALES:
            step = max(1, scale // 4)
            for c in range(0, cells, step):
                if not (c + scale <= cells or c == 0 or c + scale - step < cells):
                    continue
                for p in pieces.at[scale].tolist():
                    m = len(pieces.words[p])
                    lo = max(0, c * D.CELL - m // 2)
                    hi = min(n, (n if c + scale >= cells else (c + scale) * D.CELL) + m // 2)
                    seen = ids[starts[d] + lo : starts[d] + hi].tolist()
                    if len(pieces.rare[p] & set(seen)) >= D.ANSWER_SHARE * len(pieces.rare[p]) and D.lcs(pieces.masks[p], m, seen) >= D.LCS_SHARE * m:
                        out.add((d, p, lo, hi))
    return out


def setting(seed):
    """Pieces of usual words, whole or with words replaced and dropped, among words that weigh much more."""
    rnd = np.random.default_rng(seed)
    idf = np.where(np.arange(D.V) < 3000, 3.0, 11.0) + rnd.random(D.V)
    table = (rnd.standard_normal((D.V, D.RANK)) * (idf - D.IDF_FLOOR)[:, None]).astype(np.float32)
    words = [rnd.integers(0, 3000, m) for m in (8, 9, 20, 21, 33, 40, 41, 59, 64)]
    pieces = D.Pieces([(i, 0, w) for i, w in enumerate(words)], table, idf)
    docs, own = [np.zeros(0, int), rnd.integers(0, D.V, 3)], {}
    for p, w in enumerate(words * 6):
        keep = rnd.random(len(w)) > (0 if p % 2 else 0.1)
        swap = rnd.random(len(w)) < (0 if p % 2 else 0.15)
        bad = np.where(swap, rnd.integers(0, 3000, len(w)), w)[keep]
        if p % 2:
            own[len(docs)] = p % len(words)
        docs.append(np.concatenate((rnd.integers(3000, D.V, rnd.integers(0, 150)), bad, rnd.integers(3000, D.V, rnd.integers(0, 150)))))
    return np.concatenate(docs).astype(np.uint16), np.concatenate(([0], np.cumsum([len(d) for d in docs]))), pieces, table, own


def test_no_window_is_lost():
    for seed in range(3):
        ids, starts, pieces, table, own = setting(seed)
        found = list(D.find(ids, starts, pieces, table))
        assert {f[:4] for f in found} == plain_find(ids, starts, pieces)
        assert set(own.items()) <= {f[:2] for f in found}
        assert any(f[4] < D.COSINE for f in found)


def test_search_of_nothing():
    ids, starts, pieces, table, _ = setting(9)
    assert not list(D.find(ids[:0], np.zeros(3, np.int64), pieces, table))
    assert not list(D.find(np.full(50, 65_000, np.uint16), np.array([0, 50]), pieces, table))
