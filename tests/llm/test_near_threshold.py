"""Near-dedup at thresholds other than op9's, against plain versions."""

import random

from test_dedup import shingles

from packspark.llm import near_dedup


def pairs(seed=3, n=40):
    """Pairs of texts of 100 words, the last words of the second replaced: Jaccard from 0.7 to 1."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(100)]
        cut = rnd.randint(0, 16)
        out += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 100 - cut] + [f"x{i}y{k}" for k in range(cut)]))]
    return out


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_threshold_is_a_parameter(spark):
    data = pairs()
    alike = [jaccard(data[i][1], data[i + 1][1]) for i in range(0, len(data), 2)]
    assert any(0.80 <= j < 0.85 for j in alike) and any(j < 0.80 for j in alike)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for numerator in (80, 85):
        left = {r["doc_id"] for r in near_dedup.near_dups(docs, numerator).filter("kept").collect()}
        assert left == {i for i, _ in data if i % 2 == 0 or 100 * alike[i // 2] < numerator}


def test_prefix_pairs_lose_nothing_at_80(spark):
    sets = near_dedup.shingle_sets([t.encode() for _, t in pairs(5)])
    seen = {near_dedup.set_id(s): s for s in sets}
    frame = spark.createDataFrame([(bytearray(k), bytearray(k), bytearray(s.tobytes()), *near_dedup.parity(s).tolist()) for k, s in seen.items()], "fp binary, root binary, set binary, " + ", ".join(f"{c} long" for c in near_dedup.ODD))
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in near_dedup.prefix_pairs(frame, 80).collect()}
    keys = list(seen)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = set(seen[a].tolist()), set(seen[b].tolist())
            if 100 * len(x & y) >= 80 * len(x | y):
                assert frozenset((a, b)) in got
