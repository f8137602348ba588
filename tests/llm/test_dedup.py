"""Line dedup, near-dedup and substring dedup against plain versions on small hostile tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from packspark.llm import graph, induced_sort, line_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string, source string, n_lines long, size string, at int"
VOCABULARY = [a + b for a in ("on", "the", "er", "tion", "wh") for b in ("", "ing", "ed", "sh", "ble", "a", "or")]


def rows(seed=5, n=60):
    """Texts with shared passages, copies, near copies, blanks, odd characters; nulls and repeats."""
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randint(3, 12)))
    shared = [line() for _ in range(6)]
    out = []
    for i in range(n):
        body = [line() for _ in range(rnd.randint(0, 8))]
        if rnd.random() < 0.5:
            at = rnd.randint(0, len(body))
            body[at:at] = shared[: rnd.randint(2, 6)]
        if rnd.random() < 0.2:
            body += ["", "", "", " ", ""]
        out.append((i, "\n".join(body)))
    base = " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 40)) for _ in range(150)).split()
    for i in range(n, n + 40):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            words[rnd.randrange(150)] = f"edit{rnd.randint(0, 500)}"
        out.append((i, " ".join(words)))
    out += [(n + 40, out[3][1]), (n + 41, out[3][1]), (n + 42, ""), (n + 43, None), (n + 44, " \n\t "), (n + 45, "Ärger ÄRGER one two"), (n + 46, "ärger Ärger One TWO")]
    out += [(n + 47, "x" * 700), (n + 48, "x" * 350 + "\0" * 120 + "é" * 200), (n + 49, "one two"), (n + 50, "ONE two"), (n + 51, "a\r\nb\r\nc\na\r\nb\r\nc")]
    out.append(out[5])  # a repeated row
    out.append((None, out[7][1]))
    out.append((out[9][0], "another text under the same id " + line()))
    return [(i, t, "s", 7, "big", 1) for i, t in out]


def table(spark, data, parts=5):
    return spark.createDataFrame(data, DOCS).repartition(parts)


def plain_lines(data):
    docs = sorted({(r[0], r[1]) for r in data if r[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    seen, result = set(), {}
    for d, t in docs:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not re.search(r"[^\s]", "".join(w)):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        spans = sum(1 for g in gone if g - 1 not in gone)
        result[d, t] = (len(lines), len(gone), spans, "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return result


def test_lines(spark):
    data = [r for r in rows() if r[0] != 9 or "another" not in (r[1] or "")]  # equal ids tie by a hash that plain_lines lacks
    want = plain_lines(data)
    keyed = table(spark, data).withColumn("_text", F.col("text"))
    got = line_dedup.dedup_lines(keyed)
    assert set(got.columns) == {*keyed.columns, "n_removed", "n_spans"}
    found = got.collect()
    assert len(found) == len(data)
    assert any(r["n_removed"] for r in found)
    for r in found:
        if r["_text"] is None:
            assert (r["text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
        else:
            assert (r["n_lines"], r["n_removed"], r["n_spans"], r["text"]) == want[r["doc_id"], r["_text"]]
            assert r["size"] == "big" and r["at"] == 1


def test_lines_use_no_python(spark):
    plan = line_dedup.dedup_lines(table(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_long_and_empty(spark):
    long = "\n".join(["same"] * 30_000)
    got = line_dedup.dedup_lines(table(spark, [(1, long, "s", 0, "", 0)])).first()
    assert (got["n_removed"], got["text"]) == (29_999, "same")
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(data):
    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(data)):
        groups[find(i)].append(data[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return collections.Counter((data[i][0], len(sets[i]), least[find(i)], data[i][0] == least[find(i)]) for i in range(len(data)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near(spark, seed):
    data = rows(seed)
    got = near_dedup.near_dups(table(spark, data)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == plain_components(data)
    assert sum(not r["kept"] for r in got) > 5


def test_near_empty(spark):
    assert near_dedup.near_dups(table(spark, [])).count() == 0
    got = near_dedup.near_dups(table(spark, [(None, None, None, None, None, None)])).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got] == [(None, 0, None, True)]


def test_prefix_pairs_lose_nothing(spark):
    """All links between sets of different roots are among the candidates, without any buckets."""
    texts = [r[1] for r in rows(8) if r[1] and r[1].strip()]
    sets = near_dedup.shingle_sets([t.encode() for t in texts])
    seen = {near_dedup.set_id(s): s for s in sets}
    frame = spark.createDataFrame([(bytearray(k), bytearray(k), bytearray(s.tobytes()), *near_dedup.parity(s).tolist()) for k, s in seen.items()], "fp binary, root binary, set binary, " + ", ".join(f"{c} long" for c in near_dedup.ODD))
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in near_dedup.prefix_pairs(frame).collect()}
    keys = list(seen)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = set(seen[a].tolist()), set(seen[b].tolist())
            if 100 * len(x & y) >= 85 * len(x | y):
                assert frozenset((a, b)) in got


def test_signatures_of_small_sets():
    """Densified signatures of near-equal small sets agree in about as many places as the sets do."""
    rnd = random.Random(1)
    a = near_dedup.shingle_sets([" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(24)).encode()])[0]
    sig = near_dedup.signatures([a, a[:-1]])
    assert 0.75 < (sig[0] == sig[1]).mean() <= 1
    assert (sig != 0).all()


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}


def plain_substrings(data, depth=100):
    docs = sorted({(r[0], r[1]) for r in data}, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if b[i : i + depth] in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(b[i : i + depth])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()] = True
    return set(out)


@pytest.mark.parametrize("hot", [2, 5000])
def test_substrings(spark, hot):
    data = [r for r in rows(6) if "another" not in (r[1] or "")]
    got = substring_dedup.dedup_substrings(table(spark, data), hot_classes=hot).collect()
    assert len(got) == len(data)
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_substrings(data)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_substrings_unique_ids_and_empty(spark):
    data = [r for r in rows(7)[:90] if r[0] is not None]
    got = substring_dedup.dedup_substrings(table(spark, data)).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_substrings(data)
    assert substring_dedup.dedup_substrings(table(spark, [])).count() == 0


def test_induced_sort_spills(tmp_path):
    import numpy as np

    rnd = random.Random(2)
    for _ in range(150):
        t = np.array([rnd.randrange(rnd.choice([1, 2, 3, 200])) for _ in range(rnd.randint(1, 150))], np.uint8)
        raw = t.tobytes()
        assert list(induced_sort.suffix_order(t, 10**6, str(tmp_path), 64)) == sorted(range(len(t)), key=lambda i: raw[i:])
    assert not list(tmp_path.iterdir())
