"""Substring dedup of a passage that stands in many documents in different surroundings."""

import random

import pytest
from test_dedup import plain_substrings

from packspark.llm import substring_dedup


def test_hot_strings_are_not_dealt_by_their_bytes(spark, monkeypatch):
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(110)
    data = [(i, noise(rnd.randint(60, 160)) + passage + noise(rnd.randint(60, 160))) for i in range(60)]
    data += [(100 + i, noise(300)) for i in range(5)]
    sent = []

    def no_rows(docs, blocks, real=substring_dedup.hot_repeats):
        out = real(docs, blocks)
        sent.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "hot_repeats", no_rows)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = substring_dedup.dedup_substrings(frame, hot_classes=20).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == plain_substrings(data)
    assert sent and sent[0] >= 59 * 11  # each later place of the passage's 11 strings, by the aggregation


@pytest.mark.parametrize("n", [0, 3])
def test_strings_are_hashed_in_place(n):
    import pyarrow as pa

    raw = bytes(range(200))
    batch = pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([7], pa.int64()), pa.array([[5 << 14 | n << 7]], pa.list_(pa.int64()))], names=["raw", "d", "todo"])
    (out,) = substring_dedup._strings(iter([batch]))
    assert out.column("lo").to_pylist() == list(range(5, 6 + n)) and set(out.column("d").to_pylist()) == {7}
    assert len(set(zip(out.column("h1").to_pylist(), out.column("h2").to_pylist(), strict=True))) == n + 1
