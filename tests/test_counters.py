"""Token counters of the caller's, events that can't be written, mentions and batches of a stream."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from packspark.functions import signals
from packspark.functions import text as T
from packspark.operators import anchors as A
from packspark.operators import pack as P
from packspark.streaming import events as E


@pytest.fixture
def by_words():
    T.use_counter(T.encoder_counter(lambda: lambda text: len(text.split())), "words")
    yield
    T.use_counter()


def test_counter_of_the_caller(spark, by_words):
    texts = ["one two three", "", None, "x" * 100]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")
    assert [r["n"] for r in frame.orderBy("query_id").select(T.tokens("query").alias("n")).collect()] == [3, 0, None, 1]
    assert T.token_method() == "words"
    assert {r["query_id"]: r["signals"]["query_tokens"] for r in signals.analyze(frame).collect()} == {0: 3, 1: 0, 2: 0, 3: 1}
    kept = spark.createDataFrame([(1, 0, "a", 1, 2, "two words", 1.0, "r", True), (1, 0, "b", 1, 2, "now three words", 0.5, "r", False)], "query_id long, tier_rank int, path string, start_line int, end_line int, content string, score double, reason string, is_must boolean")
    limits = spark.createDataFrame([(1, 4)], "query_id long, budget_limit int")
    assert P.pack(kept, limits).first()["budget_used"] == 2
    T.use_counter()
    assert T.token_method() == "chars/4" and spark.range(1).select(T.tokens(F.lit("abcdefgh"))).first()[0] == 2


def test_wrong_events_are_raised(spark, tmp_path):
    bad = spark.createDataFrame([(1,)], "a int").select(F.raise_error(F.lit("wrong event")).cast("int").alias("a"))
    with pytest.raises(PySparkException):
        E.append(bad, f"{tmp_path}/log")
    (tmp_path / "file").write_text("x")
    E.append(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/file/below")  # no folder there


def test_a_batch_that_is_tried_again_is_logged_once(spark, tmp_path):
    row = (1.0, "e", "q")
    source = spark.createDataFrame([row], "timestamp double, event string, query_id string")
    source.write.json(f"{tmp_path}/in")
    for check in ("a", "b"):  # another checkpoint: the same batch number comes again
        stream = spark.readStream.schema(source.schema).json(f"{tmp_path}/in")
        E.for_each_batch(stream, f"{tmp_path}/log", f"{tmp_path}/{check}").awaitTermination()
    assert [(r["event"], r["query_id"]) for r in E.read_log(spark, f"{tmp_path}/log").collect()] == [("e", "q")]


def test_mentions_against_plain_rules(spark):
    paths = ["src/a/file.py", "file.py", "b/myfile.py", "file.pyi", "deep/x/y.ts", "x/y.ts", "ax/y.ts", "é/ñ.md", ".hidden"]
    asked = ["file.py", "./file.py", "a/file.py", "x/y.ts", "y.ts", "..", "ñ.md", "other/file.py", "missing", "\\x\\y.ts"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    mentions = spark.createDataFrame(list(enumerate(asked)), "query_id long, mention string")
    want = set()
    for q, m in enumerate(asked):
        m = m.replace("\\", "/").lstrip("./")
        want |= {(q, p) for p in paths if p.endswith(m) or p.rsplit("/", 1)[-1] == m.rsplit("/", 1)[-1]}
    got = A.resolve_mentions(mentions, frame).collect()
    assert {(r["query_id"], r["path"]) for r in got} == want and len(got) == len(want)
