"""Keyword retrieval: matching lines, merged context ranges, chunks, the best of each query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspark.functions import text as T
from packspark.operators.candidates import TIERS, candidates
from packspark.settings import Settings
from packspark.sources.workspace import Corpus

#: Distinct keywords that go to every task at once; more of them are matched in several passes.
KEYWORD_BLOCK = 2_000
#: Ranges (of some 100 bytes, no text) that are sent to every task; more of them are shuffled.
BROADCAST_RANGES = 50_000


def query_keywords(queries: DataFrame, extra: str | None = None) -> DataFrame:
    """query_id, ord (from 1), kw, match (what lines are searched for) of each query."""
    words = T.keywords(F.coalesce(F.col("query"), F.lit("")), F.col(extra) if extra else None)
    return queries.select("query_id", F.posexplode(words).alias("ord", "kw")).select("query_id", (F.col("ord") + 1).alias("ord"), "kw")


def line_hits(lines: DataFrame, keywords: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(query_id, path, line_no, total): lines that contain a keyword of the query.

    Substrings rule an equi-join out, so distinct keywords, which come from the query batch and
    don't grow with the corpus, are sent to the lines in blocks; each line is tested once for each
    of them, whatever the number of queries, and hits are joined back to the queries by keyword.
    """
    match = F.col("kw") if case_sensitive else F.lower("kw")
    wanted = keywords.select("query_id", match.alias("m")).distinct()
    words = sorted(r["m"] for r in wanted.select("m").distinct().collect())
    line = "line" if case_sensitive else "line_lower"
    found = None
    for k in range(0, max(1, len(words)), KEYWORD_BLOCK):
        block = F.array(*[F.lit(w) for w in words[k : k + KEYWORD_BLOCK]]).cast("array<string>")
        here = lines.select("path", "line_no", "total", F.explode(F.filter(block, lambda w: F.contains(F.col(line), w))).alias("m"))
        found = here if found is None else found.unionByName(here)
    return found.join(wanted, "m").select("query_id", "path", "line_no", "total").distinct()


def _present(words: Column) -> Callable[[Column], Column]:
    return lambda text: F.filter(words, lambda w: F.contains(text, w))


def file_hits(files: DataFrame, keywords: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(query_id, path, total, m, nums): the lines in which a file has a keyword of a query, for the
    keywords it has.

    Lines never become rows: each file is first tested as a whole for each distinct keyword, its lines
    only for the keywords that it has, and what leaves the scan are numbers.
    """
    match = F.col("kw") if case_sensitive else F.lower("kw")
    wanted = keywords.select("query_id", match.alias("m")).distinct()
    words = sorted(r["m"] for r in wanted.select("m").distinct().collect())
    text, lines = (F.col("content"), F.col("lines")) if case_sensitive else (F.lower("content"), F.transform("lines", F.lower))
    found = None
    for k in range(0, max(1, len(words)), KEYWORD_BLOCK):
        block = F.array(*[F.lit(w) for w in words[k : k + KEYWORD_BLOCK]]).cast("array<string>")
        here = T.let(text, _present(block))
        numbers = lambda ls, w: F.filter(F.transform(ls, lambda x, i: F.when(F.contains(x, w), i + 1)), lambda n: n.isNotNull())
        hits = T.let(lines, lambda ls: F.transform("_here", lambda w: F.struct(w.alias("m"), numbers(ls, w).alias("nums"))))
        some = files.withColumn("_here", here).filter(F.size("_here") > 0)
        each = some.select("path", F.size("lines").alias("total"), F.explode(hits).alias("_h")).select("path", "total", "_h.m", "_h.nums")
        found = each if found is None else found.unionByName(each)
    return found.join(wanted, "m").select("query_id", "path", "total", "m", "nums")


def hit_ranges(hits: DataFrame, context: int) -> DataFrame:
    """(query_id, path, start_line, end_line, keyword_match) of file_hits(): merged ranges with context
    lines around them, and how many of the query's keywords each has."""
    gap = 2 * context + 1
    per = hits.groupBy("query_id", "path").agg(F.max("total").alias("total"), F.collect_list(F.struct("m", "nums")).alias("_hits"))
    starts = lambda at: F.filter(at, lambda x, i: (i == 0) | (x - F.get(at, i - 1) > gap))
    ends = lambda at: F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - x > gap))
    lines = F.array_sort(F.array_distinct(F.flatten("_hits.nums")))
    ranges = T.let(lines, lambda at: F.arrays_zip(starts(at).alias("a"), ends(at).alias("b")))
    one = per.select("query_id", "path", "total", "_hits", F.explode(ranges).alias("_r")).select("query_id", "path", "total", "_hits", F.col("_r").getField("a").alias("a"), F.col("_r").getField("b").alias("b"))
    inside = F.size(F.filter("_hits", lambda h: F.exists(h["nums"], lambda n: (n >= F.col("a")) & (n <= F.col("b")))))
    return one.select("query_id", "path", F.greatest(F.lit(1), F.col("a") - context).alias("start_line"), F.least(F.col("total"), F.col("b") + context).alias("end_line"), inside.cast("double").alias("keyword_match"))


def islands(hits: DataFrame, context: int) -> DataFrame:
    """Merged ranges (query_id, path, start_line, end_line) of hits with context lines around them.

    Two hits share a range iff their ranges touch, that is if they are at most 2 * context + 1 apart.
    """
    w = Window.partitionBy("query_id", "path").orderBy("line_no")
    new = F.when(F.col("line_no") - F.lag("line_no").over(w) > 2 * context + 1, 1).otherwise(0)
    numbered = hits.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = numbered.groupBy("query_id", "path", "_island").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"), F.max("total").alias("total"))
    return ranges.select("query_id", "path", F.greatest(F.lit(1), F.col("a") - context).alias("start_line"), F.least(F.col("total"), F.col("b") + context).alias("end_line"))


def chunks(ranges: DataFrame, files: DataFrame, keywords: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Grep candidates of ranges; keyword_match is how many keywords the snippet has."""
    match = F.col("kw") if case_sensitive else F.lower("kw")
    per_query = keywords.groupBy("query_id").agg(F.collect_set(match).alias("_kws"))
    at = ranges.join(files.select("path", "lines"), "path").join(per_query, "query_id")
    at = at.withColumn("content", T.snippet(F.col("lines"), F.col("start_line"), F.col("end_line")))
    body = F.col("content") if case_sensitive else F.lower("content")
    n = F.size(F.filter("_kws", lambda w: F.contains(body, w)))
    return candidates(at, TIERS["grep"], "grep", "content", keyword=n)


def top(found: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` candidates of each query: most keywords, then path, then line."""
    w = Window.partitionBy("query_id").orderBy(F.desc("keyword_match"), "path", "start_line")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def grep(queries: DataFrame, corpus: Corpus, settings: Settings | None = None, limit: int | None = None) -> DataFrame:
    """Keyword search of every query over the corpus: ranges are found and the best chosen as numbers,
    then the text of the chosen is fetched."""
    settings = settings or Settings()
    limit = settings.max_grep_candidates if limit is None else limit
    words = query_keywords(queries)
    best = top(hit_ranges(file_hits(corpus.files, words, settings.case_sensitive), settings.grep_context_lines), limit)
    # At most ``limit`` rows a query: sent to the files if the batch is small, else joined by path.
    small = limit * words.select("query_id").distinct().count() <= BROADCAST_RANGES
    at = corpus.files.select("path", "lines").join(F.broadcast(best) if small else best, "path")
    text = at.withColumn("content", T.snippet(F.col("lines"), F.col("start_line"), F.col("end_line")))
    return candidates(text, TIERS["grep"], "grep", "content", keyword=F.col("keyword_match"))
