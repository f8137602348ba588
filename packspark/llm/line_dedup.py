"""Line dedup: repeated windows of three consecutive lines are removed but for their first place.

Every window of three lines is hashed (128 bits); windows that occur more than once anywhere are
found by one aggregation, which first combines within each task, so that a window that a third
of all documents share stays cheap. Each later occurrence covers its three lines; a document
loses the union of what is covered. Windows are judged on the input, not on what is left.

Occurrences are ordered by doc_id (null last), then a hash of the text, then line number. Windows
whose three lines are all blank don't count. Repeated rows (equal doc_id and text) are one
document: they add no occurrence and get the same result. Null text stays null with 0 lines; a
text of fewer than three lines stays as it is; a text that loses all lines becomes empty.
Everything is column expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import join_facts, let, row_key, stash, unused

WIDTH = 3


def _window_hashes(lines: Column) -> Column:
    """(position, hash, second hash) of each window of three lines that isn't all blank."""
    at = lambda i, d: F.get(lines, i + F.lit(d))
    both = lambda i: F.struct(
        i.alias("at"),
        F.xxhash64(*[at(i, d) for d in range(WIDTH)]).alias("w1"),
        F.xxhash64(F.lit("second"), *[at(i, d) for d in range(WIDTH)]).alias("w2"),
        F.concat(*[at(i, d) for d in range(WIDTH)]).rlike(r"\S").alias("solid"),
    )
    starts = F.when(F.size(lines) >= WIDTH, F.sequence(F.lit(0), F.size(lines) - WIDTH)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, both), lambda w: w["solid"])


def removed_lines(df: DataFrame) -> DataFrame:
    """k1, k2 of each document of df (k1, k2, order, lines) that loses lines, with the sorted numbers
    (from 0) of those lines. A window that very many documents share is dealt to several places."""
    windows = df.select("k1", "k2", "order", F.explode(_window_hashes(F.col("lines"))).alias("w")).select("k1", "k2", "w.w1", "w.w2", F.struct("order.*", F.col("w.at").alias("at")).alias("place"))
    repeated = windows.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("_rows")).filter("first <> last")
    later = join_facts(windows, stash(repeated.drop("last"), "windows"), ["w1", "w2"]).filter("place > first")
    covered = F.flatten(F.transform(F.collect_set("place.at"), lambda p: F.array(*[p + d for d in range(WIDTH)])))
    return later.groupBy("k1", "k2").agg(F.sort_array(F.array_distinct(covered)).alias("removed"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with ``text`` freed of repeated windows, and n_lines, n_removed, n_spans (columns of
    these names are replaced; all others pass through, whatever they are called)."""
    k1, k2 = row_key(doc_id, text)
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), k1.alias("k1"), k2.alias("k2"))
    lines = F.split(F.col(text), "\n", -1)
    a, b, off = unused(df, "_k1", "_k2", "_removed")
    keyed = df.withColumns({a: k1, b: k2})
    removed = removed_lines(df.select(k1.alias("k1"), k2.alias("k2"), order.alias("order"), lines.alias("lines")))
    joined = keyed.join(removed.toDF(a, b, off), [a, b], "left")
    gone = F.coalesce(F.col(off), F.array().cast("array<int>"))
    n = F.coalesce(F.size(lines), F.lit(0))
    left = let(lines, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)))
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) < x - 1))
    return joined.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(n).cast("long"),
            "n_removed": F.size(gone).cast("long"),
            "n_spans": F.size(starts).cast("long"),
            text: F.when(F.size(gone) == 0, F.col(text)).otherwise(F.array_join(left, "\n")),
        }
    ).drop(a, b, off)


#: The same by DuckDB, which compares the lines themselves.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, text, p, ls[p] AS a, ls[p + 1] AS b, ls[p + 2] AS c
  FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) - 1)) AS p FROM d)
),
o AS (
  SELECT doc_id, text, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, p) AS nth
  FROM w WHERE regexp_matches(a || b || c, '\S')
),
gone AS (
  SELECT DISTINCT doc_id, text, unnest([p, p + 1, p + 2]) AS p FROM o WHERE nth > 1
),
l AS (
  SELECT doc_id, text, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d
),
m AS (
  SELECT l.doc_id, l.text, l.p, l.line, g.p IS NOT NULL AS off,
         lag(g.p IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id, l.text ORDER BY l.p) AS off_before
  FROM l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.p = g.p
),
r AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (off) AS n_removed,
         count(*) FILTER (off AND NOT off_before) AS n_spans,
         coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT off), '') AS kept
  FROM m GROUP BY doc_id, text
)
SELECT doc_id, n_lines, n_removed, n_spans, kept AS text FROM r
"""
