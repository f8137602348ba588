"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code point order (null last) get weights 1, 2, 3, repeating, and share all
words in that proportion; no target passes ``max_epochs`` times its source's size, and what such
a cap leaves over is shared by the others by weight until none is above its cap.

Taking: a source whose target is e times its size and a part is taken e whole times; the part
comes from its documents in the order of their exponential keys -ln(u)/w, where u is a hash of
document and seed and w the document's quality weight. A document is taken if more than half of
it fits under the rest of the budget, so a source misses its target by half a document at most.

No group is sorted whole: keys are placed on a line of 2^LINE_BITS places, and for each source the
place where its budget ends is found by counting: one aggregation sums the words of each (source,
range of places), the range in which the budget ends is cut further, until it holds at most
``bin_rows`` rows or is a single place. Only that range is ordered; all other documents are decided
by their place. So no task holds much of a source, whatever weights its documents have.
Targets are made from one row a source, in one task (its sorts go to disk if they must).

Null text has size 0 and is taken 0 words; a null source is a source of its own; a source without
words has target 0; repeated rows count each for itself, rows that differ in any column are
different rows; equal keys are ordered by doc_id, then by hashes of the row; texts of any length are
counted whole. An empty table gives an empty table. Extra columns pass through ``mix`` as they are,
whatever they are called; ``decide`` returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspark.llm.common import WORD, discard, join_facts, row_key, stash, unused

MAX_EPOCHS = 3
BIN_ROWS = 20_000
SEED = 20_24
#: Places on the line of keys' logarithms, and by how many bits a range is cut at once.
LINE_BITS, CUT_BITS = 46, 10
LEAST_LOG, LOGS = -40, 64  # of -ln(u)/w with 48 bits of u and w of 0.05 or more, with room


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column | str) -> Column:
    """A document's weight in (0, 1]: the share of letters and spaces in its characters, at least 0.05."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.length(F.translate(text, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ""))
    return F.greatest(F.lit(0.05), F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.05)))


def exponential_key(weight: Column, *identity: Column | str, seed: int = SEED) -> Column:
    """-ln(u)/w with u in (0, 1) from a hash of the identity: small keys come first."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]).cast("binary")), 1, 12)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))) / weight


def targets(sizes: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from a table of sources with their sizes (one row each).

    Water filling in closed form: with sources ordered by cap/weight, the level is the first at
    which the words that the capped ones leave, divided by the weight of the rest, is below the
    next cap/weight.
    """
    everyone = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighted = sizes.withColumn("weight", ((F.row_number().over(everyone) - 1) % 3 + 1).cast("double"))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("bound", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("bound", F.col("source").isNull(), F.col("source").cast("binary"))
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = weighted.withColumns({"nth": F.row_number().over(rising), "level": level})
    # The level only means something where it is at most the row's own bound; the first such row sets
    # it (the first by place: behind it, sources of the same bound would count as capped).
    found = levelled.withColumn("level", F.min(F.when(F.col("level") <= F.col("bound"), F.struct("nth", "level"))).over(Window.partitionBy())["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return found.select("source", "source_size", target.alias("target"))


def place_of(key: Column) -> Column:
    """The place of a key on the line: the larger the key, the further on."""
    step = float((1 << LINE_BITS) / LOGS)
    at = F.floor((F.log(F.greatest(key, F.lit(1e-300))) - LEAST_LOG) * step)
    return F.least(F.lit((1 << LINE_BITS) - 1), F.greatest(F.lit(0), at)).cast("long")


_SOURCE = ["_none", "_source"]  # a source as a key that is never null


def _here(shift: str = "_shift") -> Column:
    return F.expr(f"shiftright(_place_of_key, {shift})")


def budget_ends(keyed: DataFrame, plan: DataFrame, bin_rows: int) -> DataFrame:
    """For each source of plan (_rows, rest: the words to take from its order of keys): the range of
    places in which rest ends (_prefix: what places there have in front, _shift: how many bits are
    left, inside: how many rows), and what is left of rest where the range begins."""
    state = stash(plan.select(*_SOURCE, "_rows", F.col("_rows").alias("inside"), F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("_prefix"), F.lit(LINE_BITS).alias("_shift")), "mix-ends")
    for shift in range(LINE_BITS - CUT_BITS, -CUT_BITS, -CUT_BITS):
        shift = max(0, shift)
        open_ = F.expr(f"rest > 0 AND inside > {int(bin_rows)}")
        if state.filter(open_).isEmpty():
            break
        there = join_facts(keyed, state.filter(open_), _SOURCE).filter(_here() == F.col("_prefix"))
        sums = there.groupBy(*_SOURCE, F.expr(f"shiftright(_place_of_key, {shift})").alias("_cut")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        running = Window.partitionBy(*_SOURCE).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        at = before.join(state.filter(open_).select(*_SOURCE, "_rows", "rest"), _SOURCE)
        # The budget ends in the range that brings the words to it.
        end = at.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        cut = end.select(*_SOURCE, "_rows", F.col("n").alias("inside"), (F.col("rest") - F.col("before")).alias("rest"), F.col("_cut").alias("_prefix"), F.lit(shift).alias("_shift"))
        old, state = state, stash(state.filter(~open_).unionByName(cut), "mix-ends")
        discard(old)
        if not shift:
            break
    return state


def decide(df: DataFrame, weight: Column | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, bin_rows: int = BIN_ROWS) -> DataFrame:
    """A row for each row of df (doc_id, text, source): _k1 and _k2 (hashes of the whole row),
    doc_id, source, size, source_size, target, copies, and taken (words of it in the mix)."""
    k1, k2 = row_key(*[F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes])
    weight = quality_weight("text") if weight is None else weight
    # A small table (no text) that everything else is decided on.
    key = exponential_key(weight, "doc_id", "text", seed=seed)
    keyed = df.select("doc_id", "source", k1.alias("_k1"), k2.alias("_k2"), word_count("text").alias("size"), key.alias("_key"))
    keyed = stash(keyed.withColumns({"_place_of_key": place_of(F.col("_key")), "_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}), "mix-keys")
    sizes = stash(keyed.groupBy(*_SOURCE).agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "mix-sizes")
    goal = targets(sizes.select("source", "source_size"), max_epochs).select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = goal.join(sizes.select(*_SOURCE, "_rows"), _SOURCE).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = stash(plan, "mix-plan")
    ends = budget_ends(keyed, plan, bin_rows)
    facts = stash(plan.drop("rest").join(ends.drop("_rows", "inside"), _SOURCE, "left"), "mix-facts")
    discard(sizes, plan, ends)
    at = join_facts(keyed, facts, _SOURCE)
    # Where nothing is to be taken (or, behind the last range, all is), no range has been found.
    inside = (F.col("rest") > 0) & (_here() == F.col("_prefix"))
    sure = at.filter(~F.coalesce(inside, F.lit(False))).withColumn("more", F.coalesce((F.col("rest") > 0) & (_here() < F.col("_prefix")), F.lit(False)))
    order = Window.partitionBy(*_SOURCE).orderBy("_key", "doc_id", "_k1", "_k2").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 < F.col("rest")
    both = sure.unionByName(at.filter(inside).withColumn("more", fits))
    copies = F.col("epochs") + F.col("more").cast("long")
    return both.select("_k1", "_k2", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(df: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every row of df as often as it is taken, with its columns as they are.

    Of rows that are equal in all columns one stands for all and comes as often as they do.
    """
    a, b, rows, copies, nth = unused(df, "_k1", "_k2", "_rows", "_copies", "_nth")
    k1, k2 = row_key(*[F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes])
    taken = decide(df, **options).groupBy(F.col("_k1").alias(a), F.col("_k2").alias(b)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    taken = stash(taken.filter(F.col(copies) > 0), "mix-taken")
    out = df.withColumns({a: k1, b: k2}).join(taken, [a, b])
    if not taken.filter(F.col(rows) > 1).isEmpty():
        again = out.filter(F.col(rows) > 1).dropDuplicates([a, b])
        out = out.filter(F.col(rows) == 1).unionByName(again)
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in df.columns])


#: The same by DuckDB, with each source ordered whole.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 281474976710656)
    / greatest(CAST(0.05 AS DOUBLE), coalesce(CAST(length(translate(text, '0123456789!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')) AS DOUBLE) / nullif(length(text), 0), CAST(0.05 AS DOUBLE))) AS k
  FROM documents
),
s AS (
  SELECT source, sum(size) AS n, CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source
),
b AS (SELECT *, CAST(3 * n AS DOUBLE) AS cap, CAST(3 * n AS DOUBLE) / w AS bound FROM s),
l AS (
  SELECT *, (sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY bound, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY bound, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY bound, source IS NULL, encode(source)) AS nth
  FROM b
),
t AS (
  SELECT source, n, least(cap, (SELECT arg_min(level, nth) FROM l WHERE level <= bound) * w) AS target FROM l
),
r AS (
  SELECT d.doc_id, d.source, d.size, t.n AS source_size, t.target, floor(t.target / nullif(t.n, 0)) AS e,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (coalesce(e, 0) + CASE WHEN before + CAST(size AS DOUBLE) / 2 < target - coalesce(e, 0) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
