"""Suffix-array dedup: repeated strings of DEPTH bytes are removed but for their first place.

All texts as UTF-8 bytes; a byte goes if it is covered by a string of DEPTH bytes that also starts
earlier (smaller doc_id, or same document and earlier start). No document and no shard needs to
hold the others: strings meet by content-defined anchors.

1. Every string of DEPTH bytes has one anchor: of its substrings of GRAM bytes the one with the
   least hash (the leftmost at a tie). Equal strings have equal anchors, at the same place. Strings
   that follow each other mostly share their anchor; a maximal run of them is a block, and about
   DEPTH - GRAM bytes apart lies the next. Blocks, not bytes, are what is shuffled.
2. Blocks with equal anchors and equal bytes form a class; in all its places but the first the
   whole block goes. Anchors that occur once need no more work.
3. Anchors with several classes may share strings across them. The first block of each such class
   is cut in two, so that all strings of a part also have the SIDE bytes before or behind the anchor
   in common, and goes with its bytes to the shard of that longer anchor. Parts whose longer anchor
   nothing else has are dropped there; the others are sorted by external induced sorting
   (``induced_sort``), which yields the sets of equal strings. Strings of an anchor with very many
   classes (a frequent phrase) are sent as hashes with their places instead: an aggregation, which
   first combines within each task, finds the first place of each string that repeats, and the
   later places are joined with it.
4. What goes from a document is merged, and the rest is joined up.

Results are exact up to collisions of 128-bit hashes in step 2 and for anchors with very many
classes; the sort of step 3 compares bytes.

Null text counts as empty. If a doc_id is null or stands in several rows, documents are first
numbered by (doc_id, null last, then hashes of the text); rows with equal doc_id and text are one
document, so they share one result and are no copies of each other. Texts of any length are cut into
blocks whole; texts shorter than DEPTH bytes lose nothing; equal places can't tie, as documents are
numbered; an empty table gives an empty table. Only doc_id and text are read, so other columns may be
called anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.llm import induced_sort
from packspark.llm.common import discard, join_facts, release, row_key, stash
from packspark.llm.near_dedup import _BYTE, _U, _powers, mix64, steps

DEPTH = 100
GRAM = 32
SPAN = DEPTH - GRAM + 1  # grams in a string, and the most strings in a block
SIDE = (DEPTH - GRAM) // 2
#: Classes of one anchor beyond which its strings are aggregated by their hashes.
HOT_CLASSES = 5_000
SHARD_BYTES = 16 << 20
SORT_BUDGET = 64 << 20


def blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first string, last string, anchor, anchor hash, block hash) of all blocks."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    n = len(data) - DEPTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    gram = mix64((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    # Hash above, place below: the least of a range is the leftmost of its least hashes.
    least = (gram >> _U(32) << _U(32)) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while reach * 2 <= SPAN:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < SPAN:
        least = np.minimum(least[: reach - SPAN], least[SPAN - reach :])
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)[:n]
    inside = np.arange(n) + DEPTH <= end[owner]
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    lo = np.flatnonzero(edge)
    hi = np.concatenate((lo[1:], [n])) - 1
    keep = inside[lo]
    lo, hi = lo[keep], hi[keep]
    at = anchor[lo]
    whole = (total[hi + DEPTH] - total[lo]) * down[lo]
    b = mix64(whole + mix64((hi - lo).astype(np.uint64) * _U(1 << 20) + (at - lo).astype(np.uint64)))
    first = (end - size)[owner[lo]]
    return owner[lo], lo - first, hi - first, at - first, gram[at].view(np.int64), b.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, base = np.array(batch.column("d")), 0
        for chunk in steps(v.as_py() or b"" for v in batch.column("raw")):
            owner, lo, hi, at, a, b = blocks(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(docs[base + owner]), pa.array(lo << 14 | (hi - lo) << 7 | (at - lo))], names=["a", "b", "d", "at"])
            base += len(chunk)


#: at: place of the first string, number of strings after it (7 bits), place of the anchor after it (7).
BLOCK_DDL = "a long, b long, d long, at long"


def _key(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of blocks, by their longer anchors."""
    for batch in batches:
        for raw, d, todo in zip(*[batch.column(c) for c in ("raw", "d", "todo")], strict=True):
            raw, d, shard, lo, seg = raw.as_py(), d.as_py(), [], [], []

            def add(key: bytes, first: int, last: int, raw: bytes = raw, out: tuple = (shard, lo, seg)) -> None:
                if first <= last:
                    for column, value in zip(out, (_key(key), first, raw[first : last + DEPTH]), strict=True):
                        column.append(value)

            for x in todo.as_py():
                start = x["at"] >> 14
                stop, anchor = start + (x["at"] >> 7 & 127), start + (x["at"] & 127)
                add(raw[anchor - SIDE : anchor + GRAM] + b"<", start, min(stop, anchor - SIDE))
                add(raw[anchor : anchor + GRAM + SIDE] + b">", max(start, anchor - SIDE + 1), stop)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([d] * len(lo), pa.int64()), pa.array(lo, pa.int64()), pa.array(seg, pa.binary())], names=["shard", "d", "lo", "seg"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of blocks of hot anchors: 128 bits of hash and the place of each."""
    for batch in batches:
        for raw, d, todo in zip(*[batch.column(c) for c in ("raw", "d", "todo")], strict=True):
            raw, d, todo = raw.as_py(), d.as_py(), todo.as_py()
            for k in range(0, len(todo), 1_000):
                lo = [p for at in todo[k : k + 1_000] for p in range(at >> 14, (at >> 14) + (at >> 7 & 127) + 1)]
                h = np.frombuffer(b"".join(hashlib.blake2b(raw[p : p + DEPTH], digest_size=16).digest() for p in lo), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.full(len(lo), d, np.int64)), pa.array(lo, pa.int64())], names=["h1", "h2", "d", "lo"])


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of the strings of a shard that have an earlier equal one in it."""
    held_batches = list(batches)
    if not held_batches:
        return
    rows = pa.Table.from_batches(held_batches)
    _, number, count = np.unique(np.array(rows["shard"]), return_inverse=True, return_counts=True)
    rows = rows.filter(pa.array(count[number] > 1))
    d, p = np.array(rows["d"]), np.array(rows["lo"])
    stream = ((x, len(x) - DEPTH + 1) for chunk in rows["seg"].chunks for v in chunk for x in [v.as_py()])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for segment, offset in induced_sort.groups(stream, DEPTH, SORT_BUDGET):
        who, at = d[segment], p[segment] + offset
        order = np.lexsort((at, who))[1:]
        out.append((who[order], at[order]))
        held += len(order)
        if held > 200_000:
            yield _merged(out)
            out, held = [], 0
    if out:
        yield _merged(out)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Starts of strings as ranges of bytes, neighbours joined."""
    d, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, d))
    d, at = d[order], at[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (at[1:] > at[:-1] + DEPTH)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(at[first]), pa.array(at[last] + DEPTH)], names=["d", "lo", "hi"])


def numbered(df: DataFrame) -> tuple[DataFrame, bool]:
    """df (doc_id, text) as rows (d, doc_id, raw), where d orders documents as the contract does,
    and whether every d stands in one row."""
    t1, t2 = row_key("text")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    ids = df.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return df.select(F.col("doc_id").cast("long").alias("d"), "doc_id", raw), True
    keys = df.select("doc_id", t1.alias("t1"), t2.alias("t2")).distinct()
    order = stash(keys.orderBy(F.col("doc_id").asc_nulls_last(), "t1", "t2").withColumn("d", F.monotonically_increasing_id()), "numbers")
    named = order.withColumnsRenamed({"doc_id": "_id", "t1": "_t1", "t2": "_t2"})
    rows = df.select("doc_id", t1.alias("t1"), t2.alias("t2"), raw)
    return rows.join(named, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))).select("d", "doc_id", "raw"), False


def hot_repeats(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(d, lo, hi) of the strings of blocks (d, at) that have an earlier equal one among them."""
    todo = blocks.groupBy("d").agg(F.collect_list("at").alias("todo"))
    strings = stash(docs.select("d", "raw").join(todo, "d").mapInArrow(_strings, "h1 long, h2 long, d long, lo long"), "strings")
    place = F.struct("d", "lo")
    first = stash(strings.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"), "firsts")
    later = join_facts(strings, first, ["h1", "h2"]).filter(place > F.col("first"))
    out = stash(later.select("d", "lo", (F.col("lo") + DEPTH).alias("hi")), "repeats")
    discard(strings, first)
    return out


def removed_ranges(docs: DataFrame, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(d, lo, hi): ranges of bytes that go, which may overlap, for docs (d, raw)."""
    spark = docs.sparkSession
    cut = docs.select("d", "raw").mapInArrow(_blocks, BLOCK_DDL)
    seen = cut.groupBy("a").agg(F.min("b").alias("b0"), F.max("b").alias("b1"), F.count(F.lit(1)).alias("n"))
    often = stash(seen.filter("n > 1").select("a", (F.col("b0") != F.col("b1")).alias("multi"), F.col("n").alias("_rows")), "anchors")
    del seen
    release(spark)
    kept = stash(join_facts(cut, often, ["a"]), "blocks")
    discard(often)
    release(spark)

    place = F.struct("d", "at")
    classes = stash(kept.groupBy("a", "b").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.first("multi").alias("multi"), F.count(F.lit(1)).alias("_rows")), "classes")
    again = join_facts(kept, classes.filter("p0 <> p1").select("a", "b", "p0", "_rows"), ["a", "b"]).filter(place != F.col("p0"))
    lo = F.shiftright("at", 14)
    whole = stash(again.select("d", lo.alias("lo"), (lo + F.shiftright("at", 7).bitwiseAND(F.lit(127)) + DEPTH).alias("hi")), "whole")
    del again
    discard(kept)
    release(spark)

    several = classes.filter("multi").select("a", "p0.d", "p0.at")
    hot = stash(several.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_classes).select("a"), "hot")
    any_hot = not hot.isEmpty()
    rest = several.join(hot, "a", "left_anti") if any_hot else several
    todo = rest.groupBy("d").agg(F.collect_list(F.struct("a", "at")).alias("todo"))
    segments = docs.select("d", "raw").join(todo, "d").mapInArrow(_segments, "shard long, d long, lo long, seg binary")
    # One sort a partition, of SHARD_BYTES or so: an anchor that isn't hot has at most hot_classes
    # classes, and each sends one block (in two parts) of less than 3 * DEPTH bytes.
    size = rest.agg(F.sum(F.shiftright("at", 7).bitwiseAND(F.lit(127)) + 1 + 2 * DEPTH)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    repeats = stash(segments.repartition(parts, "shard").mapInArrow(_sorted_repeats, "d long, lo long, hi long"), "repeats")
    if any_hot:
        repeats = repeats.unionByName(hot_repeats(docs, several.join(hot, "a", "left_semi")))
    del several, rest, todo, segments
    discard(classes)
    release(spark)
    return whole.unionByName(repeats)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, ranges in zip(batch.column("raw"), batch.column("ranges"), strict=True):
            raw, merged = raw.as_py(), []
            for r in ranges.as_py() or ():
                if merged and r["lo"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r["hi"])
                else:
                    merged.append([r["lo"], r["hi"]])
            parts, at = [], 0
            for a, b in merged:
                parts.append(raw[at:a])
                at = b
            left = b"".join([*parts, raw[at:]])
            rows.append((len(raw), len(raw) - len(left), len(merged), left, hashlib.sha256(left).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def dedup_substrings(df: DataFrame, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """For each row of df (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept (what is left, as bytes: a cut may fall inside a character), kept_sha256."""
    docs, alone = numbered(df)
    ranges = removed_ranges(docs if alone else docs.dropDuplicates(["d"]), hot_classes)
    by_doc = ranges.groupBy("d").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    return docs.join(by_doc, "d", "left").select("doc_id", "raw", "ranges").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
