"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. A document's set is its distinct shingles of five words; documents with the same set form one
   class, and only classes go on.
2. Each class gets a one-permutation MinHash signature of BINS bins; empty bins borrow from a bin
   that a universal hash picks (optimal densification). Bands of the signature are bucket keys.
3. In each bucket every member is a candidate of the bucket's smallest member only: a star, so a
   bucket of n gives n - 1 pairs. Candidates are confirmed on their full sets.
4. Stars alone would lose a link between two members that both differ from the hub. Buckets whose
   members are not all connected by now are completed exactly: their classes are joined on the
   shingles of their prefixes in order of rarity, with the length and position bounds that the
   threshold allows (a prefix-filter similarity join). Only pairs of different components are
   formed, and again confirmed on full sets.
5. Components of all confirmed links, as tables; nothing is collected.

The threshold is NUMERATOR / DENOMINATOR unless the caller gives another numerator. A pair at
threshold t misses all BANDS buckets with probability (1 - t^ROWS)^BANDS: below 1e-10 at 0.85, below
1e-7 at 0.80.

Null and empty texts, and texts of blanks, have an empty set and link with nothing; texts of fewer
than five words have one shingle, the whole sequence; repeated rows are in one class; a null doc_id
can be linked but is nobody's representative (alone, its component is null and it is kept). Very long
texts are handled whole, one at a time; ties between hubs are broken by their keys, so reruns agree; an
empty table gives an empty table. Only doc_id and text are read, so other columns may be called anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import arrow_udf, discard, every_place, join_facts, one_place, places, release, row_key, stash
from packspark.llm.graph import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 85, 100
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: A table of class keys is broadcast up to so many rows (48 bytes each), else shuffled.
BROADCAST_ROWS = 200_000
#: 64-bit words of the parity bitmap that bounds the difference of two sets from below.
PARITY_WORDS = 8
#: Bytes of text that one vectorised step takes.
STEP_BYTES = 1 << 18

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_PLACE = mix64(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | _U(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = _U(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("up", _BASE), ("down", inverse)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(data: np.ndarray, blanks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (maximal runs of bytes that aren't blanks) of a byte array, and their starts."""
    blank = blanks[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    lowered = [t.lower() for t in texts]  # bytes: A-Z only
    data = np.frombuffer(b"\n".join(lowered), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    words, start = word_hashes(data)
    cut = np.concatenate(([0], np.searchsorted(start, ends)))
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        runs = mix64(sum((words[k : k + n] * _PLACE[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            k = b - a
            out.append(mix64((words[a:b] * _PLACE[:k]).sum(keepdims=True) + _U(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def steps(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lists of texts of about STEP_BYTES together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STEP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def donors(attempts: int = 4096) -> np.ndarray:
    """Which bin an empty bin asks at each attempt: the same for all documents."""
    at = np.arange(attempts * BINS, dtype=np.uint64).reshape(attempts, BINS)
    return (mix64(at + _U(77)) % _U(BINS)).astype(np.int64)


_DONORS = donors()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation signatures with optimal densification; all sets non-empty."""
    shift = _U(64 - BINS.bit_length() + 1)
    floor = np.arange(BINS, dtype=np.uint64) << shift
    sig, full = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(s, floor), len(s) - 1)
        sig[i] = s[at]
        full[i] = s[at] >> shift == np.arange(BINS, dtype=np.uint64)
    row, col = np.nonzero(~full)
    for ask in _DONORS:
        if not len(row):
            break
        donor = ask[col]
        ok = full[row, donor]
        sig[row[ok], col[ok]] = sig[row[ok], donor[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row, col, strict=True):  # 4096 misses: the next full bin
        sig[r, c] = sig[r, (c + 1 + np.argmax(np.roll(full[r], -c - 1))) % BINS]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    weights = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * _U(31)) | _U(1)
    return mix64((parts * weights).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _BASE)


def set_id(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix64(s ^ _U(0x5BF0_3635)).sum(dtype=np.uint64)).to_bytes(8, "big")


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of PARITY_WORDS * 64 places in which each element flips one: where two bitmaps
    differ in d places, the sets differ in d elements at least."""
    bits = np.bincount((mix64(s) % _U(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for chunk in steps(x or b"" for x in (v.as_py() for v in batch.column("raw"))):
            sets = shingle_sets(chunk)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = iter(bands(signatures([sets[i] for i in full])).view(np.int64) if full else ())
            rows = batch.slice(at, len(chunk))
            at += len(chunk)
            yield pa.RecordBatch.from_arrays(
                [
                    *[rows.column(c) for c in ("doc_id", "t1", "t2")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "t1", "t2", "n", "fp", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for chunk in steps(x or b"" for x in (v.as_py() for v in batch.column("raw"))):
            sets = shingle_sets(chunk)
            odd = np.stack([parity(s) for s in sets], 1)
            yield pa.RecordBatch.from_arrays([batch.column("fp").slice(at, len(chunk)), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, odd)], names=["fp", "set", *ODD])
            at += len(chunk)


ODD = [f"odd{i}" for i in range(PARITY_WORDS)]


def _linked(numerator: int) -> Callable[..., Column]:
    """Whether two full sets reach the threshold."""

    @arrow_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.searchsorted(y, x)
            common = int((y[np.minimum(both, len(y) - 1)] == x).sum())
            out.append(DENOMINATOR * common >= numerator * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return linked


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    A hub is in as many pairs as its buckets have members, so its set is sent to several places; in
    ``need``, if pairs have it, stands to how many.
    """
    if "need" not in pairs.columns:
        pairs = pairs.withColumn("need", F.lit(1))
    hubs = pairs.groupBy("a").agg(F.max("need").alias("most")).withColumn("at", every_place(F.col("most"))).drop("most")
    left = hubs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a")
    right = pairs.withColumn("at", one_place(F.col("need"), "b")).join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    return right.join(left, ["a", "at"]).filter(_linked(numerator)("x", "y")).select("a", "b")


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fp, root, raw in zip(*[batch.column(c) for c in ("fp", "root", "set")], strict=True):
            s = np.frombuffer(raw.as_py(), np.int64)
            k = pa.array(np.zeros(len(s), np.int32))
            take = lambda v: pa.array([v.as_py()], pa.binary()).take(k)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([take(fp), take(root), pa.array(np.full(len(s), len(s))), pa.array(s)], names=["fp", "root", "n", "h"])


def prefix_pairs(sets: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """Candidate pairs (a, b) among sets (fp, root, set, parity bitmap) of different roots: all that
    can reach the threshold, found on the prefixes of the sets in order of rarity.

    Sets x and y, x no larger, need a common part of o = ceil(r / (1 + r) * (|x| + |y|)). In one
    order of all shingles they then share one at a place of at most |x| - o in x and |y| - o in y.
    Shingles that one set alone has can't be shared; they only count as the first places. Parity
    bitmaps that differ in more places than the sets may differ in elements rule a pair out.
    """
    rows = sets.select("fp", "root", "set").mapInArrow(_explode_sets, "fp binary, root binary, n long, h long")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    spent = F.col("n") - F.size("hs")
    width = F.col("n") - F.ceil(F.col("n") * numerator / DENOMINATOR) + 1
    prefixes = (
        rows.join(often, "h")
        .groupBy("fp", "root", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("hs"))
        .filter(spent < width)
        .join(sets.select("fp", *ODD), "fp")
        .select("fp", "root", "n", *ODD, spent.alias("spent"), F.posexplode(F.slice("hs", F.lit(1), (width - spent).cast("int"))))
        .select("fp", "root", "n", *ODD, (F.col("spent") + F.col("pos")).alias("at"), F.col("col.h").alias("h"), places(F.col("col.f")).alias("need"))
    )
    prefixes = stash(prefixes, "prefixes")
    release(sets.sparkSession)
    # Components meet first, each with the bounds of its members, so that the members of one are never
    # compared with each other, however many share a shingle. Most have one member, whose bounds decide.
    room = F.col("n") - F.col("at")
    groups = prefixes.groupBy("h", "root").agg(F.max("need").alias("need"), F.count(F.lit(1)).alias("members"), F.min("fp").alias("fp"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(room).alias("room"), *[F.min(c).alias(c) for c in ODD])
    groups = stash(groups, "groups")
    own = lambda s, *more: [F.col(c).alias(f"{c}_{s}") for c in ("root", "fp", "members", "low", "high", "room", *ODD)] + list(more)
    x, y = groups.select("h", *own("x"), one_place(F.col("need"), "root").alias("place")), groups.select("h", *own("y"), every_place(F.col("need")).alias("place"))

    def able(low: Column, room_x: Column, room_y: Column, few: tuple[Column, Column], many: tuple[Column, Column]) -> Column:
        o = F.ceil(low * numerator / (numerator + DENOMINATOR))
        sizes = (many[0] * DENOMINATOR >= few[1] * numerator) & (many[1] * DENOMINATOR >= few[0] * numerator)
        return sizes & (room_x >= o) & (room_y >= o)

    apart = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in ODD), F.lit(0))

    def close(n: Column) -> Column:
        return apart <= n - 2 * F.ceil(n * numerator / (numerator + DENOMINATOR))

    c = F.col
    both = able(c("low_x") + c("low_y"), c("room_x"), c("room_y"), (c("low_x"), c("low_y")), (c("high_x"), c("high_y")))
    single = (c("members_x") == 1) & (c("members_y") == 1)
    met = x.join(y, (x["h"] == y["h"]) & (x["place"] == y["place"]) & (c("root_x") < c("root_y")) & both & (~single | close(c("low_x") + c("low_y"))))
    met = stash(met.select(x["h"].alias("h"), single.alias("single"), *[c(f"{k}_{s}") for s in "xy" for k in ("root", "fp", "members", "low", "high", "room", *ODD)]), "met")
    release(sets.sparkSession)
    # Members of components that have several meet the other component's bounds, which are exact where
    # it has one member; else that one's members.
    swap = c("members_x") == 1
    side = lambda k, s, t: F.when(swap, c(f"{k}_{t}")).otherwise(c(f"{k}_{s}")).alias(f"{k}_{s}")
    many = met.filter(~c("single")).select("h", side("root", "x", "y"), *[side(k, "y", "x") for k in ("root", "fp", "members", "low", "high", "room", *ODD)])
    x, y = (prefixes.select(c("h").alias(f"h_{s}"), *[c(k).alias(f"{k}_of_{s}" if k == "root" else f"{k}_{s}") for k in ("root", "fp", "n", "at", *ODD)]) for s in "xy")
    bound = able(c("n_x") + c("low_y"), c("n_x") - c("at_x"), c("room_y"), (c("n_x"), c("low_y")), (c("n_x"), c("high_y")))
    one = x.join(many, (c("h_x") == c("h")) & (c("root_of_x") == c("root_x")) & bound & ((c("members_y") > 1) | close(c("n_x") + c("low_y"))))
    n = c("n_x") + c("n_y")
    fits = able(n, c("n_x") - c("at_x"), c("n_y") - c("at_y"), (c("n_x"), c("n_y")), (c("n_x"), c("n_y"))) & close(n)
    rest = one.filter("members_y > 1").select("h", "root_y", "fp_x", "n_x", "at_x", *[f"{k}_x" for k in ODD])
    two = rest.join(y, (c("h_y") == c("h")) & (c("root_of_y") == c("root_y")) & fits)
    pairs = one.filter("members_y = 1").select(c("fp_x").alias("a"), c("fp_y").alias("b")).unionByName(two.select(c("fp_x").alias("a"), c("fp_y").alias("b")))
    pairs = stash(met.filter("single").select(c("fp_x").alias("a"), c("fp_y").alias("b")).unionByName(pairs).distinct(), "pairs")
    discard(prefixes, groups, met)
    release(sets.sparkSession)
    return pairs


def links(df: DataFrame, numerator: int = NUMERATOR) -> tuple[DataFrame, DataFrame]:
    """(sketch, components): a row (doc_id, t1, t2, n, fp) for each row of df (doc_id, text), and
    (fp, root) for each class that is linked with another."""
    k1, k2 = row_key("text")
    keyed = df.select("doc_id", k1.alias("t1"), k2.alias("t2"), F.col("text").cast("binary").alias("raw"))
    sketch = stash(keyed.mapInArrow(_sketch, "doc_id long, t1 long, t2 long, n long, fp binary, bands array<long>"), "sketch")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("one")
    buckets = sketch.filter("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands")).select("fp", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("hub"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    members = stash(buckets.join(shared, "key").select("key", "fp", "n", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hub_n"), "rows"), "members")

    # The full sets of the classes that share a bucket, from the text of one document of each.
    wanted = members.select("fp").distinct().join(sketch.filter("n > 0").groupBy("fp").agg(one), "fp").select("fp", F.col("one.doc_id").alias("id"), "one.t1", "one.t2")
    wanted = stash(wanted, "wanted")
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = keyed.join(F.broadcast(wanted) if small else wanted, ["t1", "t2"]).filter(F.col("doc_id").eqNullSafe(F.col("id"))).select("fp", "raw")
    sets = stash(rows.mapInArrow(_sets, ", ".join(["fp binary, set binary", *[f"{c} long" for c in ODD]])).dropDuplicates(["fp"]), "sets")
    discard(wanted)

    possible = (F.least("n", "hub_n") * DENOMINATOR) >= (F.greatest("n", "hub_n") * numerator)
    star = members.filter(possible & (F.col("fp") != F.col("hub"))).groupBy(F.col("hub").alias("a"), F.col("fp").alias("b")).agg(F.max(places(F.col("rows"))).alias("need"))
    found = stash(confirm(star, sets, numerator), "links")
    release(df.sparkSession)
    roots = components(found)
    discard(found)

    rooted = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    rest = stash(rooted.join(open_, "key", "left_semi").select("fp", "root").distinct(), "open")
    more = stash(confirm(prefix_pairs(sets.join(rest, "fp"), numerator), sets, numerator), "links")
    discard(sets, members)
    release(df.sparkSession)
    named = roots.withColumnRenamed("node", "fp")
    if not more.isEmpty():
        # What is linked already counts as its root, so only few edges meet here.
        ends = more.join(rest.select(F.col("fp").alias("a"), F.col("root").alias("u")), "a").join(rest.select(F.col("fp").alias("b"), F.col("root").alias("v")), "b")
        again = components(ends.select("u", "v")).select(F.col("node").alias("fp"), F.col("root").alias("over"))
        joined = named.unionByName(again.select("fp", F.col("fp").alias("root"))).groupBy("fp").agg(F.min("root").alias("root"))
        named = joined.join(again.select(F.col("fp").alias("root"), "over"), "root", "left").select("fp", F.coalesce("over", "root").alias("root"))
    discard(rest, more)
    return sketch, named


def near_dups(df: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """For each row of df (doc_id, text): doc_id, n_shingles, component_id, kept, t1 and t2 (hashes of
    the text), and representative: whether the row is the first of its component by doc_id (null
    last), then t1, t2 (of repeated rows all are)."""
    sketch, linked = links(df.select("doc_id", "text"), numerator)
    classes = sketch.filter("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("first"), F.count(F.lit(1)).alias("_rows"))
    rooted = stash(classes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"), F.sum("_rows").alias("all"), F.count(F.lit(1)).alias("_rows")).filter("all > 1").drop("all")
    least = stash(least, "components")
    named = stash(join_facts(rooted.withColumnRenamed("_rows", "copies"), least, ["root"]).select("fp", "component", F.col("copies").alias("_rows")), "named")
    discard(rooted, least)
    release(df.sparkSession)
    out = join_facts(sketch.drop("bands"), named, ["fp"], "left")
    own = F.col("component.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("component.t1") == F.col("t1")) & (F.col("component.t2") == F.col("t2"))
    alone = F.col("component").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component.doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "t1", "t2", (alone | own).alias("representative"))
