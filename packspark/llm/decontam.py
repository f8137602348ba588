"""Benchmark decontamination by latent semantic retrieval.

1. Texts become sequences of hashed words (lower-cased, split at ASCII characters that are no
   letters or digits), stored once in the shared folder.
2. Statistics over all passages of 32 words of all documents: in how many each word occurs.
3. Distributed randomised SVD of the TF-IDF passage matrix A (rows of unit length): each pass, every
   task adds its passages' part of A'(A X), the parts are added up in a tree, and the driver makes the
   result orthonormal (QR) for the next pass. The last pass gives singular values and the latent
   basis. A text is folded in: the sum of its words' rows of V/S, weighed by TF-IDF. The latent
   dimensions alone take passages of one language for much the same, so a random projection of the
   plain TF-IDF vector stands beside them; a cosine is LATENT_SHARE latent, the rest plain.
4. Benchmark items are cut into pieces of at most 64 words. Every window of each document, at the
   width next to a piece's length, is compared with the piece by that cosine, in blocks. Beside
   this, windows that hold enough of a piece's rarest words for the answer check of 5 are candidates
   whatever their cosine: foreign words around an item can't hide it.
5. A candidate counts if the longest common subsequence of words covers LCS_SHARE of the piece
   (so inserted, dropped and replaced words are survived) and, as the answer check, the piece's
   rarest third of words, which carry what is asked and answered, is there to ANSWER_SHARE. In
   candidates of the latent search, the words nearest to a rare word in the latent space may stand
   for it: paraphrases in other words are found by the fitted basis only.
6. Items of fewer than MIN_WORDS words, which can't be told from chance by 4 and 5, are searched
   word for word.

Documents are never reduced or sampled; benchmark items go through in blocks of BLOCK_PIECES
pieces, each one pass over the word sequences, so nothing that is sent grows with the data.

Null and empty texts match nothing, nor do items without words; items with a null id are searched
like others and match with a null item_id (several such items count as one); repeated rows and rows
of equal id match alike; the best match of a document and an item is the one with the largest LCS,
then cosine, then the first; very long texts go through in whole, STEP_WORDS words or one text at a
time; an empty table gives no matches; without items there are none. ``matches`` reads doc_id and
text alone; ``decontaminate`` keeps all columns, whatever they are called.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.llm import near_dedup
from packspark.llm.common import release, row_key, stash, unused

VOCABULARY_BITS = 16
V = 1 << VOCABULARY_BITS
RANK = 32
#: Dimensions of the random projection beside the latent ones, and what the latent cosine counts.
PROJECTION, LATENT_SHARE = 40, 0.35
#: Passes over the passages before the last one; with it, (A'A)^3 is applied to the random start.
POWER_ITERATIONS = 2
CELL = 8
SCALES = (2, 4, 8)  # windows of 16, 32 and 64 words, in cells
PIECE_WORDS = 64
MIN_WORDS = 8
PASSAGE_WORDS = 32
COSINE = 0.55
#: What the logarithmic idf is lowered by: words in more than one of e^2 passages weigh next to nothing.
IDF_FLOOR, IDF_LEAST = 2.0, 0.05
LCS_SHARE = 0.6
ANSWER_SHARE = 0.34
#: Words that may stand for a rare word of a piece: its nearest in the latent space.
SYNONYMS, SYNONYM_COSINE, SYNONYM_PASSAGES = 8, 0.9, 5
BLOCK_PIECES, BLOCK_PHRASES = 2_000, 50_000
BLOCKS = 64  # in how many parts a table of V rows is summed
FAN = 64  # how many tables are added up in one place
SUM_BYTES = 64 << 20  # of words that a task sums up before it sends its table
STEP_WORDS = 100_000
GRAM_WORDS = 1024 * PASSAGE_WORDS

_SPLIT = np.ones(256, bool)
_SPLIT[128:] = False
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _SPLIT[ord(_a) : ord(_b) + 1] = False


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's end among them."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    words, start = near_dedup.word_hashes(np.frombuffer(b" ".join(raw), np.uint8), _SPLIT)
    return words, np.searchsorted(start, np.cumsum([len(t) + 1 for t in raw]))


def word_ids(texts: list[str]) -> list[np.ndarray]:
    """The hashed words (1 to V - 1; 0 is none) of each text."""
    words, cut = _hashes(texts)
    ids = np.maximum(words >> np.uint64(64 - VOCABULARY_BITS), np.uint64(1)).astype(np.uint16)
    return np.split(ids, cut[:-1]) if texts else []


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        texts = (v.as_py() or "" for v in batch.column("text"))
        for chunk in near_dedup.steps(texts):
            rows = batch.slice(at, len(chunk))
            at += len(chunk)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "k1", "k2")], pa.array([x.tobytes() for x in word_ids(chunk)], pa.binary())], names=["doc_id", "k1", "k2", "ids"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(words, offsets of documents, their rows) of about STEP_WORDS words."""
    for batch in batches:
        held, size, first = [], 0, 0
        column = batch.column("ids")
        for i in range(len(batch)):
            held.append(np.frombuffer(column[i].as_py(), np.uint16))
            size += len(held[-1])
            if size >= STEP_WORDS or i == len(batch) - 1:
                yield np.concatenate(held), np.concatenate(([0], np.cumsum([len(h) for h in held]))), batch.slice(first, len(held))
                held, size, first = [], 0, i + 1


def pieces_of(starts: np.ndarray, width: int) -> np.ndarray:
    """Starts of runs of ``width`` words in documents at the given offsets."""
    n = np.diff(starts)
    many = -(-n // width)
    return np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])) * width, many) + np.arange(many.sum()) * width


PART_DDL = "node int, block int, words binary, part binary"


def _parts(table: np.ndarray) -> pa.RecordBatch:
    """A task's table of V rows by blocks of words, without its empty rows."""
    node, rows = TaskContext.get().partitionId(), []
    for k, part in enumerate(np.split(table, BLOCKS)):
        words = np.flatnonzero(part.any(1)).astype(np.uint16)
        rows.append((node, k, words.tobytes(), part[words].tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "block", "words", "part"])


def _summed(df: DataFrame, nodes: int, dtype: type, rank: int) -> np.ndarray:
    """The sum of the tables that ``nodes`` tasks have given in parts: a tree in which a place adds
    FAN tables of V / BLOCKS rows. V rows come to the driver whatever the data."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((V // BLOCKS, rank), dtype)
        for words, part in zip(pdf["words"], pdf["part"], strict=True):
            total[np.frombuffer(words, np.uint16)] += np.frombuffer(part, dtype).reshape(-1, rank)
        words = np.flatnonzero(total.any(1)).astype(np.uint16)
        return pd.DataFrame({"node": [pdf["node"].iloc[0] // FAN], "block": [pdf["block"].iloc[0]], "words": [words.tobytes()], "part": [total[words].tobytes()]})

    while True:
        df = df.groupBy((F.col("node") / FAN).cast("int").alias("over"), "block").applyInPandas(add, PART_DDL)
        nodes = -(-nodes // FAN)
        if nodes <= 1:
            break
    out = np.zeros((BLOCKS, V // BLOCKS, rank), dtype)
    for r in df.select("block", "words", "part").collect():
        out[r["block"]][np.frombuffer(r["words"], np.uint16)] = np.frombuffer(r["part"], dtype).reshape(-1, rank)
    return out.reshape(V, rank)


def summable(tokens: DataFrame) -> tuple[DataFrame, int]:
    """The word sequences in tasks of about SUM_BYTES, and how many tasks: their tables stay a small
    share of the data, and a lost executor costs little."""
    size = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    least = tokens.sparkSession.sparkContext.defaultParallelism
    few = tokens.select("ids").coalesce(max(least, -(-size // SUM_BYTES)))
    return few, few.rdd.getNumPartitions()


def frequencies(few: DataFrame, nodes: int) -> tuple[np.ndarray, int]:
    """In how many passages each word occurs, and how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((V, 1), np.int64)
        for ids, starts, _ in _chunks(batches):
            cut = pieces_of(starts, PASSAGE_WORDS)
            passage = np.zeros(len(ids), np.int64)
            passage[cut[cut > 0]] = 1
            order = np.argsort(ids, kind="stable")  # passages stay in order within a word
            word, at = ids[order], np.cumsum(passage)[order]
            new = np.ones(len(ids), bool)
            new[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1])
            total[:, 0] += np.bincount(word[new], minlength=V)
            total[0, 0] += len(cut)  # no text has word 0
        yield _parts(total)

    df = _summed(few.mapInArrow(count, PART_DDL), nodes, np.int64, 1)[:, 0]
    passages, df[0] = int(df[0]), 0
    return df, passages


def word_weights(df: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray]:
    """What each word weighs in a passage (its idf, lowered by IDF_FLOOR), and the idf itself."""
    idf = np.log((1 + passages) / (1 + df))
    weight = np.maximum(idf - IDF_FLOOR, IDF_LEAST)
    weight[0] = 0
    return weight, idf


def gram_times(ids: np.ndarray, starts: np.ndarray, weight: np.ndarray, x: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A X) of the passages of some documents to total, words' weights aside: x is X times the
    weights, and so must total be in the end. Word 0, which weighs nothing, fills documents' last passages."""
    n = np.diff(starts)
    many = -(-n // PASSAGE_WORDS)
    padded = np.zeros(int(many.sum()) * PASSAGE_WORDS, np.uint16)
    shift = (np.cumsum(many) - many) * PASSAGE_WORDS - starts[:-1]
    padded[np.arange(len(ids)) + np.repeat(shift, n)] = ids
    rank = x.shape[1]
    rows = np.empty((min(GRAM_WORDS, len(padded)), rank), np.float32)
    square = (weight**2).astype(np.float32)
    for k in range(0, len(padded), GRAM_WORDS):
        words = padded[k : k + GRAM_WORDS]
        y = np.take(x, words, axis=0, out=rows[: len(words)], mode="clip").reshape(-1, PASSAGE_WORDS, rank).sum(1)
        y /= np.maximum(square[words].reshape(-1, PASSAGE_WORDS).sum(1), 1e-9)[:, None]  # passages have unit length
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        size = np.diff(np.concatenate((first, [len(words)])))
        back = np.take(y, order // PASSAGE_WORDS, axis=0, out=rows[: len(words)], mode="clip")
        found, often = back[first], size > 8
        for at in range(1, 8):  # the words' second, third, ... places at once
            who = np.flatnonzero((size > at) & ~often)
            found[who] += back[first[who] + at]
        for i in np.flatnonzero(often):
            found[i] = back[first[i] : first[i] + size[i]].sum(0)
        total[words[first]] += found


def _orthonormal(z: np.ndarray) -> np.ndarray:
    return np.linalg.qr(z.astype(np.float64))[0].astype(np.float32)


def svd(times: Callable[[np.ndarray], np.ndarray], rank: int = RANK, iterations: int = POWER_ITERATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (V x rank) and singular values of A, given x -> A'(A x): a random start,
    power iterations with QR between them, and the exact SVD within the space they span."""
    q = np.random.default_rng(seed).standard_normal((V, rank), np.float32)
    for _ in range(iterations):
        q = _orthonormal(times(q))
    z = times(q)
    values, turn = np.linalg.eigh(q.T.astype(np.float64) @ z)
    values = values[::-1]
    return q @ turn[:, ::-1].astype(np.float32), np.sqrt(np.maximum(values, 0))


def fold_in(right: np.ndarray, values: np.ndarray, weight: np.ndarray, seed: int = 8) -> np.ndarray:
    """What each word adds to the vector of a text: its TF-IDF weight times its row of V/S
    (folding-in: each latent dimension varies alike among the passages), and times a random row of
    PROJECTION dimensions, which keeps words apart that the latent ones take for the same."""
    live = values > 1e-3 * max(float(values.max(initial=0)), 1e-9)
    latent = right * np.where(live, 1 / np.maximum(values, 1e-9), 0).astype(np.float32)
    random = np.random.default_rng(seed).standard_normal((V, PROJECTION), np.float32)
    return np.hstack((latent, random)) * weight[:, None].astype(np.float32)


def unit(x: np.ndarray, latent: int) -> np.ndarray:
    """Vectors whose product is LATENT_SHARE times the cosine of the first ``latent`` dimensions plus
    the rest times that of the others; a part without length counts as 0."""
    out = np.array(x, np.float32)
    for part, share in ((out[:, :latent], LATENT_SHARE), (out[:, latent:], 1 - LATENT_SHARE)) if latent else ((out, 1.0),):
        part *= (share**0.5 / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9))[:, None]
    return out


def synonyms(words: np.ndarray, terms: np.ndarray, df: np.ndarray) -> dict[int, list[int]]:
    """For each word the at most SYNONYMS nearest by the cosine of their rows of V S (in what
    passages words stand), among words of SYNONYM_PASSAGES passages or more: fewer say nothing."""
    able = np.flatnonzero(df >= SYNONYM_PASSAGES)
    words = words[df[words] >= SYNONYM_PASSAGES]
    if not len(words) or len(able) < 2:
        return {}
    rows = terms / np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-12)
    others, out = rows[able].T, {}
    for k in range(0, len(words), 32):
        block = words[k : k + 32]
        near = rows[block] @ others
        near[block[:, None] == able] = -1
        best = np.argpartition(-near, min(SYNONYMS, near.shape[1] - 1), axis=1)[:, :SYNONYMS]
        for w, at, cosine in zip(block.tolist(), best, np.take_along_axis(near, best, 1), strict=True):
            if found := able[at[cosine >= SYNONYM_COSINE]].tolist():
                out[w] = found
    return out


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a piece, given as bit masks of its words'
    places, and words (bit-parallel, one addition a word)."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return length - v.bit_count()


class Pieces:
    """Benchmark pieces as they are sent to the tasks."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], table: np.ndarray, idf: np.ndarray, latent: int = 0, near: Callable[[np.ndarray], dict[int, list[int]]] | None = None):
        self.latent = latent
        self.items = [r[0] for r in rows]
        self.words = [r[2] for r in rows]
        self.masks = []
        self.rare: list[set[int]] = []
        for w in self.words:
            masks: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << i
            self.masks.append(masks)
            distinct = sorted(set(w.tolist()), key=lambda x: (-idf[x], x))
            self.rare.append(set(distinct[: max(1, len(distinct) // 3)]))
        # With what may stand for the rarest words: places in the piece, and which rare word it is.
        alike = near(np.unique(np.array([w for r in self.rare for w in r], np.int64))) if near else {}
        self.soft: list[dict[int, int]] = []
        self.stands: list[dict[int, int]] = []
        for masks, rare in zip(self.masks, self.rare, strict=True):
            soft, stands = dict(masks), {}
            for i, w in enumerate(sorted(rare)):
                for x in (w, *alike.get(w, ())):
                    stands[x] = stands.get(x, 0) | 1 << i
                    if x != w:
                        soft[x] = soft.get(x, 0) | masks[w]
            self.soft.append(soft)
            self.stands.append(stands)
        # The rarest words by number, with the pieces that have them, and how many of them a piece needs.
        pairs = sorted((w, p) for p, rare in enumerate(self.rare) for w in rare)
        self.rare_piece = np.array([p for _, p in pairs], np.int64)
        self.rare_count = np.bincount([w for w, _ in pairs], minlength=V)
        self.rare_first = np.cumsum(self.rare_count) - self.rare_count
        self.need = np.array([math.ceil(ANSWER_SHARE * len(r)) for r in self.rare], np.int64)
        self.vectors = unit(np.stack([table[w].sum(0) for w in self.words]), latent)
        self.size = size = np.array([len(w) for w in self.words])
        self.at = {s: np.flatnonzero((size > (s * CELL * 5 // 8 if s > SCALES[0] else 0)) & (size <= (s * CELL * 5 // 4 if s < SCALES[-1] else 1 << 30))) for s in SCALES}


def rare_places(ids: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(piece, place) of each occurrence of a piece's rarest words, in order."""
    at = np.flatnonzero(pieces.rare_count[ids])
    n = pieces.rare_count[ids[at]]
    row = np.repeat(pieces.rare_first[ids[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    piece = pieces.rare_piece[row]
    order = np.argsort(piece, kind="stable")
    return piece[order], np.repeat(at, n)[order]


def rare_windows(piece: np.ndarray, place: np.ndarray, starts: np.ndarray, pieces: Pieces, who: np.ndarray, scale: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, cell in it, piece) of at least all windows of a scale that have enough of the
    rarest words of one of the pieces ``who``; cells may lie behind the document's last window."""
    ok = np.zeros(len(pieces.size), bool)
    ok[who] = True
    ok = ok[piece]
    piece, place = piece[ok], place[ok]
    doc = np.searchsorted(starts, place, side="right") - 1
    to = np.arange(len(piece)) + pieces.need[piece] - 1
    inside = np.minimum(to, len(piece) - 1)
    half = pieces.size[piece] // 2
    ok = (to < len(piece)) & (piece[inside] == piece) & (doc[inside] == doc) & (place[inside] - place < scale * CELL + 2 * half)
    piece, doc, half, first, last = piece[ok], doc[ok], half[ok], (place - starts[doc])[ok], (place[inside] - starts[doc])[ok]
    low = np.maximum(0, (last - scale * CELL - half) // CELL + 1)
    high = (first + half) // CELL // step * step
    many = np.maximum(0, (high - low) // step + 1)
    cell = np.repeat(high, many) - (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * step
    return np.repeat(doc, many), cell, np.repeat(piece, many)


def find(ids: np.ndarray, starts: np.ndarray, pieces: Pieces, table: np.ndarray) -> Iterator[tuple[int, int, int, int, float, float]]:
    """(document number, piece, first word, last word + 1, cosine, share of the LCS) of matches."""
    n = np.diff(starts)
    per = -(-n // CELL)
    cells = pieces_of(starts, CELL)
    if not len(cells):
        return
    padded = np.zeros(int(per.sum()) * CELL, np.uint16)
    word = np.zeros(len(padded), bool)  # and not a place behind a document's end
    at = np.arange(len(ids)) + np.repeat((np.cumsum(per) - per) * CELL - starts[:-1], n)
    padded[at], word[at] = ids, True
    sums = np.zeros((len(cells) + 1, table.shape[1]), np.float32)
    rows = np.empty((min(len(padded), CELL << 11), table.shape[1]), np.float32)
    for k in range(0, len(padded), len(rows)):
        held = np.take(table, padded[k : k + len(rows)], axis=0, out=rows[: len(padded) - k], mode="clip")
        held[~word[k : k + len(rows)]] = 0
        held.reshape(-1, CELL, held.shape[1]).sum(1, out=sums[1 + k // CELL : 1 + (k + len(held)) // CELL])
    np.cumsum(sums, axis=0, out=sums)
    last = np.repeat(np.cumsum(per), per)  # the cell behind the cell's document
    first = last - np.repeat(per, per)
    doc = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(cells))
    piece, place = rare_places(ids, pieces)
    for scale in SCALES:
        who = pieces.at[scale]
        if not len(who):
            continue
        step = max(1, scale // 4)
        window = ((number - first) % step == 0) & ((number + scale <= last) | (number == first) | (number + scale - step < last))
        at = number[window]
        seen_at, cell, p = rare_windows(piece, place, starts, pieces, who, scale, step)
        inside = cell < per[seen_at]
        cell, p = (cell + np.cumsum(per)[seen_at] - per[seen_at])[inside], p[inside]
        keys = [(cell * len(pieces.items) + p)[window[cell]]]
        near = []
        for k in range(0, len(at), 20_000):
            a = at[k : k + 20_000]
            x = unit(sums[np.minimum(a + scale, last[a])] - sums[a], pieces.latent)
            cosines = x @ pieces.vectors[who].T
            some = np.flatnonzero(cosines.max(1) >= COSINE)
            i, j = np.nonzero(cosines[some] >= COSINE)
            near.append(a[some[i]] * len(pieces.items) + who[j])
        near = np.concatenate(near) if near else np.zeros(0, np.int64)
        close = set(near.tolist())
        for key in np.unique(np.concatenate((*keys, near))).tolist():
            a, p = divmod(key, len(pieces.items))
            b = min(a + scale, int(last[a]))
            d, m = doc[a], len(pieces.words[p])
            # What surrounds the window by half a piece belongs to it, within the document.
            lo = max(starts[d], cells[a] - m // 2)
            hi = min(starts[d + 1], (cells[b] if b < last[a] else starts[d + 1]) + m // 2)
            seen = ids[lo:hi].tolist()
            # Words of similar company count for rare ones only where the latent search has led.
            held = len(pieces.rare[p].intersection(seen))
            if key in close:
                bits, stands = 0, pieces.stands[p]
                for w in stands.keys() & seen:
                    bits |= stands[w]
                held = max(held, bits.bit_count())
            if held < ANSWER_SHARE * len(pieces.rare[p]):
                continue
            share = lcs(pieces.soft[p] if key in close else pieces.masks[p], m, seen) / m
            if share >= LCS_SHARE:
                x = unit((sums[b] - sums[a])[None], pieces.latent)[0]
                yield int(d), p, int(lo - starts[d]), int(hi - starts[d]), float(x @ pieces.vectors[p]), share


def _items(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, int, np.ndarray]]]:
    """Blocks of (item, piece number, words) of the items of MIN_WORDS words or more."""

    def pieces() -> Iterator[tuple[int | None, int, np.ndarray]]:
        for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
            ids = word_ids([r["t"] or ""])[0]
            if len(ids) >= MIN_WORDS:
                for k, part in enumerate(np.array_split(ids, -(-len(ids) // PIECE_WORDS))):
                    yield r["i"], k, part

    source = pieces()
    while block := list(itertools.islice(source, BLOCK_PIECES)):
        yield block


def _phrases(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Blocks of (item, 64-bit word hashes) of the items of fewer than MIN_WORDS words."""

    def short() -> Iterator[tuple[int | None, np.ndarray]]:
        for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
            words, _ = _hashes([r["t"] or ""])
            if 0 < len(words) < MIN_WORDS:
                yield r["i"], words

    source = short()
    while block := list(itertools.islice(source, BLOCK_PHRASES)):
        yield block


def run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * (near_dedup.mix64(np.array([k + 1], np.uint64)) | np.uint64(1))
    return near_dedup.mix64(total + np.uint64(n))


def exact_phrases(docs: DataFrame, block: list[tuple[int | None, np.ndarray]]) -> DataFrame:
    """Where short items stand word for word in docs (doc_id, k1, k2, text): MATCH_DDL, with cosine
    and lcs 1 (up to collisions of 64-bit hashes)."""
    sizes = sorted({len(w) for _, w in block})
    keys = {n: np.array([run_keys(w, n)[0] for _, w in block if len(w) == n]) for n in sizes}
    items = {n: [i for i, w in block if len(w) == n] for n in sizes}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text in enumerate(batch.column("text")):
                words, _ = _hashes([text.as_py() or ""])
                for n in sizes:
                    runs = run_keys(words, n)
                    hit = np.flatnonzero(np.isin(runs, keys[n]))
                    first = dict(zip(runs[hit][::-1].tolist(), hit[::-1].tolist(), strict=True))
                    rows += [(d, item, first[key], first[key] + n) for key, item in zip(keys[n].tolist(), items[n], strict=True) if key in first]
            if rows:
                d, item, start, end = zip(*rows, strict=True)
                own = [batch.column(c).take(pa.array(d)) for c in ("doc_id", "k1", "k2")]
                ones = pa.array([1.0] * len(d))
                yield pa.RecordBatch.from_arrays([*own, pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), ones, ones], names=MATCH_NAMES)

    return docs.mapInArrow(search, MATCH_DDL)


MATCH_DDL = "doc_id long, k1 long, k2 long, item_id long, start long, end long, cosine double, lcs double"
MATCH_NAMES = [x.split()[0] for x in MATCH_DDL.split(", ")]


def latent_model(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], dict[int, list[int]]]]:
    """What each word adds to a text's vector (V x (RANK + PROJECTION)), its idf, and the words that
    are like given ones."""
    spark = tokens.sparkSession
    few, nodes = summable(tokens)
    df, passages = frequencies(few, nodes)
    weight, idf = word_weights(df, passages)
    light = weight.astype(np.float32)

    def times(x: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(x * light[:, None])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((V, RANK), np.float32)
            for ids, starts, _ in _chunks(batches):
                if len(ids):
                    gram_times(ids, starts, light, sent.value, total)
            yield _parts(total)

        out = _summed(few.mapInArrow(add, PART_DDL), nodes, np.float32, RANK) * light[:, None]
        sent.unpersist()
        release(spark)
        return out

    right, values = svd(times)
    return fold_in(right, values, weight), idf, lambda words: synonyms(words, right * values.astype(np.float32), df)


def matches(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The best match of each document (doc_id, text) and benchmark item: doc_id, k1, k2 (hashes of
    doc_id and text), item_id, start and end (words), cosine, lcs."""
    spark: SparkSession = docs.sparkSession
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1, k2, "text")
    tokens = stash(keyed.mapInArrow(_tokenise, "doc_id long, k1 long, k2 long, ids binary"), "words")
    table, idf, near = latent_model(tokens)
    sent = spark.sparkContext.broadcast(table)  # once, whatever the number of blocks
    found = spark.createDataFrame([], MATCH_DDL)
    for block in _items(benchmark, item_id, item_text):
        pieces = Pieces(block, table, idf, RANK, near)

        def search(batches: Iterator[pa.RecordBatch], pieces: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            for ids, starts, rows in _chunks(batches):
                hits = list(find(ids, starts, pieces, sent.value)) if len(ids) else []
                if hits:
                    d = pa.array([h[0] for h in hits])
                    keep = [rows.column(c).take(d) for c in ("doc_id", "k1", "k2")]
                    rest = [pa.array([pieces.items[h[1]] for h in hits], pa.int64()), *[pa.array([h[i] for h in hits], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()), (5, pa.float64()))]]
                    yield pa.RecordBatch.from_arrays([*keep, *rest], names=MATCH_NAMES)

        found = found.unionByName(tokens.mapInArrow(search, MATCH_DDL))
    for block in _phrases(benchmark, item_id, item_text):
        found = found.unionByName(exact_phrases(keyed, block))
    best = F.max(F.struct("lcs", "cosine", (-F.col("start")).alias("start"), "end")).alias("m")
    return found.groupBy("doc_id", "k1", "k2", "item_id").agg(best).select("doc_id", "k1", "k2", "item_id", (-F.col("m.start")).alias("start"), "m.end", F.round("m.cosine", 4).alias("cosine"), "m.lcs")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) without the documents that match an item."""
    a, b = unused(docs, "_k1", "_k2")
    hits = matches(docs.select("doc_id", "text"), benchmark).select("k1", "k2").distinct().toDF(a, b)
    k1, k2 = row_key("doc_id", "text")
    return docs.withColumns({a: k1, b: k2}).join(hits, [a, b], "left_anti").drop(a, b)
