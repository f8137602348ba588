"""External induced sorting: the suffix order of a byte string on disk, deep enough for a given depth.

The string lies in a memory-mapped file. Suffixes are classed as larger or smaller than the next
one. A first sweep sorts the leftmost-smaller (LMS) substrings and names them; the order of the LMS
suffixes is that of the string of names, which is sorted by doubling (not by the same sort again, as
its alphabet is too large for a queue a letter). A second sweep induces all others from them. A sweep's
work list is a monotone priority queue: tuples wait in the bucket of their first byte, in the order in
which they came, and buckets that outgrow the memory budget go to disk. The arrays of positions, types
and names are in memory, some 40 bytes for each byte of the shard: shards are dealt so small that they
fit. All steps are array operations.

Common prefixes are cut at ``depth``: two suffixes that agree on that many bytes may come in either
order, and ``groups`` reports where neighbours agree on them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np


class BucketQueue:
    """First-in-first-out queues, one for each key; their arrays go to disk beyond a budget."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget, self.held = folder, budget, 0
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.stored: dict[int, str] = {}
        self.serial = 0

    def push(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Append each value to the queue of its key, in the order given."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for part, key in zip(np.split(values, cuts), keys[np.concatenate(([0], cuts))].tolist(), strict=True):
            self.waiting.setdefault(key, []).append(part)
        self.held += values.nbytes
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        for key, parts in self.waiting.items():
            path = self.stored.setdefault(key, os.path.join(self.folder, f"{id(self)}-{key}"))
            with open(path, "ab") as f:
                for p in parts:
                    p.astype(np.int64).tofile(f)
        self.waiting, self.held = {}, 0

    def pop(self, key: int) -> np.ndarray:
        """Everything that waits under a key, in order."""
        parts = []
        if path := self.stored.pop(key, None):
            parts.append(np.fromfile(path, np.int64))
            os.unlink(path)
        waiting = self.waiting.pop(key, [])
        self.held -= sum(p.nbytes for p in waiting)
        parts += waiting
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is larger than the end."""
    n = len(t)
    differs = np.concatenate((t[1:] != t[:-1], [True]))
    # The type of a run of equal bytes is that of its last byte.
    where = np.flatnonzero(differs)
    up = np.concatenate((t[1:] > t[:-1], [False]))[where]
    return np.repeat(up, np.diff(np.concatenate(([-1], where)))).reshape(n)


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, folder: str, budget: int) -> np.ndarray:
    """All suffixes, given the LMS suffixes in the order that they should have within their bytes."""
    seeds = BucketQueue(folder, budget)
    seeds.push(t[lms], lms)
    larger, smaller = BucketQueue(folder, budget), BucketQueue(folder, budget)
    larger.push(t[-1:], np.array([len(t) - 1]))  # the suffix before the end of the string
    found: dict[int, list[np.ndarray]] = {}
    alphabet = np.flatnonzero(np.bincount(t, minlength=256)).tolist()
    for c in alphabet:  # upwards: larger suffixes come from what precedes a sorted suffix
        wave, kept = larger.pop(c), []
        seed = seeds.pop(c)
        while len(wave):
            kept.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            larger.push(t[before], before)
            wave = larger.pop(c)
        found[c] = kept
        before = seed[seed > 0] - 1
        before = before[~small[before]]
        larger.push(t[before], before)
    out: dict[int, np.ndarray] = {}
    for c in reversed(alphabet):  # downwards: smaller suffixes, from the largest on
        wave, kept = smaller.pop(c), []
        while len(wave):
            kept.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            smaller.push(t[before], before)
            wave = smaller.pop(c)
        big = np.concatenate(found[c]) if found[c] else np.zeros(0, np.int64)
        before = big[::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        smaller.push(t[before], before)
        out[c] = np.concatenate([big, *[w[::-1] for w in reversed(kept)]])
    return np.concatenate([out[c] for c in alphabet])


def name_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a string of numbers, right for ``depth`` places, by doubling."""
    rank, reach = names.astype(np.int64), 1
    while True:
        after = np.concatenate((rank[reach:], np.full(min(reach, len(rank)), -1)))[: len(rank)] + 1
        key = rank << 32 | after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty_like(rank)
        rank[order] = new
        reach *= 2
        if reach >= depth or new[-1] == len(rank) - 1:
            return order


def suffix_order(t: np.ndarray, depth: int, folder: str, budget: int) -> np.ndarray:
    """Positions of all suffixes of t (bytes), sorted by their first ``depth`` bytes."""
    if len(t) < 2:
        return np.arange(len(t))
    small = smaller_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        # The first sweep sorts the LMS substrings; equal ones get the same name.
        order = induce(t, small, lms, folder, budget)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        ordered = order[is_lms[order]]
        end = np.concatenate((lms[1:], [len(t) - 1]))
        length = np.zeros(len(t), np.int64)
        length[lms] = end - lms + 1
        same = equal_substrings(t, ordered[:-1], ordered[1:], length)
        names = np.zeros(len(t), np.int64)
        names[ordered] = np.concatenate(([0], np.cumsum(~same)))
        reduced = names[lms]
        if reduced.max() < len(lms) - 1:
            ordered = lms[name_order(reduced, depth)]
        lms = ordered
    return induce(t, small, lms, folder, budget)


def equal_substrings(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings at a and b, of the lengths given by position, are equal."""
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        ok = t[a[live] + k] == t[b[live] + k]
        same[live[~ok]] = False
        live = live[ok]
        k += 1
        live = live[length[a[live]] > k]
    return same


def groups(segments: Iterator[tuple[bytes, int]], depth: int, budget: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment numbers, offsets) of each set of two or more equal strings of ``depth`` bytes.

    segments: (bytes, how many of its first places count as starts); a string never reaches beyond
    its segment. Segments stream to the file, so what is in memory is the sort's own work.
    """
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "text")
        sizes, counts = [], []
        with open(path, "wb") as f:
            for data, n in segments:
                sizes.append(len(data) + 1)
                counts.append(n)
                f.write(data)
                f.write(b"\0")
        if not sizes:
            return
        t = np.memmap(path, np.uint8, "r")
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        valid = np.zeros(len(t), bool)
        for s, n in zip(start.tolist(), counts, strict=True):
            valid[s : s + n] = True
        order = suffix_order(t, depth, folder, budget)
        order = order[valid[order]]
        step = 1 << 18
        run = np.zeros(len(order), bool)  # whether a suffix agrees with the one before it
        width = np.arange(depth)
        for k in range(0, len(order), step):
            rows = order[max(0, k - 1) : k + step]
            w = t[rows[:, None] + width]
            same = (w[1:] == w[:-1]).all(1)
            run[k + (k == 0) : k + len(rows) - (k > 0)] = same
        first = np.flatnonzero(~run)
        size = np.diff(np.concatenate((first, [len(order)])))
        for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            at = order[a : a + n]
            segment = np.searchsorted(start, at, side="right") - 1
            yield segment, at - start[segment]
        del t
