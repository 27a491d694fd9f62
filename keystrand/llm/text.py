"""Vectorised kernels over the bytes of Arrow string columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; letters A-Z are lower-cased.
Every kernel works on whole texts.  Long ones are worked through in segments, so that what is held
beside the text itself is a few bytes for each of its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE_AFTER = re.compile("[^ ](?= )")
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n + 1:
        size = max(n, _SEGMENT + (1 << 16)) + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def _segments(data: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + _SEGMENT, n)
        while end < n and not gaps[data[end]]:
            step = min(n, end + 4096)
            gap = np.flatnonzero(gaps[data[end:step]])
            end = end + int(gap[0]) if len(gap) else step
        yield at, end
        at = end


def word_spans(offsets: np.ndarray, data: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first (n+1 entries).

    With other ``gaps``, the runs between these bytes instead of words."""
    n = len(data)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, _SEGMENT):
        b = min(n, a + _SEGMENT)
        solid = np.zeros(b - a + 2, bool)  # with the bytes before and after
        solid[1:-1] = ~gaps[data[a:b]]
        solid[0], solid[-1] = a > 0 and not gaps[data[a - 1]], b < n and not gaps[data[b]]
        edge = np.zeros(b - a + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        starts.append(np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1])) + a)
        ends.append(np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + a + 1)
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.searchsorted(first, offsets)


def word_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Words in each text."""
    return np.diff(word_spans(offsets, data)[2])


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = True, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the first index of each text (n+1)."""
    starts, ends, first = word_spans(offsets, data, gaps)
    out = np.empty(len(starts), np.uint64)
    done = 0
    for a, b in _segments(data, gaps):
        k = int(np.searchsorted(starts, b))
        if k == done:
            continue
        up, down = _power(b - a)
        values = (LOWER[data[a:b]] if lower else data[a:b]).astype(np.uint64)
        values += np.uint64(1)
        values *= up[: b - a]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        s = starts[done:k] - a
        h = sums[ends[done:k] - a]
        h -= sums[s]
        h *= down[s]
        out[done:k] = h
        done = k
    return mix(out), first


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within one text, and where each starts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h *= np.uint64(_BASE)
            h += words[j : j + n]
    crosses = np.zeros(len(words) + 1, bool)
    for j in range(1, size):
        at = first[1:-1] - j
        crosses[at[at >= 0]] = True
    # a text shorter than the window is crossed by starts in it or before it
    inside = np.flatnonzero(~crosses[:n])
    return mix(h[inside]), inside


def groups_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and in that order whether a key is the first of its kind."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, new


def pieces(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A long text in parts that begin at a space after another character; most texts are one part."""
    at = 0
    while len(text) - at > most:
        found = _SPACE_AFTER.search(text, at + most)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


class Known:
    """Values of words met before, bounded in bytes: two generations of half the bytes each.  A word
    that is asked for again moves to the younger; when that is full it becomes the older."""

    def __init__(self, most: int, entry: int) -> None:
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.held, self.most, self.entry = 0, most, entry

    def add(self, wanted: set[str], learn: Callable[[list[str]], Iterable[tuple[str, Any]]]) -> Callable[[str], Any]:
        """Makes sure that all wanted words have a value; returns the way to look them up."""
        if self.held > self.most // 2:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        new = [w for w in wanted if w not in young]
        self.held += sum(map(len, new)) + self.entry * len(new)
        unknown = []
        for w in new:
            value = old.get(w)
            if value is None:
                unknown.append(w)
            else:
                young[w] = value
        young.update(learn(unknown))
        return young.__getitem__


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each (one row at least)."""
    offsets, _ = string_buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


class Lookup:
    """An open-addressing table from distinct 64-bit keys to their positions, probed in bulk."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.slot_key = np.zeros(1 << self.bits, np.uint64)
        self.slot_at = np.full(1 << self.bits, -1, np.int32)
        pending = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(pending):
            free = self.slot_at[slot] < 0
            self.slot_at[slot[free]] = pending[free]
            lost = self.slot_at[slot] != pending
            pending, slot = pending[lost], (slot[lost] + 1) & self.mask
        used = self.slot_at >= 0
        self.slot_key[used] = keys[self.slot_at[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is absent."""
        slot = self._slot(keys)
        at = self.slot_at[slot]
        miss = np.flatnonzero((self.slot_key[slot] != keys) & (at >= 0))
        slot = slot[miss]
        while len(miss):
            slot = (slot + 1) & self.mask
            found = self.slot_at[slot]
            at[miss] = found
            again = (found >= 0) & (self.slot_key[slot] != keys[miss])
            miss, slot = miss[again], slot[again]
        return at
