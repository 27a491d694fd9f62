"""Best-fit packing of token sequences by a linear grouping scheme.

Long pieces are sorted and cut into groups of equal cardinality; each is rounded up to the
longest of its group.  The few sizes left form a configuration problem, solved by column
generation (a bounded knapsack prices new configurations); its whole multiples are filled with
the actual pieces of each group, and what is left, with the short pieces, goes best-fit into
the gaps.  Pieces are dealt over blocks of bounded size, and each block is packed by itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

CAPACITY = 2048
GROUPS = 24
#: Pieces over this share of the capacity are long.
LONG = 1 / 3
BLOCK = 1 << 16

# Texts of these characters alone can be split into words here, by one byte for each character; all
# others go through the tokenizer as a whole.
_ODD = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_SPACE if c in "\t\n\v\f\r " else _LETTER if c.isalpha() else _DIGIT if c in "0123456789" else _OTHER for c in map(chr, range(256))], np.uint8)
#: Bytes that a process keeps for words met before, about.
CACHE_BYTES = 32 << 20
_ENTRY = 250
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
# Byte-level models write bytes that don't print as the code points from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_pack_ids = [struct.Struct(f"<{n}I").pack for n in range(32)]
_encoders: dict[str, Encoder] = {}


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lower-cased text in Latin-1: 's, 't, 're, 've, 'm, 'll or 'd where a
    run of other characters would begin, runs of letters, single digits, runs of other characters."""
    n = len(data)
    kind = np.full(n + 3, _SPACE, np.uint8)
    kind[:n] = _KIND[data]
    new = np.ones(n + 3, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    at = np.flatnonzero(data == ord("'"))
    at = at[new[at] & (at + 1 < n)]
    a, b = data[at + 1], data[np.minimum(at + 2, n - 1)]
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (at + 2 < n)
    new[at[one | two] + 1] = False
    new[at[one] + 2] = True
    new[at[two] + 3] = True
    edges = np.flatnonzero(new)
    found = np.flatnonzero(kind[edges] != _SPACE)  # the last edge is never a word's
    return edges[found], edges[found + 1]


class Ids:
    """Token ids of words of 16 bytes at most, found and added in bulk: open addressing over the words'
    own bytes, two numbers padded by zeros, so that no two words are taken for one.  Word 0 stands for none."""

    def __init__(self) -> None:
        self.keys = np.zeros((2, 1), np.uint64)
        self.first = np.zeros(2, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.slots = np.zeros(1 << 10, np.int32)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.first.nbytes + self.ids.nbytes + self.slots.nbytes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix(keys[0] ^ (keys[1] * np.uint64(T._BASE))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each word, 0 where it is absent."""
        slot = self._slot(keys)
        at = self.slots[slot]
        miss = np.flatnonzero((self.keys[0][at] != keys[0]) | (self.keys[1][at] != keys[1]))
        miss = miss[at[miss] > 0]
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (len(self.slots) - 1)
            found = self.slots[slot[miss]]
            at[miss] = found
            miss = miss[(found > 0) & ((self.keys[0][found] != keys[0][miss]) | (self.keys[1][found] != keys[1][miss]))]
        return at

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct words that are absent, with the number of ids of each and all ids in a row."""
        n = self.keys.shape[1]
        self.keys = np.concatenate([self.keys, keys], axis=1)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])
        if 2 * self.keys.shape[1] > len(self.slots):
            self.slots = np.zeros(1 << (2 * self.keys.shape[1]).bit_length(), np.int32)
            n = 1
        pending = np.arange(n, self.keys.shape[1], dtype=np.int32)
        slot = self._slot(self.keys[:, n:])
        while len(pending):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = pending[free]
            lost = self.slots[slot] != pending
            pending, slot = pending[lost], (slot[lost] + 1) & (len(self.slots) - 1)


def runs(pool: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of a pool that start at ``first``, one after another."""
    before = np.cumsum(counts) - counts
    return pool[np.repeat(first - before, counts) + np.arange(counts.sum())]


class Encoder:
    """Ids of texts by a tokenizer's file, and the ids of words met before.

    What is kept is bounded in bytes; results don't depend on it.
    Strings of special tokens in a text become those tokens, as the tokenizer's file has it."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        # A part with the string of an added token, in any case, goes through the tokenizer as a whole.
        added = [re.escape(t.content.lower()) for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)")
        self.known = T.Known(CACHE_BYTES // 4, _ENTRY)  # longer words
        self.young, self.old = Ids(), Ids()

    def _word(self, w: str) -> bytes:
        own = w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(own)]
        return _pack_ids[len(ids)](*ids) if len(ids) < 32 else np.array(ids, "<u4").tobytes()

    def _find(self, text: str, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of words in the younger table, which learns those that it lacks."""
        if self.young.nbytes > CACHE_BYTES // 4:
            self.young, self.old = Ids(), self.young
        out = self.young.find(keys)
        lost = np.flatnonzero(out == 0)
        at = self.old.find(keys[:, lost])
        held = np.unique(at[at > 0])
        counts = self.old.first[held + 1] - self.old.first[held]
        self.young.add(self.old.keys[:, held], counts, runs(self.old.ids, self.old.first[held], counts))
        new = lost[at == 0]
        one = dict(zip([text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], new.tolist()))
        ids = list(map(self._word, one))
        self.young.add(keys[:, list(one.values())], np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4"))
        out[lost] = self.young.find(keys[:, lost])
        return out

    def _plain(self, parts: list[str]) -> list[bytes]:
        text = "\n".join(parts)
        raw = text.encode("latin-1") + bytes(16)
        starts, ends = words(np.frombuffer(raw, np.uint8)[: len(text)])
        sizes = ends - starts
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
        keys = np.zeros((2, len(starts)), np.uint64)
        keys[0] = eight[starts] & _MASK[np.minimum(sizes, 8)]
        more = np.flatnonzero(sizes > 8)
        keys[1, more] = eight[starts[more] + 8] & _MASK[np.minimum(sizes[more] - 8, 8)]
        short, long = np.flatnonzero(sizes <= 16), np.flatnonzero(sizes > 16)
        first, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at = self._find(text, keys[:, short], starts[short], ends[short])
        pool = self.young.ids
        first[short], counts[short] = self.young.first[at], self.young.first[at + 1] - self.young.first[at]
        if len(long):
            own = [text[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            get = self.known.add(set(own), lambda new: zip(new, map(self._word, new)))
            ids = [get(w) for w in own]
            counts[long] = [len(x) // 4 for x in ids]
            first[long] = len(pool) + np.cumsum(counts[long]) - counts[long]
            pool = np.concatenate([pool, np.frombuffer(b"".join(ids), "<u4")])
        out = runs(pool, first, counts).astype("<u4").tobytes()
        offsets = np.cumsum([0, *(len(t) + 1 for t in parts)])
        edges = (4 * np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]).tolist()
        return [out[a:b] for a, b in zip(edges, edges[1:])]

    def _parts(self, parts: list[str]) -> list[bytes]:
        low = [t.lower() for t in parts]
        whole = [bool(_ODD.search(t) or self.added.search(w)) for t, w in zip(parts, low)]
        plain = iter(self._plain([w for w, x in zip(low, whole) if not x]))
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if x else next(plain) for t, x in zip(parts, whole)]

    def encode(self, texts: Iterable[str], most: int = 1 << 18) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; about ``most`` characters at a time."""
        out: list[list[bytes]] = []
        parts: list[tuple[int, str]] = []

        def flush() -> None:
            for (i, _), ids in zip(parts, self._parts([t for _, t in parts])):
                out[i].append(ids)
            parts.clear()

        size = 0
        for i, text in enumerate(texts):
            out.append([])
            for part in T.pieces(text, most):  # a cut at a space changes no token
                parts.append((i, part))
                size += len(part)
                if size >= most:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file, one for each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    return encoder(path).encode(texts)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every row: doc_id, piece, start, length, ids_crc32 and a slot number.

    A row's tokens are the text's ids and then 0; those over ``capacity`` are cut into pieces of
    that length, of which the last may be shorter.  Null text: empty, one piece of one token.
    """
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = 0
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()], path)):
                    ids += b"\0\0\0\0"
                    for k, a in enumerate(range(0, len(ids), width)):
                        own = ids[a : a + width]
                        row.append(i), piece.append(k), start.append(a // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                n = len(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(range(slot, slot + n), pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])
                slot += n

    return scratch.map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, slot long")


def _knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes within the capacity, size i at most most[i] times."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (s, v, m) in enumerate(zip(sizes, values, most)):
        if v <= 0:
            continue
        top = best.copy()
        for k in range(1, min(int(m), capacity // s) + 1):
            better = best[: capacity + 1 - k * s] + k * v > top[k * s :] + 1e-12
            at = np.flatnonzero(better) + k * s
            top[at] = best[at - k * s] + k * v
            took[i, at] = k
        best = top
    c, out = int(best.argmax()), np.zeros(len(sizes), np.int64)
    value = best[c]
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = took[i, c]
        c -= int(out[i]) * int(sizes[i])
    return float(value), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, configuration): whole parts of the configuration program's solution.

    Columns are generated until none prices out, or (where the basis is degenerate) until 4 g of g
    sizes have come in without an improvement."""
    g = len(sizes)
    most = np.minimum(demand, capacity // sizes)
    basis = np.diag(most.astype(float))
    best, idle = np.inf, 0
    while idle < 4 * g:
        x = np.linalg.solve(basis, demand)
        idle = 0 if x.sum() < best - 1e-9 else idle + 1
        best = min(best, x.sum())
        price = np.linalg.solve(basis.T, np.ones(g))
        value, new = _knapsack(sizes, price, most, capacity)
        if value <= 1 + 1e-6:
            break
        step = np.linalg.solve(basis, new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    x = np.linalg.solve(basis, demand)
    return [(int(v + 1e-9), basis[:, j].round().astype(np.int64)) for j, v in enumerate(x) if v + 1e-9 >= 1]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """The bin of each length (all between 1 and the capacity)."""
    n, bins = len(lengths), 0
    out = np.full(n, -1, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = order[lengths[order] == capacity]
    out[full] = np.arange(len(full))
    bins = len(full)
    room: dict[int, list[int]] = {}
    rooms: list[int] = []

    def give(b: int, r: int) -> None:
        if r > 0:
            if r not in room:
                insort(rooms, r)
                room[r] = []
            room[r].append(b)

    large = order[(lengths[order] < capacity) & (lengths[order] > capacity * LONG)]
    if len(large):
        parts = np.array_split(large, min(groups, len(large)))
        sizes, which = np.unique([lengths[p[0]] for p in parts], return_inverse=True)
        demand = np.bincount(which, weights=[len(p) for p in parts])
        stock: dict[int, list[int]] = {}
        for at in large[::-1].tolist():
            stock.setdefault(int(lengths[at]), []).append(at)
        present = sorted(stock)

        def take(limit: int) -> int:
            k = bisect_right(present, limit) - 1
            if k < 0:
                return -1
            at = stock[present[k]].pop()
            if not stock[present[k]]:
                del present[k]
            return at

        # configurations with the longest pieces first, so that those still find their partners
        for times, config in sorted(configurations(sizes, demand, capacity), key=lambda c: c[1][::-1].tolist(), reverse=True):
            slots = np.repeat(sizes, config)[::-1].tolist()
            for _ in range(times):
                left = capacity
                for k, size in enumerate(slots):  # the last gets the longest piece that fits
                    at = take(left if k == len(slots) - 1 else min(size, left))
                    if at >= 0:
                        out[at] = bins
                        left -= int(lengths[at])
                while (at := take(left)) >= 0:  # room that rounding has hidden
                    out[at] = bins
                    left -= int(lengths[at])
                if left < capacity:
                    give(bins, left)
                    bins += 1
    for at in order[out[order] < 0].tolist():
        size = int(lengths[at])
        k = bisect_left(rooms, size)
        if k == len(rooms):
            b, r = bins, capacity
            bins += 1
        else:
            r = rooms[k]
            b = room[r].pop()
            if not room[r]:
                del room[r], rooms[k]
        out[at] = b
        give(b, r - size)
    return out


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Query op9: one row per piece with its sequence and its place there.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Blocks of about ``block``
    pieces are packed apart; each wastes one sequence at most beside a packing of all.  Null and
    empty texts are one token; repeated rows are packed each; an empty table gives no rows.
    """
    cut = scratch.table(pieces(docs, path, capacity).withColumn("part", F.spark_partition_id()), "pieces")
    n_blocks = max(1, -(-cut.count() // block))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("part", "slot"), F.lit(n_blocks)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "part", "slot"], kind="stable", ignore_index=True)
        pdf["bin"] = pack(pdf["length"].to_numpy(), capacity)
        pdf = pdf.sort_values("bin", kind="stable", ignore_index=True)
        ends = pdf["length"].cumsum()
        pdf["offset"] = ends - pdf["length"]
        pdf["offset"] -= pdf.groupby("bin")["offset"].transform("first")
        pdf["sequence_id"] = pdf["block"].astype("int64") * (1 << 40) + pdf["bin"]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return cut.groupBy("block").applyInPandas(run, f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
