"""Language-model scoring by prediction by partial matching over bytes.

A text is its lower-cased UTF-8 bytes and an end symbol, after a start context; the alphabet has
256 symbols (byte 0xFF, which no UTF-8 text holds, is the end and the start context).  A symbol's
probability comes from the longest context seen in training that saw it; each context passed on
the way costs its escape probability (method D: half a count of each distinct symbol), and what a
longer context has seen is excluded from the shorter ones.  With exclusion by the next longer context,
a symbol's probability depends on its last ORDER + 1 bytes alone.

The context trie is kept as sorted arrays of packed paths, dealt over shards by the three last
bytes of the context, so that each shard holds whole subtrees of order 3 and up; orders 0 to 2
have 2^24 paths at most, whatever the corpus, and are broadcast.  Texts are cut into chunks; each
chunk sends its distinct paths (with its training counts) to the shards and gets their
probabilities back, as it does for its distinct words and their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as T

ORDER = 5
CHUNK_BYTES = 32 << 20
#: Text for each shard of the trie, whatever the input.
SHARD_TEXT_BYTES = 32 << 20
_END = 0xFF
_END_WORD = np.uint64(1)
_GRAM, _WORD, _LOW, _SUMS, _GRAM_VALUE, _WORD_VALUE, _DOC = range(7)
_ESCAPE = 0.5
_LOW_BITS = 24


def is_held_out(doc_id: Column) -> Column:
    """Rows nothing is learned from: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def paths(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed (context, symbol) path of every symbol, ends included, and each text's first (n+1)."""
    n = len(offsets) - 1
    pad = ORDER + 1
    stream = np.full(len(data) + n * pad, _END, np.uint8)
    lengths = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(n) * pad + ORDER, lengths)
    stream[at] = T.LOWER[data]
    m = len(stream) - ORDER
    out = np.zeros(max(m, 0), np.uint64)
    for j in range(pad):
        out <<= np.uint64(8)
        out |= stream[j : j + m]
    inside = np.ones(max(m, 0), bool)
    ends = offsets[1:-1] + np.arange(1, n) * pad
    for j in range(1, pad):
        inside[ends - j] = False
    return out[inside], offsets + np.arange(n + 1)


def path_parts(offsets: np.ndarray, data: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What :func:`paths` returns; of a single text with more bytes, in parts."""
    n = len(data)
    if len(offsets) != 2 or n <= most:
        yield paths(offsets, data)
        return
    for a in range(0, n + 1, most):
        b = min(n + 1, a + most)
        stream = np.full(b - a + ORDER, _END, np.uint8)
        before = min(a, ORDER)
        own = data[a - before : b]
        stream[ORDER - before : ORDER - before + len(own)] = T.LOWER[own]
        out = np.zeros(b - a, np.uint64)
        for j in range(ORDER + 1):
            out <<= np.uint64(8)
            out |= stream[j : j + b - a]
        yield out, np.array([0, b - a])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first).astype(np.uint64) if len(k) else c.astype(np.uint64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)


class _Counts:
    """Distinct keys of a chunk with their counts in training texts (0: in others only)."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, train: np.ndarray) -> None:
        for own, weight in ((keys[train], 1), (keys[~train], 0)):
            k, c = _counted(own)
            self.keys.append(k)
            self.counts.append(c * np.uint64(weight))
            self.size += len(k)
        if self.size > 2_000_000:
            k, c = _merge(self.keys, self.counts)
            self.keys, self.counts, self.size = [k], [c], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return _merge(self.keys, self.counts)


def _words(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Word keys of each text with the end token after them, and each text's first (n+1)."""
    words, first = T.word_hashes(*T.string_buffers(part.column(column)))
    return np.insert(words, first[1:], _END_WORD), first + np.arange(len(first))


_PACK = "chunk long, kind int, shard int, keys binary, vals binary"


def _packs(chunk: int, kind: int, shard: np.ndarray, keys: np.ndarray, vals: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    for s, k, v in zip(shard[edges].tolist(), np.split(keys[order], edges[1:]), np.split(vals[order], edges[1:])):
        yield chunk, kind, int(s), np.diff(k, prepend=np.uint64(0)).tobytes(), v.astype(np.uint32).tobytes()


def _keys(raw: pa.Scalar) -> np.ndarray:
    """The sorted keys of a pack, which are kept as differences."""
    return np.cumsum(np.frombuffer(raw.as_buffer(), np.uint64), dtype=np.uint64)


def _chunk_counts(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint32).astype(np.uint64)


def _gather(docs: DataFrame, n_shards: int) -> DataFrame:
    """One pass over the texts: the documents with their chunk, and each chunk's packs."""
    kind = docs.schema["doc_id"].dataType
    names = ["chunk", "kind", "shard", "keys", "vals", "doc_id", "train", "text"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, sub, size = TaskContext.get().partitionId() << 24, 0, 0
        grams, words = _Counts(), _Counts()
        schema = None

        def close() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            k, c = grams.all()
            rows += _packs(base + sub, _GRAM, (T.mix((k >> np.uint64(8)) & np.uint64((1 << 24) - 1)) % np.uint64(n_shards)).astype(np.int64), k, c)
            low, seen = _merge([k[c > 0] & np.uint64((1 << _LOW_BITS) - 1)], [c[c > 0]])
            rows += _packs(base + sub, _LOW, (T.mix(low >> np.uint64(8)) % np.uint64(n_shards)).astype(np.int64), low, seen)
            k, c = words.all()
            rows += _packs(base + sub, _WORD, (T.mix(k) % np.uint64(n_shards)).astype(np.int64), k, c)
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)] + [pa.nulls(len(part), schema.field(n).type) for n in names[5:]], names)

        for batch in batches:
            schema = batch.schema
            for part in T.slices(batch, "text", 1 << 20):
                n, train = part.num_rows, part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                for keys, first in path_parts(*T.string_buffers(part.column("text"))):
                    grams.add(keys, np.repeat(train, np.diff(first)))
                keys, first = _words(part, "text")
                words.add(keys, np.repeat(train, np.diff(first)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base + sub)), pa.array(np.full(n, _DOC, np.int32)), *(pa.nulls(n, t) for t in types[2:]), *(part.column(c) for c in names[5:])], names)
                size += part.nbytes
                if size >= CHUNK_BYTES:
                    yield from close()
                    sub, size, grams, words = sub + 1, 0, _Counts(), _Counts()
        if size:
            yield from close()

    return scratch.table(scratch.map_arrow(docs, run, f"{_PACK}, doc_id {kind.simpleString()}, train boolean, text string"), "chunks")


class Level:
    """Paths of one length: counts, and per context its total, distinct symbols and number."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.ctx, start, self.owner = np.unique(keys >> np.uint64(8), return_index=True, return_inverse=True)
        self.total = np.add.reduceat(self.counts, start) if len(keys) else np.zeros(0)
        self.distinct = np.diff(np.append(start, len(keys))).astype(np.float64)
        self.excluded = np.zeros(0)

    def exclude_in(self, lower: Level) -> None:
        """For each context here, the counts in its suffix of the symbols that it has seen."""
        if len(self.keys):
            shorter = self.keys & np.uint64((1 << (8 * _width(lower))) - 1)
            self.excluded = np.bincount(self.owner, weights=lower.counts[np.searchsorted(lower.keys, shorter)], minlength=len(self.ctx))


def _width(level: Level) -> int:
    return level.width  # type: ignore[attr-defined]


def _level(keys: np.ndarray, counts: np.ndarray, width: int) -> Level:
    out = Level(*_merge([keys & np.uint64((1 << (8 * width)) - 1)], [counts]))
    out.width = width  # type: ignore[attr-defined]
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def low_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Orders 0, 1 and 2 from the counts of all paths of two context bytes and a symbol."""
    out = [_level(keys, counts, w) for w in (1, 2, 3)]
    for longer, shorter in zip(out[1:], out):
        longer.exclude_in(shorter)
    return out


def log_probabilities(requests: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 of the probability of each requested path; ``keys`` hold every trained path that
    shares the last three context bytes with one of them."""
    high = [_level(keys, counts, w) for w in range(4, ORDER + 2)]
    levels = low + high
    for longer, shorter in zip(levels[3:], levels[2:]):
        longer.exclude_in(shorter)
    out, open_ = np.zeros(len(requests)), np.ones(len(requests), bool)
    gone_count, gone_kinds = np.zeros(len(requests)), np.zeros(len(requests))
    for level in reversed(levels):
        path = requests & np.uint64((1 << (8 * _width(level))) - 1)
        ctx, known = _find(level.ctx, path >> np.uint64(8))
        at, seen = _find(level.keys, path)
        if not len(level.keys):
            continue
        total, kinds = level.total[ctx] - gone_count, level.distinct[ctx] - gone_kinds
        live = open_ & known & (kinds > 0)
        hit = live & seen
        out[hit] += np.log10((level.counts[at[hit]] - _ESCAPE) / total[hit])
        miss = live & ~seen
        out[miss] += np.log10(_ESCAPE * kinds[miss] / total[miss])
        open_ &= ~hit
        has = known
        gone_kinds = np.where(has, level.distinct[ctx], 0.0)
        gone_count = np.where(has, level.excluded[ctx] if len(level.excluded) else 0.0, 0.0)
    kinds = len(levels[0].keys)
    out[open_] += -np.log10(max(256 - kinds, 1))
    return out


def _answers(packs: DataFrame, low: list[Level], n_shards: int) -> DataFrame:
    """For each pack the log-probabilities of its paths or the counts of its words, in order;
    and the sums of each shard's word counts."""
    shared = packs.sparkSession.sparkContext.broadcast(low)
    names = [x.split()[0] for x in _PACK.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {_GRAM: [], _WORD: []}
        for batch in batches:
            for chunk, kind, shard, k, v in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
                held[kind].append((chunk, shard, _keys(k), _chunk_counts(v)))
        for kind, parts in held.items():
            if not parts:
                continue
            keys, counts = _merge([p[2] for p in parts], [p[3] for p in parts])
            if kind == _GRAM:
                values = log_probabilities(keys, keys[counts > 0], counts[counts > 0], shared.value).astype(np.float32)
            else:
                values = counts
                yield _rows([(None, _SUMS, 0, np.array([counts.sum(), (counts > 0).sum()], np.uint64).tobytes(), None)], names, types)
            for at in range(0, len(parts), 64):
                answer = _GRAM_VALUE if kind == _GRAM else _WORD_VALUE
                yield _rows([(chunk, answer, shard, None, values[np.searchsorted(keys, k)].tobytes()) for chunk, shard, k, _ in parts[at : at + 64]], names, types)

    return scratch.table(scratch.map_arrow(packs.repartitionById(n_shards, F.col("shard")), run, _PACK), "answers")


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _low_counts(packs: DataFrame, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """All paths of two context bytes and a symbol (2^24 at most) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            keys, counts = _merge([keys, *map(_keys, batch.column(3))], [counts, *map(_chunk_counts, batch.column(4))])
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["keys", "vals"])

    got = scratch.map_arrow(packs.repartitionById(min(n_shards, 64), F.col("shard")), run, "keys binary, vals binary").collect()
    return _merge([np.frombuffer(r[0], np.uint64) for r in got], [np.frombuffer(r[1], np.uint64) for r in got])


def score(docs: DataFrame) -> DataFrame:
    """Query op2: one row per row of ``docs``.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.  Null texts are
    empty: one end token and one end symbol.  Repeated rows count and are scored each; a null
    doc_id trains; without training rows the model is uniform; an empty table gives no rows.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (~is_held_out(F.col("doc_id"))).alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(12, -(-total // SHARD_TEXT_BYTES))
    made = _gather(rows, n_shards)
    low = low_levels(*_low_counts(made.where(F.col("kind") == _LOW).select("chunk", "kind", "shard", "keys", "vals"), n_shards))
    answers = _answers(made.where(F.col("kind").isin(_GRAM, _WORD)).select("chunk", "kind", "shard", "keys", "vals"), low, n_shards)
    sums = [np.frombuffer(r[0], np.uint64) for r in answers.where(F.col("kind") == _SUMS).select("keys").collect()]
    train_tokens, distinct = (int(sum(int(s[k]) for s in sums)) for k in (0, 1))
    texts = made.where(F.col("kind").isin(_GRAM, _WORD, _DOC)).select("chunk", "kind", "shard", F.when(F.col("kind") != _DOC, F.col("keys")).alias("keys"), F.lit(None).cast("binary").alias("vals"), "doc_id", "train", "text")
    back = answers.where(F.col("kind") != _SUMS).select("chunk", "kind", "shard", "keys", "vals", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("string").alias("text"))
    origin, sub = F.shiftright("chunk", 24), F.col("chunk").bitwiseAND(F.lit((1 << 24) - 1))  # input partition, chunk in it
    most = texts.agg(F.max(origin), F.max(sub)).first()
    part, n_parts = (origin + sub * ((most[0] or 0) + 1)).cast("int"), ((most[0] or 0) + 1) * ((most[1] or 0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[int, np.ndarray]] = {}
        tables: dict[int, tuple[T.Lookup, np.ndarray]] = {}
        current = None
        for batch in batches:
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                if chunks[a] != current:
                    current, parts, tables = chunks[a], {}, {}
                own, kind = batch.slice(a, b - a), int(kinds[a])
                if kind != _DOC:
                    read = _keys if kind in (_GRAM, _WORD) else lambda x, t=np.float32 if kind == _GRAM_VALUE else np.uint64: np.frombuffer(x.as_buffer(), t)
                    parts.setdefault(kind, {}).update(zip(own.column("shard").to_pylist(), map(read, own.column("keys" if kind in (_GRAM, _WORD) else "vals"))))
                    continue
                if not tables:
                    for asked, answer in ((_GRAM, _GRAM_VALUE), (_WORD, _WORD_VALUE)):
                        tables[asked] = (T.Lookup(np.concatenate([parts[asked][i] for i in parts[asked]])), np.concatenate([parts[answer][i] for i in parts[asked]]))
                    parts = {}
                for part in T.slices(own, "text", 1 << 20):
                    logs = sum(np.add.reduceat(tables[_GRAM][1][tables[_GRAM][0].find(keys)].astype(np.float64), first[:-1]) for keys, first in path_parts(*T.string_buffers(part.column("text"))))
                    keys, first = _words(part, "text")
                    c = tables[_WORD][1][tables[_WORD][0].find(keys)]
                    n_tokens = np.diff(first)
                    base = np.add.reduceat(np.log10(c + 1.0), first[:-1]) - n_tokens * np.log10(train_tokens + distinct + 1.0)
                    known = np.add.reduceat((c > 0).astype(np.int64), first[:-1])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(~part.column("train").to_numpy(zero_copy_only=False).astype(bool)), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(known), train_tokens)), pa.array(base), pa.array(logs)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    dealt = texts.unionAll(back).repartitionById(n_parts, part).sortWithinPartitions("chunk", "kind")
    return scratch.map_arrow(dealt, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
