"""Similarity join of documents on word shingles by rare-first prefix filtering.

Documents with equal shingle sets form a class and are compared once.  Shingles are ordered by
their frequency in a count sketch of fixed size, rare ones first, ties by hash.  Two sets of
Jaccard similarity 0.8 or more share a shingle in their prefixes of n/5 + 1 shingles; classes that
meet on one are candidates where length, position and suffix allow it, and a
candidate pair is verified once, on whole sets.

Only components matter, so pairs are tried in rounds: first a few prefix shingles of each class
with two leaders each, then, wherever a shingle still joins different components, all rows with
more leaders, and in the last round every pair across components that is left.  No link between components is lost, and a large
group of near copies never emits all its pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import text as T

SHINGLE = 5
SKETCH_BITS = 20
SLICES = 16
#: A prefix shingle with more rows than this (by the sketch) is dealt over several shards.
HOT = 1 << 16
#: Packed prefix rows of a shard, whatever the input.
SHARD_BYTES = 16 << 20
#: A shingle's rows are dealt over so many salts that about so many rows meet under one.
SALT_ROWS = 500
FLUSH_BYTES = 32 << 20
FILTER_BITS = 26
#: The suffix filter cuts hash space into so many ranges, of whose sizes it keeps the parities.
RANGE_BITS = 9
_SIGN = 1 << (RANGE_BITS - 6)
_SIGNS = [f"s{i}" for i in range(_SIGN)]
#: In the bounded comparison of neighbours, so many rows of a prefix shingle are looked at.
NEIGHBOURS = 64
#: Pairs of one leader that are verified in one group.
GROUP = 200
#: In the first round, so many prefix rows of each class are looked at.
FEW = 4
#: Leaders per prefix shingle in each round but the last.
LEADERS = (2, 8)

_ROW = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("pos", "<i4")])
#: Prefix rows name a shingle by so many high bits: equal shingles always meet, and two that only
#: look equal make a candidate that verification refuses.
TOKEN_BITS = 48
_TOKEN_LOW = np.uint64(64 - TOKEN_BITS)
_SLICE_BYTES = 4 * (1 << SKETCH_BITS) // SLICES


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after another, and the bounds (n+1)."""
    offsets, data = T.string_buffers(column)
    words, first = T.word_hashes(offsets, data)
    keys, at = T.windows(words, first, SHINGLE)
    bound = np.searchsorted(at, first)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        with np.errstate(over="ignore"):
            whole = [int(T.mix(np.array([np.add.reduce(words[first[i] : first[i + 1]] * (np.arange(1, counts[i] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))], np.uint64) + np.uint64(counts[i]))[0]) for i in short]
        keys = np.insert(keys, bound[short], np.array(whole, np.uint64))
        bound = bound + np.concatenate([[0], np.cumsum((counts > 0) & (counts < SHINGLE))])
    for a, b in zip(bound[:-1], bound[1:]):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = bound[:-1][bound[:-1] < bound[1:]]
    new[starts] = True
    return keys[new], np.concatenate([[0], np.cumsum(new)])[bound]


def _class_keys(keys: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set that is not empty (0 for those), the same for equal sets."""
    out = np.zeros(len(bound) - 1, np.uint64)
    full = np.flatnonzero(bound[:-1] < bound[1:])
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = T.mix(np.add.reduceat(T.mix(keys + np.uint64(0x632BE59BD9B4E019)), bound[:-1][full]) + np.diff(bound)[full].astype(np.uint64))
    return out.view(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of all values, byte by byte: high ones that are zero compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()


def _of_planes(raw: np.ndarray, width: int, dtype: str) -> np.ndarray:
    out = np.zeros((len(raw) // width, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view(dtype).ravel()


def _pack(rows: np.ndarray) -> bytes:
    """Prefix rows that are sorted by token, for a shuffle: tokens as the steps between them."""
    steps = np.diff(rows["token"] >> _TOKEN_LOW, prepend=np.uint64(0))
    raw = _planes(steps, TOKEN_BITS // 8) + rows["cls"].tobytes() + _planes(rows["n"], 4) + _planes(rows["pos"], 4)
    return len(rows).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(raw[:8].to_pybytes(), "little")
    width = TOKEN_BITS // 8
    data = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * (width + 16), codec="zstd"), np.uint8)
    token, cls, size, pos = np.split(data, [n * width, n * (width + 8), n * (width + 12)])
    out = np.empty(n, _ROW)
    out["token"] = np.cumsum(_of_planes(token, width, "<u8"), dtype=np.uint64) << _TOKEN_LOW
    out["cls"], out["n"], out["pos"] = cls.view("<i8"), _of_planes(size, 4, "<i4"), _of_planes(pos, 4, "<i4")
    return out


def _pack_set(keys: np.ndarray) -> bytes:
    """A sorted set as the steps between its members, whose high bytes are zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)), 8)


def _unpack_set(raw: pa.Buffer) -> np.ndarray:
    return np.cumsum(_of_planes(np.frombuffer(raw, np.uint8), 8, "<u8"), dtype=np.uint64)


def _signatures(keys: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Parities of the sizes of 2^RANGE_BITS hash ranges, as 64-bit words for each set.

    A range whose parities differ holds a shingle that only one of two sets has, so the number of
    those ranges bounds the symmetric difference from below."""
    n = len(bound) - 1
    owner = np.repeat(np.arange(n), np.diff(bound))
    at = (T.mix(keys) >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    parity = (np.bincount((owner << RANGE_BITS) + at, minlength=n << RANGE_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, -1), axis=1, bitorder="little").view(np.int64)


def _survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, h, n, cls, signature) of every document (doc_id, h, text), and the sketch: how many documents hold a shingle of
    each of 2^SKETCH_BITS hash ranges."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h", "n", "cls", *_SIGNS, "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in T.slices(batch, "text", 1 << 20):
                keys, bound = _sets(part.column("text"))
                np.add.at(counts, (keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                n, signs = part.num_rows, _signatures(keys, bound)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(np.diff(bound).astype(np.int64)), pa.array(_class_keys(keys, bound)), *(pa.array(np.ascontiguousarray(signs[:, i])) for i in range(_SIGN)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if id_type is not None:
            parts = counts.reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, id_type), *(pa.nulls(SLICES, pa.int64()) for _ in names[1:-2]), pa.array(range(SLICES), pa.int32()), pa.array([pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts], pa.binary())], names)

    made = scratch.table(scratch.map_arrow(docs, run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names[1:-2])}, slice int, counts binary"), "survey")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(pa.decompress(raw.as_buffer(), decompressed_size=_SLICE_BYTES, codec="zstd"), np.uint32)
                sums[k] = sums.get(k, 0) + own.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])

    sketch = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for k, raw in scratch.map_arrow(made.where("slice is not null").select("slice", "counts").repartitionById(SLICES, F.col("slice")), add, "slice int, counts binary").collect():
        sketch[k] = np.frombuffer(raw, np.int64)
    return made.where("slice is null").select(*names[:-2]), sketch.ravel()


def _prefix_rows(docs: DataFrame, sketch: np.ndarray, n_shards: int) -> DataFrame:
    """Packed rows (token, class, size, position) of the prefixes of all classes, by shard."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.uint32) if sketch.max(initial=0) < 1 << 32 else sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, size = shared.value, set(), [], 0
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                keys, bound = _sets(part.column("text"))
                freq = counts[(keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                rank = (np.minimum(freq, np.uint64((1 << 24) - 1)) << np.uint64(40)) | (keys >> np.uint64(24))
                cls = _class_keys(keys, bound)
                for a, b, c in zip(bound[:-1].tolist(), bound[1:].tolist(), cls.tolist()):
                    if a == b or c in seen:
                        continue
                    seen.add(c)
                    n = b - a
                    order = np.argsort(rank[a:b], kind="stable")[: n // 5 + 1] + a
                    out = np.empty(len(order), _ROW)
                    out["token"], out["cls"], out["n"], out["pos"] = keys[order] >> _TOKEN_LOW << _TOKEN_LOW, c, n, np.arange(len(order))
                    held.append(out)
                    size += out.nbytes
                if size > FLUSH_BYTES:
                    yield _dealt(np.concatenate(held), counts, n_shards)
                    held, size = [], 0
        if held:
            yield _dealt(np.concatenate(held), counts, n_shards)

    return scratch.map_arrow(docs, run, "shard int, rows binary")


def _dealt(rows: np.ndarray, counts: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """The rows by shard, a range of tokens; what is dealt out of a hot token goes to any shard."""
    token = rows["token"]
    hot = counts[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) // np.uint64(HOT)
    salt = rows["cls"].astype(np.int64).view(np.uint64) % (hot + np.uint64(1))
    with np.errstate(over="ignore"):
        shard = np.where(salt > 0, T.mix(token + salt) % np.uint64(n_shards), ((token >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((token, shard))
    shard = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    parts = np.split(rows[order], edges[1:])
    return pa.RecordBatch.from_arrays([pa.array(shard[edges].astype(np.int32)), pa.array([_pack(p) for p in parts], pa.binary())], ["shard", "rows"])


def _meetings(packed: DataFrame, sketch: np.ndarray, n_shards: int) -> DataFrame:
    """(token, cls, n, pos, salts) of prefix rows that share their token with a class whose size and
    position fit theirs.  Of tokens with many rows, all rows with a class of a like size.  salts:
    over how many salts the token's rows are dealt; rows of one token may differ, the most counts."""
    shared = packed.sparkSession.sparkContext.broadcast((sketch // HOT).astype(np.uint16) if sketch.max(initial=0) // HOT < 1 << 16 else sketch // HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(raw.as_buffer()) for batch in batches for raw in batch.column(1)]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.lexsort((rows["pos"], rows["cls"], rows["n"], rows["token"]))]
        token, cls, n = rows["token"], rows["cls"], rows["n"]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]) | (n[1:] != n[:-1])
        rows = rows[fresh]
        token, n, rest = rows["token"], rows["n"].astype(np.int64), rows["n"].astype(np.int64) - rows["pos"]
        parts = shared.value[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
        keep = parts > 0  # the other rows of the token may be in other shards
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        alike = np.repeat(np.diff(np.append(begin, len(rows))), np.diff(np.append(begin, len(rows))))
        many, salts = alike > NEIGHBOURS, -(-alike * (parts + 1) // SALT_ROWS)
        for d in range(1, min(NEIGHBOURS, len(rows))):
            like = (token[d:] == token[:-d]) & (5 * n[:-d] >= 4 * n[d:])
            if not like.any():
                break
            fits = like & ((9 * np.minimum(rest[:-d], rest[d:]) >= 4 * (n[:-d] + n[d:])) | many[d:])
            keep[d:] |= fits
            keep[:-d] |= fits
        rows, salts = rows[keep], salts[keep]
        for at in range(0, len(rows), 100_000):
            own, dealt = rows[at : at + 100_000], salts[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own["token"].astype(np.uint64).view(np.int64)), pa.array(own["cls"].astype(np.int64)), pa.array(own["n"].astype(np.int32)), pa.array(own["pos"].astype(np.int32)), pa.array(dealt.astype(np.int32))], ["token", "cls", "n", "pos", "salts"])

    return scratch.table(scratch.map_arrow(packed.repartitionById(n_shards, F.col("shard")), run, "token long, cls long, n int, pos int, salts int"), "meetings")


def _set_table(docs: DataFrame, wanted: DataFrame, path: str) -> str:
    """The name of a table (cls, members) at ``path``, bucketed by class: the sorted shingles of the
    wanted classes (and of few others).  Joins on the class don't move it again."""
    shared = docs.sparkSession.sparkContext.broadcast(scratch.filter_bits(wanted, F.col("cls"), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                keys, bound = _sets(part.column("text"))
                cls = _class_keys(keys, bound)
                at = [i for i in np.flatnonzero(scratch.in_filter(shared.value, cls) & (np.diff(bound) > 0)).tolist() if not (cls[i] in seen or seen.add(cls[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array([_pack_set(keys[bound[i] : bound[i + 1]]) for i in at], pa.binary())], ["cls", "members"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            if len(cls):
                yield batch.filter(pa.array(np.concatenate([[cls[0] != last], cls[1:] != cls[:-1]])))
                last = cls[-1]

    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = scratch.map_arrow(scratch.map_arrow(docs, run, "cls long, members binary").repartition(buckets, "cls").sortWithinPartitions("cls"), distinct, "cls long, members binary")
    name = f"keystrand_sets_{uuid.uuid4().hex}"
    made.write.bucketBy(buckets, "cls").sortBy("cls").option("path", path).saveAsTable(name)
    return name


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= 80 * union."""
    both = np.concatenate([a, b])
    both.sort()
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (len(a) + len(b))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(head, tail, ok) for each candidate pair.

    Only the sets of classes in a pair are made, and go when the pairs are verified.  Each pair's
    second set goes to where its first is; only a first with many pairs moves too, dealt over
    several groups, so that none meets them all."""
    spark = pairs.sparkSession
    path = scratch.new_path(spark, "sets")
    sets = _set_table(docs, pairs.select(F.explode(F.array("head", "tail")).alias("cls")), path)
    known = spark.table(sets)
    head_sets = known.select(F.col("cls").alias("head"), F.col("members").alias("head_members"))
    tail_sets = known.select(F.col("cls").alias("tail"), F.col("members").alias("tail_members"))
    groups = scratch.table(pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")).where("groups > 1"), "groups")
    columns = ["head", "tail", "head_members", "tail_members"]
    if groups.isEmpty():
        both = pairs.join(tail_sets, "tail").join(head_sets, "head").select(columns)
    else:
        heads = groups.select("head", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt")).join(head_sets, "head")
        salt = F.pmod(F.xxhash64("tail"), F.col("groups")).cast("int").alias("salt")
        tails = pairs.join(groups, "head").select("head", "tail", salt).join(tail_sets, "tail")
        alone = pairs.join(groups, "head", "left_anti").join(tail_sets, "tail").join(head_sets, "head")
        both = alone.select(columns).unionAll(tails.join(heads, ["head", "salt"]).select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(_unpack_set(x.as_buffer()), _unpack_set(y.as_buffer())) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["head", "tail", "ok"])

    try:
        return scratch.table(scratch.map_arrow(both, run, "head long, tail long, ok boolean"), "verified")
    finally:
        spark.sql(f"DROP TABLE {sets}")
        scratch.remove(spark, path)


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) of all ends of ``edges`` (a, b): alternating large-star and small-star steps
    until nothing changes; only sums of what changed reach the driver."""
    made = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        both = made.unionAll(made.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        made = scratch.table(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = tuple(made.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == last:
            return made.select(F.col("u").alias("cls"), F.col("v").alias("root"))
        last = state


_SIDE = ("cls", "n", "pos", "comp")


def _fits() -> Column:
    """Length and positional filters for a row and another (o_...) of one shingle, of different
    components."""
    n, pos, other_n, other_pos = (F.col(c) for c in ("n", "pos", "o_n", "o_pos"))
    return (F.col("comp") != F.col("o_comp")) & (5 * F.least(n, other_n) >= 4 * F.greatest(n, other_n)) & (9 * F.least(n - pos, other_n - other_pos) >= 4 * (n + other_n))


def _suffix_fits() -> Column:
    """The suffix filter for the signatures of two classes."""
    apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"o_{s}"))) for s in _SIGNS), F.lit(0))
    return 9 * apart <= F.col("n") + F.col("o_n")


def _suffixes_fit(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (head, tail) that the suffix filter leaves."""
    tails = signs.select(F.col("cls").alias("tail"), *[F.col(c).alias(f"o_{c}") for c in ("n", *_SIGNS)])
    return pairs.join(signs.withColumnRenamed("cls", "head"), "head").join(tails, "tail").where(_suffix_fits()).select("head", "tail")


def _salted(rows: DataFrame) -> DataFrame:
    """Adds the salt of each row: below the salts of its token in whatever relation joins it."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))


def _salts() -> Column:
    """A row for each salt of a token."""
    return F.explode(F.sequence(F.lit(0), F.col("salts") - 1))


def _candidates(rows: DataFrame, signs: DataFrame, leaders: int | None) -> DataFrame:
    """Distinct pairs (head, tail) of different components that meet on a shingle and fit.

    With ``leaders``, each row is paired with so many rows of its shingle, least in orders that
    are the same for all shingles; pairs are few enough to look up signatures for the suffix filter
    once they are distinct.  Without, it is paired with every row, but only rows outside the
    shingle's most frequent component look for partners, and rows carry their signatures, so that
    of texts with a common passage only pairs that fit are made."""
    most, side, fits = F.max("salts").alias("salts"), _SIDE, _fits()
    if leaders:
        first = [F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls")).getField("cls") for k in range(leaders)]
        heads = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array(*first).alias("heads"), most).where("lo < hi")
        chosen = heads.select("token", "salts", F.explode(F.array_distinct("heads")).alias("cls")).join(rows.drop("salts"), ["token", "cls"])
    else:
        side, fits = (*_SIDE, *_SIGNS), fits & _suffix_fits()
        sizes = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), most)
        main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), most).where("comps > 1")
        rows = rows.join(signs.select("cls", *_SIGNS), "cls")
        named = main.select("token", "main", F.col("salts").alias("m_salts"), _salts().alias("salt"))
        chosen = _salted(rows).join(named, ["token", "salt"]).where("comp <> main").drop("salts", "salt").withColumnRenamed("m_salts", "salts")
    other = chosen.select("token", _salts().alias("salt"), *[F.col(c).alias(f"o_{c}") for c in side])
    met = _salted(rows).join(other, ["token", "salt"]).where(fits).select(F.col("o_cls").alias("head"), F.col("cls").alias("tail"))
    low, high = F.least("head", "tail"), F.greatest("head", "tail")
    pairs = met.groupBy(low.alias("low"), high.alias("high")).agg(F.min("head").alias("head")).select("head", F.when(F.col("head") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("tail"))
    return _suffixes_fit(pairs, signs) if leaders else pairs


def _open(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows, with their component, of shingles that still join several components."""
    if roots is None:
        rows = rows.withColumn("comp", F.col("cls"))
    else:
        rows = rows.join(roots, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("salts").alias("salts")).where("lo < hi").select("token", _salts().alias("salt"))
    return scratch.table(_salted(rows).join(mixed, ["token", "salt"], "left_semi").drop("salt"), "open")


def class_components(meetings: DataFrame, signs: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(cls, root) of the classes that link with another, or None.

    The first round looks at a few rows of each class, which unites most groups; the others at all
    rows of shingles that still join different components."""
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("pos", "token"))
    rows = meetings.withColumn("rank", rank).where(F.col("rank") <= FEW).drop("rank")
    roots: DataFrame | None = None
    tried: DataFrame | None = None
    for k, leaders in enumerate((*LEADERS, None)):
        if k == 1:
            rows = meetings
        rows = _open(rows, roots)
        pairs = _candidates(rows, signs, leaders)
        if tried is not None:
            low, high = F.least("head", "tail"), F.greatest("head", "tail")
            pairs = pairs.withColumn("low", low).withColumn("high", high).join(tried, ["low", "high"], "left_anti").select("head", "tail")
        rows = rows.drop("comp")
        pairs = scratch.table(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = _verified(pairs, docs)
        done = found.select(F.least("head", "tail").alias("low"), F.greatest("head", "tail").alias("high"))
        tried = done if tried is None else tried.unionAll(done)
        own = found.where("ok").select(F.col("head").alias("a"), F.col("tail").alias("b"))
        if not own.isEmpty():
            roots = components(own if roots is None else own.unionAll(roots.select(F.col("cls").alias("a"), F.col("root").alias("b"))))
    return roots


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The survey of ``docs``, and (cls, root) of the classes that link with another."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    survey, sketch = _survey(rows)
    total = survey.where("n > 0").agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    size = total * _ROW.itemsize
    n_shards = max(12, -(-size // SHARD_BYTES))
    meetings = _meetings(_prefix_rows(rows.select("text"), sketch, n_shards), sketch, n_shards)
    signs = survey.where("n > 0").join(meetings.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(*[F.min(s).alias(s) for s in ("n", *_SIGNS)])
    return survey, class_components(meetings, scratch.table(signs, "signatures"), rows.select("text"))


def join(docs: DataFrame) -> DataFrame:
    """Query op5: doc_id, n_shingles and component_id for each row of ``docs``.

    Null, empty and blank texts have no shingles and are their own component; one to four words
    are one shingle; rows with equal sets share a component whatever the doc_id, and a component
    is named by the smallest doc_id that is not null; an empty table gives no rows.  Classes are
    told apart by 64-bit keys of their sets.
    """
    survey, roots = _linked(docs)
    full = survey.where("n > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("low"))
    if roots is None:
        named = classes.select("cls", F.col("low").alias("component_id"))
    else:
        rooted = scratch.table(classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "rooted")
        named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("cls", "component_id")
    out = full.join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(survey.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns: of each component that with the smallest doc_id (null
    last; of equal ones that with the smallest hash of its text, and one of rows that repeat).

    Rows without shingles all stay."""
    survey, roots = _linked(docs)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("low")
    classes = survey.where("n > 0").groupBy("cls").agg(low)
    if roots is not None:
        classes = classes.join(roots, "cls", "left").groupBy(F.coalesce("root", "cls")).agg(F.min("low").alias("low"))
    firsts = classes.select(F.col("low.doc_id").alias("q_id"), F.col("low.h").alias("q_h"))
    many = survey.where("n > 0").groupBy(F.col("doc_id").alias("q_id"), F.col("h").alias("q_h")).count()
    firsts = scratch.table(firsts.join(many, firsts["q_id"].eqNullSafe(many["q_id"]) & (firsts["q_h"] == many["q_h"])).select(firsts["q_id"], firsts["q_h"], "count"), "firsts")
    mark = "q_hash"
    while mark in docs.columns:
        mark += "_"
    rows = docs.withColumn(mark, F.xxhash64("text"))

    def matching(keys: DataFrame) -> DataFrame:
        return rows.join(keys, rows["doc_id"].eqNullSafe(keys["q_id"]) & (rows[mark] == keys["q_h"]), "left_semi")

    blank = docs.where(~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    out = matching(firsts.where("count = 1"))
    repeated = firsts.where("count > 1")
    if not repeated.isEmpty():
        out = out.unionByName(matching(repeated).dropDuplicates(["doc_id", mark]))
    return out.drop(mark).unionByName(blank)


#: Brute force in DuckDB: all pairs that share a shingle, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.root = e.x)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
