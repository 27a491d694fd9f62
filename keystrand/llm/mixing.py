"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's rows are dealt, by a hash, over a fixed number of blocks.  The plan says how
many whole passes over a source the mix takes and which blocks of one more, partial pass.
A tree then splits each source's exact block quota among the output shards: a node gives its
left half a multivariate-hypergeometric draw of what it holds.  Shards take disjoint slices of
the permuted blocks of a source and order their rows by another hash.

Rows move only in the last, optional step; the plan itself needs sums per source and bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: A source's permuted order is searched in so many steps of so many bits, and then place by place.
LEVELS, LEVEL_BITS = 3, 8
#: Blocks of a source: four for each shard as a power of two, between these.
BLOCK_BITS = (8, 16)
#: Words of a shard, and shards at least.
SHARD_WORDS, LEAST_SHARDS = 50_000_000, 16
#: Sides of so many rows or blocks (a few MB) at most are broadcast; larger ones are joined.
BROADCAST_ROWS, BROADCAST_BLOCKS = 200_000, 2_000_000


@dataclass
class Source:
    """What the plan holds of one source; ``name`` None is the null source."""

    name: str | None
    size: int
    weight: float
    target: float = 0.0
    passes: int = 0
    #: Rows whose permuted place is below this are in the partial pass, and so many of those there.
    below: int = 0
    ties: int = 0
    #: For each pass, a shard for each of 2^bits blocks.
    shards: list[list[int]] = field(default_factory=list)
    bits: int = BLOCK_BITS[0]


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, each at most ``most`` times its size.

    What a capped share leaves is dealt again by weight among the others until none is above.
    """
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows) by the splitting tree.

    Shards get equally many blocks, within one; each column sums exactly to its quota.
    """
    out = np.zeros((n_shards, len(quotas)), np.int64)
    todo = [(0, n_shards, np.asarray(quotas, np.int64))]
    total = int(sum(quotas))
    edges = [total * i // n_shards for i in range(n_shards + 1)]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(held, edges[mid] - edges[lo], method="marginals")
        todo += [(lo, mid, left), (mid, hi, held - left)]
    return out


def place(seed: int) -> Column:
    """A row's place in its source's permuted order, 0 to 2^62: a hash of id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 2)


def slots(rows: DataFrame) -> DataFrame:
    """Adds a row's partition and its place there, which stay once the rows are written."""
    return rows.withColumn("m_part", F.spark_partition_id()).withColumn("m_slot", F.monotonically_increasing_id())


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size (words; null text: 0), place and slot of every row, written once."""
    return scratch.table(slots(_sized(docs, seed)), "mix-sizes")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       place(seed).alias("place"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, n_shards: int | None = None, seed: int = 1) -> list[Source]:
    """The mix of ``rows`` (from :func:`sized`).  The driver holds a few numbers per source.

    Sources in order of code points, null last, weigh ``weights``, repeating.  A source's
    partial pass ends where its words come nearest to what is left of the target, to within one
    row; of rows that repeat and so have one place, as many are taken as are needed.
    """
    sums = {r[0]: int(r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    names = sorted((n for n in sums if n is not None)) + [None] * (None in sums)
    sources = [Source(n, sums[n], float(weights[i % len(weights)])) for i, n in enumerate(names)]
    for s, t in zip(sources, water_fill([s.size for s in sources], [s.weight for s in sources], most)):
        s.target, s.passes = t, min(most, int(t // s.size)) if s.size else 0
    left = {s.name: s.target - s.passes * s.size for s in sources if s.size and s.passes < most}
    prefix = {n: 0 for n in left}
    bits = 62
    for _ in range(LEVELS):
        bits -= LEVEL_BITS
        if not prefix:
            break
        at = rows.sparkSession.createDataFrame([(n, v) for n, v in prefix.items()], "name string, prefix long")
        part = rows.join(F.broadcast(at) if len(prefix) <= BROADCAST_ROWS else at, F.col("source").eqNullSafe(F.col("name")))
        bins: dict[str | None, list[tuple[int, int]]] = {}
        for n, b, v in part.where(F.shiftright("place", bits + LEVEL_BITS) == F.col("prefix")).groupBy("name", F.shiftright("place", bits).alias("bin")).agg(F.sum("size")).collect():
            bins.setdefault(n, []).append((int(b), int(v)))
        for n in prefix:
            edge = (prefix[n] + 1) << LEVEL_BITS
            for b, v in sorted(bins.get(n, [])):
                if v > left[n]:
                    edge = b
                    break
                left[n] -= v
            else:
                edge -= 1
            prefix[n] = edge
    if prefix:  # what is left: a bin of 2^-24 of each source, or rows that repeat
        at = rows.sparkSession.createDataFrame(list(prefix.items()), "name string, prefix long")
        part = rows.join(F.broadcast(at) if len(prefix) <= BROADCAST_ROWS else at, F.col("source").eqNullSafe(F.col("name"))).where(F.shiftright("place", bits) == F.col("prefix"))
        places: dict[str | None, list[tuple[int, int, int]]] = {}
        for n, place_, v, k in part.groupBy("name", "place").agg(F.sum("size"), F.count(F.lit(1))).collect():
            places.setdefault(n, []).append((int(place_), int(v), int(k)))
        for s in sources:
            if s.name not in prefix:
                continue
            s.below = (prefix[s.name] + 1) << bits
            for place_, v, k in sorted(places.get(s.name, [])):
                take = k if v <= max(left[s.name], 0) else max(0, int(left[s.name] * k / v + 0.5))
                if take < k:
                    s.below, s.ties = place_, take
                    break
                left[s.name] -= v
    _deal(sources, n_shards or shards_for(sum(sums.values())), seed)
    return sources


def shards_for(total: int) -> int:
    """Shards for a mix of so many words."""
    return max(LEAST_SHARDS, -(-total // SHARD_WORDS))


def _block_bits(n_shards: int) -> int:
    """So many blocks that a source has four for each shard, within bounds."""
    return min(BLOCK_BITS[1], max(BLOCK_BITS[0], (4 * n_shards - 1).bit_length()))


def _deal(sources: list[Source], n_shards: int, seed: int) -> None:
    bits = _block_bits(n_shards)
    n = 1 << bits
    draws = [n * s.passes + -(-(s.below + (s.ties > 0)) // (1 << (62 - bits))) for s in sources]
    quotas = split_quotas(draws, n_shards, seed) if sources else np.zeros((n_shards, 0), np.int64)
    for i, s in enumerate(sources):
        owner = np.repeat(np.arange(n_shards), quotas[:, i])
        shard = np.empty(draws[i], np.int64)
        shard[np.random.default_rng([seed, i]).permutation(draws[i])] = owner
        s.shards, s.bits = [shard[k : k + n].tolist() for k in range(0, draws[i], n)], bits


def _table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    kind = T.StructType([T.StructField("m_source", T.StringType()), T.StructField("m_source_size", T.LongType()), T.StructField("m_target", T.DoubleType()), T.StructField("m_passes", T.IntegerType()), T.StructField("m_below", T.LongType()), T.StructField("m_ties", T.LongType()), T.StructField("m_shards", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("m_bits", T.IntegerType())])
    at = spark.createDataFrame([(s.name, s.size, s.target, s.passes, s.below, s.ties, s.shards, s.bits) for s in sources], kind)
    return F.broadcast(at) if sum(map(len, (p for s in sources for p in s.shards))) <= BROADCAST_BLOCKS else at


def tied(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """Rows (source, place, ...) of the places where only some of the rows that repeat are taken."""
    edges = rows.sparkSession.createDataFrame([(s.name, s.below) for s in sources if s.ties], "m_edge_source string, m_edge long")
    small = sum(s.ties > 0 for s in sources) <= BROADCAST_ROWS
    return rows.join(F.broadcast(edges) if small else edges, F.col("source").eqNullSafe(F.col("m_edge_source")) & (F.col("place") == F.col("m_edge"))).drop("m_edge_source", "m_edge")


def with_tie_rank(rows: DataFrame) -> DataFrame:
    """Adds m_rank (from 0) to the written rows of :func:`tied`: their number within the source, by
    partition and slot.  Partitions are counted, so that no task sees all rows of a source."""
    offsets, total = [], {}
    for source, part, n in sorted(rows.groupBy("source", "m_part").count().collect(), key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        offsets.append((source, part, total.get(source, 0)))
        total[source] = total.get(source, 0) + n
    table = rows.sparkSession.createDataFrame(offsets, "m_s string, m_p int, m_offset long")
    here = F.row_number().over(Window.partitionBy("source", "m_part").orderBy("m_slot"))
    return rows.withColumn("m_rank", here - 1).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("m_s")) & (F.col("m_part") == F.col("m_p"))).withColumn("m_rank", F.col("m_rank") + F.col("m_offset")).drop("m_s", "m_p", "m_offset")


def with_plan(rows: DataFrame, sources: list[Source], rank: Column | None = None) -> DataFrame:
    """Adds m_copies and m_shard_list (a shard for each copy) to rows that have source and place,
    and a rank among the rows of their place where only some of these are taken."""
    at = rows.join(_table(rows.sparkSession, sources), F.col("source").eqNullSafe(F.col("m_source")))
    more = F.col("place") < F.col("m_below")
    if rank is not None:
        more = more | (rank < F.col("m_ties"))
    copies = F.col("m_passes") + F.when(more, 1).otherwise(0)
    block = F.call_function("shiftright", F.col("place"), F.lit(62) - F.col("m_bits")).cast("int")
    return at.withColumn("m_copies", copies).withColumn("m_shard_list", F.transform(F.slice("m_shards", F.lit(1), copies), lambda p: F.get(p, block)))


def _apart(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """The rows of :func:`rows` that aren't those of :func:`tied`."""
    edge = F.lit(False)
    for s in sources:
        if s.ties:
            edge = edge | (F.col("source").eqNullSafe(F.lit(s.name)) & (F.col("place") == s.below))
    return rows.where(~edge)


def mix(docs: DataFrame, n_shards: int | None = None, seed: int = 1, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, shuffle: bool = True) -> DataFrame:
    """The mixed rows: every column of ``docs``, once per copy; with ``shuffle``, written shard by
    shard in a local random order.  A row that no pass takes goes; null and empty texts, null
    sources and rows that repeat fare as in :func:`mixture`; an empty table gives an empty one."""
    names = docs.columns
    sources = plan(sized(docs, seed), weights, most, n_shards, seed)
    n_shards = n_shards or shards_for(sum(s.size for s in sources))
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(names)]
    rows = docs.select(*kept, F.col("source").cast("string").alias("source"), place(seed).alias("place"))
    wanted = [*[f"k{i}" for i in range(len(names))], "place", F.explode("m_shard_list").alias("shard")]
    out = with_plan(_apart(rows, sources), sources).select(*wanted)
    if any(s.ties for s in sources):
        ranked = with_tie_rank(scratch.table(slots(tied(rows, sources)), "mix-ties"))
        out = out.unionByName(with_plan(ranked, sources, F.col("m_rank")).select(*wanted))
    if shuffle:
        out = out.repartition(n_shards, "shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 1), "place", "shard"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])


def mixture(docs: DataFrame, n_shards: int | None = None, seed: int = 1) -> DataFrame:
    """Query op1: one row per row of ``docs`` with what the mix takes of it.

    doc_id, size, source_size, target, taken, and shards (one per copy).  Null and empty texts
    have size 0 and are kept; a null source is a source of its own; of rows that repeat some may be
    taken once more than others; an empty table gives an empty result.  Other columns are ignored,
    whatever their names.
    """
    rows = sized(docs, seed)
    sources = plan(rows, n_shards=n_shards, seed=seed)
    out = with_plan(_apart(rows, sources), sources)
    if any(s.ties for s in sources):
        out = out.unionByName(with_plan(with_tie_rank(tied(rows, sources)), sources, F.col("m_rank")).drop("m_rank"))
    return out.select("doc_id", "size", F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"),
                      (F.col("size") * F.col("m_copies")).cast("long").alias("taken"), F.col("m_shard_list").alias("shards"))
