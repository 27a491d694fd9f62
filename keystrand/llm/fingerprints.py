"""Document fingerprints: a canonical exact digest.

A text is normalised (NFKC), case-folded and its white space folded; a 128-bit xxhash of the
result is its fingerprint.  Documents with equal digests meet in salted buckets where their
canonical bytes are compared; texts that collide without being equal get a suffix of their own.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import text as T

#: Bits of the filter that says which digests may occur twice; fixed, so it can be broadcast.
FILTER_BITS = 25
SALTS = 256


def _canonical(part: str) -> str:
    if part.isascii():
        return " ".join(part.lower().split())
    part = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", part).casefold())
    return " ".join(part.split())


def canonical(text: str) -> str:
    """The text under NFKC and case folding, words joined by single spaces.

    Long texts go part by part: no character composes with a space before it."""
    return " ".join(filter(None, map(_canonical, T.pieces(text))))


def digest(canon: str) -> tuple[str, int]:
    """The 128-bit digest in hexadecimal, and 63 other bits."""
    raw = canon.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_hexdigest(raw), xxhash.xxh64_intdigest(raw, seed=7) >> 1


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_ROW = "n_chars long, fingerprint string, f_check long, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"


def _compare(text: str, canon: str, mark: tuple[str, int], following: str, next_canon: str, next_mark: tuple[str, int]) -> tuple:
    edited = edit(text, following)
    other = canonical(edited)
    other_mark = digest(other)
    return (len(text), *mark, hashlib.sha256(edited.encode()).hexdigest(), other_mark[0],
            float(mark == other_mark and canon == other), float(mark == next_mark and canon == next_canon))


def _neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of all rows and of their edited texts; rows in order of doc_id (null last),
    then of the text's hash.  One shuffle of the texts."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(*key).sortWithinPartitions(*key)
    names = ["f_kind", "f_part", "doc_id", *[x.split()[0] for x in _ROW.split(", ")], "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: tuple | None = None
        blank = (None,) * 7
        for batch in batches:
            for own in T.slices(batch, "text", 1 << 20):
                out = []
                for i, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist()):
                    canon = canonical(text)
                    mark = digest(canon)
                    if held is None:
                        out.append((2, part, i, *blank, text))
                    else:
                        out.append((0, part, held[0], *_compare(*held[1:], text, canon, mark), None))
                    held = (i, text, canon, mark)
                yield _batch(out, names, batch.schema.field(0).type)
        if held is not None:
            yield _batch([(1, part, held[0], *blank, held[1])], names, batch.schema.field(0).type)

    made = scratch.table(scratch.map_arrow(ordered, run, f"f_kind int, f_part int, doc_id {kind.simpleString()}, {_ROW}, text string"), "fingerprints")
    parts = sorted(r[0] for r in made.where("f_kind = 2").select("f_part").collect())
    follows = [(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)]
    spark = docs.sparkSession
    last = made.where("f_kind = 1").select("f_part", "doc_id", "text")
    head = made.where("f_kind = 2").select(F.col("f_part").alias("n_part"), F.col("text").alias("n_text"))
    pairs = last.join(spark.createDataFrame(follows, "f_part int, n_part int"), "f_part").join(head, "n_part").select("doc_id", "text", "n_text")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = canonical(text), canonical(following)
                out.append((i, *_compare(text, a, digest(a), following, b, digest(b))))
            yield _batch(out, names[2:-1], batch.schema.field(0).type)

    done = made.where("f_kind = 0").select(*names[2:-1])
    return done.unionByName(scratch.map_arrow(pairs, ends, f"doc_id {kind.simpleString()}, {_ROW}"))


_TYPES = {"f_kind": pa.int32(), "f_part": pa.int32(), "n_chars": pa.int64(), "f_check": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, id_type if n == "doc_id" else _TYPES.get(n, pa.string())) for n, c in zip(names, columns)], names)


def collisions(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(fingerprint, f_check, suffix) of texts that share a digest with a different canonical text.

    Only texts whose digest may occur twice move: one to a bucket of (digest, salt), where
    neighbours are compared byte by byte, and then one for each salt to the bucket of the digest.
    """
    spark = docs.sparkSession
    twice = marks.groupBy("fingerprint").count().where("count > 1")
    shared = spark.sparkContext.broadcast(scratch.filter_bits(twice, F.xxhash64("fingerprint"), FILTER_BITS))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in T.slices(batch, "text", 1 << 20):
                out = []
                for text in own.column(0).to_pylist():
                    canon = canonical(text)
                    out.append((*digest(canon), canon))
                yield _batch(out, ["fingerprint", "f_check", "canon"], pa.int64())

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scratch.in_filter(shared.value, batch.column("hash").to_numpy())))

    made = scratch.map_arrow(rows, marked, "fingerprint string, f_check long, canon string").withColumn("hash", F.xxhash64("fingerprint"))
    twins = scratch.map_arrow(made, hit, "fingerprint string, f_check long, canon string, hash long").drop("hash")
    salted = twins.withColumn("salt", F.floor(F.rand(5) * SALTS).cast("int"))
    for keys in (["fingerprint", "salt"], ["fingerprint"]):
        salted = scratch.map_arrow(salted.repartition(*keys).sortWithinPartitions("fingerprint", "salt"), _distinct, salted.schema)
    found = scratch.table(salted.where("salt < 0").select("fingerprint", "f_check").distinct(), "collisions")
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("f_check"))
    return found.withColumn("suffix", F.concat(F.lit("-"), rank.cast("string")))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, one for each different canonical text; salt -1 where there are several."""
    key, seen = None, []
    for batch in batches:
        out = []
        for d, check, canon, salt in zip(*(c.to_pylist() for c in batch.columns)):
            if d != key:
                key, seen = d, []
            if any(canon == x[1] for x in seen):
                continue
            if seen:  # a collision: both texts are told apart from here on
                out += [(d, c, t, -1) for c, t in seen if len(seen) == 1] + [(d, check, canon, -1)]
            else:
                out.append((d, check, canon, salt))
            seen.append((check, canon))
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch.schema)], schema=batch.schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Query op7: one row per row of ``docs``.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    As the digest is exact, a likeness is 1 where canonical bytes are equal, else 0.  Null texts
    are empty texts; texts that differ in case, white space or normal form only share a
    fingerprint.  Rows with equal doc_id follow each other by a hash of their text; a null
    doc_id comes last; a single row is its own next; an empty table gives no rows.
    """
    made = _neighbours(docs)
    found = collisions(docs, made.select("fingerprint"))
    out = made.join(F.broadcast(found) if found.count() < 10_000 else found, ["fingerprint", "f_check"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", F.concat("fingerprint", F.coalesce("suffix", F.lit(""))).alias("fingerprint"),
                      "edited_fingerprint", "near_edited", "near_next")
