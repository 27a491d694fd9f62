"""Quality rules: robust multivariate outliers by minimum covariance determinants.

For each language and source, whatever its size, the location and scatter of the three quarters of
its documents whose regularised covariance has the smallest determinant: hashed blocks of bounded
size each take concentration steps from several random starts, the blocks' best subsets are
pooled, and concentration steps over all rows of the group, from sums and histograms, follow until
its determinant falls no more.  A group's scatter is shrunk towards that pooled within all groups,
the more the fewer rows it has, so that few rows leave it regular.  A document whose Mahalanobis
distance is too large is rejected, beside those that fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, stats
from . import text as T

#: Of the transformed statistics, those whose vector is judged.
USED = ("log_words", "word_length", "symbols", "bars", "bangs", "upper", "digits", "punct", "dup_lines", "repeat_words", "entropy")
AT = [stats.FEATURES.index(n) for n in USED]
D = len(USED)
#: Standard deviations that a scatter has at least in each direction, so that statistics that
#: are constant in the clean half (no symbols at all, say) leave it regular.
FLOOR = np.array([0.5, 0.08, 0.05, 0.05, 0.05, 0.06, 0.06, 0.05, 0.12, 0.12, 0.15])
SHARE = 0.75
#: Squared distances over this are outliers (11 degrees of freedom: about 1e-8 if normal).
CUTOFF = 60.0
BLOCK = 500
#: Models of so many groups at most (about 1 KB each) are broadcast.
BROADCAST_GROUPS = 20_000
#: Squared distances are counted in bins of 1/BINS of a natural logarithm.
BINS = 64


def _squared(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    y = x - mean
    return np.einsum("ij,jk,ik->i", y, inverse, y)


def regularised(cov: np.ndarray, n: float, target: np.ndarray | None = None) -> np.ndarray:
    """The scatter of a group of n rows whose subset has the covariance ``cov``: shrunk towards the
    target as if that were known from as many rows as there are statistics, and with the floor."""
    kept = SHARE * n
    share = 0.0 if target is None else D / (D + kept)
    return (1 - share) * cov + (share * target if target is not None else 0.0) + np.diag(FLOOR**2)


def concentrate(x: np.ndarray, starts: int = 8, seed: int = 1, target: np.ndarray | None = None) -> np.ndarray:
    """The best subset of SHARE of the rows: concentration steps from random starts of up to D + 1
    rows and from the rows nearest to the median, until the determinant falls no more."""
    n, h = len(x), max(1, int(np.ceil(SHARE * len(x))))
    if h == n:
        return np.arange(n)
    rng, best = np.random.default_rng(seed), (np.inf, np.arange(h))
    middle = np.argsort((((x - np.median(x, axis=0)) / FLOOR) ** 2).sum(axis=1), kind="stable")[:h]
    scatter = lambda own: regularised(np.cov(x[own].T, bias=True), n, target)
    for k in range(starts):
        own, last = middle if k == 0 else rng.choice(n, min(D + 1, max(2, h // 2)), replace=False), np.inf
        while True:
            new = np.argpartition(_squared(x, x[own].mean(axis=0), np.linalg.inv(scatter(own))), h - 1)[:h]
            det = np.linalg.slogdet(scatter(new))[1]
            if det >= last - 1e-9:
                break
            own, last = new, det
        if last < best[0]:
            best = (last, own)
    return np.sort(_exchanged(x, best[1], n, target))


def _exchanged(x: np.ndarray, own: np.ndarray, n: int, target: np.ndarray | None) -> np.ndarray:
    """The subset after exchanges of one row for another, as long as one lowers the determinant,
    which concentration steps may miss where rows are few.  The determinants of all exchanges
    come from the rows' inner products, as each changes the scatter by a matrix of rank two."""
    h, inside = len(own), np.zeros(n, bool)
    inside[own] = True
    weight = (1 - (0.0 if target is None else D / (D + SHARE * n))) / h
    joint, out_, in_ = weight / h, weight + weight / h, weight - weight / h
    while True:
        a, b = np.flatnonzero(inside), np.flatnonzero(~inside)
        y = x - x[a].mean(axis=0)
        inverse = np.linalg.inv(regularised(np.cov(x[a].T, bias=True), n, target))
        left, size = y[a] @ inverse, np.einsum("ij,jk,ik->i", y, inverse, y)
        cross, mine, other = left @ y[b].T, size[a][:, None], size[b][None, :]
        ratio = (1 + in_ * other + joint * cross) * (1 + joint * cross - out_ * mine) - (in_ * cross + joint * mine) * (joint * other - out_ * cross)
        k = int(ratio.argmin())
        if ratio.flat[k] >= 1 - 1e-9:
            return a
        inside[a[k // len(b)]], inside[b[k % len(b)]] = False, True


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])


def _estimate(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(total[0], 1.0)
    mean = total[1 : 1 + D] / n
    return mean, total[1 + D :].reshape(D, D) / n - np.outer(mean, mean)


def group_key(lang: Column, source: Column) -> Column:
    """One string for each pair of language and source, nulls apart from empty strings."""
    return F.to_json(F.struct(lang.cast("string").alias("l"), source.cast("string").alias("s")))


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def stats_table(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, group g, vector x and row number of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = 0
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                s = stats.statistics(part.column("text"))
                x = stats.features(s)[:, AT]
                base = s[:, :5].astype(np.int64)
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                n = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("g"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * D, pa.int32()), pa.array(x.ravel())), pa.array(np.arange(slot, slot + n))],
                    ["doc_id", "g", *_BASE, "base_failed", "x", "slot"])
                slot += n

    rows = docs.select("doc_id", group_key(F.col("lang"), F.col("source")).alias("g"), F.col("text").cast("string").alias("text"))
    made = scratch.map_arrow(rows, run, f"doc_id {kind}, g string, {', '.join(f'{n} long' for n in _BASE)}, base_failed boolean, x array<double>, slot long")
    return scratch.table(made.withColumn("part", F.spark_partition_id()), "statistics")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, x, squared distances) of the rows of each group in a batch with q_g, x and m."""
    codes = batch.column("q_g").dictionary_encode().indices.to_numpy()
    x, m = _matrix(batch.column("x"), D), batch.column("m")
    for k in np.unique(codes):
        at = np.flatnonzero(codes == k)
        model = np.asarray(m[int(at[0])].as_py())
        yield at, x[at], _squared(x[at], model[:D], model[D:].reshape(D, D))


def _bin(d: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(d, 1e-6)) * BINS).astype(np.int32)


def _totals(parts: DataFrame) -> DataFrame:
    """(g, total) from (g, v) rows of partial sums: added by place first, so no group meets in a task."""
    each = parts.select("g", F.posexplode("v").alias("at", "v")).groupBy("g", "at").agg(F.sum("v").alias("v"))
    return each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("total"))


def _with_models(rows: DataFrame, models: DataFrame, n_groups: int, salts: int = 64) -> DataFrame:
    """Rows (q_g, ...) with the columns of their group's model: models are broadcast up to a number
    of groups; beyond it each is copied ``salts`` times, so that a group's rows are dealt as widely."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(models), "q_g")
    copies = models.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("q_salt", F.floor(F.rand(1) * salts).cast("int")).join(copies, ["q_g", "q_salt"]).drop("q_salt")


def _models(totals: DataFrame, counts: DataFrame, target: np.ndarray, name: str) -> DataFrame:
    """(g, m, det): mean, inverse scatter and log-determinant of each group from its subset's sums."""
    width = 1 + D + D * D

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dets = [], []
            for total, n in zip(_matrix(batch.column("total"), width), batch.column("n").to_numpy()):
                mean, cov = _estimate(total)
                scatter = regularised(cov, n, target)
                out.append(np.concatenate([mean, np.linalg.inv(scatter).ravel()]))
                dets.append(np.linalg.slogdet(scatter)[1])
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(out, pa.list_(pa.float64())), pa.array(dets, pa.float64())], ["g", "m", "det"])

    return scratch.table(scratch.map_arrow(totals.join(counts, "g").select("g", "total", "n"), run, "g string, m array<double>, det double"), name)


def _within(totals: DataFrame) -> np.ndarray:
    """The scatter within the blocks' subsets, pooled over all groups; one row of sums."""
    sums = [F.sum(F.get("v", 0)).alias("n")] + [F.sum(F.get("v", 1 + D + j * D + k) - F.get("v", 1 + j) * F.get("v", 1 + k) / F.get("v", 0)).alias(f"s{j}_{k}") for j in range(D) for k in range(D)]
    row = np.array([v or 0.0 for v in totals.agg(*sums).first()])
    return row[1:].reshape(D, D) / max(row[0], 1.0)


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """(g, m) for each group of ``rows`` (g, x, part, slot): mean, then inverse scatter; and how
    many groups there are."""
    counts = scratch.table(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "counts")
    n_groups = counts.count()
    at = counts.select(F.col("g").alias("q_g"), "n")
    blocks = _with_models(rows.withColumnRenamed("g", "q_g"), at, n_groups).withColumn("block", F.pmod(F.xxhash64("part", "slot"), F.ceil(F.col("n") / BLOCK)).cast("int"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values(["part", "slot"])["x"].to_numpy())
        return pd.DataFrame({"g": [pdf["q_g"].iloc[0]], "v": [_sums(x[concentrate(x)]).tolist()]})

    pooled = scratch.table(blocks.select("q_g", "block", "x", "part", "slot").groupBy("q_g", "block").applyInPandas(best, "g string, v array<double>"), "subsets")
    target = _within(pooled)
    active = _models(_totals(pooled), counts, target, "models").withColumn("det", F.lit(float("inf")))
    finished: DataFrame | None = None
    left = n_groups
    while left:
        new = _models(_totals(_concentrated(rows, active, left)), counts, target, "models").select("g", F.col("m").alias("new_m"), F.col("det").alias("new_det"))
        both = scratch.table(active.join(new, "g"), "steps")
        better = F.col("new_det") < F.col("det") - 1e-9
        over = both.where(~better).select("g", "m")
        finished = over if finished is None else finished.unionAll(over)
        active = both.where(better).select("g", F.col("new_m").alias("m"), F.col("new_det").alias("det"))
        left = active.count()
    return (scratch.table(finished, "estimates") if finished is not None else active.select("g", "m")), n_groups


def _concentrated(rows: DataFrame, models: DataFrame, n_groups: int) -> DataFrame:
    """(g, v) partial sums of the rows that a concentration step keeps: those in the nearest bins
    that hold SHARE of the rows of their group."""
    at = models.select(F.col("g").alias("q_g"), "m")
    named = rows.select(F.col("g").alias("q_g"), "x")

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            for at, _, d in _by_model(batch):
                out[at] = _bin(d)
            yield pa.RecordBatch.from_arrays([batch.column("q_g"), pa.array(out)], ["g", "bin"])

    near = scratch.map_arrow(_with_models(named, at, n_groups), bins, "g string, bin int").groupBy("g", "bin").count()
    running = "sum(count) over (partition by g order by bin)"
    edge = near.selectExpr("g", "bin", f"{running} as below", "sum(count) over (partition by g) as n").where(F.col("below") >= F.lit(SHARE) * F.col("n")).groupBy("g").agg(F.min("bin").alias("edge"))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, edges = batch.column("q_g"), batch.column("edge").to_numpy()
            for at, x, d in _by_model(batch):
                name = names[int(at[0])].as_py()
                held[name] = held.get(name, 0) + _sums(x[_bin(d) <= edges[at[0]]])
            if len(held) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], ["g", "v"])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], ["g", "v"])

    limited = scratch.table(models.select("g", "m").join(edge, "g"), "edges").select(F.col("g").alias("q_g"), "m", "edge")
    return scratch.map_arrow(_with_models(named, limited, n_groups), inner, "g string, v array<double>")


def judge(docs: DataFrame) -> DataFrame:
    """Query op6: one row per row of ``docs``.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    distance (squared; null where the base rules fail).  Null texts have no words and fail;
    null languages or sources make groups of their own; repeated rows are judged each; a single
    row of a group has distance 0 and is kept; an empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    table = stats_table(docs)
    models, n_groups = estimates(table.where("not base_failed").select("g", "x", "part", "slot"))
    models = models.select(F.col("g").alias("q_g"), "m")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.zeros(batch.num_rows)
            for at, _, own in _by_model(batch):
                d[at] = own
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", *_BASE, "base_failed")), pa.array(d <= CUTOFF), pa.array(d)], ["doc_id", *_BASE, "base_failed", "kept", "distance"])

    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in _BASE)}, base_failed boolean, kept boolean, distance double"
    passed = table.where("not base_failed").select("doc_id", *_BASE, "base_failed", F.col("g").alias("q_g"), "x")
    judged = scratch.map_arrow(_with_models(passed, models, n_groups), run, schema)
    failed = table.where("base_failed").select("doc_id", *_BASE, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(failed)


def keep_normal(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns under their names, that pass the base rules and are no
    outliers: the rows that :func:`judge` keeps.  Null and empty texts go; rows that repeat are
    kept or go each; an empty table gives an empty one."""
    table = stats_table(docs)
    models, n_groups = estimates(table.where("not base_failed").select("g", "x", "part", "slot"))
    models = models.select(F.col("g").alias("q_g"), F.col("m").alias("q_m"))
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], group_key(F.col("lang"), F.col("source")).alias("q_g"))
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, f"k{text}", 1 << 20):
                s = stats.statistics(part.column(f"k{text}"))
                x = pa.array(stats.features(s)[:, AT].tolist(), pa.list_(pa.float64()))
                keep = (s[:, 0] >= 20) & (100 * s[:, 4] <= 30 * s[:, 0])
                for at, _, d in _by_model(pa.RecordBatch.from_arrays([part.column("q_g"), x, part.column("q_m")], ["q_g", "x", "m"])):
                    keep[at] &= d <= CUTOFF
                part = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(part.columns[: len(names)], names)

    return scratch.map_arrow(_with_models(rows, models, n_groups).select(*[f"k{i}" for i in range(len(names))], "q_g", "q_m"), run, docs.schema)
