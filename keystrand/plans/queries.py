"""The contract queries over the test tables, and the SQL that gives the same rows.

``events`` seen as a mutation log: key user_<id>, sequence number event_id + 1, a delete where the
type is 'error', else a put of "type|props".
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.functions import keys as K
from keystrand.functions import samplers
from keystrand.functions.bounds import UNBOUNDED, Bound, excluded, in_range, included
from keystrand.operators import files as FL
from keystrand.operators import versions as V
from keystrand.plans import report, runner, workload
from keystrand.plans.server import scan_response
from keystrand.plans.table import KVTable
from keystrand.schema import DELETE, PUT
from keystrand.sources import logs, manifest
from keystrand.sources.staging import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_LOG = """WITH log AS (SELECT printf('user_%06d', user_id) AS k, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '|', props) END AS v FROM events),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1),
live AS (SELECT k, seq, v FROM newest WHERE op = 1)
"""


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log (key, seq, op, value)."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(
        F.format_string("user_%06d", F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"),
        F.when(gone, DELETE).otherwise(PUT).cast("byte").alias("op"), F.when(~gone, F.concat_ws("|", "event_type", "props").cast("binary")).alias("value"))


def _text(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """key and value as strings, and other columns."""
    return rows.select(F.col("key").alias("k"), F.col("value").cast("string").alias("v"), *columns)


@_query(_LOG + "SELECT k, v FROM live WHERE k >= 'user_000010' AND k < 'user_000100' ORDER BY k LIMIT 50")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.scan(event_log(spark, sf_dir), included("user_000010"), excluded("user_000100"), 50))


_BOUNDS = {"ii": ("k >= 'user_000005' AND k <= 'user_000012'", included("user_000005"), included("user_000012")), "ie": ("k >= 'user_000005' AND k < 'user_000012'", included("user_000005"), excluded("user_000012")),
           "ei": ("k > 'user_000005' AND k <= 'user_000012'", excluded("user_000005"), included("user_000012")), "ee": ("k > 'user_000005' AND k < 'user_000012'", excluded("user_000005"), excluded("user_000012")),
           "ui": ("k <= 'user_000007'", UNBOUNDED, included("user_000007")), "iu": ("k >= 'user_000009'", included("user_000009"), UNBOUNDED), "uu": ("true", UNBOUNDED, UNBOUNDED)}


@_query(_LOG + " UNION ALL ".join(f"SELECT '{n}' AS bounds, k, v FROM live WHERE {c}" for n, (c, _, _) in _BOUNDS.items()))
def kv_scan_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = V.live_view(event_log(spark, sf_dir))
    return V.merge_runs(_text(current.where(in_range(F.col("key"), a, b)), F.lit(n).alias("bounds")) for n, (_, a, b) in _BOUNDS.items())


@_query(_LOG + "SELECT k, v FROM live WHERE k >= 'user_000050' AND k < 'user_000010'")
def kv_scan_empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.scan(event_log(spark, sf_dir), included("user_000050"), excluded("user_000010")))


@_query(_LOG + "SELECT k, v FROM live LIMIT 0")
def kv_limit_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.scan(event_log(spark, sf_dir), limit=0))


@_query(_LOG + "SELECT k, v FROM live")
def kv_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.scan(event_log(spark, sf_dir), limit=None))


@_query(_LOG + "SELECT k, v FROM live WHERE k LIKE 'user_0000%'")
def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.scan(event_log(spark, sf_dir), included("user_0000"), excluded("user_0001"), None))


@_query(_LOG + "SELECT '{\"results\":[' || string_agg('{\"key\":\"' || k || '\",\"value\":\"' || to_base64(encode(v)) || '\"}', ',' ORDER BY k) || ']}' AS body FROM (SELECT k, v FROM live WHERE k >= 'user_000010' ORDER BY k LIMIT 20)")
def kv_scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_response(V.scan(event_log(spark, sf_dir), included("user_000010"), UNBOUNDED, 20))


def _get(key: str) -> str:
    return _LOG + f"SELECT k, v FROM live WHERE k = '{key}'"


@_query(_LOG + "SELECT k, v FROM live WHERE k = (SELECT min(k) FROM live)")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    first = V.scan(log, limit=1).first()
    return _text(V.get(log, first["key"] if first else ""))


@_query(_LOG + "SELECT n.k, n.v FROM newest n WHERE n.op = 1 AND n.k = (SELECT min(k) FROM newest WHERE op = 0)")
def kv_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    gone = V.tombstones(log).agg(F.min("key")).first()[0]
    return _text(V.get(log, gone or ""))


@_query(_get("nobody"))
def kv_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.get(event_log(spark, sf_dir), "nobody"))


@_query(_LOG + "SELECT p.k, l.k IS NOT NULL AS hit, l.v FROM (SELECT printf('user_%06d', c_custkey) AS k FROM customer) p LEFT JOIN live l ON p.k = l.k")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "customer").select(F.format_string("user_%06d", F.col("c_custkey")).alias("key"))
    return _text(V.multi_get(event_log(spark, sf_dir), probes), "hit")


@_query(_LOG + "SELECT k, v, seq FROM (SELECT * FROM log WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE op = 1")
def kv_as_of_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.live_view(V.as_of(event_log(spark, sf_dir), 5000)), "seq")


@_query(_LOG + "SELECT k, seq, CAST(op AS INTEGER) AS op, v FROM log WHERE k = 'user_000007'")
def kv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.history(event_log(spark, sf_dir), "user_000007"), "seq", F.col("op").cast("int").alias("op"))


@_query(_LOG + "SELECT k, seq, v FROM log WHERE k > 'user_000003' AND k <= 'user_000006'")
def kv_range_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.range_versions(event_log(spark, sf_dir), excluded("user_000003"), included("user_000006")), "seq")


@_query(_LOG + """, past AS (SELECT k, v FROM (SELECT * FROM log WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1) WHERE op = 1)
(SELECT k, v, 'left' AS side FROM live EXCEPT SELECT k, v, 'left' FROM past) UNION ALL (SELECT k, v, 'right' AS side FROM past EXCEPT SELECT k, v, 'right' FROM live)""")
def kv_state_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return _text(V.differences(V.live_view(log), V.live_view(V.as_of(log, 5000))), "side")


@_query(_LOG + "SELECT DISTINCT k, v FROM log WHERE op = 1")
def kv_values_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.values_written(event_log(spark, sf_dir)))


@_query(_LOG + "SELECT k, seq FROM newest WHERE op = 0")
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tombstones(event_log(spark, sf_dir)).withColumnRenamed("key", "k")


@_query(_LOG + "SELECT k, count(*) AS versions, count(*) - 1 AS shadowed, arg_max(op, seq) = 1 AS live FROM log GROUP BY k")
def kv_version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.version_counts(event_log(spark, sf_dir)).withColumnRenamed("key", "k")


@_query(_LOG + "SELECT k, v, seq FROM live")
def kv_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return _text(V.live_view(V.merge_runs(log.where(F.col("seq") % 4 == r) for r in range(4))), "seq")


@_query(_LOG + "SELECT k, v, seq FROM live")
def kv_replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return _text(V.live_view(log.unionByName(log)), "seq")


@_query(_LOG + "SELECT k, v, seq FROM live")
def kv_compact_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.compacted(event_log(spark, sf_dir), drop_tombstones=True), "seq")


@_query(_LOG + "SELECT k, v, seq, CAST(op AS INTEGER) AS op FROM newest")
def kv_compact_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(V.compacted(event_log(spark, sf_dir), drop_tombstones=False), "seq", F.col("op").cast("int").alias("op"))


_FILE_META = "SELECT (seq - 1) // 1000 AS file_id, min(k) AS smallest_key, max(k) AS largest_key, max(seq) AS max_seq, count(*) AS n_rows, CAST(sum(strlen(k) + coalesce(strlen(v), 0) + 8) AS BIGINT) AS n_bytes FROM log GROUP BY 1"


def _file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.summaries(event_log(spark, sf_dir), F.floor((F.col("seq") - 1) / 1000).cast("long"))


@_query(_LOG + _FILE_META)
def kv_file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_meta(spark, sf_dir)


_RANGES = """WITH files AS (SELECT l_orderkey // 500 AS file_id, printf('key_%020d', min(l_orderkey)) AS smallest_key, printf('key_%020d', max(l_orderkey)) AS largest_key FROM lineitem GROUP BY 1),
ranges AS (SELECT o_orderkey // 700 AS range_id, printf('key_%020d', min(o_orderkey)) AS low, printf('key_%020d', max(o_orderkey)) AS high FROM orders GROUP BY 1)
"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 500).cast("long").alias("file_id")).agg(K.encode_key(F.min("l_orderkey")).alias("smallest_key"), K.encode_key(F.max("l_orderkey")).alias("largest_key"))
    b = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 700).cast("long").alias("range_id")).agg(K.encode_key(F.min("o_orderkey")).alias("low"), K.encode_key(F.max("o_orderkey")).alias("high"))
    return a, b


_OVERLAP = "SELECT file_id, range_id FROM files JOIN ranges ON smallest_key <= high AND largest_key >= low"


@_query(_RANGES + _OVERLAP)
def kv_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.overlapping(*_ranges(spark, sf_dir)).select("file_id", "range_id")


@_query(_RANGES + _OVERLAP)
def kv_overlap_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = [f"key_{n:020d}" for n in range(0, 20_000, 1000)]
    return FL.overlapping_bucketed(*_ranges(spark, sf_dir), cuts).select("file_id", "range_id")


@_query(_RANGES + "SELECT file_id FROM files WHERE smallest_key < 'key_00000000000000005000' AND largest_key > 'key_00000000000000000499'")
def kv_overlap_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keystrand.functions.bounds import overlaps

    files, _ = _ranges(spark, sf_dir)
    return files.where(overlaps(F.col("smallest_key"), F.col("largest_key"), F.lit("key_00000000000000000499"), F.lit("key_00000000000000005000"), False, False)).select("file_id")


_EDITS = "WITH edits AS (SELECT event_id AS version, CASE WHEN event_type IN ('error', 'signup') THEN 'remove' ELSE 'add' END AS action, event_id % 97 AS file_id, CAST(event_id % 3 AS INTEGER) AS level FROM events), final AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY version DESC) = 1)\n"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("version"), F.when(F.col("event_type").isin("error", "signup"), "remove").otherwise("add").alias("action"), (F.col("event_id") % 97).alias("file_id"), (F.col("event_id") % 3).cast("int").alias("level"))


@_query(_EDITS + "SELECT file_id, level FROM final WHERE action = 'add'")
def kv_manifest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.fold(_edits(spark, sf_dir)).select("file_id", "level")


@_query(_EDITS + "SELECT DISTINCT file_id FROM edits WHERE file_id NOT IN (SELECT file_id FROM final WHERE action = 'add')")
def kv_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _edits(spark, sf_dir)
    return manifest.orphans(edits.select("file_id").distinct(), manifest.fold(edits))


@_query(_LOG + ", m AS (" + _FILE_META + ") SELECT CAST(file_id % 3 AS INTEGER) AS level, count(*) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, min(smallest_key) AS smallest_key, max(largest_key) AS largest_key, max(max_seq) AS max_seq FROM m GROUP BY 1")
def kv_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.level_stats(_file_meta(spark, sf_dir).withColumn("level", (F.col("file_id") % 3).cast("int")))


@_query("SELECT CAST(l AS INTEGER) AS level, (SELECT max(event_id % 3) FROM events) <= l AS bottommost FROM range(1, 7) t(l)")
def kv_bottommost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.bottommost(table(spark, sf_dir, "events").select((F.col("event_id") % 3).cast("int").alias("level")))


@_query(_LOG + "SELECT CAST(coalesce(max(seq), 0) + 1 AS BIGINT) AS next_seq FROM log")
def kv_next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.next_seq(event_log(spark, sf_dir), _file_meta(spark, sf_dir))


@_query(_LOG + "SELECT CAST(sum(strlen(k) + coalesce(strlen(v), 0) + 8) AS BIGINT) AS n_bytes FROM log")
def kv_buffered_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.buffered_bytes(event_log(spark, sf_dir))


@_query(_LOG + "SELECT k, coalesce('over|' || CAST(o_orderkey AS VARCHAR), v) AS v FROM live FULL JOIN (SELECT o_orderkey, printf('user_%06d', o_orderkey) AS k FROM orders) USING (k)")
def kv_put_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = table(spark, sf_dir, "orders").select(F.format_string("user_%06d", F.col("o_orderkey")).alias("key"), (F.lit(10**9) + F.col("o_orderkey")).alias("seq"), F.lit(PUT).cast("byte").alias("op"), F.concat(F.lit("over|"), F.col("o_orderkey").cast("string")).cast("binary").alias("value"))
    return _text(V.live_view(event_log(spark, sf_dir).unionByName(puts)))


@_query(_LOG + "SELECT k, v FROM live WHERE CAST(substr(k, 6) AS INTEGER) >= 20")
def kv_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.range(20).select(F.format_string("user_%06d", F.col("id")).alias("key"), (F.lit(10**9) + F.col("id")).alias("seq"), F.lit(DELETE).cast("byte").alias("op"), F.lit(None).cast("binary").alias("value"))
    return _text(V.live_view(event_log(spark, sf_dir).unionByName(gone)))


@_query(_LOG + """, probes AS (SELECT printf('user_%06d', c_custkey) AS k FROM customer),
written AS (SELECT p.k, 1000000000 + row_number() OVER (ORDER BY p.k) AS seq, coalesce(l.v, 'none') || '!' AS v FROM probes p LEFT JOIN live l ON p.k = l.k)
SELECT k, seq, v FROM written UNION ALL SELECT k, seq, v FROM live WHERE k NOT IN (SELECT k FROM written)""")
def kv_rmw(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    probes = table(spark, sf_dir, "customer").select(F.format_string("user_%06d", F.col("c_custkey")).alias("key"))
    change = lambda v: F.concat(F.coalesce(v.cast("string"), F.lit("none")), F.lit("!")).cast("binary")
    return _text(V.live_view(log.unionByName(V.read_modify_write(log, probes, change, 10**9))), "seq")


@_query("SELECT printf('key_%020d', o_orderkey) AS k, printf('%020d.wal', o_orderkey) AS wal FROM orders")
def kv_encode_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(K.encode_key(F.col("o_orderkey")).alias("k"), K.file_name(F.col("o_orderkey"), ".wal").alias("wal"))


@_query("SELECT p_partkey, to_base64(encode(p_name || ' ' || p_type || ' ' || p_name || ' ' || p_name)) AS b FROM part")
def kv_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", K.base64_plain(F.concat_ws(" ", "p_name", "p_type", "p_name", "p_name")).alias("b"))


@_query("SELECT o_orderkey, upper(printf('%016x', o_orderkey)) AS big_endian, strlen(o_orderpriority) AS n_bytes, url_decode(url_encode(o_orderpriority)) AS decoded FROM orders")
def kv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", K.big_endian(F.col("o_orderkey")).alias("big_endian"), F.octet_length("o_orderpriority").cast("long").alias("n_bytes"), K.percent_decoded(F.replace(F.url_encode("o_orderpriority"), F.lit("+"), F.lit("%20"))).alias("decoded"))


# The table of the reversed polynomial 0xEDB88320 by eight steps for each byte, then a fold over the bytes.
_CRC = """, t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_),
h AS (SELECT seq, printf('%02x', CAST(op AS INTEGER)) || printf('%016x', seq) || hex(encode(k)) || coalesce(hex(encode(v)), '') AS h FROM log)
SELECT seq, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))), lambda c, b: xor(c >> 8, table_[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS crc FROM h, t"""


@_query(_LOG + _CRC)
def kv_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.framed(event_log(spark, sf_dir)).select("seq", "crc")


@_query(_LOG + "SELECT k, seq FROM log WHERE seq < 4321")
def kv_log_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of a log whose record 4321 is damaged: what stands before it."""
    records = logs.framed(event_log(spark, sf_dir))
    torn = records.withColumn("crc", F.when(F.col("seq") == 4321, F.col("crc") + 1).otherwise(F.col("crc")))
    return logs.valid_prefix(torn).select(F.col("key").alias("k"), "seq")


@_query(_LOG + "SELECT k, seq FROM log WHERE seq < 2345")
def kv_log_torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of a log whose record 2345 was cut short and can't be read, in whatever order."""
    records = logs.framed(event_log(spark, sf_dir))
    return logs.whole_prefix(records.where(F.col("pos") != 2345)).select(F.col("key").alias("k"), "seq")


# A fold over the list of all sizes; the state is the buffer's size after a row, and what was frozen.
_SIZES = "WITH sizes AS (SELECT list(struct_pack(seq := event_id, b := CAST(12 + strlen(event_type) + strlen(props) AS BIGINT)) ORDER BY event_id) AS l FROM events), "
_NEXT = "CASE WHEN a.size >= 4096 THEN 0 ELSE a.size END + x.size"
_ROTATE = f"""fold AS (SELECT list_reduce(list_transform(l, lambda x: struct_pack(size := x.b, seq := x.seq, frozen := CASE WHEN x.b >= 4096 THEN [struct_pack(seq := x.seq, size := x.b)] ELSE [] END)),
  lambda a, x: struct_pack(size := {_NEXT}, seq := x.seq, frozen := CASE WHEN {_NEXT} >= 4096 THEN list_append(a.frozen, struct_pack(seq := x.seq, size := {_NEXT})) ELSE a.frozen END)) AS f FROM sizes)
SELECT r.seq AS seq, r.size AS size FROM (SELECT unnest(f.frozen) AS r FROM fold)"""


@_query(_SIZES + _ROTATE)
def kv_memtable_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freeze points of one write buffer of 4,096 bytes over all events."""
    e = table(spark, sf_dir, "events")
    return FL.freeze_points(e.select(F.col("event_id").alias("seq"), (F.lit(12) + F.octet_length("event_type") + F.octet_length("props")).cast("long").alias("bytes")), 4096)


@_query(_LOG + "SELECT k, seq, CAST(floor(coalesce(sum(strlen(k) + coalesce(strlen(v), 0) + 8) OVER (ORDER BY k, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16384) AS BIGINT) AS file_no FROM log")
def kv_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.split_by_bytes(event_log(spark, sf_dir), 16_384, 8).select(F.col("key").alias("k"), "seq", "file_no")


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return e.select(F.col("event_type").alias("kind"), F.round(F.col("value") * 1000).cast("long").alias("latency_ns"), (F.timestamp_diff("SECOND", start, F.col("ts")) * F.lit(1_000_000)).alias("t_ns"), (F.col("event_id") % 5 != 0).alias("hit"))


_LAT = "WITH lat AS (SELECT event_type AS kind, CAST(round(value * 1000) AS BIGINT) AS latency_ns, date_diff('second', TIMESTAMP '2024-01-01', ts) * 1000000 AS t_ns, event_id % 5 <> 0 AS hit FROM events)\n"
_PCT = ", ".join(f"CAST(quantile_disc(latency_ns, {q}) AS BIGINT) AS {n}" for n, q in report.PERCENTILES)


@_query(_LAT + f"SELECT kind, count(*) AS n, {_PCT}, max(latency_ns) AS max_ns, round(avg(latency_ns), 6) AS mean_ns FROM lat GROUP BY kind")
def bench_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.percentiles(_latencies(spark, sf_dir), ["kind"]).withColumn("mean_ns", F.round("mean_ns", 6))


_CO = "SELECT kind, unnest(CASE WHEN latency_ns > 40000 THEN generate_series(latency_ns, 40000, -40000) ELSE [latency_ns] END) AS latency_ns FROM lat"


@_query(_LAT + _CO)
def bench_co_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.corrected(_latencies(spark, sf_dir).select("kind", "latency_ns"), 40_000)


_SECOND = "SELECT CAST(floor(t_ns / 1000000000) AS BIGINT) AS t_sec, count(*) AS ops, CAST(quantile_disc(latency_ns, 0.5) AS BIGINT) AS p50_ns, CAST(quantile_disc(latency_ns, 0.99) AS BIGINT) AS p99_ns, CAST(quantile_disc(latency_ns, 0.999) AS BIGINT) AS p999_ns, max(latency_ns) AS max_ns FROM lat GROUP BY 1"


@_query(_LAT + _SECOND)
def bench_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.per_second(_latencies(spark, sf_dir))


_SNAP = "snap AS (SELECT event_id % 2400 AS t_sec, max(event_id) AS l0_files, max(user_id) AS total_flushes FROM events GROUP BY 1)"


@_query(_LAT + f", per AS ({_SECOND}), {_SNAP} SELECT p.t_sec, p.ops, coalesce(s.l0_files, 0) AS l0_files, coalesce(s.total_flushes, 0) AS total_flushes FROM per p ASOF LEFT JOIN snap s ON p.t_sec >= s.t_sec")
def bench_asof_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    snap = e.groupBy((F.col("event_id") % 2400).alias("t_sec")).agg(F.max("event_id").alias("l0_files"), F.max("user_id").alias("total_flushes"))
    return report.as_of_join(report.per_second(_latencies(spark, sf_dir)).select("t_sec", "ops"), snap, "t_sec", ["l0_files", "total_flushes"])


@_query(_LAT + f", per AS ({_SECOND}) SELECT t AS t_sec, coalesce(ops, 0) AS ops, coalesce(p50_ns, 0) AS p50_ns, coalesce(p99_ns, 0) AS p99_ns, coalesce(p999_ns, 0) AS p999_ns, coalesce(max_ns, 0) AS max_ns, CAST(t // 100 AS INTEGER) AS l0_files, 0 AS immutable_q, CAST(0 AS BIGINT) AS in_flight_compactions, t // 100 AS total_flushes, t // 500 AS total_compactions FROM range(3000) r(t) LEFT JOIN per ON t = t_sec")
def bench_series_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = (F.col("id") * 100).cast("int")
    snaps = spark.range(31).select(second.alias("second_index"), F.col("id").cast("int").alias("l0_files"), F.lit(0).alias("immutable_q"), F.lit(0).cast("long").alias("in_flight_compactions"), F.col("id").alias("total_flushes"), F.floor(F.col("id") / 5).cast("long").alias("total_compactions"))
    return report.time_series(_latencies(spark, sf_dir), snaps, 3000)


@_query(_LAT + "SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS pct FROM lat GROUP BY kind")
def bench_op_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.op_counts(_latencies(spark, sf_dir)).withColumn("pct", F.round("pct", 9))


@_query(_LAT + "SELECT count(*) AS reads, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits, round(1 - sum(CAST(hit AS INTEGER)) / count(*), 9) AS miss_rate FROM lat WHERE kind = 'view'")
def bench_miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.miss_rate(_latencies(spark, sf_dir).where("kind = 'view'")).withColumn("miss_rate", F.round("miss_rate", 9))


@_query("SELECT round(count(*) / 30.0, 6) AS ops_per_sec FROM events")
def bench_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.throughput(table(spark, sf_dir, "events"), 30.0).withColumn("ops_per_sec", F.round("ops_per_sec", 6))


@_query("SELECT event_id AS step, CAST(event_id * 1000000000 // 2000 AS BIGINT) AS intended_ns FROM events")
def bench_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.scheduled(table(spark, sf_dir, "events").select(F.col("event_id").alias("step")), 2000)


def _unit_sql(seed: int, salt: int, row: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}/{salt}/' || {row}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


# z: the number n of ranks, the sum of their weights and eta, which inverts the distribution.
_ZIPF_Z = """z AS (SELECT n, total, (1 - pow(2.0 / n, 1 - 0.99)) / (1 - (1 + pow(2.0, -0.99)) / total) AS eta
  FROM (SELECT any_value(n) AS n, sum(pow(CAST(i AS DOUBLE), -0.99)) AS total FROM (SELECT n, unnest(range(1, n + 1)) AS i FROM ranks)))"""
_ZIPF_RANK = """CAST(least(greatest(CASE WHEN u * total < 1 THEN 1 WHEN u * total < 1 + pow(0.5, 0.99) THEN 2
  ELSE 1 + floor(n * pow(eta * u - eta + 1, 1 / (1 - 0.99))) END, 1), n) AS BIGINT)"""


@_query(f"""WITH ranks AS (SELECT count(*) AS n FROM orders), {_ZIPF_Z},
us AS (SELECT {_unit_sql(42, 1, "id")} AS u FROM (SELECT unnest(range(10 * n)) AS id FROM ranks))
SELECT {_ZIPF_RANK} AS rank, count(*) AS count FROM us, z GROUP BY 1""")
def bench_zipf_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count()
    rank = samplers.zipf_rank(samplers.unit(F.col("id"), 42, 1), n)
    return spark.range(10 * n).select(rank.alias("rank")).groupBy("rank").count()


@_query(f"""WITH ranks AS (SELECT 10000 AS n), {_ZIPF_Z},
us AS (SELECT step, {_unit_sql(42, 1, "step")} < 0.95 AS scans, {_unit_sql(42, 2, "step")} AS u, {_unit_sql(42, 3, "step")} AS length FROM range(20000) AS r(step)),
placed AS (SELECT *, {_ZIPF_RANK} AS rank, n + count(*) FILTER (NOT scans) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS there FROM us, z)
SELECT step, CASE WHEN scans THEN 'scan' ELSE 'insert' END AS kind, printf('key_%020d', CAST(CASE WHEN scans THEN least(rank, there) - 1 ELSE there END AS BIGINT)) AS key,
  CAST(CASE WHEN scans THEN 1 + least(floor(length * 100), 99) ELSE 0 END AS INTEGER) AS scan_length FROM placed""")
def bench_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = workload.operations(spark, workload.load("ycsb-e", keys=10_000), 20_000)
    return ops.withColumn("scan_length", F.coalesce("scan_length", F.lit(0)))


def _stored(spark: SparkSession, sf_dir: str, compact: bool) -> KVTable:
    """The log written as four batches to a table in the shared folder."""
    kv = KVTable(spark, f"{shared_dir(spark)}/keystrand-tables/{uuid.uuid4().hex}")
    log = event_log(spark, sf_dir)
    n = log.agg(F.max("seq")).first()[0] or 1
    for k in range(4):
        part = log.where((F.col("seq") > k * n // 4) & (F.col("seq") <= (k + 1) * n // 4))
        kv.write_batch(part.repartitionByRange("seq").sortWithinPartitions("seq"))
    if compact:
        kv.compact()
    return kv


@_query(_LOG + "SELECT k, v FROM live")
def kv_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, compacted and scanned."""
    return _text(_stored(spark, sf_dir, True).scan(limit=None))


@_query(ORACLE_SQL["kv_multi_get"])
def kv_table_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer looked up in the four runs, as they are before a compaction."""
    probes = table(spark, sf_dir, "customer").select(F.format_string("user_%06d", F.col("c_custkey")).alias("key"))
    return _text(_stored(spark, sf_dir, False).multi_get(probes), "hit")


@_query(_LOG + ", ranked AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS before FROM live), scans AS (SELECT o_orderkey, o_custkey % 100 + 1 AS n, printf('user_%06d', o_custkey) AS s FROM orders) SELECT o_orderkey AS step, least(n, (SELECT count(*) FROM live) - coalesce(before, (SELECT count(*) FROM live))) AS rows FROM scans ASOF LEFT JOIN ranked ON s <= k")
def bench_scan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a scan from each order's customer returns."""
    scans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.format_string("user_%06d", F.col("o_custkey")).alias("key"), (F.col("o_custkey") % 100 + 1).alias("scan_length"))
    return runner.scan_sizes(V.live_view(event_log(spark, sf_dir)), scans)


__all__ = ["ORACLE_SQL", "QUERIES", "Bound", "event_log", "kv_scan"]
