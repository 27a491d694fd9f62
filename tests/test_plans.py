"""Workloads, reports, streams, the HTTP contract and the contract queries."""

import base64
import json
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from keystrand.functions import samplers
from keystrand.plans import queries, report, runner, workload
from keystrand.plans.server import handle, serve
from keystrand.plans.table import KVTable
from keystrand.streaming.ingest import ingest, newest_stream, tumbling_counts

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(str([None if v is None or v != v else (v.item() if hasattr(v, "item") else v) for v in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_contract_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_query(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def whole(spark, name, cap, sf=SMALL):
    """Rows of a query, and of its SQL without the condition that makes a table smaller."""
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return rows_of(queries.QUERIES[name](spark, sf).toPandas()), rows_of(con.sql(queries.ORACLE_SQL[name].replace(cap, "")).df())


def test_rmw_changes_every_customer(spark):
    got, want = whole(spark, "kv_rmw", " WHERE c_custkey % 7 = 0")
    assert got == want
    assert sum("!'" in r for r in got) == spark.read.parquet(f"{SMALL}/customer.parquet").count()


def test_multi_get_probes_every_customer(spark):
    got, want = whole(spark, "kv_multi_get", " WHERE c_custkey % 3 = 0")
    assert got == want and len(got) == spark.read.parquet(f"{SMALL}/customer.parquet").count()


def test_asof_snapshots_are_of_all_events(spark):
    got, want = whole(spark, "bench_asof_stats", " WHERE event_id % 7 = 0")
    assert got == want
    highest = spark.read.parquet(f"{SMALL}/events.parquet").agg(F.max("event_id")).first()[0]
    assert queries.bench_asof_stats(spark, SMALL).agg(F.max("l0_files")).first()[0] == highest


def test_put_overwrite_puts_every_order(spark):
    got, want = whole(spark, "kv_put_overwrite", " WHERE o_orderkey < 50")
    assert got == want
    assert sum("over|" in r for r in got) == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_presets_and_validation():
    assert set(workload.PRESETS) == {f"ycsb-{x}" for x in "abcdef"}
    assert workload.load("ycsb-d").key_distribution == "latest"
    assert workload.load("ycsb-a", keys=5).keys == 5
    assert workload.load('name = "x"\nkeys = 9\nop_mix = { read = 0.5, scan = 0.5 }').op_mix["scan"] == 0.5
    for bad in ({"op_mix": {"read": 0.5}}, {"op_mix": {"read": -1, "scan": 2}}, {"key_distribution": "none"}, {"op_mix": {"fly": 1.0}}):
        with pytest.raises(ValueError):
            workload.load("ycsb-a", **bad)


def test_operations(spark):
    spec = workload.load("ycsb-d", keys=1000)
    ops = workload.operations(spark, spec, 20_000).cache()
    counts = {r["kind"]: r["count"] for r in ops.groupBy("kind").count().collect()}
    assert abs(counts["insert"] / 20_000 - 0.05) < 0.01 and sum(counts.values()) == 20_000
    inserted = [r["key"] for r in ops.where("kind = 'insert'").orderBy("step").collect()]
    assert inserted == [f"key_{1000 + i:020d}" for i in range(counts["insert"])]
    number = F.substring("key", 5, 20).cast("long")
    recent = ops.where("kind = 'read'").select((number >= 900).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert recent > 0.5
    assert workload.initial_rows(spark, workload.load(None, keys=10, value_size=70)).select(F.max(F.length("value"))).first()[0] == 70


def test_zipf_shape(spark):
    rank = samplers.zipf_rank(samplers.unit(F.col("id"), 1, 1), 1000, 0.99)
    n = {r["rank"]: r["count"] for r in spark.range(100_000).select(rank.alias("rank")).groupBy("rank").count().collect()}
    total = samplers.zeta(1000, 0.99)
    assert abs(samplers.zeta(5000, 0.99) - sum(i**-0.99 for i in range(1, 5001))) < 1e-9
    assert abs(n[1] / 100_000 - 1 / total) < 0.01 and n[1] > n[2] > n[10] > n.get(900, 0) and min(n) >= 1 and max(n) <= 1000


def test_coordinated_omission(spark):
    rows = spark.createDataFrame([(10,), (35,), (100,)], "latency_ns long")
    assert sorted(r[0] for r in report.corrected(rows, 30).collect()) == [10, 35, 40, 70, 100]


def test_series_and_text(spark, tmp_path):
    lat = spark.createDataFrame([(0, "read", 5), (10**9, "scan", 7), (10**9, "read", 9)], "t_ns long, kind string, latency_ns long")
    snaps = spark.createDataFrame([(1, 3, 0, 0, 2, 1)], "second_index int, l0_files int, immutable_q int, in_flight_compactions long, total_flushes long, total_compactions long")
    series = report.time_series(lat, snaps, 3)
    got = [tuple(r) for r in series.orderBy("t_sec").collect()]
    assert got[0][:3] == (0, 1, 5) and got[0][6] == 0 and got[1][1] == 2 and got[1][6:] == (3, 0, 0, 2, 1) and got[2][1] == 0 and got[2][6] == 3
    report.write_csv(series, f"file://{tmp_path}/csv")
    lines = next(Path(tmp_path, "csv").glob("part-*")).read_text().splitlines()
    assert lines[0].startswith("t_sec,ops,p50_ns,p99_ns") and len(lines) == 4
    assert "ops/sec 1" in report.summary(lat, 3.0)
    empty = report.miss_rate(spark.createDataFrame([], "hit boolean")).first()
    assert (empty["reads"], empty["miss_rate"]) == (0, 0.0)


def test_as_of_join_by_key(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 9, 90)], "k string, t long, v long")
    got = {(r["k"], r["t"]): r["v"] for r in report.as_of_join(left, right, "t", ["v"], by=["k"], default=None).collect()}
    assert got == {("a", 1): None, ("a", 5): 50, ("b", 5): None}


def test_stream_ingest(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    schema = "key string, seq long, op byte, value binary"
    spark.createDataFrame([("a", 1, 1, bytearray(b"1")), ("a", 2, 0, None), ("b", 3, 1, bytearray(b"3"))], schema).write.parquet(src)
    table = KVTable(spark, f"file://{tmp_path}/t")
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    ingest(stream(), table, f"file://{tmp_path}/c").awaitTermination()
    assert {r["key"]: bytes(r["value"]) for r in table.scan(limit=None).collect()} == {"b": b"3"}
    spark.createDataFrame([("a", 4, 1, bytearray(b"4"))], schema).write.mode("append").parquet(src)
    ingest(stream(), table, f"file://{tmp_path}/c").awaitTermination()
    number = table.manifest.load().number
    ingest(stream(), table, f"file://{tmp_path}/c2").awaitTermination()  # the ids of these batches are known
    assert table.manifest.load().number == number
    assert {r["key"]: bytes(r["value"]) for r in table.scan(limit=None).collect()} == {"a": b"4", "b": b"3"}


def test_newest_as_state(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    schema = "key string, seq long, op byte, value binary"
    for batch in ([("a", 5, 1, bytearray(b"5")), ("b", 1, 1, bytearray(b"1"))], [("a", 2, 1, bytearray(b"2")), ("b", 7, 0, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = newest_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"file://{tmp_path}/out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["key"], r["seq"], r["op"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", 5, 1), ("b", 1, 1), ("b", 7, 0)]


def test_tumbling(spark):
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00.2' AS ts UNION ALL SELECT timestamp'2024-01-01 00:00:00.9' UNION ALL SELECT timestamp'2024-01-01 00:00:01'")
    assert sorted(r["n"] for r in tumbling_counts(e, "ts").collect()) == [1, 2]


def test_http_contract(spark, tmp_path):
    table = KVTable(spark, f"file://{tmp_path}/h")
    assert handle(table, "GET", "/health")[0] == 200 and handle(table, "GET", "/kv/none")[0] == 404
    for k in "abcde":
        assert handle(table, "PUT", f"/kv/{k}", k.encode())[0] == 204
    assert handle(table, "PUT", "/kv/sp%20ace", b"")[0] == 204 and handle(table, "GET", "/kv/sp%20ace") == (200, b"")
    assert handle(table, "DELETE", "/kv/zzz")[0] == 204
    status, body = handle(table, "GET", "/kv?start=b&end=d")
    assert status == 200 and json.loads(body) == {"results": [{"key": k, "value": base64.b64encode(k.encode()).decode()} for k in "bc"]}
    assert len(json.loads(handle(table, "GET", "/kv?limit=2")[1])["results"]) == 2
    assert handle(table, "GET", "/kv?limit=x")[0] == 400 and handle(table, "POST", "/kv/a")[0] == 405
    server = serve(table, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    assert urllib.request.urlopen(f"{url}/kv/a").read() == b"a"
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{url}/kv/none")
    server.shutdown()


def test_workload_run(spark, tmp_path):
    spec = workload.load(None, keys=50, value_size=20, op_mix={"read": 0.3, "update": 0.2, "insert": 0.2, "rmw": 0.1, "scan": 0.2}, max_scan_length=30)
    table = KVTable(spark, f"file://{tmp_path}/run", level_zero_files=2)
    table.put_batch(workload.initial_rows(spark, spec))
    with runner.StateSampler(table, 0.2) as sampler:
        got = sorted(runner.run(table, spec, 120, block=50).collect())
    ops = sorted(workload.operations(spark, spec, 120).collect())
    assert [(r["step"], r["kind"], r["key"]) for r in got] == [(r["step"], r["kind"], r["key"]) for r in ops]
    there, later = {f"key_{i:020d}" for i in range(50)}, set()
    for r, op in zip(got, ops):
        if r["step"] % 50 == 0:
            there, later = there | later, set()
        assert r["hit"] == ((r["key"] in there) if r["kind"] in ("read", "rmw") else None)
        assert r["rows"] == (min(op["scan_length"], sum(k >= r["key"] for k in there)) if r["kind"] == "scan" else None)
        assert 0 < r["latency_ns"] <= r["t_ns"]
        if r["kind"] in ("update", "insert", "rmw"):
            later.add(r["key"])
    assert {r["key"] for r in table.scan(limit=None).collect()} == there | later
    samples = sorted(sampler.snapshots().collect())
    assert len(samples) >= 2 and samples[-1]["total_flushes"] == 4 and samples[-1]["total_compactions"] > 0
    series = report.time_series(runner.run(table, spec, 10), sampler.snapshots(), 3)
    assert series.count() == 3
