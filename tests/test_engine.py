"""Log semantics, table, compaction and manifest: contract, invariants, and a model to match."""

import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from keystrand.errors import BadKey, Expired, NotFound, Stalled
from keystrand.functions import keys as K
from keystrand.functions.bounds import UNBOUNDED, Bound, excluded, included, may_hold
from keystrand.operators import compaction, versions
from keystrand.operators.files import freeze_points, overlapping, overlapping_bucketed
from keystrand.plans.queries import QUERIES
from keystrand.plans.table import KVTable
from keystrand.schema import LOG, checked
from keystrand.sources import manifest
from keystrand.sources.logs import LogDir, framed


def log(spark, rows):
    return spark.createDataFrame([(k, s, o, None if v is None else bytearray(v)) for k, s, o, v in rows], LOG)


def test_newest_wins_and_deletes_hide(spark):
    rows = log(spark, [("a", 1, 1, b"1"), ("a", 3, 0, None), ("b", 2, 1, b"2"), ("b", 2, 1, b"2"), ("c", 5, 1, b""), ("a", 2, 1, b"x")])
    assert {r["key"]: bytes(r["value"]) for r in versions.live_view(rows).collect()} == {"b": b"2", "c": b""}
    assert versions.newest_per_key(rows.where("op = 1")).count() == 3  # filtering first would bring a back
    assert versions.get(rows, "a").count() == 0
    assert [r["seq"] for r in versions.history(rows, "a").collect()] == [3, 2, 1]
    assert {r["key"] for r in versions.live_view(versions.as_of(rows, 2)).collect()} == {"a", "b"}
    assert versions.scan(rows, limit=0).count() == 0
    assert versions.compacted(rows, False).count() == 3
    assert versions.compacted(rows, True).count() == 2


def test_scan_bounds(spark):
    rows = log(spark, [(f"k{i:02d}", i + 1, 1, b"v") for i in range(10)])
    got = lambda a, b: [r["key"] for r in versions.scan(rows, a, b, None).collect()]
    assert got(included("k03"), included("k05")) == ["k03", "k04", "k05"]
    assert got(excluded("k03"), excluded("k05")) == ["k04"]
    assert got(UNBOUNDED, excluded("k02")) == ["k00", "k01"]
    assert got(included("k08"), UNBOUNDED) == ["k08", "k09"]
    assert got(included("k05"), excluded("k05")) == []


def test_astral_keys_sort_bytewise(spark):
    keys = ["￿", "\U0001f600", "a", "é", ""]
    rows = log(spark, [(k, i + 1, 1, b"v") for i, k in enumerate(keys)])
    assert [r["key"] for r in versions.scan(rows, limit=None).collect()] == sorted(keys, key=str.encode)


def test_may_hold():
    assert may_hold("b", "d", included("d"), UNBOUNDED) and not may_hold("b", "d", excluded("d"), UNBOUNDED)
    assert may_hold("b", "d", UNBOUNDED, included("b")) and not may_hold("b", "d", UNBOUNDED, excluded("b"))
    assert may_hold("\U0010ffffx", "\U0010ffffy", Bound(), Bound())


@pytest.mark.parametrize("seed", [1, 2])
def test_table_matches_a_dict(spark, tmp_path, seed):
    rng, model, past = random.Random(seed), {}, {}
    root = f"file://{tmp_path}/t"
    table = KVTable(spark, root, level_zero_files=3, output_bytes=400)
    keys = [f"key{i:02d}" for i in range(20)]
    for step in range(7):
        ops = []
        for _ in range(rng.randint(1, 12)):
            k = rng.choice(keys)
            if rng.random() < 0.3:
                ops.append((k, 0, None))
                model.pop(k, None)
            else:
                v = rng.randbytes(rng.choice([0, 5, 31, 600]))
                ops.append((k, 1, bytearray(v)))
                model[k] = v
        frame = spark.createDataFrame(ops, "key string, op byte, value binary").coalesce(1)
        version = table.write_batch(frame, batch_id=f"b{step}")
        assert table.write_batch(frame, batch_id=f"b{step}") == version  # a replay is harmless
        past[version.number] = dict(model)
        if step in (3, 6):
            table.compact(force=step == 6)
            table = KVTable(spark, root, level_zero_files=3, output_bytes=400)
        assert {r["key"]: bytes(r["value"]) for r in table.scan(limit=None).collect()} == model
    assert [r["key"] for r in table.scan(included("key03"), excluded("key15"), 4).collect()] == [k for k in sorted(model) if "key03" <= k < "key15"][:4]
    for k in keys[:6]:
        assert table.get(k) == model.get(k)
    for number, state in list(past.items())[:2]:
        assert {r["key"]: bytes(r["value"]) for r in table.scan(limit=None, version=number).collect()} == state
    at = table.manifest.load()
    for level in range(1, 7):
        own = at.at_level(level)
        assert all(a.largest_key < b.smallest_key for a, b in zip(own, own[1:]))
    before = at.last_seq
    assert table.put("key00", b"new").last_seq == before + 1
    assert KVTable(spark, root).get("key00") == b"new"
    removed = table.vacuum(retain=1)
    assert removed and table.get("key00") == b"new"
    with pytest.raises(NotFound):
        table.manifest.load(1)


def test_table_edges(spark, tmp_path):
    table = KVTable(spark, f"file://{tmp_path}/e")
    assert table.get("x") is None and table.scan().count() == 0
    table.delete("absent")
    table.put("é", b"")
    assert table.get("é") == b"" and table.get("absent") is None
    table.put("bytes", bytes(range(256)))
    assert table.get("bytes") == bytes(range(256))
    with pytest.raises(BadKey):
        table.put("k" * 65_536, b"v")
    with pytest.raises(BadKey):
        table.put_batch(spark.createDataFrame([(None, bytearray(b"v"))], "key string, value binary"))
    table.read_modify_write(spark.createDataFrame([("é",), ("new",)], "key string"), lambda v: F.concat(F.coalesce(v, F.unhex(F.lit(""))), F.encode(F.lit("!"), "UTF-8")))
    assert table.get("é") == b"!" and table.get("new") == b"!"
    stats = table.stats().first()
    assert stats["total_writes"] == 5 and stats["total_flushes"] == 4 and stats["total_compactions"] == 0


def test_commit_of_two_writers(spark, tmp_path):
    table = KVTable(spark, f"file://{tmp_path}/w")
    other = KVTable(spark, f"file://{tmp_path}/w")
    real, calls = other.manifest.load, []

    def stale(number=None):  # the first look is at the state before the other writer's commit
        out = real(number)
        if not calls:
            calls.append(1)
            table.put("a", b"first")
        return out

    other.manifest.load = stale
    other.put("a", b"second")
    assert table.get("a") == b"second" and table.manifest.load().last_seq == 2


def test_a_writer_that_dies_leaves_the_table_writable(spark, tmp_path):
    table = KVTable(spark, f"file://{tmp_path}/d")
    table.put("a", b"1")
    store = table.manifest.store
    store._put(store._path(store.path("manifest/00000000000000000002.json.x.part")), "{")  # died before the name was taken
    assert table.put("a", b"2").number == 2 and KVTable(spark, table.root).get("a") == b"2"
    assert not store.create("manifest/00000000000000000002.json", "{}") and table.get("a") == b"2"


def test_concurrent_writers_all_publish(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    made = [spark.createDataFrame([(f"k{i}", bytearray(b"v")), ("same", bytearray(b"%d" % i))], "key string, value binary") for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda df: KVTable(spark, root).put_batch(df), made))
    at = KVTable(spark, root).manifest.load()
    assert (at.number, at.last_seq) == (6, 12)
    assert [r["key"] for r in KVTable(spark, root).scan(limit=None).collect()] == [*(f"k{i}" for i in range(6)), "same"]


def test_vacuum_spares_a_writer_in_flight(spark, tmp_path):
    table, other = (KVTable(spark, f"file://{tmp_path}/v") for _ in range(2))
    table.put("a", b"1")
    real = other.manifest.commit

    def late(change):  # files are written, the version isn't published yet
        table.put("b", b"2")
        table.compact(force=True)
        assert table.vacuum(retain=1)
        return real(change)

    other.manifest.commit = late
    other.put("c", b"3")
    assert {r["key"] for r in table.scan(limit=None).collect()} == {"a", "b", "c"}
    assert table.vacuum(retain=1, in_flight=0) == []


def test_past_states_after_a_compaction(spark, tmp_path):
    table = KVTable(spark, f"file://{tmp_path}/p")
    table.put("a", b"1")
    before = table.put("a", b"2").number
    assert table.get("a", as_of=1) == b"1"
    table.compact(force=True)
    with pytest.raises(Expired):
        table.get("a", as_of=1)
    assert table.get("a", as_of=2) == b"2" and table.get("a", as_of=1, version=before) == b"1"


def test_multi_get_skips_files(spark, tmp_path):
    table = KVTable(spark, f"file://{tmp_path}/m")
    for k in range(5):
        table.put_batch(spark.createDataFrame([(f"{k}{i:02d}", bytearray(b"%d" % k)) for i in range(0, 40, 2)], "key string, value binary").coalesce(1))
    table.delete("204")
    at = table.manifest.load()
    ask = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    touched = lambda *keys: {f.path.split("/")[1] for f in table.files_for(ask(*keys))}
    runs = list(dict.fromkeys(f.path.split("/")[1] for f in at.files))
    assert touched("104", "438") <= {runs[1], runs[4]} and touched("138x", "000 ", None) <= {runs[0]}
    assert touched("9", "", None) == set()
    got = {r["key"]: (r["hit"], r["value"] and bytes(r["value"])) for r in table.multi_get(ask("104", "105", "204", "438", None)).collect()}
    assert got == {"104": (True, b"1"), "105": (False, None), "204": (False, None), "438": (True, b"4"), None: (False, None)}
    many = [f"{k}{i:02d}" for k in range(6) for i in range(40)]
    assert sum(r["hit"] for r in table.multi_get(ask(*many)).collect()) == 99
    plan = table.log()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan
    assert KVTable(spark, f"file://{tmp_path}/none").multi_get(ask("a")).collect()[0]["hit"] is False


def test_manifest_of_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "CHECKPOINT_EVERY", 4)
    root = f"file://{tmp_path}/e"
    own = manifest.Manifest(spark, root)
    meta = lambda i: manifest.FileMeta(f"r{i}/f", 0, f"runs/r{i}/f", "a", "b", i, i, 1, 1)
    states = {}
    for i in range(1, 11):
        change = lambda v, i=i: manifest.replace(v, files=tuple(f for f in v.files if f.max_seq % 3) + (meta(i),), last_seq=i, batches=v.with_batch(f"s/{i}"))
        states[i] = own.commit(change)
    fresh = lambda: manifest.Manifest(spark, root)
    assert all(fresh().load(i) == v for i, v in states.items()) and fresh().load() == states[10]
    assert list(fresh().walk(states)) == list(states.values())
    assert states[10].batches == {"s/": 10} and states[10].has_batch("s/7") and not states[10].has_batch("s/11")
    assert own._found()[1] == [4, 8]
    table = KVTable(spark, root)
    table.vacuum(retain=3)
    assert fresh()._found() == ([8, 9, 10], [8]) and all(fresh().load(i) == states[i] for i in (8, 9, 10))
    table.vacuum(retain=2)
    assert fresh()._found() == ([9, 10], [9]) and fresh().load() == states[10]


def test_writers_wait_for_compaction(spark, tmp_path):
    table = KVTable(spark, f"file://{tmp_path}/b", max_pending=2, stall_seconds=0.2)
    table.put("a", b"1"), table.put("b", b"2")
    assert table.is_falling_behind()
    with pytest.raises(Stalled):
        table.put("c", b"3")
    table.stall_seconds = 60
    with ThreadPoolExecutor(1) as pool:
        late = pool.submit(table.put, "c", b"3")
        time.sleep(0.3)
        assert not late.done()
        table.compact(force=True)
        late.result()
    assert [r["key"] for r in table.scan(limit=None).collect()] == ["a", "b", "c"] and table.state()[1:3] == (0, 0)


def test_torn_record_ends_replay(spark, tmp_path):
    logs = LogDir(spark, f"file://{tmp_path}/t")
    logs.append(log(spark, [(f"k{i}", 10 * i, 1, b"v") for i in range(1, 6)]).coalesce(1))
    for cut, want in ((3, [10, 20]), (5, [10, 20, 30, 40]), (1, [])):
        folder = tmp_path / "t/wal" / f"{1:020d}.wal"
        lines = [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]
        torn = [x[:25] if f'"pos":{cut},' in x else x for x in lines]
        target = tmp_path / f"t/wal/{cut + 1:020d}.wal"
        target.mkdir()
        (target / "part-0").write_text("\n".join(torn[::-1]) + "\n")  # read in another order
        assert sorted(r["seq"] for r in logs.replay(cut + 1).collect()) == want
        assert sorted(r["seq"] for r in logs.replay(1).collect()) == [10, 20, 30, 40, 50]


def test_compaction_choice():
    meta = lambda i, level, lo, hi, size=10: manifest.FileMeta(f"r{i}/f", level, "", lo, hi, 0, 1, 1, size)
    v = manifest.Version(files=(meta(1, 1, "apple", "cherry"), meta(2, 1, "date", "grape"), meta(3, 1, "mango", "peach"), meta(4, 0, "fig", "nectarine")))
    plan = compaction.plan(v, 0)
    assert {f.file_id for f in plan.overlapped} == {"r2/f", "r3/f"} and plan.drop_tombstones
    deeper = manifest.Version(files=v.files + (meta(5, 3, "a", "b"),))
    assert not compaction.plan(deeper, 0).drop_tombstones
    assert compaction.level_to_compact(v) is None
    assert compaction.level_to_compact(manifest.Version(files=tuple(meta(i, 0, "a", "b") for i in range(4)))) == 0
    limit = K.level_limit(1)
    assert compaction.level_to_compact(manifest.Version(files=(meta(1, 1, "a", "b", limit),))) is None
    assert compaction.level_to_compact(manifest.Version(files=(meta(1, 1, "a", "b", limit + 1),))) == 1


def test_manifest_fold(spark):
    edits = spark.createDataFrame([(1, "add", 1, 1), (1, "add", 2, 1), (2, "remove", 1, 1), (2, "remove", 2, 1), (2, "add", 3, 2), (2, "add", 4, 2)], "version long, action string, file_id long, level int")
    assert {(r["file_id"], r["level"]) for r in manifest.fold(edits).collect()} == {(3, 2), (4, 2)}


def test_log_replay(spark, tmp_path):
    logs = LogDir(spark, f"file://{tmp_path}/l")
    assert logs.replay_all() is None and logs.highest() == 0
    rows = log(spark, [(f"k{i}", i + 1, i % 2, b"v" if i % 2 else None) for i in range(10)])
    assert logs.append(rows) == 1 and logs.append(rows.withColumn("seq", F.col("seq") + 10)) == 2
    assert logs.replay(1).count() == 10
    framed(rows).withColumn("crc", F.when(F.col("seq") == 4, F.lit(0)).otherwise(F.col("crc"))).write.json(logs._path(3))
    assert sorted(r["seq"] for r in logs.replay(3).collect()) == [1, 2, 3]
    assert sorted({r["generation"] for r in logs.replay_all().collect()}) == [1, 2, 3]
    assert logs.delete_through(2) == [1, 2] and logs.generations() == [3]


def test_log_contract(spark):
    assert checked(log(spark, [("a", 1, 1, b"v")])).count() == 1
    with pytest.raises(Exception, match="corrupt log row"):
        checked(log(spark, [("a", 1, 7, b"v")])).collect()


def test_overlap_forms_agree(spark):
    rng = random.Random(5)
    span = lambda: sorted(f"{rng.randint(0, 50):03d}" for _ in range(2))
    files = spark.createDataFrame([(i, *span()) for i in range(40)], "file_id long, smallest_key string, largest_key string")
    ranges = spark.createDataFrame([(i, *span()) for i in range(30)] + [(30, None, "010"), (31, "040", None), (32, None, None)], "range_id long, low string, high string")
    pairs = lambda df: sorted((r["file_id"], r["range_id"]) for r in df.collect())
    a, b = pairs(overlapping(files, ranges)), pairs(overlapping_bucketed(files, ranges, ["010", "020", "033"]))
    assert a == b and len(a) > 50


def test_freeze_points_fold(spark):
    rng = random.Random(3)
    sizes = [(i, rng.randint(1, 50)) for i in range(300)]
    want, size = [], 0
    for i, b in sizes:
        size += b
        if size >= 100:
            want.append((i, size))
            size = 0
    got = freeze_points(spark.createDataFrame(sizes, "seq long, bytes long"), 100)
    assert sorted((r["seq"], r["size"]) for r in got.collect()) == want


@pytest.mark.parametrize("slices", [None, 1, 7])
def test_freeze_points_carry_the_size_from_range_to_range(spark, slices):
    rng = random.Random(4)
    for sizes, limit in (([rng.randint(0, 50) for _ in range(3000)], 100), ([rng.choice((0, 1, 500)) for _ in range(400)], 100), ([1] * 300, 250), ([1] * 50, 100), ([0, 200] * 40, 100)):
        want, size = [], 0
        for i, b in enumerate(sizes):
            size += b
            if size >= limit:
                want.append((i, size))
                size = 0
        got = freeze_points(spark.createDataFrame(list(enumerate(sizes)), "seq long, bytes long"), limit, slices=slices)
        assert sorted((r["seq"], r["size"]) for r in got.collect()) == want


def test_memtable_rotation_folds_all_events(spark):
    sf = "/root/testdata/sf0.01"
    want, size = [], 0
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "props").collect()):
        size += 12 + len(r["event_type"].encode()) + len(r["props"].encode())
        if size >= 4096:
            want.append((r["event_id"], size))
            size = 0
    got = QUERIES["kv_memtable_rotation"](spark, sf)
    assert sorted((r["seq"], r["size"]) for r in got.collect()) == want and want[-1][0] >= 2000
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_scalar_functions(spark):
    row = spark.range(1).select(
        K.encode_key(F.lit(7)).alias("key"), K.base64_plain(F.lit("x" * 100)).alias("b"), F.crc32(F.lit("123456789")).alias("crc"),
        K.percent_decoded(F.lit("a%20b+c")).alias("p"), K.percent_decoded(F.lit("%zz")).alias("bad"), K.big_endian(F.lit(258)).alias("be"),
        K.valid_utf8(F.unhex(F.lit("FF"))).alias("u"), K.elapsed_second(F.lit(1999)).alias("s")).first()
    assert row["key"] == "key_00000000000000000007" and "\n" not in row["b"] and row["crc"] == 0xCBF43926
    assert (row["p"], row["bad"], row["be"], row["u"], row["s"]) == ("a b+c", None, "0000000000000102", False, 1)
    assert [K.level_limit(i) for i in (1, 2)] == [640 << 20, 6400 << 20]
