"""Core operators against tables made by hand and against plain Python models."""

import os
import struct
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.functions import bloom, hashing, workload
from larder.model import CorruptError, EmptyKeyError, Options, RecordTooLargeError, UnknownVersionError
from larder.operators import log as ops
from larder.operators import metrics, recovery
from larder.plans import load, queries
from larder.plans.table import KVTable, file_stats
from larder.sources import records, segments
from larder.sources.manifest import Manifest, PublishConflict

LOG = "key string, gen long, pos long, deleted boolean, value string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [("a", 1, 1, False, "1"), ("a", 2, 5, False, "2"), ("b", 1, 2, False, "x"), ("b", 2, 6, True, None), ("c", 1, 3, True, None), ("c", 2, 7, False, ""), ("d", 1, 4, False, "y")],
        LOG,
    )


def test_newest_wins_and_tombstones(log):
    assert rows(ops.visible(log), "key", "value") == [("a", "2"), ("c", ""), ("d", "y")]
    assert rows(ops.tombstoned(log), "key") == [("b",)]


def test_compaction_counts(log):
    r = ops.compaction_result(log).first()
    assert (r.segments_in, r.records_in, r.records_out, r.tombstones_purged) == (2, 7, 3, 1)
    assert r.bytes_in == 7 * 14 + 4 and r.bytes_out == 3 * 14 + 2


def test_lookups(spark, log):
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    assert rows(ops.get_many(keys, log), "key", "found") == [("a", True), ("b", False), ("z", False)]
    assert rows(ops.missing(keys, log), "key") == [("b",), ("z",)]
    assert rows(ops.layer_hits(keys, log), "key", "outcome", "layers_read") == [("a", "hit", 1), ("b", "tombstone", 1), ("z", "miss", 2)]


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert ops.visible(empty).count() == 0
    assert ops.memtable_size(empty).first().asDict() == {"keys": 0, "bytes": 0}
    assert ops.compaction_result(empty).first().records_in == 0


def test_refuses_empty_keys(spark):
    bad = spark.createDataFrame([(b"", 1, 1, False, b"v")], "key binary, gen long, pos long, deleted boolean, value binary")
    with pytest.raises(Exception, match="empty key"):
        ops.checked(bad).collect()


@pytest.mark.parametrize("block", [2, 3, 65536])
def test_recovery_drops_what_was_not_committed(spark, block):
    pending = [0, 1, 1, 0, 1, 0, 1, 1]
    log = spark.createDataFrame([(i, "ok", bool(p), 10) for i, p in enumerate(pending)], "pos long, status string, pending boolean, nbytes long")
    applied = recovery.classified(log, block).where("commit_pos IS NOT NULL")
    assert rows(applied, "pos") == [(i,) for i in range(6)]
    r = recovery.report(log).first()
    assert (r.records_applied, r.discarded_bytes, r.cause) == (6, 20, "uncommitted")
    torn = log.withColumn("status", F.when(F.col("pos") == 2, "torn").otherwise("ok"))
    r = recovery.report(torn).first()
    assert (r.records_applied, r.discarded_bytes, r.cause) == (1, 70, "torn")


def test_fnv_and_crc_vectors(spark):
    words = spark.createDataFrame([(b"",), (b"a",), (b"foobar",)], "b binary")
    got = [int(r[0]) for r in words.select(hashing.as_decimal(hashing.fnv1a64(F.col("b")))).collect()]
    assert got == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8] == [hashing.fnv1a64_of(w) for w in (b"", b"a", b"foobar")]
    assert hashing.crc32c_of(b"123456789") == 0xE3069283
    assert words.select(hashing.crc32c("b")).first()[0] == 0


@pytest.mark.parametrize("n,p,m,k", [(0, 0.01, 512, 7), (100, 0.01, 959, 7), (953, 0.01, 9135, 7), (7437, 0.01, 71285, 7), (10000, 0.001, 143776, 10), (953, 0.99, 512, 1), (10000, 0.99, 512, 1), (100, 0.0, 959, 7)])
def test_bloom_sizing(spark, n, p, m, k):
    assert bloom.size_for(n, p) == (m, k)
    assert tuple(spark.range(1).select(*bloom.sizing(F.lit(n), F.lit(p))).first()) == (m, k)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.lit(1).cast("long").alias("gen"), F.concat(F.lit("key"), F.col("id").cast("string")).cast("binary").alias("key"))
    absent = spark.range(2000).select(F.concat(F.lit("no"), F.col("id").cast("string")).cast("binary").alias("key"))
    bits = bloom.build(keys, 0.01)
    assert bloom.might_contain(keys, bits).where(~F.col("maybe")).count() == 0
    assert bloom.might_contain(absent, bits).where("maybe").count() <= 60
    both = keys.select("key").unionAll(absent.select("key"))
    joined = {tuple(r) for r in bloom.candidates(both, bits, most=0).collect()}  # beyond the broadcast
    assert joined == {tuple(r) for r in bloom.candidates(both, bits).collect()}
    words = bloom.filters(bits).first()
    assert {64 * i + j for i, w in enumerate(words["words"]) for j in range(64) if w >> j & 1} == {r.bit_index for r in bits.collect()}
    assert 0.003 < bloom.estimate(bits).first().fpr < 0.03


def test_bloom_counts_and_candidates_are_those_of_each_filter(spark):
    held = {g: [b"%d-%d" % (g, i) for i in range(n)] for g, n in enumerate([1, 2, 9, 53, 54, 70, 70, 70, 71, 300, 300, *[60] * 20])}
    places = lambda key, m, k: [((h := hashing.fnv1a64_of(key)) % 2**32 + i * (h >> 32 | 1)) % m for i in range(k)]
    sizes = {g: bloom.size_for(len(ks), 0.01) for g, ks in held.items()}
    bits = {g: {b for x in ks for b in places(x, *sizes[g])} for g, ks in held.items()}
    wanted = [x for ks in held.values() for x in ks[:20]] + [b"no%d" % i for i in range(1500)]
    want = {(x, g) for x in wanted for g in held if bits[g].issuperset(places(x, *sizes[g]))}
    keys = spark.createDataFrame([(g, bytearray(x)) for g, ks in held.items() for x in ks], "gen long, key binary")
    asked = spark.createDataFrame([(bytearray(x),) for x in wanted] + [(bytearray(wanted[0]),), (None,)], "key binary")
    per = {x: sum((x, g) in want for g in held) for x in wanted}
    for most in (bloom.BROADCAST_BYTES, 700):  # in one block and in several
        found = [(bytes(r.key), r.gen) for r in bloom.candidates(asked, bloom.build(keys, 0.01), bloom.sized(keys, 0.01), most).collect()]
        assert len(found) == len(want) and set(found) == want
        counted = [(bytes(r.key), r.maybe) for r in bloom.counted(asked, bloom.placed(keys, 0.01), bloom.sized(keys, 0.01), most).collect()]
        assert len(counted) == len(per) and dict(counted) == per
    none = keys.limit(0)
    assert {r.maybe for r in bloom.counted(asked, bloom.placed(none, 0.01), bloom.sized(none, 0.01)).collect()} == {0}
    assert bloom.candidates(asked, bloom.build(none, 0.01)).count() == 0


def test_bloom_pruning_does_not_test_pair_by_pair(spark, tmp_path):
    rows = spark.range(10_000_000, step=250)  # two events a generation
    rows.select(F.col("id").alias("event_id"), (F.col("id") % 977).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(8000).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    began = time.monotonic()
    got = queries.bloom_prune_report(spark, str(tmp_path)).agg(F.count("*"), F.min("segments"), F.max("segments"), F.sum("pruned"), F.sum("false_positives")).first()
    took = time.monotonic() - began
    assert tuple(got)[:3] == (8000, 20_000, 20_000)
    assert 160_000_000 - got[3] - got[4] == rows.select(F.expr("id div 500"), F.col("id") % 977).distinct().count()  # all keys that are there
    assert took < 60  # 160 million pairs


@pytest.mark.parametrize("bad", [b"", b"\0" * 5, struct.pack("<IB", 64, 3), struct.pack("<IB", 64, 3) + b"\0" * 9, struct.pack("<IB", 0, 3)])
def test_malformed_filters_are_refused(bad):
    with pytest.raises(CorruptError):
        bloom.decode(bad)
    assert bloom.decode(bloom.encode(100, 3, {0, 63, 64, 99})) == (100, 3, {0, 63, 64, 99})


def test_log_files_of_both_kinds(spark, tmp_path):
    whole = [records.encode_record(b"a", b"1"), records.encode_record(b"b", b"", pending=True), records.encode_record(b"a", None, deleted=True)]
    for cut in range(1, 13):
        data = records.encode_log(whole)[:-cut]
        _, found = records.decode_log(data)
        assert [f.status for f in found] == ["ok", "ok", "torn"]
    flipped = bytearray(records.encode_log(whole))
    flipped[-1] ^= 1
    assert [f.status for f in records.decode_log(bytes(flipped))[1]] == ["ok", "ok", "corrupt"]
    zeros = records.encode_log(whole[:1]) + bytes(512)
    found = list(records.decode_log(zeros)[1])
    assert found[-1].status == "corrupt" and found[-1].nbytes == 512
    old = b"".join(struct.pack("<BII", d, len(k), len(v)) + k + v for d, k, v in ((0, b"alpha", b"1"), (0, b"beta", b"2"), (1, b"alpha", b"")))
    is_old, found = records.decode_log(old)
    assert is_old and [(f.key, f.deleted) for f in found] == [(b"alpha", False), (b"beta", False), (b"alpha", True)]
    with pytest.raises(UnknownVersionError):
        records.decode_log(b"STRATAWL" + struct.pack("<H", 2))
    (tmp_path / "wal").write_bytes(records.encode_log(whole))
    assert rows(records.read_log(spark, str(tmp_path / "wal")), "pos", "status", "pending", "deleted") == [(0, "ok", False, False), (1, "ok", True, False), (2, "ok", False, True)]


def test_segment_files(spark, tmp_path):
    data = records.encode_segment([(b"a", b"1", False), (b"b", None, True)])
    old, found, (m, k, bits) = records.decode_segment(data)
    assert not old and [(f.key, f.value, f.deleted) for f in found] == [(b"a", b"1", False), (b"b", None, True)] and (m, k) == (512, 7)
    for bad in (data[: len(data) // 2], data[:20] + bytes([data[20] ^ 255]) + data[21:], data[:-9] + b"x" + data[-8:]):
        with pytest.raises(CorruptError):
            records.decode_segment(bad)
    (tmp_path / "00000000000000000007.seg").write_bytes(data)
    (tmp_path / "notes.txt").write_bytes(b"x")
    assert rows(records.read_segments(spark, str(tmp_path)), "gen", "key", "deleted") == [(7, b"a", False), (7, b"b", True)]


def test_zipf_is_skewed_and_scramble_stays_in_range(spark):
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    ranks = u.select(workload.zipf_rank(F.col("u"), 1000).alias("r"))
    assert 0.08 < ranks.where("r = 0").count() / 20_000 < 0.20
    assert ranks.agg(F.min("r"), F.max("r")).first()[0] == 0
    low, high = spark.range(500).select(workload.scramble(F.col("id"), 1000).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert 0 <= low and high < 1000


def test_churn_accounts_for_every_key(spark):
    log = workload.churn(spark, 400).select("key", F.floor(F.col("pos") / 300).alias("gen"), "pos", "deleted", F.lit(b"v").alias("value"))
    r = ops.compaction_result(log).first()
    assert r.records_out + r.tombstones_purged == 400


def test_workload_limits():
    for bad in ({"mix": "Z"}, {"records": 0}, {"distribution": "normal"}):
        with pytest.raises(ValueError):
            workload.Workload(**bad)


def test_latency_summary_and_series(spark):
    s = spark.createDataFrame([(0, "read", i * 1000) for i in range(1, 101)] + [(2, "write", 5000)], "sec int, kind string, ns long")
    r = metrics.summary(s).where("kind = 'read'").first()
    assert (r.n, r.p50_us, r.p99_us, r.p999_us, r.max_us) == (100, 50.0, 99.0, 100.0, 100.0)
    gauges = spark.createDataFrame([(1, 3), (2, 0)], "sec int, segments int")
    assert rows(metrics.series(s, gauges, 4), "second", "reads", "writes", "segments") == [(0, 100, 0, 0), (1, 0, 0, 3), (2, 0, 1, 3), (3, 0, 0, 3)]


@pytest.mark.parametrize("bad", [{"memtable_size": 0}, {"false_positive_rate": 0.0}, {"false_positive_rate": 1.0}, {"sync": "always"}])
def test_options_are_validated(bad):
    with pytest.raises(ValueError):
        Options(**bad)


def state(table):
    return {bytes(r.key): bytes(r.value) for r in table.state().collect()}


def test_table_life(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    t.put(b"a", b"1")
    t.batch().put(b"b", b"2").put(b"b", b"3").delete(b"a").put(b"c", b"").commit()
    assert state(t) == {b"b": b"3", b"c": b""} and t.get(b"a") is None and t.has(b"c")
    assert t.flush() and not t.flush()
    t.delete(b"b")
    t = KVTable.open(spark, str(tmp_path))
    assert state(t) == {b"c": b""}
    t.flush()
    r = t.compact().first()
    assert (r.segments_in, r.records_in, r.records_out, r.tombstones_purged) == (2, 4, 1, 2)
    assert t.compact().first().segments_in == 0
    s = t.stats().first()
    assert (s.segments, s.segment_entries, s.memtable_keys) == (1, 1, 0)
    with pytest.raises(EmptyKeyError):
        t.put(b"", b"x")
    t.close()
    with pytest.raises(Exception, match="closed"):
        t.get(b"c")


def test_damage_is_refused(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    t.put(b"a", b"1" * 100)
    t.flush()
    part = t.manifest().segments[0]
    file = next(f for f in os.listdir(part.path) if f.endswith(".parquet"))
    whole = (tmp_path / part.path / file).read_bytes()
    (tmp_path / part.path / f".{file}.crc").unlink(missing_ok=True)
    (tmp_path / part.path / file).write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        KVTable.open(spark, str(tmp_path))


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    t.store.publish(Manifest(version=1))
    with pytest.raises(PublishConflict):
        t.store.publish(Manifest(version=1))
    assert t.store.versions() == [1]


KEYS = st.sampled_from([b"a", b"b", b"c"])
STEP = st.one_of(st.tuples(st.just("put"), KEYS, st.binary(max_size=4)), st.tuples(st.just("delete"), KEYS), st.tuples(st.just("flush")), st.tuples(st.just("compact")), st.tuples(st.just("reopen")))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(st.lists(STEP, min_size=2, max_size=5))
def test_table_agrees_with_a_dict(spark, tmp_path_factory, steps):
    root = str(tmp_path_factory.mktemp("t"))
    t, model = KVTable.open(spark, root), {}
    for kind, *args in steps:
        if kind == "put":
            t.put(*args)
            model[args[0]] = args[1]
        elif kind == "delete":
            t.delete(*args)
            model.pop(args[0], None)
        elif kind == "reopen":
            t = KVTable.open(spark, root)
        else:
            getattr(t, kind)()
    assert state(t) == model


def test_windows_counters_and_limits(spark, tmp_path):
    ops_ = spark.createDataFrame([(i, i * 500_000_000, "read" if i % 2 else "write", i != 3, i == 5, 10) for i in range(8)], "op_id long, start_ns long, kind string, found boolean, failed boolean, bytes long")
    inside = metrics.measured(ops_, F.lit(1_000_000_000), F.lit(3_000_000_000))
    assert rows(inside, "op_id", "sec") == [(2, 0), (3, 0), (4, 1), (5, 1)]
    assert metrics.counters(ops_).first().asDict() == {"operations": 8, "misses": 1, "read_errors": 1, "bytes_written": 40}
    assert rows(metrics.up_to(ops_, 6, 35, block=3), "op_id") == [(0,), (1,), (2,), (3,)]
    assert metrics.up_to(ops_, 6).count() == 6
    metrics.write_series(spark.createDataFrame([(1, 2), (0, 5)], "second int, reads long"), str(tmp_path / "csv"))
    file = next((tmp_path / "csv").glob("*.csv"))
    assert file.read_text() == "second,reads\n0,5\n1,2\n"
    assert segments.directory_size(spark, str(tmp_path / "csv")) >= file.stat().st_size
    line = metrics.describe(metrics.summary(spark.createDataFrame([(0, "read", 2000)], "sec int, kind string, ns long")))
    assert line == ["read: n 1, mean 2.0 us, p50 2.0, p95 2.0, p99 2.0, p999 2.0, max 2.0"]


def test_readers_go_on_while_a_table_changes(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), Options(retain=3))
    t.put(b"a", b"1")
    t.flush()
    t.put(b"a", b"2")
    before, version = t.state(), t.manifest().version
    t.flush()
    t.compact()
    assert [bytes(r.value) for r in before.collect()] == [b"2"]  # opened before the compaction
    assert [bytes(r.value) for r in t.version(version).select("value").collect()] == [b"2"]
    assert t.manifest().retired and t.vacuum(keep=0) > 0 and not t.manifest().retired
    assert state(t) == {b"a": b"2"} and t.vacuum(keep=0) == 0
    with pytest.raises(Exception):
        t.version(version).collect()
    assert len(t.store.versions()) <= 2


def test_a_commit_overwrites_without_filling_the_memtable(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), Options(memtable_size=100))
    for i in range(3):
        t.put(b"k", b"x" * 40)  # 54 bytes each, one key
    assert len(t.manifest().log) == 3 and not t.manifest().segments
    assert t.rewrite_log() and not t.rewrite_log() and len(t.manifest().log) == 1
    t.put(b"k", b"new")
    t.put(b"l", b"y" * 90)
    assert len(t.manifest().segments) == 1 and state(t) == {b"k": b"new", b"l": b"y" * 90}


def test_bulk_refusals_are_typed(spark, tmp_path, monkeypatch):
    t = KVTable.open(spark, str(tmp_path))
    with pytest.raises(EmptyKeyError):
        t.put_many(spark.createDataFrame([(bytearray(b""), bytearray(b"v"))], "key binary, value binary"))
    monkeypatch.setattr(ops, "MAX_RECORD", 10)
    with pytest.raises(RecordTooLargeError):
        t.put_many(spark.createDataFrame([(bytearray(b"k" * 6), bytearray(b"v" * 5))], "key binary, value binary"))
    monkeypatch.setattr("larder.plans.table.MAX_RECORD", 10)
    with pytest.raises(RecordTooLargeError):
        t.batch().put(b"k" * 6, b"v" * 5)
    assert t.manifest().version == 0


def test_creation_on_condition_refuses_an_existing_name(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path))
    target = t.store._path(f"{tmp_path}/_manifest/{1:020d}.json")
    t.store.create_new(target, Manifest(version=1).dumps())
    with pytest.raises(PublishConflict):
        t.store.create_new(target, "other")
    assert t.manifest().version == 1


def test_binary_stores_are_taken_over(spark, tmp_path):
    (tmp_path / "segments").mkdir()
    old = b"".join(records.encode_old_record(*r) for r in ((b"a", b"old", False), (b"b", b"old", False), (b"c", None, True)))
    (tmp_path / "segments" / "3.seg").write_bytes(old)
    (tmp_path / "segments" / f"{4:020d}.seg").write_bytes(records.encode_segment([(b"b", b"new", False), (b"d", b"1", False)]))
    log = records.encode_log([records.encode_record(b"a", None, deleted=True), records.encode_record(b"e", b"1"), *(records.encode_record(b"x%d" % i, b"-", pending=i < 49) for i in range(50))])
    (tmp_path / "wal").write_bytes(log[:-10])
    shape = file_stats(spark, str(tmp_path / "segments"), str(tmp_path / "wal")).first()
    assert (shape.segments, shape.segment_entries, shape.legacy_segments, shape.memtable_keys, shape.records_applied, shape.cause) == (2, 5, 1, 2, 2, "torn")
    assert file_stats(spark, str(tmp_path / "segments")).first().records_applied == 0
    t = KVTable.open(spark, str(tmp_path / "table"))
    report = t.import_files(str(tmp_path / "wal"), str(tmp_path / "segments")).first()
    assert report.records_applied == 2 and report.cause == "torn" and report.discarded_bytes > 0
    assert state(t) == {b"b": b"new", b"d": b"1", b"e": b"1"}
    s = KVTable.open(spark, str(tmp_path / "table")).stats().first()
    assert (s.records_applied, s.cause, s.legacy_segments) == (2, "torn", 0)
    whole, found, (m, k, bits) = records.decode_segment(old)
    assert whole and len(found) == 3 and (m, k) == (512, 7) and bits == records.filter_of([b"a", b"b", b"c"], 0.01)[2]
    old_log = records.encode_old_record(b"alpha", b"1") + records.encode_old_record(b"beta", b"2") + b"\0\0"
    is_old, now = records.decode_log(records.current_log(old_log))
    assert not is_old and [(f.status, f.key, f.value) for f in now] == [("ok", b"alpha", b"1"), ("ok", b"beta", b"2")]
    segments.copy_directory(spark, str(tmp_path / "segments"), str(tmp_path / "copy"))
    assert (tmp_path / "copy" / "3.seg").read_bytes() == old


def test_throttle_drops_a_backlog():
    now, slept = [0.0], []
    t = load.Throttle(1.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    t.wait()
    now[0] += 0.6  # a step that takes part of the interval
    t.wait()
    assert [round(s, 6) for s in slept] == [1.0, 0.4]
    now[0] += 10  # a stall
    assert t.wait() == 0 and t.next == now[0]
    assert load.Throttle(0, lambda: 0.0).wait() == 0


def test_load_run_measures_and_compacts(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path), Options(memtable_size=1))
    w = workload.Workload(mix="A", records=40, operations=60, seconds=300, value_size=8)
    load.load(t, w)
    done = load.run(t, w, step=30, compact_at=2)
    assert (done.operations, done.misses, done.stopped) == (60, 0, "operations done")
    assert done.samples.count() == 60 and t.state().count() == 40 and len(t.manifest().segments) == 1
    assert metrics.compaction_times(done.compactions).first().compactions >= 1
    assert done.gauges.count() >= 1
    assert load.run(t, workload.Workload(mix="A", records=40, operations=60, seconds=1), clock=iter(range(0, 1000, 5)).__next__).stopped == "seconds over"
    assert not load.should_compact(9, None) and not load.should_compact(1, 2) and load.should_compact(2, 2)


def test_fixture_has_exactly_its_segments(spark, tmp_path):
    t = load.build_fixture(spark, str(tmp_path), 2, 8192)
    assert [p.rows for p in t.manifest().segments] == [127, 127] and not t.manifest().log


@pytest.mark.parametrize("bad", [{"threads": 65}, {"seconds": 0}, {"records": 1}, {"records": 2_000_001}, {"most_write_mb": 4096}, {"target_ops": -1}, {"value_size": -1}])
def test_workload_settings_are_bounded(bad):
    with pytest.raises(ValueError):
        workload.Workload(**bad)


def test_summary_lines_name_rates_and_absent_kinds(spark):
    s = spark.createDataFrame([(0, "read", 2000)] * 4, "sec int, kind string, ns long")
    assert metrics.describe(metrics.summary(s, seconds=2), ("read", "write")) == ["read: n 4, ops/s 2, mean 2.0 us, p50 2.0, p95 2.0, p99 2.0, p999 2.0, max 2.0", "write: no operations"]
    spent = spark.createDataFrame([(1, 5), (1, 7)], "sec int, ms long")
    gauges = spark.createDataFrame([(1, 3)], "sec int, segments int")
    out = metrics.series(s, gauges, 3, spent)
    assert out.columns == ["second", "reads", "writes", "read_p50_us", "read_p99_us", "read_max_us", "write_p99_us", "write_max_us", "segments", "compaction_ms"]
    assert rows(out, "second", "compaction_ms") == [(0, 0), (1, 12), (2, 0)]
