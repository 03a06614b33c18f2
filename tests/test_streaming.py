"""Stream ingest and flush points."""

from larder.model import Options, RECORD_OVERHEAD
from larder.plans.table import KVTable
from larder.streaming.ingest import flush_points, ingest

SCHEMA = "key binary, pos long, deleted boolean, value binary"


def test_stream_commits_each_batch_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(bytearray(b"a"), 0, False, bytearray(b"1")), (bytearray(b"b"), 1, False, bytearray(b"2"))], SCHEMA).coalesce(1).write.parquet(source)
    table = KVTable.open(spark, str(tmp_path / "table"), Options(memtable_size=1))
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    ingest(stream, table, str(tmp_path / "ck")).awaitTermination()
    assert {bytes(r.key) for r in table.state().collect()} == {b"a", b"b"}
    assert len(table.manifest().segments) == 1  # the limit of one byte flushes at once
    again = spark.createDataFrame([(bytearray(b"a"), 0, True, None)], SCHEMA)
    assert not table.commit(again, epoch=("ingest", 0))
    assert table.has(b"a")


def test_flush_points_follow_a_fold(spark):
    log = [(i % 2, i, f"k{i * 7 % 5}", "v" * (i * 13 % 40)) for i in range(200)]
    want = []
    for shard in (0, 1):
        held, flushes = {}, 0
        for s, pos, key, value in log:
            if s == shard:
                held[key] = RECORD_OVERHEAD + len(key) + len(value)
                if sum(held.values()) >= 120:
                    flushes += 1
                    want.append((shard, flushes, pos, len(held), sum(held.values())))
                    held = {}
    df = spark.createDataFrame([(s, p, k, v) for s, p, k, v in log], "shard long, pos long, key string, value string")
    assert sorted(tuple(r) for r in flush_points(df, 120).collect()) == want
