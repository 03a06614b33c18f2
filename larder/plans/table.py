"""KVTable: a table of keys and values whose every change is one published manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.model import MAX_RECORD, TAIL_GEN, ClosedError, EmptyKeyError, Options, RecordTooLargeError, SyncMode
from larder.operators import log as ops
from larder.operators import recovery
from larder.sources import records, segments
from larder.sources.manifest import Manifest, ManifestStore, Part, PublishConflict

STATS = "segments int, segment_entries long, memtable_keys long, memtable_bytes long, legacy_segments int, version long, records_applied long, discarded_bytes long, cause string"
COMPACTED = "segments_in int, records_in long, records_out long, tombstones_purged long, bytes_in long, bytes_out long"


class Batch:
    """Ordered staged mutations, committed in one step; the last write of a key wins."""

    def __init__(self, table: KVTable):
        self.table, self.rows = table, []

    def put(self, key: bytes, value: bytes) -> Batch:
        return self._add(key, False, bytes(value))

    def delete(self, key: bytes) -> Batch:
        return self._add(key, True, None)

    def _add(self, key: bytes, deleted: bool, value: bytes | None) -> Batch:
        if not key:
            raise EmptyKeyError("empty key")
        if len(key) + len(value or b"") > MAX_RECORD:
            raise RecordTooLargeError(f"record exceeds {MAX_RECORD} bytes")
        self.rows.append((bytearray(key), len(self.rows), deleted, None if value is None else bytearray(value)))
        return self

    def __len__(self) -> int:
        return len(self.rows)

    def size(self) -> int:
        """Key and value bytes staged, repeats included."""
        return sum(len(k) + len(v or b"") for k, _, _, v in self.rows)

    def reset(self) -> None:
        self.rows.clear()

    def commit(self) -> None:
        """All or nothing; the batch is emptied on success and kept on failure."""
        if self.rows:
            self.table.commit(self.table.spark.createDataFrame(self.rows, "key binary, pos long, deleted boolean, value binary"))
            self.reset()


class KVTable:
    """Open with KVTable.open(). Bulk calls take and give DataFrames."""

    def __init__(self, spark: SparkSession, root: str, options: Options):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.store = ManifestStore(spark, self.root)
        self.closed = False

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options | None = None, verify: bool = True) -> KVTable:
        """Open or create. With verify, every listed part is counted against the manifest first."""
        table = cls(spark, root, options or Options())
        current = table.store.current()
        if verify:
            segments.verify(spark, current.segments + current.log)
        return table

    def sync(self) -> None:
        """Returns when what was committed is durable. A commit is once it is published, so this only
        checks that the table is open and its manifest can be read."""
        self.manifest()

    def close(self) -> None:
        """Ends this handle. What was committed stays; nothing is flushed."""
        self.closed = True

    def manifest(self) -> Manifest:
        if self.closed:
            raise ClosedError("the table was closed")
        return self.store.current()

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    def _publish(self, change: Callable[[Manifest], Manifest | None], retries: int = 20) -> Manifest | None:
        """Publish change(current); on a conflict, change what has become current since."""
        for _ in range(retries):
            new = change(self.manifest())
            if new is None:
                return None
            try:
                self.store.publish(new, self.options.sync is SyncMode.ALWAYS)
                return new
            except PublishConflict:
                continue
        raise PublishConflict(f"gave up after {retries} tries")

    # writing

    def commit(self, rows: DataFrame, epoch: tuple[str, int] | None = None) -> bool:
        """Append mutations (key, deleted, value, and pos where order within matters) in one step, then
        flush if the unflushed data have reached the limit. epoch names a stream and its batch number;
        one that is recorded already is not applied again, and False is returned."""
        if epoch and self.manifest().epochs.get(epoch[0], -1) >= epoch[1]:
            return False
        if "pos" not in rows.columns:
            rows = rows.withColumn("pos", F.monotonically_increasing_id())
        checked = ops.checked(rows.select("key", "pos", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("value", F.lit(b"")).alias("value")))
        try:
            part, last = segments.write(checked, self._path("log"), TAIL_GEN)
        except Exception as e:
            for refused, named in ((EmptyKeyError, ops.EMPTY_KEY), (RecordTooLargeError, ops.TOO_LARGE)):
                if named in str(e):
                    raise refused(named) from e
            raise
        if not part.rows:
            self.store.delete((part,))
            return True

        def add(m: Manifest) -> Manifest | None:
            if epoch and m.epochs.get(epoch[0], -1) >= epoch[1]:
                return None
            epochs = {**m.epochs, epoch[0]: epoch[1]} if epoch else m.epochs
            # positions inside a commit are its own; the commit's place is its gen-like start position
            placed = replace(part, gen=m.next_pos)
            return m.after(log=(*m.log, placed), next_pos=m.next_pos + last + 1, epochs=epochs)

        if self._publish(add) is None:
            self.store.delete((part,))
            return False
        if self._is_full():
            self.flush()
        return True

    def put_many(self, rows: DataFrame) -> None:
        """Rows (key, value)."""
        self.commit(rows.select("key", F.lit(False).alias("deleted"), "value"))

    def delete_many(self, keys: DataFrame) -> None:
        """Tombstones, whether or not the keys are known."""
        self.commit(keys.select("key", F.lit(True).alias("deleted"), F.lit(None).cast("binary").alias("value")))

    def batch(self) -> Batch:
        return Batch(self)

    def put(self, key: bytes, value: bytes) -> None:
        self.batch().put(key, value).commit()

    def delete(self, key: bytes) -> None:
        self.batch().delete(key).commit()

    # reading

    def _tail(self, m: Manifest) -> DataFrame:
        """Unflushed rows, with positions that order commits one after another."""
        rows = segments.read_paths(self.spark, [p.path for p in m.log])
        if not m.log:
            return rows
        starts = self.spark.createDataFrame([(p.path.rsplit("/", 1)[1], p.gen) for p in m.log], "name string, start long")
        named = rows.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return named.join(F.broadcast(starts), "name").select("key", "gen", (F.col("pos") + F.col("start")).alias("pos"), "deleted", "value")

    def log(self, m: Manifest | None = None) -> DataFrame:
        """Everything readers see, all versions: segments and the unflushed tail."""
        m = m or self.manifest()
        return segments.read_paths(self.spark, [p.path for p in m.segments]).unionByName(self._tail(m))

    def state(self) -> DataFrame:
        """(key, value) of current keys."""
        return ops.visible(self.log()).select("key", "value")

    def get_many(self, keys: DataFrame) -> DataFrame:
        return ops.get_many(keys, self.log())

    def has_many(self, keys: DataFrame) -> DataFrame:
        return ops.has_many(keys, self.log())

    def get(self, key: bytes) -> bytes | None:
        """One value; None if the key is not there. Read failures raise."""
        if not key:
            raise EmptyKeyError("empty key")
        row = self.log().where(F.col("key") == F.lit(bytearray(key))).orderBy(F.desc("gen"), F.desc("pos")).first()
        return None if row is None or row["deleted"] else bytes(row["value"])

    def has(self, key: bytes) -> bool:
        return self.get(key) is not None

    def scan(self, low: bytes, high: bytes) -> DataFrame:
        """Extension: current keys with low <= key < high."""
        return ops.key_range(self.log(), F.lit(bytearray(low)), F.lit(bytearray(high))).select("key", "value")

    def version(self, number: int) -> DataFrame:
        """Extension: the state at an older version, while its files are still there."""
        return ops.visible(self.log(self.store.read(number))).select("key", "value")

    # upkeep

    def _is_full(self) -> bool:
        """Whether the unflushed data reach the limit. The manifest has each commit's bytes, which are
        more than what a memtable holds where commits overwrite one another; only between the limit and
        four times as much are the rows looked at."""
        m, limit = self.manifest(), self.options.memtable_size
        logged = sum(p.bytes for p in m.log)
        return logged >= limit and (logged >= 4 * limit or ops.memtable_size(self._tail(m)).first()["bytes"] >= limit)

    def vacuum(self, keep: int | None = None) -> int:
        """Delete what only versions older than the last `keep` (else Options.retain) read; the number of
        folders that went. Readers of newer versions are not disturbed."""
        keep, gone = self.options.retain if keep is None else keep, []

        def change(m: Manifest) -> Manifest | None:
            gone[:] = [path for v, path in m.retired if v <= m.version - keep]
            return replace(m.after(), retired=tuple(r for r in m.retired if r[1] not in set(gone))) if gone else None

        done = self._publish(change)
        if done is not None:
            self.store.forget(done.version - 1 - keep)
            self.store.delete_paths(gone)
        return len(gone) if done is not None else 0

    def rewrite_log(self) -> bool:
        """The unflushed commits become one, without what newer ones hide."""
        before = self.manifest()
        if len(before.log) < 2:
            return False
        done, _ = segments.write(ops.newest(self._tail(before)), self._path("log"), TAIL_GEN)

        def swap(m: Manifest) -> Manifest | None:
            if m.log[: len(before.log)] != before.log:
                return None
            # its positions are the table's own already
            return m.after(retire=before.log, log=(replace(done, gen=0), *m.log[len(before.log) :]))

        if self._publish(swap) is None:
            self.store.delete((done,))
            return False
        return True

    def import_files(self, log: str | None = None, segment_files: str | None = None) -> DataFrame:
        """Take over binary segment files and a binary log, of the current or the old kind: first the
        segments' newest records, as one segment, then what recovery applies of the log, as one commit.
        One row: records_applied, discarded_bytes and cause of the log; stats() has it too."""
        if segment_files is not None:
            found = records.read_segments(self.spark, segment_files).withColumn("pos", F.lit(0).cast("long"))
            before = self.manifest()
            done, _ = segments.write(ops.newest(found), self._path("segments"), before.next_gen, self.options.false_positive_rate, 1 << 20)

            def add(m: Manifest) -> Manifest | None:
                return m.after(segments=(*m.segments, done), next_gen=m.next_gen + 1) if m.next_gen == before.next_gen else None

            if done.rows and self._publish(add) is None:
                self.store.delete((done,))
                raise PublishConflict("another writer added a segment during the import")
        report = {"records_applied": 0, "discarded_bytes": 0, "cause": None}
        if log is not None:
            found = records.read_log(self.spark, log)
            report = recovery.report(found).first().asDict()
            self.commit(recovery.committed(found).select("key", "pos", "deleted", "value"))
        self._publish(lambda m: m.after(recovery=report))
        return self.spark.createDataFrame([tuple(report.values())], "records_applied long, discarded_bytes long, cause string")

    def flush(self) -> bool:
        """The unflushed rows become one segment; nothing to flush is no change."""
        before = self.manifest()
        if not before.log:
            return False
        rows = ops.newest(self._tail(before))
        done, _ = segments.write(rows, self._path("segments"), before.next_gen, self.options.false_positive_rate, sum(p.rows for p in before.log))

        def swap(m: Manifest) -> Manifest | None:
            if m.log[: len(before.log)] != before.log or m.next_gen != before.next_gen:
                return None  # flushed by another writer
            return m.after(retire=before.log, segments=(*m.segments, done), log=m.log[len(before.log) :], next_gen=m.next_gen + 1)

        if self._publish(swap) is None:
            self.store.delete((done,))
            return False
        return True

    def compact(self, force: bool = False) -> DataFrame:
        """Merge all segments into one and drop tombstones; one row of counters. Fewer than two segments
        are left alone, with zero counters, unless forced. What is replaced goes with a later vacuum."""
        self.flush()
        before = self.manifest()
        if len(before.segments) < (1 if force else 2):
            return self.spark.createDataFrame([(0,) * 6], COMPACTED)
        old = segments.read_paths(self.spark, [p.path for p in before.segments])
        done, _ = segments.write(ops.visible(old), self._path("segments"), before.next_gen, self.options.false_positive_rate, max(p.rows for p in before.segments))

        def swap(m: Manifest) -> Manifest | None:
            if m.segments[: len(before.segments)] != before.segments:
                return None
            gen = m.next_gen
            return m.after(retire=before.segments, segments=(done, *m.segments[len(before.segments) :]), next_gen=gen + 1)

        # keys alone, and only if there are tombstones at all
        purged = ops.tombstoned(old.select("key", "gen", "pos", "deleted")).count() if any(p.tombstones for p in before.segments) else 0
        if self._publish(swap) is None:
            self.store.delete((done,))
            raise PublishConflict("the segments changed during compaction")
        self.vacuum()
        counters = (len(before.segments), sum(p.rows for p in before.segments), done.rows, purged, sum(p.bytes for p in before.segments), done.bytes)
        return self.spark.createDataFrame([counters], COMPACTED)

    def stats(self) -> DataFrame:
        """One row: the table's shape, and what the last import of a log found. Segments of the old kind
        are rewritten when they are imported, so the table has none; file_stats() counts those of a store's
        own files."""
        m = self.manifest()
        size = ops.memtable_size(self._tail(m)).first()
        recovered = m.recovery or {"records_applied": 0, "discarded_bytes": 0, "cause": None}
        return self.spark.createDataFrame([(len(m.segments), sum(p.rows for p in m.segments), size["keys"], size["bytes"], 0, m.version, *recovered.values())], STATS)


def file_stats(spark: SparkSession, segment_files: str, log: str | None = None) -> DataFrame:
    """One row, STATS without a version, over a store's own binary files as they are."""
    shape = records.read_segments(spark, segment_files).agg(F.countDistinct("gen").cast("int").alias("segments"), F.count("*").alias("segment_entries"), F.countDistinct(F.when(F.col("old"), F.col("gen"))).cast("int").alias("legacy_segments"))
    if log is None:
        none = spark.createDataFrame([(0, 0, 0, 0, None)], "memtable_keys long, memtable_bytes long, records_applied long, discarded_bytes long, cause string")
        return shape.crossJoin(none)
    found = records.read_log(spark, log)
    tail = recovery.committed(found).withColumn("gen", F.lit(TAIL_GEN))
    size = ops.memtable_size(tail).select(F.col("keys").alias("memtable_keys"), F.col("bytes").alias("memtable_bytes"))
    return shape.crossJoin(size).crossJoin(recovery.report(found))  # one row each
