"""Load runs against a table: schedule, sampling, compaction policy and what was measured.

Single operations are Spark jobs here, so a run replays its operations in steps: the reads of a step are
one bulk lookup and its writes one commit, and an operation's latency is that of its step.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import workload
from larder.functions.workload import Workload
from larder.model import Options
from larder.plans.table import KVTable

MAX_BACKLOG = 1.0  # seconds


class Throttle:
    """Paces steps by a schedule, so that after a slow one the wait is shorter; a backlog of more than
    MAX_BACKLOG seconds is dropped, not paid back in a burst."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.next = clock()

    def wait(self) -> float:
        """Wait for the next step; the seconds slept."""
        if self.interval <= 0:
            return 0.0
        self.next += self.interval
        left = self.next - self.clock()
        if left > 0:
            self.sleep(left)
        elif left < -MAX_BACKLOG:
            self.next = self.clock()
        return max(0.0, left)


def should_compact(segments: int, compact_at: int | None) -> bool:
    """The policy: at so many segments; None or 0 for never."""
    return bool(compact_at) and segments >= compact_at


@dataclass
class Compactor:
    """Looks at a table now and then, and compacts it at `compact_at` segments."""

    table: KVTable
    compact_at: int | None
    clock: Callable[[], float] = time.monotonic
    done: list[tuple[float, int]] = field(default_factory=list)  # (start, milliseconds)

    def poll(self) -> bool:
        if not should_compact(len(self.table.manifest().segments), self.compact_at):
            return False
        start = self.clock()
        self.table.compact()
        self.done.append((start, int((self.clock() - start) * 1000)))
        return True


@dataclass
class SegmentSampler:
    """The number of segments, once for each second of a run in which it is asked."""

    table: KVTable
    start: float
    seconds: int
    clock: Callable[[], float] = time.monotonic
    seen: dict[int, int] = field(default_factory=dict)

    def poll(self) -> None:
        sec = int(self.clock() - self.start)
        if 0 <= sec < self.seconds and sec not in self.seen:
            self.seen[sec] = len(self.table.manifest().segments)


@dataclass
class Run:
    samples: DataFrame  # sec, kind, ns
    gauges: DataFrame  # sec, segments
    compactions: DataFrame  # sec, ms
    misses: int
    operations: int
    stopped: str


def load(table: KVTable, w: Workload, batch: int = 500) -> None:
    """The records a workload starts from, as one commit."""
    table.put_many(workload.load_phase(table.spark, w, batch).select("key", "value"))


def run(table: KVTable, w: Workload, step: int = 1000, compact_at: int | None = None, clock: Callable[[], float] = time.monotonic) -> Run:
    """Replay a workload's operations until they are done, its seconds are over or its bytes written."""
    spark = table.spark
    ops = workload.operations(spark, w)
    start = clock()
    compactor, sampler = Compactor(table, compact_at, clock), SegmentSampler(table, start, w.seconds, clock)
    throttle = Throttle(step / w.target_ops if w.target_ops else 0.0, clock)
    samples, misses, done, written, stopped = [], 0, 0, 0, "operations done"
    per_write = 64 + w.value_size + 13
    while done < w.operations:
        if clock() - start >= w.seconds:
            stopped = "seconds over"
            break
        if written >= w.most_write_mb << 20:
            stopped = "bytes written"
            break
        throttle.wait()
        part = ops.where((F.col("op_id") >= done) & (F.col("op_id") < done + step))
        began = clock()
        reads = part.where("kind = 'read'").select("key")
        found = table.get_many(reads).agg(F.count("*").alias("n"), F.count_if(~F.col("found")).alias("misses")).first()
        between = clock()
        writes = part.where("kind <> 'read'").select("key", workload.value_bytes(w.value_size).alias("value"))
        n_writes = min(step, w.operations - done) - found["n"]
        if n_writes:
            table.put_many(writes)
        sec, end = int(began - start), clock()
        samples += [(sec, "read", int((between - began) * 1e9), found["n"]), (sec, "write", int((end - between) * 1e9), n_writes)]
        misses, done, written = misses + found["misses"], done + found["n"] + n_writes, written + n_writes * per_write
        sampler.poll()
        compactor.poll()
    rows = spark.createDataFrame(samples, "sec int, kind string, ns long, n long").where("n > 0")
    each = rows.select("sec", "kind", F.explode(F.array_repeat("ns", F.col("n").cast("int"))).alias("ns"))
    compactions = [(int(at - start), ms) for at, ms in compactor.done if at - start < w.seconds]
    return Run(each, spark.createDataFrame(list(sampler.seen.items()), "sec int, segments int"), spark.createDataFrame(compactions, "sec int, ms long"), misses, done, stopped)


def build_fixture(spark, root: str, segments: int, value_size: int, rate: float = 0.01) -> KVTable:
    """A table of exactly so many full segments, nothing unflushed."""
    table = KVTable.open(spark, root, Options(memtable_size=1 << 40, false_positive_rate=rate))
    rows = workload.full_segments(spark, segments, value_size)
    for gen in range(1, segments + 1):
        table.commit(rows.where(F.col("gen") == gen).select("key", "pos", "deleted", "value"))
        table.flush()
    return table
