"""Latency and throughput analytics over samples (sec, kind, ns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The percentiles a summary names.
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def percentile(p: float, ns: str) -> Column:
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {ns})")


def summary(samples: DataFrame, by: str = "kind", ns: str = "ns", seconds: float | None = None) -> DataFrame:
    """Per kind: n, mean, p50, p95, p99, p999 and max in microseconds; and, if it is known how many seconds
    were measured, ops_per_sec."""
    out = samples.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(ns) / 1e3, 3).alias("mean_us"),
        *((percentile(p, ns) / 1e3).alias(f"{name}_us") for name, p in PERCENTILES.items()),
        (F.max(ns) / 1e3).alias("max_us"),
    )
    return out if seconds is None else out.withColumn("ops_per_sec", F.col("n") / F.lit(float(seconds)))


def throughput(samples: DataFrame, seconds: int, capped: bool = False) -> DataFrame:
    """Operations per second; when a cap ended the run early, over the seconds that ran."""
    ran = F.max("sec") + 1 if capped else F.lit(seconds)
    return samples.agg((F.count("*") / ran).alias("ops_per_sec"))


def series(samples: DataFrame, gauges: DataFrame, seconds: int, compactions: DataFrame | None = None) -> DataFrame:
    """One row per second from 0, empty ones included: reads, writes, percentiles and maxima of either, the
    segment count (gauges: sec, segments), carried forward over seconds without one, and the milliseconds
    of the compactions (sec, ms) that began in it."""
    of = {k: F.col("kind") == k for k in ("read", "write")}

    def when(kind: str, p: float) -> Column:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ns) FILTER (WHERE kind = '{kind}')")

    per = samples.groupBy("sec").agg(
        *(F.count_if(of[k]).alias(f"{k}s") for k in of),
        when("read", 0.5).alias("read_p50"),
        *(when(k, 0.99).alias(f"{k}_p99") for k in of),
        *(F.max(F.when(of[k], F.col("ns"))).alias(f"{k}_max") for k in of),
    )
    spine = samples.sparkSession.range(seconds).select(F.col("id").cast("int").alias("second"))
    known = gauges.groupBy("sec").agg(F.max("segments").alias("segments"))
    filled = spine.join(known, F.col("second") == known.sec, "left").drop("sec")
    carried = F.last(F.nullif(F.col("segments"), F.lit(0)), ignorenulls=True).over(Window.orderBy("second").rowsBetween(Window.unboundedPreceding, 0))
    filled = filled.withColumn("segments", F.coalesce(carried, F.lit(0)).cast("int"))  # one row per second of a run
    out = filled.join(per, F.col("second") == per.sec, "left").drop("sec")
    if compactions is None:
        out = out.withColumn("ms", F.lit(0).cast("long"))
    else:
        spent = compactions.groupBy("sec").agg(F.sum("ms").cast("long").alias("ms"))
        out = out.join(spent, F.col("second") == spent.sec, "left")
    micro = [F.coalesce(F.col(c) / 1e3, F.lit(0.0)).alias(f"{c}_us") for c in ("read_p50", "read_p99", "read_max", "write_p99", "write_max")]
    return out.select("second", *(F.coalesce(f"{k}s", F.lit(0)).alias(f"{k}s") for k in of), *micro, "segments", F.coalesce("ms", F.lit(0)).cast("long").alias("compaction_ms"))


def compaction_times(compactions: DataFrame) -> DataFrame:
    """One row over compactions (ms): how many, their sum and the longest."""
    total, longest = (F.coalesce(f("ms"), F.lit(0)).cast("long") for f in (F.sum, F.max))
    return compactions.agg(F.count("*").alias("compactions"), total.alias("total_ms"), longest.alias("longest_ms"))


def reclaimed(before: Column, after: Column) -> Column:
    return 100 * (before - after) / before


def measured(operations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Operations (start_ns, ...) that began inside the measured window, with their second in it; what
    warms up before it or runs over after it is left out."""
    inside = operations.where((F.col("start_ns") >= start) & (F.col("start_ns") < end))
    return inside.withColumn("sec", F.floor((F.col("start_ns") - start) / 1_000_000_000).cast("int"))


def counters(operations: DataFrame) -> DataFrame:
    """One row over operations (kind, found, failed, bytes): operations, misses, read_errors and
    bytes_written. A read that failed is an error, never a miss."""
    read = F.col("kind") == "read"
    return operations.agg(
        F.count("*").alias("operations"),
        F.count_if(read & ~F.col("failed") & ~F.col("found")).alias("misses"),
        F.count_if(read & F.col("failed")).alias("read_errors"),
        F.coalesce(F.sum(F.when(~read & ~F.col("failed"), F.col("bytes"))), F.lit(0).cast("long")).alias("bytes_written"),
    )


def up_to(operations: DataFrame, most_operations: int | None = None, most_bytes: int | None = None, block: int = 1 << 16) -> DataFrame:
    """Operations (op_id from 0, bytes) up to the one that reaches a limit, that one included.

    Bytes are summed within blocks of operations, and only the blocks' sums one after another.
    """
    if most_operations is not None:
        operations = operations.where(F.col("op_id") < most_operations)
    if most_bytes is None:
        return operations
    rows = operations.withColumn("_block", F.floor(F.col("op_id") / block).cast("long"))
    sums = rows.groupBy("_block").agg(F.sum("bytes").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("_block").orderBy("op_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(sums, "_block")
    return rows.where(F.col("_before") + F.col("_inside") < most_bytes).drop("_block", "_inside", "_before")


def write_series(table: DataFrame, path: str) -> None:
    """A per-second series as one CSV file with a header: one row per second of a run."""
    table.coalesce(1).sortWithinPartitions("second").write.option("header", True).csv(path)


def describe(table: DataFrame, kinds: tuple[str, ...] = ()) -> list[str]:
    """The lines of a summary for people; a kind that is asked for and has no operations says so."""
    rows = {r["kind"]: r.asDict() for r in table.collect()}  # one row per kind
    out = []
    for kind in sorted({*rows, *kinds}):
        if kind not in rows:
            out.append(f"{kind}: no operations")
            continue
        r = rows[kind]
        rate = f"ops/s {r['ops_per_sec']:.0f}, " if "ops_per_sec" in r else ""
        out.append(f"{kind}: n {r['n']}, {rate}mean {r['mean_us']:.1f} us, " + ", ".join(f"{p} {r[f'{p}_us']:.1f}" for p in (*PERCENTILES, "max")))
    return out
