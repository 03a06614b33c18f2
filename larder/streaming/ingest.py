"""Streams into tables, and the flush points of a log read as a stream."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.model import RECORD_OVERHEAD
from larder.plans.load import Compactor
from larder.plans.table import KVTable


def ingest(stream: DataFrame, table: KVTable, checkpoint: str, name: str = "ingest", compact_at: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Commit each micro-batch of mutations (key, deleted, value[, pos]) to the table, once: the batch
    number is published with the data, so a batch that is run again after a failure changes nothing.
    With compact_at, the table is compacted whenever it has that many segments."""

    def apply(batch: DataFrame, number: int) -> None:
        if table.commit(batch, epoch=(name, number)):
            Compactor(table, compact_at).poll()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def flush_points(log: DataFrame, limit: int, shard: str = "shard") -> DataFrame:
    """(shard, flush, pos, keys, bytes): where each shard's memtable reaches the limit.

    The size depends on every write since the last flush, and overwrites may shrink it, so a shard is
    read in order by one task, in batches; its state is one memtable. Shards run in parallel: they are
    the unit to choose with the data's size in mind.
    """
    rows = log.select(shard, "pos", "key", F.coalesce(F.octet_length("value"), F.lit(0)).alias("size"))
    rows = rows.repartition(F.col(shard)).sortWithinPartitions(shard, "pos")

    def fold(pdfs):
        now, held, total, flushes = None, {}, 0, 0
        for pdf in pdfs:
            out = []
            for s, pos, key, size in zip(pdf[shard], pdf["pos"], pdf["key"], pdf["size"]):
                if s != now:
                    now, held, total, flushes = s, {}, 0, 0
                size = int(size) + RECORD_OVERHEAD + len(key)
                total += size - held.get(key, 0)
                held[key] = size
                if total >= limit:
                    flushes += 1
                    out.append((s, flushes, pos, len(held), total))
                    held, total = {}, 0
            yield pd.DataFrame(out, columns=["shard", "flush", "pos", "keys", "bytes"])

    return rows.mapInPandas(fold, "shard long, flush long, pos long, keys long, bytes long")


def per_second(stream: DataFrame, ts: str = "ts", late: str = "10 seconds", **aggregates) -> DataFrame:
    """Tumbling one-second windows over a stream of samples, kept open for late rows."""
    columns = [c.alias(name) for name, c in (aggregates or {"n": F.count("*")}).items()]
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 second")).agg(*columns).select(F.col("window.start").alias("second"), *(F.col(n) for n in (aggregates or {"n": 0})))


