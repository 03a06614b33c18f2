"""Operators over mutation logs: what is current, what is gone, where it is found.

A log has one row per mutation: key, gen, pos, deleted, value. Version order is (gen, pos).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.hashing import crc32c, little_endian
from larder.model import MAX_RECORD, RECORD_OVERHEAD

VERSION = ("gen", "pos")
EMPTY_KEY, TOO_LARGE = "empty key", f"record exceeds {MAX_RECORD} bytes"


def newest(log: DataFrame, by: tuple[str, ...] = ("key",), version: tuple[str, ...] = VERSION) -> DataFrame:
    """The newest row of each key. The rank limit is applied before the shuffle too, so a key with many
    versions sends one row per task. Filters on columns other than the key must come after this."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(v) for v in version)))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def visible(log: DataFrame) -> DataFrame:
    """Current state: newest rows that are not tombstones."""
    return newest(log).where(~F.col("deleted"))


def tombstoned(log: DataFrame) -> DataFrame:
    return newest(log).where("deleted")


def overlay(*layers: DataFrame) -> DataFrame:
    """Layers as one log, newest layer first; replaying a layer that is in another changes nothing."""
    ranked = [layer.withColumn("gen", F.lit(len(layers) - i).cast("long")) for i, layer in enumerate(layers)]
    return reduce(DataFrame.unionByName, ranked)


def record_bytes(key: Column, value: Column) -> Column:
    return F.lit(RECORD_OVERHEAD).cast("long") + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def checked(log: DataFrame) -> DataFrame:
    """The log, failing on the first empty key or oversized record when it is read."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    bad = F.when(F.col("key").isNull() | (F.octet_length("key") == 0), F.raise_error(F.lit(EMPTY_KEY)).cast("binary"))
    bad = bad.when(size > MAX_RECORD, F.raise_error(F.lit(TOO_LARGE)).cast("binary"))
    return log.withColumn("key", bad.otherwise(F.col("key")))


def segment_records(log: DataFrame) -> DataFrame:
    """What segments hold: one record per generation and key."""
    return newest(log, ("gen", "key"), ("pos",))


def compaction_result(log: DataFrame) -> DataFrame:
    """One row: segments_in, records_in, records_out, tombstones_purged, bytes_in, bytes_out.

    One shuffle by key: the records of a key's generations are counted and the newest picked from the
    same window.
    """
    w = Window.partitionBy("key").orderBy(F.desc("gen"))
    ranked = segment_records(log).withColumn("r", F.row_number().over(w)).withColumn("size", record_bytes(F.col("key"), F.col("value")))
    live = (F.col("r") == 1) & ~F.col("deleted")
    return ranked.agg(
        F.countDistinct("gen").alias("segments_in"),
        F.count("*").alias("records_in"),
        F.count_if(live).alias("records_out"),
        F.count_if((F.col("r") == 1) & F.col("deleted")).alias("tombstones_purged"),
        F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("bytes_in"),
        F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0).cast("long")).alias("bytes_out"),
    )


def segment_stats(log: DataFrame) -> DataFrame:
    """Per generation: entries, tombstones, bytes."""
    return segment_records(log).groupBy("gen").agg(F.count("*").alias("entries"), F.count_if("deleted").alias("tombstones"), F.sum(record_bytes(F.col("key"), F.col("value"))).alias("bytes"))


def memtable_size(tail: DataFrame) -> DataFrame:
    """One row: keys (tombstones included) and bytes of what is not flushed."""
    size = F.sum(record_bytes(F.col("key"), F.when(~F.col("deleted"), F.col("value"))))
    return newest(tail).agg(F.count("*").alias("keys"), F.coalesce(size, F.lit(0).cast("long")).alias("bytes"))


def shadowed(log: DataFrame) -> DataFrame:
    """Per key: versions, and how many of them a newer one hides."""
    return log.groupBy("key").agg(F.count("*").alias("versions")).withColumn("shadowed", F.col("versions") - 1)


def get_many(keys: DataFrame, log: DataFrame) -> DataFrame:
    """(key, found, value) for each asked key; a tombstone hides every older version."""
    state = newest(log.join(keys.select("key").distinct(), "key", "left_semi")).where(~F.col("deleted")).select("key", "value", F.lit(True).alias("hit"))
    return keys.select("key").join(state, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def has_many(keys: DataFrame, log: DataFrame) -> DataFrame:
    """(key, found), without reading values."""
    state = newest(log.select("key", "gen", "pos", "deleted")).where(~F.col("deleted")).select("key", F.lit(True).alias("hit"))
    return keys.select("key").join(state, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"))


def missing(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Asked keys that have no current value."""
    return keys.select("key").join(visible(log.select("key", "gen", "pos", "deleted")), "key", "left_anti")


def layer_hits(keys: DataFrame, log: DataFrame) -> DataFrame:
    """Per asked key: outcome (hit, tombstone or miss) and the layers looked at, newest first, with a
    stop at the first that has the key."""
    layers = log.select("gen").distinct()
    ranked = layers.withColumn("layer", F.row_number().over(Window.orderBy(F.desc("gen"))))  # one row per generation
    total = F.broadcast(layers.agg(F.count("*").alias("layers")))
    first = newest(log.select("key", "gen", "pos", "deleted")).join(F.broadcast(ranked), "gen").select("key", "layer", "deleted")
    met = keys.select("key").join(first, "key", "left").crossJoin(total)
    outcome = F.when(F.col("layer").isNull(), "miss").when(F.col("deleted"), "tombstone").otherwise("hit")
    return met.select("key", outcome.alias("outcome"), F.coalesce("layer", "layers").cast("long").alias("layers_read"))


def batch_state(log: DataFrame) -> DataFrame:
    """The last write of each key in each batch."""
    return newest(log, ("batch_id", "key"), ("pos",))


def as_of(log: DataFrame, gen: int) -> DataFrame:
    """Extension: the state when generation `gen` was the newest."""
    return visible(log.where(F.col("gen") <= gen))


def key_range(log: DataFrame, low: Column, high: Column) -> DataFrame:
    """Extension: current rows with low <= key < high; the predicate reaches the scan."""
    return visible(log.where((F.col("key") >= low) & (F.col("key") < high)))


def encode_record(key: Column, value: Column, deleted: Column, pending: Column) -> Column:
    """A record of the binary formats (see sources/records.py) as a binary column."""
    flags = F.when(deleted, 1).otherwise(0) + F.when(pending, 2).otherwise(0)
    value = F.when(deleted | value.isNull(), F.lit(b"")).otherwise(value)
    body = F.concat(little_endian(flags, 1), little_endian(F.octet_length(key), 4), little_endian(F.octet_length(value), 4), key, value)
    return F.concat(little_endian(crc32c(body), 4), body)
