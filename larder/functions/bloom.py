"""Bloom filters: sizing, probes, and membership as relations."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.hashing import fnv1a64, little_endian
from larder.model import CorruptError
from larder.sources.scratch import drop, folder

# Bounds of a filter, and the rate taken where none is given that makes sense.
MIN_BITS, MAX_BITS = 512, 1 << 28
MAX_HASHES = 16
DEFAULT_RATE = 0.01

BROADCAST_BYTES = 16 << 20  # filters of more bytes than this together are broadcast in blocks; turned, they take up to 4 times that
CACHED_BYTES = 1 << 18  # rows of bits looked at together


def size_for(keys: int, rate: float) -> tuple[int, int]:
    """(m bits, k hashes) for that many keys at that false-positive rate."""
    keys = max(1, keys)
    rate = rate if 0 < rate < 1 else DEFAULT_RATE
    bits = math.ceil(-keys * math.log(rate) / math.log(2) ** 2)
    hashes = int(bits / keys * math.log(2) + 0.5)  # before the bounds on bits
    return min(max(bits, MIN_BITS), MAX_BITS), min(max(hashes, 1), MAX_HASHES)


def sizing(keys: Column, rate: Column) -> tuple[Column, Column]:
    """size_for() as columns."""
    n = F.greatest(keys.cast("long"), F.lit(1).cast("long")).cast("double")
    p = F.when((rate > 0) & (rate < 1), rate).otherwise(F.lit(DEFAULT_RATE))
    bits = F.ceil(-n * F.ln(p) / F.lit(math.log(2) ** 2)).cast("long")
    hashes = F.floor(bits / n * F.lit(math.log(2)) + F.lit(0.5)).cast("int")
    m = F.least(F.greatest(bits, F.lit(MIN_BITS).cast("long")), F.lit(MAX_BITS).cast("long"))
    return m, F.least(F.greatest(hashes, F.lit(1)), F.lit(MAX_HASHES))


def probes(key: Column, m: Column, k: Column) -> Column:
    """array<long>: the k bit positions of a binary key: the hash's halves, the upper one made odd,
    combined as lower + i * upper."""
    return F.transform(F.array(fnv1a64(key)), lambda h: F.transform(F.sequence(F.lit(0), k - 1), lambda i: (h["lo"] + i * h["hi"].bitwiseOR(F.lit(1).cast("long"))) % m))[0]


def sized(keys: DataFrame, rate: float) -> DataFrame:
    """(gen, key) -> (gen, n, m, k): one filter per generation, sized to its keys."""
    m, k = sizing(F.col("n"), F.lit(rate))
    return keys.groupBy("gen").agg(F.count("*").alias("n")).withColumns({"m": m, "k": k})


def placed(keys: DataFrame, rate: float) -> DataFrame:
    """(gen, key) with distinct keys per generation -> (gen, m, k, bit_index): the bits each key sets."""
    sizes = sized(keys, rate).drop("n")
    return keys.join(sizes, "gen").select("gen", "m", "k", F.explode(probes(F.col("key"), F.col("m"), F.col("k"))).alias("bit_index"))


def build(keys: DataFrame, rate: float) -> DataFrame:
    """(gen, key) with distinct keys per generation -> (gen, m, k, bit_index): the set bits."""
    return placed(keys, rate).distinct()


def estimate(bits: DataFrame) -> DataFrame:
    """(gen, bits, fpr): the estimated false-positive rate, (set bits / m)^k."""
    counted = bits.groupBy("gen", "m", "k").agg(F.count("*").alias("bits"))
    return counted.select("gen", "m", "k", "bits", F.pow(F.col("bits") / F.col("m"), F.col("k")).alias("fpr"))


def filters(bits: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(gen, m, k, words): each generation's filter as one array of 64-bit words, at most MAX_BITS long.
    sizes, as of sized(), spare a look at all bits for them. Bits may come repeatedly."""
    words = bits.groupBy("gen", F.floor(F.col("bit_index") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit_index % 64 as int)))").alias("value"))
    spine = (bits if sizes is None else sizes).select("gen", "m", "k").distinct().withColumn("word", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / 64))))
    dense = spine.join(words, ["gen", "word"], "left").groupBy("gen", "m", "k")
    ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("value", F.lit(0).cast("long")).alias("value"))))
    return dense.agg(F.transform(ordered, lambda x: x["value"]).alias("words"))


def encoded(found: DataFrame) -> DataFrame:
    """(gen, data) of filters(): each as encode() gives it."""
    bits = F.unhex(F.array_join(F.transform("words", lambda w: F.hex(little_endian(w, 8))), ""))
    return found.select("gen", F.concat(little_endian(F.col("m"), 4), little_endian(F.col("k"), 1), bits).alias("data"))


def hashed(asked: DataFrame) -> DataFrame:
    """(key, lo, step): the distinct asked keys and the two numbers their probes are made of."""
    halves = asked.select("key").distinct().withColumn("h", fnv1a64(F.col("key")))
    return halves.select("key", F.col("h.lo").alias("lo"), F.col("h.hi").bitwiseOR(F.lit(1).cast("long")).alias("step"))


def blocks(bits: DataFrame, sizes: DataFrame | None, most: int) -> Iterator[DataFrame]:
    """filters() in blocks of about `most` bytes, each to be read before the next. Beyond one block they
    are written once, to a scratch folder, in the order of their sizes, so that filters of one size come
    together."""
    each = (bits if sizes is None else sizes).select("gen", "m", "k").distinct()
    size = each.agg(F.sum(F.col("m") / 8)).first()[0] or 0
    if size <= most:
        yield filters(bits, sizes)
        return
    spark = bits.sparkSession
    before = F.sum(F.col("m") / 8).over(Window.orderBy("m", "k", "gen").rowsBetween(Window.unboundedPreceding, -1))  # a row a generation, without its words
    dealt = each.select("gen", F.floor(F.coalesce(before, F.lit(0.0)) / max(1, most)).alias("block"))
    path = folder(spark, "filters")
    try:
        filters(bits, sizes).join(dealt, "gen").repartition("block").write.partitionBy("block").parquet(path)
        kept = spark.read.schema(f"gen {bits.schema['gen'].dataType.simpleString()}, m long, k int, words array<long>, block long").parquet(path)
        for r in kept.select("block").distinct().orderBy("block").collect():
            yield kept.where(F.col("block") == r.block).drop("block")
    finally:
        drop(spark, path)


def turned(found: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(m, k, rows, table) for each size of the collected filters: table holds one row of bits for each
    bit position, and in it one bit for each filter. rows tells which filters these are. A filter that is
    alone in its size stays as it is."""
    m, k = found.column("m").to_numpy(), found.column("k").to_numpy()
    words = pa.compute.list_flatten(found.column("words")).to_numpy().astype("<i8", copy=False)
    ends = np.cumsum((m + 63) // 64)
    out = []
    for size, hashes in sorted(set(zip(m.tolist(), k.tolist()))):
        rows, n = np.flatnonzero((m == size) & (k == hashes)), (size + 63) // 64
        packed = np.stack([words[e - n : e] for e in ends[rows]]).view(np.uint8)
        if len(rows) == 1:
            out.append((size, hashes, rows, packed[0]))
            continue
        table = np.empty((8 * packed.shape[1], (len(rows) + 7) // 8), np.uint8)
        for at in range(0, packed.shape[1], 64):
            part = np.unpackbits(packed[:, at : at + 64], axis=1, bitorder="little")
            table[8 * at : 8 * at + part.shape[1]] = np.packbits(part.T, axis=1, bitorder="little")
        out.append((size, hashes, rows, table))
    return out


def passed(lo: np.ndarray, step: np.ndarray, m: int, k: int, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bits): places of hashed keys that some filter of the table lets pass, and a row of bits
    for each, with the filters that do. A key meets all filters of a size in k reads of a row."""
    alone = table.ndim == 1
    width = 1 if alone else table.shape[1]

    def read(at: np.ndarray, i: int) -> np.ndarray:
        bit = (lo[at] + i * step[at]) % m
        return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)[:, None] if alone else table[bit]

    for start in range(0, len(lo), max(1, CACHED_BYTES // width)):
        at = np.arange(start, min(len(lo), start + max(1, CACHED_BYTES // width)))
        bits = read(at, 0)
        for i in range(1, k):
            if width <= 2:  # few filters: most keys are through with them early
                left = bits.any(axis=1)
                at, bits = at[left], bits[left]
            bits &= read(at, i)
        yield at, bits


def met(asked: DataFrame, bits: DataFrame, sizes: DataFrame | None, most: int, ddl: str, give: Callable) -> DataFrame:
    """What give(keys, lo, step, gens, tables) makes of each batch of asked keys and block of filters. A block
    goes to all tasks; a key is hashed once, whatever the number of generations."""
    # a fixed number of tasks: the keys are few bytes, but each meets all filters. By "lo", since what is
    # dealt by "key" already would be left as it is, in fewer tasks
    keys = hashed(asked.where("key IS NOT NULL")).repartition(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lo")

    def against(block: DataFrame) -> DataFrame:
        found = block.toArrow()
        sent = asked.sparkSession.sparkContext.broadcast((found.column("gen").combine_chunks(), turned(found)))

        def run(batches):
            gens, tables = sent.value
            for batch in batches:
                if batch.num_rows:
                    yield from give(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), gens, tables)

        return keys.mapInArrow(run, ddl)

    return reduce(DataFrame.unionAll, map(against, blocks(bits, sizes, most)))


def candidates(asked: DataFrame, bits: DataFrame, sizes: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """(key, gen) for each asked key and each generation whose filter does not rule it out."""

    def give(keys, lo, step, gens, tables):
        for m, k, rows, table in tables:
            for at, found in passed(lo, step, m, k, table):
                key, filter_ = np.nonzero(np.unpackbits(found, axis=1, count=len(rows), bitorder="little"))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[key])), gens.take(pa.array(rows[filter_]))], names=["key", "gen"])

    return met(asked, bits, sizes, most, f"key binary, gen {bits.schema['gen'].dataType.simpleString()}", give)


def counted(asked: DataFrame, bits: DataFrame, sizes: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """(key, maybe): how many generations' filters do not rule an asked key out. The same as counting
    candidates(), without a row for each of them. Bits may come repeatedly."""

    def give(keys, lo, step, gens, tables):
        maybe = np.zeros(len(lo), np.int64)
        for m, k, _, table in tables:
            for at, found in passed(lo, step, m, k, table):
                maybe[at] += np.bitwise_count(found).sum(axis=1, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([keys, pa.array(maybe)], names=["key", "maybe"])

    return met(asked, bits, sizes, most, "key binary, maybe long", give).groupBy("key").agg(F.sum("maybe").alias("maybe"))


def might_contain(asked: DataFrame, bits: DataFrame) -> DataFrame:
    """(key, gen, maybe) for every asked key and generation: false means the generation does not hold
    the key. Prefer candidates(), which leaves out what is false."""
    every = asked.select("key").distinct().crossJoin(F.broadcast(bits.select("gen").distinct()))
    return every.join(candidates(asked, bits).withColumn("maybe", F.lit(True)), ["key", "gen"], "left").select("key", "gen", F.coalesce("maybe", F.lit(False)).alias("maybe"))


def encode(m: int, k: int, bits) -> bytes:
    """m (u32), k (u8), then the bits in little-endian 64-bit words."""
    words = [0] * ((m + 63) // 64)
    for b in bits:
        words[b // 64] |= 1 << b % 64
    return struct.pack(f"<IB{len(words)}Q", m, k, *words)


def decode(data: bytes) -> tuple[int, int, set[int]]:
    """(m, k, set bits); refuses what does not fit together, since a short filter would deny keys."""
    if len(data) < 5:
        raise CorruptError(f"filter of {len(data)} bytes has no header")
    m, k = struct.unpack_from("<IB", data)
    if not m or not 0 < k <= MAX_HASHES:
        raise CorruptError(f"filter with m={m}, k={k}")
    words = (m + 63) // 64
    if len(data) != 5 + 8 * words:
        raise CorruptError(f"filter of {m} bits takes {5 + 8 * words} bytes, not {len(data)}")
    found = struct.unpack_from(f"<{words}Q", data, 5)
    return m, k, {64 * i + j for i, w in enumerate(found) for j in range(64) if w >> j & 1}
