"""Keys, values and operation mixes for load tests, all as columns over a range of ids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.hashing import as_decimal, fnv1a64, little_endian

THETA = 0.99
SEGMENT_BYTES = 1 << 20

# Per mix, the share of reads in a hundred, what the rest does, and the value size.
MIXES = {"A": (50, "update", 1024), "B": (95, "update", 1024), "C": (100, "read", 1024), "cache-fill": (95, "insert", 256)}


def big_endian(i: Column) -> Column:
    return F.unhex(F.lpad(F.hex(i.cast("long")), 16, "0"))


def sha_key(i: Column) -> Column:
    """Hex SHA-256 of the id as 8 big-endian bytes."""
    return F.sha2(big_endian(i), 256)


def miss_key(i: Column) -> Column:
    """As sha_key, over bytes that no id has."""
    return F.sha2(F.concat(F.lit("miss").cast("binary"), big_endian(i)), 256)


def sequential_key(i: Column) -> Column:
    return F.lpad(F.lower(F.hex(i.cast("long"))), 64, "0")


def value_bytes(size: int) -> Column:
    """Byte i is 31 i + 7 modulo 256."""
    return F.lit(bytearray((31 * i + 7) % 256 for i in range(size)))


def records_per_segment(value_size: Column) -> Column:
    return F.ceil(F.lit(SEGMENT_BYTES) / (64 + value_size + 13)).cast("long")


def zeta(n: int, theta: float = THETA) -> float:
    return math.fsum(i**-theta for i in range(1, n + 1))


def zipf_rank(u: Column, n: int, theta: float = THETA, zeta_n: float | None = None) -> Column:
    """Rank 0 .. n-1 of a uniform u in [0, 1), rank 0 the most popular."""
    zeta_n = zeta(n, theta) if zeta_n is None else zeta_n
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / zeta_n)
    rest = F.floor(n * F.pow(eta * u - eta + 1, F.lit(1 / (1 - theta)))).cast("long")
    uz = u * zeta_n
    return F.when(uz < 1, F.lit(0).cast("long")).when(uz < 1 + 0.5**theta, F.lit(1).cast("long")).otherwise(F.least(rest, F.lit(n - 1).cast("long")))


def scramble(rank: Column, n: int) -> Column:
    """A rank spread over 0 .. n-1 by the hash of its 8 little-endian bytes."""
    return (as_decimal(fnv1a64(little_endian(rank, 8))) % F.lit(n)).cast("long")


def choose(u: Column, n: int, distribution: str = "zipfian") -> Column:
    return F.floor(u * n).cast("long") if distribution == "uniform" or n < 2 else scramble(zipf_rank(u, n), n)


# The least and the most of each setting of a workload.
LIMITS = {"records": (2, 2_000_000), "threads": (1, 64), "seconds": (1, 300), "target_ops": (0, None), "most_write_mb": (1, 2048), "value_size": (1, 1 << 20), "operations": (0, None)}


@dataclass(frozen=True)
class Workload:
    mix: str = "A"
    records: int = 10_000
    operations: int = 10_000
    distribution: str = "zipfian"
    seed: int = 0
    threads: int = 4
    seconds: int = 10
    target_ops: int = 0  # a second; 0: as fast as it goes
    most_write_mb: int = 512
    value_size: int = 0  # 0: that of the mix

    def __post_init__(self) -> None:
        if self.mix not in MIXES:
            raise ValueError(f"mix is one of {', '.join(MIXES)}, not {self.mix!r}")
        if self.distribution not in ("zipfian", "uniform"):
            raise ValueError(f"distribution is zipfian or uniform, not {self.distribution!r}")
        if not self.value_size:
            object.__setattr__(self, "value_size", MIXES[self.mix][2])
        for name, (least, most) in LIMITS.items():
            value = getattr(self, name)
            if value < least or most is not None and value > most:
                raise ValueError(f"{name} must be {f'at least {least}' if most is None else f'in [{least}, {most}]'}, not {value}")


def hit_keys(spark: SparkSession, n: int = 4096) -> DataFrame:
    """(key, expect_found): keys of loaded ids."""
    return spark.range(n).select(sha_key(F.col("id")).alias("key"), F.lit(True).alias("expect_found"))


def miss_keys(spark: SparkSession, n: int = 4096) -> DataFrame:
    """(key, expect_found): keys that no id has."""
    return spark.range(n).select(miss_key(F.col("id")).alias("key"), F.lit(False).alias("expect_found"))


def full_segments(spark: SparkSession, segments: int, value_size: int) -> DataFrame:
    """(gen, pos, key, deleted, value): exactly so many full segments, from 1, of keys in order."""
    each = math.ceil(SEGMENT_BYTES / (64 + value_size + 13))
    i = F.col("id")
    return spark.range(segments * each).select((F.floor(i / each) + 1).cast("long").alias("gen"), i.alias("pos"), sha_key(i).cast("binary").alias("key"), F.lit(False).alias("deleted"), value_bytes(value_size).alias("value"))


def load_phase(spark: SparkSession, w: Workload, batch: int = 500) -> DataFrame:
    """(pos, batch_id, key, value): the records a workload starts from."""
    i = F.col("id")
    return spark.range(w.records).select(i.alias("pos"), F.floor(i / batch).cast("long").alias("batch_id"), sha_key(i).cast("binary").alias("key"), value_bytes(w.value_size).alias("value"))


def operations(spark: SparkSession, w: Workload) -> DataFrame:
    """(op_id, kind, key): inserts get fresh ids, the others choose among the loaded ones."""
    reads, other, _ = MIXES[w.mix]
    ops = spark.range(w.operations).select(F.col("id").alias("op_id"), F.rand(w.seed).alias("u"), F.rand(w.seed + 1).alias("v"))
    ops = ops.withColumn("kind", F.when(F.col("u") * 100 < reads, "read").otherwise(other))
    item = F.when(F.col("kind") == "insert", F.col("op_id") + w.records).otherwise(choose(F.col("v"), w.records, w.distribution))
    return ops.select("op_id", "kind", sha_key(item).cast("binary").alias("key"))


def churn(spark: SparkSession, keys: int, seed: int = 0) -> DataFrame:
    """(pos, key, deleted): every key once, three times as many overwrites of the hottest quarter, then
    deletes of a quarter as many keys out of the first half."""
    quarter, half = max(1, keys // 4), max(1, keys // 2)
    puts = spark.range(keys).select(F.col("id").alias("pos"), F.col("id").alias("item"), F.lit(False).alias("deleted"))
    over = spark.range(3 * keys).select((F.col("id") + keys).alias("pos"), F.floor(F.rand(seed) * quarter).cast("long").alias("item"), F.lit(False).alias("deleted"))
    gone = spark.range(keys // 4).select((F.col("id") + 4 * keys).alias("pos"), F.floor(F.rand(seed + 1) * half).cast("long").alias("item"), F.lit(True).alias("deleted"))
    return puts.unionAll(over).unionAll(gone).select("pos", sha_key(F.col("item")).cast("binary").alias("key"), "deleted")
