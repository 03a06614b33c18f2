"""FNV-1a and CRC-32C."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two hashes.
FNV_OFFSET = 14695981039346656037
FNV_PRIME_LOW = 0x1B3  # the prime is 2^40 + 0x1B3
CRC32C_POLYNOMIAL = 0x82F63B78  # Castagnoli, reversed
WORD = 0xFFFFFFFF


def fnv1a64(data: Column) -> Column:
    """struct<hi long, lo long>: the halves of the 64-bit FNV-1a hash of a binary column.

    Spark has no unsigned 64-bit product, and ANSI arithmetic refuses to wrap; in halves of 32 bits,
    multiplying by 2^40 + 0x1B3 needs no more than 42 bits.
    """
    digits = F.hex(data)

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
        lo = h["lo"].bitwiseXOR(byte)
        low = lo * FNV_PRIME_LOW
        hi = (h["hi"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo, 8)).bitwiseAND(F.lit(WORD))
        return F.struct(hi.alias("hi"), low.bitwiseAND(F.lit(WORD)).alias("lo"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & WORD).cast("long").alias("lo"))
    n = F.octet_length(data)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)


def little_endian(i: Column, size: int) -> Column:
    """The lowest `size` bytes of a long, lowest first."""
    digits = F.lpad(F.hex(i.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(8 - size, 8)))))


def as_decimal(halves: Column) -> Column:
    """The unsigned value of a hash in halves, as decimal(20,0)."""
    return (halves["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + halves["lo"]).cast("decimal(20,0)")


def fnv1a64_of(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * ((1 << 40) + FNV_PRIME_LOW) % (1 << 64)
    return h


@cache
def crc32c_table() -> tuple[int, ...]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CRC32C_POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return tuple(out)


def crc32c_of(data: bytes, crc: int = 0) -> int:
    """CRC-32C of data, continuing crc."""
    table, crc = crc32c_table(), crc ^ WORD
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ WORD


def crc32c(data: Column | str) -> Column:
    """CRC-32C of a binary column, a byte at a time through the table. Spark's own crc32 has another
    polynomial."""
    data = F.col(data) if isinstance(data, str) else data
    digits, n = F.hex(data), F.octet_length(data)
    table = F.expr(f"array({', '.join(f'{v}L' for v in crc32c_table())})")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def step(crc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
        return F.get(table, crc.bitwiseXOR(byte).bitwiseAND(F.lit(255)).cast("int")).bitwiseXOR(F.shiftright(crc, 8))

    return F.aggregate(places, F.lit(WORD).cast("long"), step, lambda crc: crc.bitwiseXOR(F.lit(WORD).cast("long")))
