"""Schemas, options and errors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

MAX_RECORD = 64 << 20  # key and value together
RECORD_OVERHEAD = 13  # bytes of a record besides key and value
FORMAT_VERSION = 1
TAIL_GEN = (1 << 63) - 1  # generation of what is logged but not yet flushed: newer than any segment

TYPES = {"long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def schema(columns: str) -> T.StructType:
    """A flat schema from "name type, ..."; unlike Spark's own parser this needs no session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


MUTATION_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("gen", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("pending", T.BooleanType()),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("value", T.BinaryType()),
    ]
)
SEGMENTS = schema("gen long, entries long, bytes long, legacy boolean, format_version int, bloom_m long, bloom_k int")
BLOOM_BITS = schema("gen long, bit_index long")
SAMPLES = schema("sec int, kind string, ns long")


class StoreError(Exception):
    """Anything the store refuses."""


class EmptyKeyError(StoreError):
    """A key without bytes."""


class RecordTooLargeError(StoreError):
    """Key and value together exceed MAX_RECORD."""


class CorruptError(StoreError):
    """Stored bytes do not check out."""


class UnknownVersionError(StoreError):
    """Written by a version this build does not know."""


class ClosedError(StoreError):
    """The table was closed."""


class SyncMode(Enum):
    """Whether a commit waits until its manifest is on stable storage, where the file system can tell."""

    ALWAYS = "always"
    NEVER = "never"

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class Options:
    memtable_size: int = 1 << 20
    sync: SyncMode = SyncMode.ALWAYS
    false_positive_rate: float = 0.01
    retain: int = 16  # versions whose files stay readable

    def __post_init__(self) -> None:
        if self.memtable_size <= 0:
            raise ValueError(f"memtable_size must be positive, not {self.memtable_size}")
        if not 0 < self.false_positive_rate < 1:
            raise ValueError(f"false_positive_rate must lie between 0 and 1, not {self.false_positive_rate}")
        if self.retain < 0:
            raise ValueError(f"retain must not be negative, not {self.retain}")
        if not isinstance(self.sync, SyncMode):
            raise ValueError(f"unknown sync mode {self.sync!r}")
