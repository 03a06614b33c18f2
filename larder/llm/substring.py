"""Removal of long repeated passages by seed and extend.

Seeds: word `gram`-grams are hashed and winnowed, so that every window of `least` consecutive words
holds exactly one chosen anchor, which depends on the window's words alone. The windows that chose the
same anchor occurrence form its reach: the anchor extended both ways as far as it stays the chosen
one. Joining documents on anchors therefore loses no repeated window.

Extension: of all documents that hold an anchor with the same reach, only the least goes on; the others
repeat the whole reach. Where one anchor has several reaches, the windows of the least document of each
are compared, which finds how far each match extends on either side. Overlapping windows are merged
into maximal repeats.

Equality is by 64-bit hashes taken twice: of the anchor, and of the reach or window around it.

Defined cases: a null text has no words; a document with a null doc_id has no smaller doc_id before it,
is before none, and is returned whole; rows that repeat a doc_id are each cut by smaller ids only; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.scratch import Scratch
from larder.llm.words import Powers, RollingHash, WordHashes, ascii_words, mix


@dataclass(frozen=True)
class Reaches:
    """Anchors of a document and the windows that chose them, as runs of window starts."""

    least: int = 50
    gram: int = 10

    def of(self, rolling: RollingHash, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, reach hash, first window start, number of windows), in order of place."""
        if n < self.least:
            none = np.zeros(0, np.uint64)
            return none, none, none.astype(np.int64), none.astype(np.int64)
        grams = rolling.grams(self.gram)
        wide = self.least - self.gram + 1
        place = np.argmin(np.lib.stride_tricks.sliding_window_view(grams, wide), axis=1) + np.arange(n - self.least + 1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        count = np.diff(np.concatenate([first, [len(place)]]))
        at = place[first]
        with np.errstate(over="ignore"):
            reach = mix(rolling.ranges(first, first + count - 1 + self.least) ^ mix((count * 65536 + (at - first)).astype(np.uint64)))
        return grams[at], reach, first, count


REACHES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("anchor", pa.int64()), ("reach", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())])
WINDOWS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("anchor", pa.int64()), ("window", pa.int64()), ("start", pa.int32())])
KEPT = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def batches_of(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if len(c) else np.zeros(0, np.int64)).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


class Rolling:
    def __init__(self):
        self.known, self.powers = WordHashes(), Powers()

    def of(self, text: bytes | None) -> tuple[RollingHash, int]:
        words = ascii_words(text)
        return RollingHash(self.known.of(words), self.powers), len(words)


def find_reaches(texts: DataFrame, reaches: Reaches) -> DataFrame:
    def run(batches):
        rolling = Rolling()
        for batch in batches:
            out: list[list] = [[] for _ in REACHES]
            held = 0
            for doc_id, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if doc_id is None:
                    continue
                r, n = rolling.of(text.as_py())
                anchor, reach, first, count = reaches.of(r, n)
                for column, value in zip(out, (np.full(len(first), doc_id), np.full(len(first), h), anchor.view(np.int64), reach.view(np.int64), first, count)):
                    column.append(value)
                held += len(first)
                if held >= 100_000:
                    yield batches_of(out, REACHES)
                    out, held = [[] for _ in REACHES], 0
            yield batches_of(out, REACHES)

    return texts.mapInArrow(run, "doc_id long, text_hash long, anchor long, reach long, first int, windows int")


def list_windows(wanted: DataFrame, texts: DataFrame, reaches: Reaches) -> DataFrame:
    """The windows of each wanted reach: (doc_id, text_hash, anchor, window, start)."""
    per_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "first", "windows")).alias("reaches"))

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            out: list[list] = [[] for _ in WINDOWS]
            for doc_id, text_hash, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                r, _ = rolling.of(text.as_py())
                grams = r.grams(reaches.gram)
                wide = reaches.least - reaches.gram + 1
                for x in found.as_py():
                    start = np.arange(x["first"], x["first"] + x["windows"])
                    at = x["first"] + x["windows"] - 1 + int(np.argmin(grams[x["first"] + x["windows"] - 1 :][:wide]))
                    with np.errstate(over="ignore"):
                        window = mix(r.ranges(start, start + reaches.least) ^ mix((at - start).astype(np.uint64)))
                    n = len(start)
                    for column, value in zip(out, (np.full(n, doc_id), np.full(n, text_hash), np.full(n, x["anchor"]), window.view(np.int64), start)):
                        column.append(value)
                if sum(map(len, out[4])) >= 100_000:
                    yield batches_of(out, WINDOWS)
                    out = [[] for _ in WINDOWS]
            yield batches_of(out, WINDOWS)

    return texts.join(per_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "reaches").mapInArrow(run, "doc_id long, text_hash long, anchor long, window long, start int")


def repeats(texts: DataFrame, reaches: Reaches, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, start, end): word ranges that repeat a smaller document; they may overlap."""
    all_reaches = scratch.keep(find_reaches(texts, reaches))
    shared = all_reaches.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(F.col("anchor").alias("seed"))
    # aggregates are written before they are joined: a join right over exchanges can be split where an anchor is hot
    shared = scratch.keep(shared)
    seeded = scratch.keep(all_reaches.join(shared, F.col("anchor") == F.col("seed")).drop("seed"))
    scratch.drop(all_reaches, shared)
    least = seeded.groupBy("anchor", "reach").agg(F.min("doc_id").alias("least_doc"))
    least = scratch.keep(least)
    several = least.groupBy("anchor").agg(F.count("*").alias("n"), F.min("least_doc").alias("first_doc")).where("n > 1").select(F.col("anchor").alias("seed"), "first_doc")
    several = scratch.keep(several)
    least = least.join(several, F.col("anchor") == F.col("seed"), "left").select(F.col("anchor").alias("a"), F.col("reach").alias("r"), "least_doc", "seed")
    placed = scratch.keep(seeded.join(least, (F.col("anchor") == F.col("a")) & (F.col("reach") == F.col("r"))).drop("a", "r"))
    scratch.drop(seeded)
    whole = placed.where("doc_id > least_doc").select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + reaches.least).alias("end"))
    windows = scratch.keep(list_windows(placed.where("doc_id = least_doc AND seed IS NOT NULL"), texts, reaches))
    again = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    again = scratch.keep(again.select(F.col("anchor").alias("a"), F.col("window").alias("w"), "low"))
    part = windows.join(again, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w")) & (F.col("doc_id") > F.col("low")))
    return whole.unionAll(part.select("doc_id", "text_hash", "start", (F.col("start") + reaches.least).alias("end")))


def with_text_hash(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, text_hash and more: the hash tells rows apart that repeat a doc_id."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"), *more)
    return texts.withColumn("text_hash", F.xxhash64("text"))


def drop_repeats(docs: DataFrame, least: int = 50, gram: int = 10, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in more, n_words, n_removed, kept_sha256, kept, repeats: one row per
    row of docs.

    A word goes if a window of `least` words that covers it also starts in a document with a smaller
    doc_id. kept: the other words, joined by one space; kept_sha256 is of that. Where no word goes, kept
    is the text as it was. repeats: the maximal ranges that went.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    texts = with_text_hash(docs)
    found = scratch.keep(repeats(texts, Reaches(least, gram), scratch))
    ranges = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text, ranges in zip(part.column(0), part.column(1)):
                    text = text.as_py()
                    words, gone = ascii_words(text), []
                    kept = words
                    if ranges.is_valid:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for x in ranges.as_py():
                            edge[x["start"]] += 1
                            edge[x["end"]] -= 1
                        out = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                        gone = [{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2])]
                        kept = [w for w, o in zip(words, out.tolist()) if not o]
                    joined = b" ".join(kept)
                    left = joined if gone else text
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), left if left is None else left.decode("utf-8", "replace"), gone))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), KEPT)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *columns], names=[*part.schema.names[2:], *KEPT.names])

    joined = with_text_hash(docs, more).join(ranges, ["doc_id", "text_hash"], "left").select("text", "ranges", "doc_id", *more)
    schema = T.StructType([joined.schema[c] for c in ("doc_id", *more)] + T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start: long, length: long>>").fields)
    return joined.mapInArrow(cut, schema)
