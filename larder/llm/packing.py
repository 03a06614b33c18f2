"""Sequence packing by best-fit decreasing.

A document is tokenised, closed by an end id and cut: full windows of `window` ids first, then the
rest. Rests are dealt evenly into shards; in each shard, longest first, a segment tree over remaining
capacities finds the tightest open window that still fits (ties: the window opened first), else a new
window opens.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they
occur; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
IRREGULAR = re.compile(r" (?:\s|$)")


class ChunkTokenizer:
    """ids of whole texts by a byte-level BPE, as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what stands before a space to what follows, when the space is
    between two characters that are not white space: each " chunk" is encoded on its own, once, and
    remembered (the first `limit` chunks met; others are encoded again in each run of texts). Texts
    with other white space after a space, or a space at the end, are encoded whole. `ranks` is the
    vocabulary of the tokenizer file `path` in rank form, which a faster library reads; the ids are
    the same. Texts that spell one of the tokenizer file's own special tokens go to that file.
    """

    def __init__(self, path: str, ranks: str, pattern: str, limit: int = 600_000):
        import tiktoken

        with open(path, "rb") as f:
            self.special = re.compile("|".join(re.escape(t["content"]) for t in json.load(f)["added_tokens"]) or r"(?!)")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.path, self.limit, self.slow = path, limit, None
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.fast(text)).tobytes()

    def whole(self, text: str) -> bytes:
        if not self.special.search(text):
            return self.encode(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def many(self, texts: list[str]) -> Iterator[bytes]:
        parts = [None if IRREGULAR.search(t) or self.special.search(t) else t.split(" ") for t in texts]
        known = self.known
        new = {c for p in parts if p for c in p[1:]}.difference(known)
        found = {c: self.encode(" " + c) for c in new}
        if len(known) + len(found) <= self.limit:
            known.update(found)
            get = known.__getitem__
        else:
            get = lambda c: known.get(c) or found[c]
        for t, p in zip(texts, parts):
            yield self.whole(t) if p is None else self.encode(p[0]) + b"".join(map(get, p[1:]))


def slices(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, so that a worker holds few chunks at a time."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], window: int, end_id: int) -> DataFrame:
    """One row per piece: full windows and the rest of each document, with the ids' checksum."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("turn", pa.int64())])
    end, wide = end_id.to_bytes(4, "little"), 4 * window

    def cut(batches):
        model, turn = ChunkTokenizer(*tokenizer), 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows, at = [], 0
            for run in slices(texts):
                for ids in model.many(run):
                    ids += end
                    total = len(ids) // 4
                    for s in range(0, len(ids), wide):
                        part = ids[s : s + wide]
                        rows.append((names[at], s // 4, len(part) // 4, zlib.crc32(part), total, turn))
                        turn += 1
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", turn long")


class BestFit:
    """Open windows by remaining capacity. `count` is a segment tree in heap order whose leaves are
    capacities 0..window; a node holds the number of open windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        heapq.heappush(self.open[capacity], window_id)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least `need`: (capacity, window_id)."""
        node, count = need + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first right sibling that holds one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, heapq.heappop(self.open[capacity])


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset in it) of each length; lengths come longest first."""
    tree, out, windows = BestFit(window), [], 0
    for n in lengths:
        capacity, at = tree.take(n) or (window, windows)
        windows += at == windows
        out.append((at, window - capacity))
        if capacity > n:
            tree.add(capacity - n, at)
    return out


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], window: int = 2048, end_id: int = 1, shard_rows: int = 16_384) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    tokenizer: the file for `tokenizers`, the same vocabulary in rank form, the pre-tokenizer's pattern.
    Shards hold about `shard_rows` pieces however large the table is, and are dealt by a running
    number, so a repeated or frequent document does not fill one. sequence_id is unique: the shard
    and the window in it.
    """
    cut = pieces(docs, tokenizer, window, end_id)
    shards = max(1, -(-docs.count() // shard_rows))

    def place(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32", "turn"], ascending=[False, True, True, True, True], kind="stable")
        placed = best_fit_decreasing(pdf["length"].tolist(), window)
        first = int(pdf["shard"].iloc[0]) << 32
        pdf["sequence_id"] = [first + at for at, _ in placed]
        pdf["offset"] = [offset for _, offset in placed]
        return pdf.drop(columns=["shard", "turn"])

    return cut.withColumn("shard", F.pmod(F.xxhash64("turn"), F.lit(shards))).groupBy("shard").applyInPandas(place, PIECES + ", sequence_id long, offset long")
