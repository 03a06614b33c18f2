"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are lists of normalised words (lower case, outer punctuation stripped).
A document that shares no run of `min_match` words with any item is passed over by Karp-Rabin hashes
alone. For each document and item that share such a seed, greedy string tiling marks, longest first,
matches whose words are not yet covered on either side, until none of at least `min_match` words is
left; every round's matches are found by running Karp-Rabin hashes, too. The share of the item's words under its tiles is its coverage, whatever the order in which the
document has them; the document is contaminated by items whose coverage reaches `threshold`.

The items are read in blocks of about `block_words` words (one item at least), and one such block at a
time is sent to the workers; a benchmark of any size takes as many passes as it has blocks.

Defined cases: null and empty texts match nothing; items of fewer than `min_match` words match only as
a whole (the seed is then the whole item); repeated documents are each reported; repeated items are
each reported; a null doc_id or item_id stays null; long and repetitive texts are tiled whole; an empty
table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch
from larder.llm.words import Powers, RollingHash, WordHashes

FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered_words", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])))])
FOUND_DDL = "doc_id long, text_hash long, item_id long, item_words long, covered_words long, coverage double, tiles array<struct<item_start: long, doc_start: long, length: long>>"


class NormalHashes(WordHashes):
    """Hash of a word's normal form; 0 for a word that has no letter or digit."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace").lower()
        lo, hi = 0, len(text)
        while lo < hi and not text[lo].isalnum():
            lo += 1
        while hi > lo and not text[hi - 1].isalnum():
            hi -= 1
        if lo == hi:
            if len(self) >= self.limit:
                self.clear()
            self[word] = 0
            return 0
        normal = text[lo:hi].encode()
        h = super().__missing__(normal) or 1
        self[word] = h
        return h

    def words(self, text: bytes | None) -> np.ndarray:
        found = self.of(text.split()) if text else np.zeros(0, np.uint64)
        return found[found != 0]


def free_runs(free: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of at least `least` unmarked words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def starts_in(runs: list[tuple[int, int]], size: int) -> np.ndarray:
    """Where `size` unmarked words in a row start."""
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - size + 1) for a, b in runs if b - a >= size)])


def shared_starts(item: np.ndarray, doc: np.ndarray, x: RollingHash, y: RollingHash, runs_x: list, runs_y: list, size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Starts in the item whose `size` words the document has too, and the least such start in the
    document of each; None if there are none. Hashes find them, the words confirm them."""
    i, j = starts_in(runs_x, size), starts_in(runs_y, size)
    if not len(i) or not len(j):
        return None
    known, first = np.unique(y.ranges(j, j + size), return_index=True)  # the first of equals is the least
    asked = x.ranges(i, i + size)
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    found = known[place] == asked
    if not found.any():
        return None
    i, at = i[found], j[first[place[found]]]
    same = np.array([np.array_equal(item[a : a + size], doc[b : b + size]) for a, b in zip(i.tolist(), at.tolist())])
    return (i[same], at[same]) if same.any() else None


def in_seeds(x: RollingHash, y: RollingHash, least: int) -> np.ndarray:
    """Which words of x lie in a run of `least` words that y has too; no others can be in a tile."""
    n = len(x.prefix) - 1
    if n < least or len(y.prefix) - 1 < least:
        return np.zeros(n, bool)
    start = np.flatnonzero(np.isin(x.grams(least), y.grams(least)))
    edge = np.zeros(n + 1, np.int64)
    edge[start] += 1
    np.subtract.at(edge, start + least, 1)
    return np.cumsum(edge[:-1]) > 0


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (item start, document start, length), longest first;
    ties go to the earlier item position, then the earlier document position.

    Each round looks for the longest match between unmarked words: rolling hashes tell whether there is
    one of a given length, which is halved in on, since a match of a length holds matches of all lesser
    ones. All matches of that length that stay clear of each other are marked in order, and the next
    round starts from that length downwards, over the runs that are left.
    """
    powers = Powers()
    x, y = RollingHash(item, powers), RollingHash(doc, powers)
    item_free, doc_free = (in_seeds(a, b, least) for a, b in ((x, y), (y, x)))
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while True:
        runs_x, runs_y = free_runs(item_free, least), free_runs(doc_free, least)
        found, low, high = None, least, min(most, max((b - a for a, b in runs_x), default=0), max((b - a for a, b in runs_y), default=0))
        while low <= high:
            size = (low + high) // 2 if found is not None else low
            met = shared_starts(item, doc, x, y, runs_x, runs_y, size)
            if met is None:
                high = size - 1
            else:
                found, low = met, size + 1
        if found is None:
            return tiles
        most = low - 1
        while found is not None:
            marked = False
            for i, j in zip(*(f.tolist() for f in found)):
                if item_free[i : i + most].all() and doc_free[j : j + most].all():
                    tiles.append((i, j, most))
                    item_free[i : i + most] = doc_free[j : j + most] = False
                    marked = True
                elif marked and item_free[i : i + most].all():
                    break  # its first place in the document is gone: look for the next one
            found = shared_starts(item, doc, x, y, free_runs(item_free, most), free_runs(doc_free, most), most)


class ItemIndex:
    """Seeds of a block of items: the sorted hashes of their `least`-word runs, with the items each
    belongs to, and a bitmap that turns away nearly all other hashes at one look."""

    BITS = 22

    def __init__(self, items: list[tuple[int | None, bytes]], least: int):
        known, powers = NormalHashes(), Powers()
        self.ids = [i for i, _ in items]
        self.words = [known.words(t) for _, t in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        seeds: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                size = min(least, len(w))
                g = np.unique(RollingHash(w, powers).grams(size))
                seeds.setdefault(size, []).append((g, np.full(len(g), k)))
        for size, parts in seeds.items():
            h, k = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << self.BITS, bool)
            bitmap[h >> np.uint64(64 - self.BITS)] = True
            self.by_length[size] = h[order], k[order], bitmap

    def candidates(self, words: np.ndarray, rolling: RollingHash) -> set[int]:
        out: set[int] = set()
        for size, (hashes, owners, bitmap) in self.by_length.items():
            if len(words) >= size:
                g = rolling.grams(size)
                g = g[bitmap[g >> np.uint64(64 - self.BITS)]]
                if len(g):
                    lo, hi = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
                    for a, b in {(int(a), int(b)) for a, b in zip(lo, hi) if a < b}:
                        out.update(owners[a:b].tolist())
        return out


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items, streamed to the driver one partition at a time, in blocks of a bounded size."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary")).toLocalIterator():
        text = bytes(row[1] or b"")
        block.append((row[0], text))
        size += len(text.split()) + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, text_hash, item_id, item_words, covered_words, coverage, tiles: one row per document and
    item whose coverage reaches the threshold. text_hash (Spark's xxhash64 of the text) tells rows apart
    that repeat a doc_id. Tiles give word positions among the normalised words."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), text.cast("binary"), F.xxhash64(text))

    def against(sent):
        def search(batches):
            index, known, powers = ItemIndex(sent.value, min_match), NormalHashes(), Powers()
            for batch in batches:
                rows = []
                for doc_id, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    words = known.words(text.as_py())
                    if not len(words):
                        continue
                    for k in index.candidates(words, RollingHash(words, powers)):
                        item = index.words[k]
                        tiles = tile(item, words, min(min_match, len(item)))
                        covered = sum(t[2] for t in tiles)
                        if covered >= threshold * len(item):
                            rows.append((doc_id, text_hash, index.ids[k], len(item), covered, covered / len(item), [dict(zip(("item_start", "doc_start", "length"), t)) for t in tiles]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)

        return texts.mapInArrow(search, FOUND_DDL)

    blocks = item_blocks(benchmark, block_words)
    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], FOUND_DDL)
    if after is None:
        return against(spark.sparkContext.broadcast(block))
    scratch, parts = Scratch(spark, "tiling"), []
    while block is not None:  # one block's broadcast at a time
        sent = spark.sparkContext.broadcast(block)
        parts.append(scratch.keep(against(sent)))
        sent.destroy()
        block, after = after, next(blocks, None)
    return reduce(DataFrame.unionByName, parts)
