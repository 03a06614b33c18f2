"""N-gram Jaccard join by chosen paths.

A text's set is the set of its word n-grams (64-bit hashes; a text of 1 to n-1 words has the one gram
of all its words). Texts with the same set are one class; only one member of each class goes on.

Each run walks a random tree. From a node at level l, a set of size s follows each token it has not used
with probability 1 / (similarity * s - l), by a hash of node and token that all sets share: two sets
with at least that overlap keep, on average, one common branch or more at every level. A node that at most `limit` sets
reach is a bucket; a larger one is split once more, down to `depth` levels. With f(0) = 0 and
f(d) = exp(f(d-1) - 1), the chance that one run fails a pair at the threshold is at most f(depth);
runs are repeated until that chance is below 1 - `recall`.

Buckets are compared by brute force on 64-bin one-permutation sketches, which only turn away pairs far
below the threshold; a bucket that stays large is compared block against block, in tasks of bounded
size. What is left is cut into components of plausible pairs, and in each component the whole sets
are compared exactly, again block against block.

A set goes by the first half of its 128-bit signature.

Defined cases: a text without words (or null) has no set, is in a class of its own and has no link; a
null doc_id is kept and is a class of its own; of rows that repeat a doc_id each has its own text's
result; texts of any length are compared whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.scratch import Scratch
from larder.llm.words import Powers, RollingHash, WordHashes, grouped, mix

BINS = 64
BROADCAST_BYTES = 32 << 20  # of the table that picks the texts to compare; a larger one is joined by shuffle
MEMBER_BYTES = 64


@dataclass(frozen=True)
class ChosenPath:
    n: int = 5
    similarity: float = 0.8
    recall: float = 0.9995
    depth: int = 2
    limit: int = 512
    block: int = 4096  # sketches a side in one task
    exact_block: int = 1024  # whole sets a side in one task, and
    exact_tokens: int = 1 << 20  # their tokens, unless one set has more

    @property
    def runs(self) -> int:
        miss = 0.0
        for _ in range(self.depth):
            miss = math.exp(miss - 1)
        return math.ceil(math.log(1 - self.recall) / math.log(miss))


class Shingles:
    def __init__(self, n: int):
        self.n, self.known, self.powers = n, WordHashes(), Powers()

    def of(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct n-gram hashes of a text."""
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        return np.unique(RollingHash(self.known.of(words), self.powers).grams(min(self.n, len(words))))


def salts(*seed: int, n: int) -> np.ndarray:
    """n odd multipliers."""
    return np.array([xxhash.xxh3_64_intdigest(repr((*seed, i)).encode()) | 1 for i in range(n)], np.uint64)


class Tree:
    """The random tree of every run: which tokens a set follows from a node, all runs at once."""

    def __init__(self, p: ChosenPath):
        self.p, self.start = p, salts(0, n=p.runs)
        self.next = [salts(1, level, n=p.runs) for level in range(p.depth)]

    def paths(self, tokens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nodes a set reaches: for each level, parents and nodes."""
        p, n = self.p, len(tokens)
        run = np.arange(p.runs)
        node, by, used = np.zeros(p.runs, np.uint64), self.start, np.full((p.runs, 0), -1)
        levels = []
        for level in range(p.depth):
            shared = max(1.0, p.similarity * n - level)
            below = np.uint64(min((1 << 64) - 1, int(2.0**64 / shared)))
            at, picked = np.nonzero(tokens[None, :] * by[:, None] <= below)
            fresh = (used[at] != picked[:, None]).all(1)
            at, picked = at[fresh], picked[fresh]
            child = mix((tokens[picked] ^ node[at]) * self.next[level][run[at]])
            levels.append((node[at], child))
            node, by, run, used = child, child | np.uint64(1), run[at], np.concatenate([used[at], picked[:, None]], axis=1)
        return levels


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One-permutation sketch: the least token of each of 64 ranges, 16 bits of it; 0 for none."""
    tokens = np.sort(mix(tokens))
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
    at = np.searchsorted(tokens, edges)
    least = tokens[np.minimum(at, len(tokens) - 1)]
    full = (at < len(tokens)) & ((least >> np.uint64(58)) == np.arange(BINS, dtype=np.uint64))
    return np.where(full, ((least >> np.uint64(20)) & np.uint64(0xFFFF)) | np.uint64(1), np.uint64(0)).astype("<u2")


NODES = pa.struct([("parent", pa.int64()), ("node", pa.int64())])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's tokens in order, in halves."""
    digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return signed(digest >> 64), signed(digest & (1 << 64) - 1)


def node_lists(levels: list[tuple[np.ndarray, np.ndarray] | None]) -> pa.Array:
    """One list of nodes per set."""
    sizes = [0 if x is None else len(x[0]) for x in levels]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    flat = [np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in levels if x is not None)]).view(np.int64) for i in (0, 1)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(f) for f in flat], fields=list(NODES)))


def describe(docs: DataFrame, p: ChosenPath) -> DataFrame:
    """Per row of docs: the 128-bit signature of its set, the set's size, sketch and paths."""

    def run(batches):
        shingles, tree = Shingles(p.n), Tree(p)
        names = ["doc_id", "text_hash", "sig_a", "sig_b", "size", "sketch", *(f"level_{k + 1}" for k in range(p.depth))]
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    rows, levels = [], []
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                        tokens = shingles.of(text.as_py())
                        if doc_id is None or not len(tokens):
                            rows.append((None, None, 0, None))
                            levels.append([None] * p.depth)
                            continue
                        rows.append((*signature(tokens), len(tokens), sketch(tokens).tobytes()))
                        levels.append(tree.paths(tokens))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns, *(node_lists([x[k] for x in levels]) for k in range(p.depth))], names=names)

    nodes = "".join(f", level_{k + 1} array<struct<parent: long, node: long>>" for k in range(p.depth))
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.cast("binary"), F.xxhash64(text)).mapInArrow(run, f"doc_id long, text_hash long, sig_a long, sig_b long, size int, sketch binary{nodes}")


def buckets(reps: DataFrame, p: ChosenPath, scratch: Scratch) -> DataFrame:
    """(node, members, rep, size, sketch): the members of every bucket of two or more sets."""
    out, large = None, None
    for level in range(1, p.depth + 1):
        nodes = reps.select("rep", F.explode(f"level_{level}").alias("at")).select("rep", "at.*")
        if large is not None:
            nodes = nodes.join(large, nodes.parent == large.split, "left_semi")
        counts = nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
        met = nodes.join(counts, "node")
        if level < p.depth:
            split = scratch.keep(counts.where(F.col("members") > p.limit).select(F.col("node").alias("split")))
            met = met.where(F.col("members") <= p.limit)
        met = met.select("node", "members", "rep")
        out = met if out is None else out.unionAll(met)
        if level < p.depth:
            large = split
            if large.isEmpty():
                break
    return out.join(reps.select("rep", "size", "sketch"), "rep")


def in_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """Deal the rows of each key into that many blocks by rep, and send each row to the pairs of blocks
    it is in: (block_a, block_b, own, ...)."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
    df = df.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return df.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other")).drop("blocks", "other")


def in_groups(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n items and linked pairs: each item's least linked item, through any chain of links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def plausible(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, p: ChosenPath) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sizes allow the similarity and whose sketches agree in enough bins: six
    standard deviations below the threshold, for sets with many more tokens than bins."""
    least = p.similarity - 6 * math.sqrt(p.similarity * (1 - p.similarity) / BINS)
    size = np.minimum(xs[:, None], ys[None, :]) >= p.similarity * np.maximum(xs[:, None], ys[None, :])
    i, j = np.nonzero(size)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 200_000):
        u, v = x[i[s : s + 200_000]], y[j[s : s + 200_000]]
        used = ((u != 0) | (v != 0)).sum(1)
        keep[s : s + 200_000] = ((u == v) & (u != 0)).sum(1) >= least * used
    return i[keep], j[keep]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def plausible_edges(members: DataFrame, p: ChosenPath, partitions: int) -> DataFrame:
    """(a, b): in each bucket or pair of blocks, every member with the least it may be similar to,
    through chains of such pairs. At most one row per member."""

    def run(batches):
        out_a: list = []
        out_b: list = []
        for (_, block_a, block_b), parts in grouped(batches, 3):
            t = pa.Table.from_batches(parts)
            rep, size, own = (t.column(c).to_numpy() for c in ("rep", "size", "own"))
            bins = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(-1, BINS)
            if len(rep) > 1:
                pairs = []
                for s in range(0, len(rep), 256):
                    if block_a == block_b:
                        i, j = plausible(bins[s : s + 256], bins[s:], size[s : s + 256], size[s:], p)
                        keep = i < j
                        pairs.append((i[keep] + s, j[keep] + s))
                    else:
                        left, right = np.flatnonzero(own == block_a)[s : s + 256], np.flatnonzero(own == block_b)
                        if len(left):
                            i, j = plausible(bins[left], bins[right], size[left], size[right], p)
                            pairs.append((left[i], right[j]))
                a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
                label = stars(len(rep), a, b)
                moved = np.flatnonzero(label != np.arange(len(rep)))
                out_a += rep[label[moved]].tolist()
                out_b += rep[moved].tolist()
            if len(out_a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=EDGES)
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=EDGES)

    cols = ("node", "block_a", "block_b", "own", "rep", "size", "sketch")
    rows = in_groups(in_blocks(members, F.ceil(F.col("members") / F.lit(p.block))).select(*cols), ["node", "block_a", "block_b"], partitions)
    return rows.mapInArrow(run, "a long, b long").distinct()


LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def exact_links(sets: DataFrame, p: ChosenPath, partitions: int) -> DataFrame:
    """(rep, links, to): for each set of a component and each pair of blocks it is in, how many sets
    of the other block are similar, and one id on a chain of links to the least there."""

    def run(batches):
        rows: list = []
        for (_, block_a, block_b), parts in grouped(batches, 3):
            t = pa.Table.from_batches(parts)
            rep, first = np.unique(t.column("rep").to_numpy(), return_index=True)  # rows may repeat a doc_id and a set
            own = t.column("own").to_numpy()[first]
            sets_here = t.column("tokens")
            raw = [np.frombuffer(sets_here[i].as_py(), np.uint64) for i in first.tolist()]
            size = np.array([len(r) for r in raw])
            tokens, at = np.unique(np.concatenate(raw), return_inverse=True)
            where = np.repeat(np.arange(len(raw)), size)
            # tokens that all these sets share count for every pair and need no column; those of one set count for none
            seen = np.bincount(at, minlength=len(tokens))
            common = int((seen == len(raw)).sum())
            column = np.cumsum((seen > 1) & (seen < len(raw))) - 1
            keep = (seen[at] > 1) & (seen[at] < len(raw))
            at, where = column[at[keep]], where[keep]
            wide = int(column[-1]) + 1 if len(column) else 0
            left = np.arange(len(raw)) if block_a == block_b else np.flatnonzero(own == block_a)
            right = left if block_a == block_b else np.flatnonzero(own == block_b)
            place_l, place_r = (np.full(len(raw), -1) for _ in range(2))
            place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
            shared = np.full((len(left), len(right)), float(common), np.float32)
            step = 4096
            order = np.argsort(at, kind="stable")
            at, where = at[order], where[order]
            for c in range(0, wide, step):
                lo, hi = np.searchsorted(at, [c, c + step])
                x, y = np.zeros((len(left), min(step, wide - c)), np.float32), None
                a, w = at[lo:hi] - c, where[lo:hi]
                on = place_l[w] >= 0
                x[place_l[w[on]], a[on]] = 1
                if block_a == block_b:
                    y = x
                else:
                    y = np.zeros((len(right), min(step, wide - c)), np.float32)
                    on = place_r[w] >= 0
                    y[place_r[w[on]], a[on]] = 1
                shared += x @ y.T
            whole = size[left][:, None] + size[right][None, :] - shared
            linked = shared >= p.similarity * whole - 1e-6
            if block_a == block_b:
                np.fill_diagonal(linked, False)
            i, j = np.nonzero(linked)
            label = stars(len(raw), left[i], right[j])
            count = np.zeros(len(raw), np.int64)
            count[left] += linked.sum(1)
            if block_a != block_b:
                count[right] += linked.sum(0)
            some = np.flatnonzero(count)
            rows += zip(rep[some].tolist(), count[some].tolist(), rep[label[some]].tolist())
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LINKS)], schema=LINKS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LINKS)], schema=LINKS)

    cols = ("root", "block_a", "block_b", "own", "rep", "tokens")
    blocks = F.ceil(F.greatest(F.col("members") / p.exact_block, F.col("all_tokens") / p.exact_tokens))
    return in_groups(in_blocks(sets, blocks).select(*cols), ["root", "block_a", "block_b"], partitions).mapInArrow(run, "rep long, links long, to long")


def similarity_join(docs: DataFrame, p: ChosenPath = ChosenPath()) -> DataFrame:
    """doc_id, text_hash, class_id, copy_id, n_links: one row per row of docs.

    text_hash: Spark's xxhash64 of the text, which tells rows apart that repeat a doc_id. copy_id: the least doc_id with the same set. n_links: the other sets (copies count once) that are
    similar. class_id: the least copy_id that a chain of links leads to.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "chosen-path")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = scratch.keep(describe(docs, p))
    classes = scratch.keep(described.where("size > 0").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("copy_id")))
    one = described.where("size > 0").select(F.col("sig_a").alias("rep"), "doc_id", "sig_b", "size", "sketch", *(f"level_{k + 1}" for k in range(p.depth)))
    first = classes.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"), "copy_id")
    reps = one.join(first, (F.col("rep") == F.col("a")) & (F.col("sig_b") == F.col("b")) & (F.col("doc_id") == F.col("copy_id")))
    reps = scratch.keep(reps.drop("a", "b", "doc_id").dropDuplicates(["rep"]))
    edges = plausible_edges(buckets(reps, p, scratch), p, parts)
    rooted = components(edges, scratch)
    placed = rooted.join(reps.select("rep", "sig_b", "size", F.col("copy_id").alias("of")), F.col("id") == F.col("rep"))
    sizes = placed.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("members"), F.sum("size").alias("all_tokens"))
    members = scratch.keep(placed.join(sizes, F.col("root") == F.col("r")).select("rep", "sig_b", "of", "root", "members", "all_tokens"))

    def tokens(batches):
        shingles = Shingles(p.n)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles.of(t.as_py()) for t in part.column(5)]
                sigs = [signature(t) if len(t) else None for t in found]
                own = pa.array([s == x for s, x in zip(sigs, zip(part.column(0).to_pylist(), part.column(1).to_pylist()))])  # else another text of that doc_id
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:5], pa.array([t.tobytes() for t in found], pa.binary())], names=["rep", "root", "members", "all_tokens", "tokens"]).filter(own)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    small = members.count() * MEMBER_BYTES <= BROADCAST_BYTES
    sets = texts.join(F.broadcast(members) if small else members, F.col("of") == F.col("doc_id")).select("rep", "sig_b", "root", "members", "all_tokens", "text")
    sets = sets.mapInArrow(tokens, "rep long, root long, members long, all_tokens long, tokens binary")
    links = scratch.keep(exact_links(sets, p, parts))
    linked = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch)
    names = reps.select("rep", F.col("copy_id").alias("name"))
    linked = scratch.keep(linked.join(names, F.col("id") == F.col("rep")).select("id", "root", "name"))
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("name").alias("class_id"))
    groups = linked.join(least, F.col("root") == F.col("r")).select(F.col("id").alias("g"), "class_id")
    counts = links.groupBy(F.col("rep").alias("c")).agg(F.sum("links").alias("n_links"))
    named = classes.join(groups, F.col("sig_a") == F.col("g"), "left").join(counts, F.col("sig_a") == F.col("c"), "left").drop("g", "c")
    out = described.select("doc_id", "text_hash", "sig_a", "sig_b").join(named, ["sig_a", "sig_b"], "left")
    return out.select("doc_id", "text_hash", F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
