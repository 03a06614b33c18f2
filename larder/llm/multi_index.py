"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, and each half is quantised on its own by k-means, which gives
centroids * centroids cells; the number of centroids grows with the square root of the number of vectors,
up to `most_centroids`. A query orders the centroids of each half by their share of the distance and
walks the cells in order of the summed distance, with a heap, until the cells it has walked hold the
wanted share of all vectors; these are reranked by the exact measure, the inner product in double
precision.

The quantisers are fitted on at most `sample` distinct vectors (those with the least hash). How far to
walk is measured, not assumed: for at most `probes` of the sample, the true neighbours among all vectors
are found by brute force, and the share is the least that reaches `recall` of them. Where neighbours are
near, as in clustered data, that is a small part of the cells; with a recall of 1 all are walked, and the
search is exact. Every vector is indexed.

Equal vectors are one entry, which keeps as many of its least ids as a result can name; queries with
equal vectors are walked once. Entries are dealt into chunks by cell, a large cell into several, and
queries into blocks by their own cell, so that the queries of a block walk much the same cells. A block
goes to the chunks that one of its queries walks, and a chunk to the groups of blocks that come to it: a
task holds one chunk and one block at a time, and no chunk meets all queries in one task.

Defined cases: vectors that are null, all zero, or hold null, NaN or infinite components, and rows
without an id, take no part; nor do vectors of another length than the commonest (the longer of two
equally common). Rows that repeat an id and a vector are one. Fewer candidates than k give all of them.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch
from larder.llm.words import grouped


@dataclass(frozen=True)
class MultiIndex:
    centroids: int | None = None  # of each half; None: by the number of vectors
    most_centroids: int = 256
    cell: int = 32  # vectors a cell is to hold, while there may be more centroids
    sample: int = 16_384
    probes: int = 256
    recall: float = 0.96
    chunk_bytes: int = 32 << 20
    least_chunk: int = 1024  # vectors
    block: int = 1024  # queries
    group: int = 16  # blocks

    def halves(self, n: int) -> int:
        return self.centroids or min(self.most_centroids, max(16, math.ceil(math.sqrt(n / self.cell))))

    def chunk(self, n: int, wide: int, parts: int) -> int:
        """Vectors of a chunk: several chunks a partition, of bounded size."""
        return max(1, min(self.chunk_bytes // (8 * wide), max(self.least_chunk, -(-n // (2 * parts)))))


@dataclass
class Quantisers:
    first: np.ndarray
    second: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = x.shape[1] // 2
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def walk(self, query: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
        """Cells by summed distance (negated inner products with the centroids), until they hold `wanted`."""
        h = len(query) // 2
        a, b = -(self.first @ query[:h]), -(self.second @ query[h:])
        order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = a.tolist(), b.tolist()
        heap, out, held = [(a[order_a[0]] + b[order_b[0]], 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = order_a[i] * len(b) + order_b[j]
            if sizes[cell]:
                out.append(cell)
                held += sizes[cell]
            if j + 1 < len(b):
                heapq.heappush(heap, (a[order_a[i]] + b[order_b[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[order_a[i + 1]] + b[order_b[0]], i + 1, 0))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(0).choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def fit(x: np.ndarray, centroids: int) -> Quantisers:
    h = x.shape[1] // 2
    return Quantisers(k_means(x[:, :h], centroids), k_means(x[:, h:], centroids))


def share_walked(placed: DataFrame, sent, sizes: np.ndarray, probes: np.ndarray, keys: np.ndarray, k: int, recall: float) -> float:
    """The least share of all vectors that the probes' walks have to hold to reach that recall of their
    true neighbours, which are found by brute force, a partition at a time."""
    wide = probes.shape[1]

    def nearest_here(batches):
        score, cell = np.full((len(probes), 0), 0.0), np.zeros((len(probes), 0), np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, wide)
            here = probes @ flat.T
            here[keys[:, None] == batch.column(2).to_numpy()[None, :]] = -np.inf
            score = np.concatenate([score, here], 1)
            cell = np.concatenate([cell, np.broadcast_to(batch.column(1).to_numpy(), here.shape)], 1)
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        if score.shape[1]:
            probe = np.repeat(np.arange(len(probes)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int32()), pa.array(score.ravel()), pa.array(cell.ravel(), pa.int32())], names=["probe", "score", "cell"])

    found = placed.select("vector", "cell", "key").mapInArrow(nearest_here, "probe int, score double, cell int").where("score > double('-infinity')")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "cell"))
    found = found.withColumn("r", place).where(F.col("r") <= k).select("probe", "cell").toArrow()  # at most probes * k
    probe, cell = (found.column(i).to_numpy() for i in (0, 1))
    needs = []
    for i in np.unique(probe).tolist():
        order = sent.value.walk(probes[i], sizes, sizes.sum())
        done = np.ones(len(sizes))
        done[order] = np.cumsum(sizes[order]) / sizes.sum()
        needs.append(done[cell[probe == i]])
    return float(np.quantile(np.concatenate(needs), recall)) if needs else 1.0


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, key_a, key_b): the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    v = v.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    size = v.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    v = v.where(F.size("vector") == (size["size"] if size else 0))
    v = v.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    return v.withColumn("key_a", F.xxhash64("vector")).withColumn("key_b", F.xxhash64(F.lit(1), "vector"))


PACKED_DDL = "block int, chunk int, queries binary, vectors binary, cells binary, walked binary"
PACKED = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), *((c, pa.binary()) for c in ("queries", "vectors", "cells", "walked"))])
MET_DDL = "chunk int, grp int, turn int, cell int, ids array<long>, vector binary, queries binary, cells binary, walked binary"
FOUND = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def spans(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells dealt in order into parts of about `most`: each cell's first and last part."""
    ends = np.cumsum(sizes)
    return (ends - sizes) // most, np.maximum(ends - 1, 0) // most


def dealt(rows: DataFrame, first: np.ndarray, last: np.ndarray, sizes: np.ndarray, name: str) -> DataFrame:
    """Rows with a cell and a key, with the part they are in."""
    span = rows.sparkSession.createDataFrame([(int(c), int(first[c]), int(last[c] - first[c] + 1)) for c in np.flatnonzero(sizes)], "cell int, low int, parts int")
    return rows.join(F.broadcast(span), "cell").withColumn(name, (F.col("low") + F.pmod("key", "parts")).cast("int")).drop("low", "parts")


def cell_sizes(rows: DataFrame, cells: int) -> np.ndarray:
    sizes = np.zeros(cells, np.int64)
    for cell, count in rows.groupBy("cell").count().collect():  # at most centroids^2 rows
        sizes[cell] = count
    return sizes


def pack(sent, sizes: np.ndarray, first: np.ndarray, last: np.ndarray, wanted: float):
    """Queries sorted by block -> for each block and chunk that one of its queries walks: the queries'
    keys and vectors, the chunk's cells that are walked, and which query walks which of them."""

    def run(batches):
        for (block,), parts in grouped(batches, 1):
            keys = np.concatenate([p.column(1).to_numpy() for p in parts])
            joined = b"".join(v for p in parts for v in p.column(2).to_pylist())
            vectors = np.frombuffer(joined).reshape(len(keys), -1)
            visits = np.zeros((len(keys), len(sizes)), bool)
            for i, v in enumerate(vectors):
                visits[i, sent.value.walk(v, sizes, wanted)] = True
            met = np.flatnonzero(visits.any(0))
            starts, ends = first[met], last[met]
            for chunk in range(int(starts[0]), int(ends[-1]) + 1) if len(met) else ():
                cells = met[np.searchsorted(ends, chunk, "left") : np.searchsorted(starts, chunk, "right")].astype(np.int32)
                if not len(cells):
                    continue
                walked = visits[:, cells]
                some = np.flatnonzero(walked.any(1))
                out = (int(block), chunk, keys[some].tobytes(), vectors[some].tobytes(), cells.tobytes(), np.packbits(walked[some]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, PACKED)], schema=PACKED)

    return run


def compare(wide: int, k: int):
    """Rows of a chunk and group, its vectors first -> the k + 1 best entries there of each query."""

    def run(batches):
        now, cells, ids, held, matrix = None, [], [], [], None
        for batch in batches:
            for chunk, grp, turn, cell, own, vector, queries, walked_cells, walked in zip(*(c.to_pylist() for c in batch.columns)):
                if (chunk, grp) != now:
                    now, cells, ids, held, matrix = (chunk, grp), [], [], [], None
                if turn == 0:
                    cells.append(cell)
                    ids.append(own)
                    held.append(vector)
                    continue
                if not held:
                    continue
                if matrix is None:
                    matrix = np.frombuffer(b"".join(held)).reshape(-1, wide)
                    order = np.argsort([i[0] for i in ids], kind="stable")
                    matrix, where = matrix[order], np.array(cells)[order]
                    names = [ids[i] for i in order.tolist()]
                asked = np.frombuffer(queries, np.int64)
                q = np.frombuffer(vector).reshape(-1, wide)
                own_cells = np.frombuffer(walked_cells, np.int32)
                bits = np.unpackbits(np.frombuffer(walked, np.uint8))[: len(asked) * len(own_cells)].reshape(len(asked), -1).astype(bool)
                column = np.searchsorted(own_cells, where)
                known = (column < len(own_cells)) & (own_cells[np.minimum(column, len(own_cells) - 1)] == where)
                some = np.flatnonzero(known)
                if not len(some):
                    continue
                here, column = matrix[some], column[some]
                out_q, out_s, out_i = [], [], []
                for s in range(0, len(asked), 256):
                    score = np.where(bits[s : s + 256][:, column], q[s : s + 256] @ here.T, -np.inf)
                    top = min(k + 1, len(some))
                    low = np.partition(score, len(some) - top, axis=1)[:, len(some) - top]
                    for i in range(len(score)):
                        row = score[i]
                        best = np.flatnonzero(row >= low[i]) if low[i] > -np.inf else np.flatnonzero(row > -np.inf)
                        best = best[np.argsort(-row[best], kind="stable")[:top]]  # equal scores stay in order of their least id
                        out_q += [int(asked[s + i])] * len(best)
                        out_s += row[best].tolist()
                        out_i += [names[j] for j in some[best].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((out_q, out_s, out_i), FOUND)], schema=FOUND)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, index: MultiIndex = MultiIndex()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where is_query (of vec_id) holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi-index")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(vectors)
    least = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("key_a", "key_b").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = least.groupBy("key_a", "key_b").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.first("vector").alias("vector"))
    entries = scratch.keep(entries)
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.select("key_a", "vector").orderBy("key_a").limit(index.sample).toArrow()
    wide = len(sample.column(1)[0])
    fitted = sample.column(1).combine_chunks().flatten().to_numpy().reshape(-1, wide)
    quantisers = fit(fitted, index.halves(n))
    sent = spark.sparkContext.broadcast(quantisers)

    def assign(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in flat], pa.binary()), pa.array(sent.value.cells(flat), pa.int32())], names=["ids", "key", "key_b", "vector", "cell"])

    placed = scratch.keep(entries.select("ids", "vector", F.col("key_a").alias("key"), "key_b").mapInArrow(assign, "ids array<long>, key long, key_b long, vector binary, cell int"))
    scratch.drop(entries)
    cells = len(quantisers.first) * len(quantisers.second)
    sizes = cell_sizes(placed, cells)
    chunk = index.chunk(n, wide, parts)
    first, last = spans(sizes, chunk)
    probed = np.arange(0, len(fitted), max(1, -(-len(fitted) // index.probes)))
    share = 1.0 if index.recall >= 1 else share_walked(placed, sent, sizes, fitted[probed], sample.column(0).to_numpy()[probed], k, index.recall)

    asked = scratch.keep(rows.where(is_query).select("vec_id", "key_a", "key_b").distinct())
    keys = asked.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    walkers = placed.join(keys, (F.col("key") == F.col("a")) & (F.col("key_b") == F.col("b"))).select("cell", "key", "vector")
    walker_sizes = cell_sizes(walkers, cells)
    blocks_first, blocks_last = spans(walker_sizes, index.block)
    blocked = dealt(walkers, blocks_first, blocks_last, walker_sizes, "block").select("block", "key", "vector")
    blocked = blocked.repartition(max(parts, int(blocks_last.max()) + 1), "block").sortWithinPartitions("block", "key")
    blocked = scratch.keep(blocked.mapInArrow(pack(sent, sizes, first, last, share * n), PACKED_DDL))
    grp = F.floor(F.col("block") / index.group).cast("int")
    pairs = blocked.select(F.col("chunk").alias("of"), grp.alias("grp")).distinct()
    chunks = dealt(placed.select("cell", "key", "ids", "vector"), first, last, sizes, "chunk").join(pairs, F.col("chunk") == F.col("of"))
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("cell", "int"), ("ids", "array<long>"), ("queries", "binary"), ("cells", "binary"), ("walked", "binary"))}
    both = chunks.select("chunk", "grp", F.lit(0).alias("turn"), "cell", "ids", "vector", none["queries"], none["cells"], none["walked"])
    both = both.unionAll(blocked.select("chunk", grp, F.lit(1), none["cell"], none["ids"], "vectors", "queries", "cells", "walked"))
    tasks = max(parts, (int(last.max()) + 1) * (1 + int(blocks_last.max()) // index.group))
    met = both.repartition(tasks, "chunk", "grp").sortWithinPartitions("chunk", "grp", "turn").mapInArrow(compare(wide, k), "query long, score double, ids array<long>")
    met = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("r") <= k + 1).drop("r")
    named = asked.join(met, F.col("key_a") == F.col("query")).select(F.col("vec_id").alias("query_id"), "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
