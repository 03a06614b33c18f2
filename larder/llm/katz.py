"""Katz backoff language model: counts in partitioned tables, exact normalisation, scores per text.

Words are maximal runs of bytes other than ASCII white space, A-Z in lower case; each text ends with an
end token, which is also the history of its first word. Every word and every bigram is counted. So

    p1(w)    = d(c) c / N for a word seen c > 0 times; what is left goes to the unknown word
    p(w | h) = d(c) c(h w) / c(h) if the bigram was seen, else a(h) p1(w)
    a(h)     = (1 - sum of the p of what was seen after h) / (1 - sum of their p1), 1 for an unknown h

with d the Good-Turing discount for counts up to 5 (Katz), taken from the counts of counts of all
training texts at each level. Each distribution sums to one over the training words and one unknown
word.

What is broadcast is bounded: the ids of at most `cached` words, those with the highest counts, one
number per such history, and the values of at most `hot_pairs` bigrams (the same). They are a cache and
have no part in the results. Counts are gathered in buckets: a worker sends, per run of
texts and bucket, its distinct keys and their counts packed into one row; a bucket's table is one row of
sorted keys and counts. There are four levels of them:

    1  words, by the word; for the counts of counts, and for what is cached
    2  bigrams of two words with ids, by both, so no frequent history or pair fills a bucket
    3  bigrams whose word has no id, by that word: all of its bigrams meet, which gives its count
    4  bigrams whose history has no id, by that history: all of its bigrams meet, which gives a(h);
       those whose word has none either come on from level 3, with the word's count

A word without an id is never frequent, so levels 3 and 4 have no hot bucket. All bigrams of a text
beyond the broadcast ones, and its rarer words, are asked of the tables: packed by bucket, answered
there, and summed by text.

Defined cases: a null or empty text is one end token; repeated rows count as often as they occur; a
null doc_id is scored, and trains if `training` says so; without training texts every probability is
that of the unknown word, one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch
from larder.llm.words import WordScan, mix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # as a table for translate()
K = 5  # counts above it are not discounted
END = np.uint64(0x2545F4914F6CDD1D)  # the end token's hash
RARE, END_ID = 0, 1  # ids of all words without one, and of the end token
SLOT_BITS = 20
TOP = np.uint64(1 << 63)  # set in the code of a word without an id
NONE = np.uint64(RARE)  # in place of the history of what is asked of level 4


@dataclass(frozen=True)
class Katz:
    cached: int = 1 << 18
    hot_pairs: int = 1 << 18
    run_chars: int = 6_000_000
    bucket_chars: int = 12_000_000


def discounts(n: list[int], total: int) -> np.ndarray:
    """d(0), ..., d(K) from counts of counts n[1..K + 1]; d(0) is unused. Where the counts give no
    sensible discount (tiny or odd data), that of absolute discounting stands in."""
    d = np.ones(K + 1)
    if not total:
        return d
    n1, n2 = n[1], n[2]
    share = (K + 1) * n[K + 1] / n1 if n1 else 1.0
    flat = min(n1 / (n1 + 2 * n2), 0.9) if n1 else 0.5  # below one: what was seen keeps some probability
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (n[r] * r) - share) / (1 - share) if n[r] and share < 1 else 0.0
        d[r] = good if 0 < good < 1 else 1 - flat / r
    return d


def apply(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= K, d[np.minimum(counts, K)], 1.0)


class Reader:
    """Texts as arrays of word hashes, each with its end token, in runs of about `run_chars`."""

    def __init__(self, model: Katz):
        self.scan, self.run_chars = WordScan(lower=True), model.run_chars

    def runs(self, batches, columns: int):
        """(other columns as lists, hashes end to end, lengths) for texts in the first column."""
        held: list[list] = [[] for _ in range(columns)]
        texts, size = [], 0
        for batch in batches:
            others = [c.to_pylist() for c in batch.columns[1:]]
            for i, text in enumerate(batch.column(0)):
                texts.append(text.as_py() or b"")
                for h, c in zip(held, others):
                    h.append(c[i])
                size += len(texts[-1])
                if size >= self.run_chars:
                    yield held, *self.tokens(texts)
                    held, texts, size = [[] for _ in range(columns)], [], 0
        if texts:
            yield held, *self.tokens(texts)

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, starts = self.scan.of(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        upto = np.searchsorted(starts, ends)
        out = np.full(len(hashes) + len(texts), END)
        word = np.ones(len(out), bool)
        word[upto + np.arange(len(texts))] = False
        out[word] = hashes
        return out, np.diff(upto, prepend=0) + 1


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


@dataclass
class Words:
    """What all workers need of the words: bounded by Katz.cached."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    ids: np.ndarray
    log_p: np.ndarray  # of p1, by id; 0 at RARE
    n_by_id: np.ndarray
    total: int
    distinct: int
    d: np.ndarray
    kept: float
    log_unknown: float  # of p1 of the unknown word

    @cached_property
    def slots(self) -> np.ndarray:
        """Where the keys with each value of the hash's first SLOT_BITS start."""
        return np.searchsorted(self.hashes >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count); RARE and -1 for a word without an id."""
        ids, counts = np.full(len(hashes), RARE), np.full(len(hashes), -1)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        left = np.flatnonzero(at < end)  # hashes are even, so a slot has a key or two
        while len(left):
            here = at[left]
            found = self.hashes[here] == hashes[left]
            ids[left[found]], counts[left[found]] = self.ids[here[found]], self.counts[here[found]]
            left = left[~found]
            at[left] += 1
            left = left[at[left] < end[left]]
        return ids, counts

    def log_p1(self, counts: np.ndarray) -> np.ndarray:
        """log10 p1 of words seen so often."""
        return np.log10(apply(self.d, counts) * self.kept / max(self.total, 1))


def learn_words(table: DataFrame, model: Katz) -> Words:
    total, distinct, n, scale = summary(table)
    d = discounts(n, total)
    keys, counts = highest(table, scale, model.cached, END)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    ids = np.arange(len(keys)) + 2
    ids[keys == END] = END_ID
    lost = sum(n[r] * r * (1 - d[r]) for r in range(1, K + 1))
    unknown = max(lost / total, 1e-9) if total else 1.0
    kept = 1.0 if lost else 1 - unknown  # where nothing was discounted a sliver is set aside all the same
    p = np.ones(len(keys) + 2)
    n_by_id = np.ones(len(keys) + 2, np.int64)
    p[ids] = apply(d, counts) * kept / max(total, 1)
    n_by_id[ids] = counts
    return Words(keys, counts, ids, np.log10(p), n_by_id, total, distinct, d, kept, float(np.log10(unknown)))


SHIFT = np.uint64(24)


def keys_of(hashes: np.ndarray, lengths: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history id << 24 | id) of each token, its id and its count."""
    ids, counts = words.find(hashes)
    history = np.roll(ids, 1)
    history[np.cumsum(lengths) - lengths] = END_ID
    return history.astype(np.uint64) << SHIFT | ids.astype(np.uint64), ids, counts


def codes_of(hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each token's history and of itself: an id, or else the hash with TOP set."""
    own = np.where(ids == RARE, hashes | TOP, ids.astype(np.uint64))
    history = np.roll(own, 1)
    history[np.cumsum(lengths) - lengths] = END_ID
    return history, own


def pair_keys(hashes: np.ndarray, lengths: np.ndarray, words: Words) -> list[tuple]:
    """(level, keys, minor keys or None) of the bigrams of a run."""
    keys, ids, _ = keys_of(hashes, lengths, words)
    h, w = codes_of(hashes, lengths, ids)
    three, four = w >= TOP, (w < TOP) & (h >= TOP)
    return [(2, keys[~three & ~four], None), (3, w[three], h[three]), (4, h[four], w[four])]


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + mix(w + END))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def packed(keys: np.ndarray, others: list[np.ndarray], buckets: int):
    """(bucket, size, packed keys, packed others...) for keys in order; keys as differences."""
    at = bucket_of(keys, buckets)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[b] : edges[b + 1]]
        yield (b, len(own), squeeze(np.diff(keys[own], prepend=np.uint64(0))), *(squeeze(o[own]) for o in others))


def squeeze(x: np.ndarray) -> bytes:
    """An array as byte planes, compressed."""
    x = np.ascontiguousarray(x, x.dtype.newbyteorder("<"))
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.copy().tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return planes.T.copy().view(np.dtype(dtype).newbyteorder("<")).reshape(n).astype(dtype)


PAIRS = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("size", pa.int32()), ("keys", pa.binary()), ("minor", pa.binary()), ("counts", pa.binary())])
TABLE = pa.schema([*PAIRS, ("by_count", pa.list_(pa.int64())), ("by_scale", pa.list_(pa.int64())), ("total", pa.int64())])
SCALES = 48


def merge(keys: list, minors: list, counts: list) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Sums of the counts of equal keys, or pairs of keys, in order."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    m = None if minors[0] is None else np.concatenate(minors)
    order = np.argsort(k, kind="stable") if m is None else np.lexsort((m, k))
    k, n = k[order], n[order]
    new = k[1:] != k[:-1]
    if m is not None:
        m = m[order]
        new |= m[1:] != m[:-1]
    first = np.flatnonzero(np.concatenate([[True], new])) if len(k) else np.zeros(0, np.int64)
    return k[first], m if m is None else m[first], np.add.reduceat(n, first) if len(k) else n


def count_table(texts: DataFrame, keys_in, model: Katz, buckets: int) -> DataFrame:
    """One row per level and bucket: its keys in order, their counts, how many keys have each count up to
    K + 1, and how many have counts from 2^i to 2^(i+1) - 1. keys_in: (hashes, lengths) -> (level, keys,
    minor keys or None), each token in one of them."""

    def emit(batches):
        for _, hashes, lengths in Reader(model).runs(batches, 0):
            out = []
            for level, keys, minor in keys_in(hashes, lengths):
                if minor is None:
                    keys, n = np.unique(keys, return_counts=True)
                else:
                    keys, minor, n = merge([keys], [minor], [np.ones(len(keys), np.int64)])
                n = n.astype(np.uint32)
                for bucket, size, k, *more in packed(keys, [n] if minor is None else [minor, n], buckets):
                    out.append((level, bucket, size, k, None if minor is None else more[0], more[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIRS)], schema=PAIRS)

    def gather(batches):
        now, keys, minors, counts, pending = None, [], [], [], 0

        def done():
            k, m, n = merge(keys, minors, counts)
            by_count = np.bincount(np.minimum(n, K + 2), minlength=K + 3)[: K + 2]
            by_scale = np.bincount(np.log2(n).astype(int), minlength=SCALES)
            out = (*now, len(k), squeeze(np.diff(k, prepend=np.uint64(0))), None if m is None else squeeze(m), squeeze(n.astype(np.uint64)), by_count.tolist(), by_scale.tolist(), int(n.sum()))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, TABLE)], schema=TABLE)

        for batch in batches:
            for level, bucket, size, k, m, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (level, bucket) != now and now is not None:
                    yield done()
                    keys, minors, counts, pending = [], [], [], 0
                now = level, bucket
                keys.append(np.cumsum(unsqueeze(k, size, np.uint64), dtype=np.uint64))
                minors.append(None if m is None else unsqueeze(m, size, np.uint64))
                counts.append(unsqueeze(n, size, np.uint32).astype(np.int64))
                pending += size
                if pending > 2_000_000 and len(keys) > 1:
                    k, m, n = merge(keys, minors, counts)
                    keys, minors, counts, pending = [k], [m], [n], 0
        if now is not None:
            yield done()

    ddl = "level int, bucket int, size int, keys binary, minor binary, counts binary"
    sent = texts.mapInArrow(emit, ddl).repartition(buckets, "level", "bucket").sortWithinPartitions("level", "bucket")
    return sent.mapInArrow(gather, ddl + ", by_count array<long>, by_scale array<long>, total long")


def summary(table: DataFrame) -> tuple[int, int, list[int], list[int]]:
    """All tokens, distinct keys, keys by count, keys by scale of count."""
    sums = table.select(F.sum("total"), F.sum("size"), *(F.sum(F.col("by_count")[r]) for r in range(K + 2)), *(F.sum(F.col("by_scale")[i]) for i in range(SCALES))).first()
    sums = [x or 0 for x in sums]
    return sums[0], sums[1], sums[2 : K + 4], sums[K + 4 :]


def highest(table: DataFrame, by_scale: list[int], most: int, always: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the keys with counts of at least 2^i, for the least i that gives at most
    `most`; and of the key `always`. Bounded, so the driver may hold them."""
    floor, room = SCALES, most
    while floor > 0 and by_scale[floor - 1] <= room:
        floor -= 1
        room -= by_scale[floor]
    least = 1 << floor
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def pick(batches):
        for batch in batches:
            for _, keys, _, counts in read_table(batch):
                some = counts >= least
                if always is not None:
                    some |= keys == always
                yield rows(schema, keys[some].view(np.int64), counts[some])

    top = table.select(*PACKED).mapInArrow(pick, "key long, n long").toArrow()
    return top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()


PACKED = ("level", "size", "keys", "minor", "counts")


def read_table(batch):
    """(level, keys, minor keys or None, counts) of rows of the columns PACKED."""
    for level, size, keys, minor, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
        minor = None if minor is None else unsqueeze(minor, size, np.uint64)
        yield level, np.cumsum(unsqueeze(keys, size, np.uint64), dtype=np.uint64), minor, unsqueeze(counts, size, np.uint64).astype(np.int64)


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each key in order, the sum of the counts of its equals."""
    _, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, counts)[at].astype(np.int64) if len(keys) else counts


HISTORY = pa.schema([("history", pa.int64()), ("seen", pa.float64()), ("lower", pa.float64())])


def history_weights(pairs: DataFrame, sent, d: np.ndarray) -> DataFrame:
    """(history, seen, lower) of histories with ids: over the bigrams seen after it, the sums of p2 and of p1."""

    def run(batches):
        words = sent.value
        p1 = 10.0**words.log_p
        for batch in batches:
            for level, keys, minor, counts in read_table(batch):
                if level == 2:
                    h, w = (keys >> SHIFT).astype(np.int64), (keys & np.uint64((1 << 24) - 1)).astype(np.int64)
                    p = p1[w]
                else:
                    known = minor < TOP
                    h, p = minor[known].astype(np.int64), 10.0 ** words.log_p1(totals(keys, counts)[known])
                    counts = counts[known]
                if not len(h):
                    continue
                top = int(h.max()) + 1
                seen, lower = np.bincount(h, apply(d, counts), top), np.bincount(h, p, top)
                some = np.flatnonzero(lower)
                yield rows(HISTORY, some, seen[some], lower[some])

    return pairs.where("level < 4").select(*PACKED).mapInArrow(run, "history long, seen double, lower double").groupBy("history").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))


def back_off(seen: np.ndarray, lower: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log a(h), factor on p2) of histories seen n times."""
    mass = seen / n
    backs_off = lower < 1 - 1e-10  # else every word was seen after h
    keep = np.where(backs_off, np.minimum(mass, 1 - 1e-6), 1.0)
    return np.log10(np.where(backs_off, 1 - keep, 1.0)) - np.log10(np.where(backs_off, 1 - lower, 1.0)), keep / mass


@dataclass
class Pairs:
    """The bounded part of the bigram level: log a(h) by id, and the hot pairs' values."""

    log_alpha: np.ndarray
    d: np.ndarray
    hot_keys: np.ndarray
    hot_values: np.ndarray
    scale: np.ndarray  # factor on p2 of what was seen after h, which keeps its sum below one

    def value(self, words: Words, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a seen bigram adds to a token's log10 probability, over backing off."""
        h, w = (keys >> SHIFT).astype(np.int64), (keys & np.uint64((1 << 24) - 1)).astype(np.int64)
        return self.gain(words, h, counts, words.log_p[w])

    def gain(self, words: Words, h: np.ndarray, counts: np.ndarray, log_p1: np.ndarray) -> np.ndarray:
        p2 = apply(self.d, counts) * self.scale[h] / words.n_by_id[h]
        return np.log10(p2) - self.log_alpha[h] - log_p1


def learn_pairs(table: DataFrame, words: Words, sent, model: Katz) -> Pairs:
    total, _, n, _ = summary(table)
    d = discounts(n, total)
    size = len(words.log_p)
    log_alpha, scale = np.zeros(size), np.ones(size)
    sums = history_weights(table, sent, d).toArrow()
    h, seen, lower = (sums.column(i).to_numpy() for i in range(3))
    if len(h):
        log_alpha[h], scale[h] = back_off(seen, lower, words.n_by_id[h])
    both = table.where("level = 2")
    keys, counts = highest(both, summary(both)[3], model.hot_pairs)
    order = np.argsort(keys)
    out = Pairs(log_alpha, d, keys[order], np.zeros(len(keys)), scale)
    if len(keys):
        out.hot_values = out.value(words, keys[order], counts[order])
    return out


# One row per run of texts: its rows of the result so far.
RUN = "run long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<double>, base array<double>, score array<double>"
# What a run asks of a bucket of a level's table: sorted keys, and the place in the run of each.
ASK = "level int, bucket int, size int, keys binary, minor binary, at binary"
# What a bucket answers: sums by place in the run.
ANSWER = "run long, size int, places binary, n_known binary, base binary, score binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def score_texts(docs: DataFrame, training: Column, model: Katz = Katz()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    training: which rows the model learns from. n_known: tokens that the training texts have.
    base_score: under add-one smoothed word counts. score: log10 probability under the model.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"))
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // model.bucket_chars)
    learned = texts.where("training").select("text")
    table1 = scratch.keep(count_table(learned, lambda hashes, lengths: [(1, hashes, None)], model, buckets))
    words = learn_words(table1, model)
    sent = spark.sparkContext.broadcast(words)
    scratch.drop(table1)  # level 3 has the counts of the words without ids
    table2 = scratch.keep(count_table(learned, lambda hashes, lengths: pair_keys(hashes, lengths, sent.value), model, buckets))
    pairs = learn_pairs(table2, words, sent, model)
    sent2 = spark.sparkContext.broadcast(pairs)
    first = scratch.keep(texts.mapInArrow(ask_tables(sent, sent2, model, buckets), f"{RUN}, {ASK}"))
    columns = ("level", "bucket", "run", "size", "keys", "minor", "at", "word_counts")
    none = F.lit(None).cast("binary").alias("word_counts")
    tables = table2.select("level", "bucket", F.lit(-1).cast("long").alias("run"), "size", "keys", "minor", F.col("counts").alias("at"), none)
    on = table2.where("level = 3").select(*PACKED).mapInArrow(rare_bigrams(buckets), MOVED)
    asked = first.where("level > 0").select(*columns[:-1], none)
    met = tables.unionAll(on.select(*columns)).unionAll(asked)
    met = met.repartition(2 * buckets, "level", "bucket").sortWithinPartitions("level", "bucket", "run")
    answers = met.mapInArrow(answer_runs(sent, sent2), ANSWER)
    own = first.where("level = 0")
    columns = [c.split()[0] for c in RUN.split(", ")]
    parts = ("places", "n_known", "base", "score")
    both = own.select(*columns, F.lit(0).alias("turn"), F.lit(0).alias("size"), *(F.lit(None).cast("binary").alias(f"{c}_sum") for c in parts))
    both = both.unionAll(answers.select("run", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in columns[1:]), F.lit(1).alias("turn"), "size", *(F.col(c).alias(f"{c}_sum") for c in parts)))
    return both.repartition(buckets, "run").sortWithinPartitions("run", "turn").mapInArrow(sum_runs(words.total), RESULT)


MOVED = "level int, bucket int, run long, size int, keys binary, minor binary, at binary, word_counts binary"


def rare_bigrams(buckets: int):
    """Level 3 -> rows of level 4: its bigrams of two words without ids, with the counts of their words."""
    schema = arrow_schema(MOVED)

    def run(batches):
        for batch in batches:
            parts = []
            for _, w, h, n in read_table(batch):
                some = h >= TOP
                parts.append((h[some], w[some], n[some].astype(np.uint64), totals(w, n)[some].astype(np.uint64)))
            h, *others = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64),)
            order = np.argsort(h, kind="stable")
            out = [(4, bucket, -1, *x) for bucket, *x in packed(h[order], [c[order] for c in others], buckets)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def ask_tables(sent, sent2, model: Katz, buckets: int):
    """Texts -> per run, its own row (level 0) and what it asks of the tables."""
    schema = arrow_schema(f"{RUN}, {ASK}")

    def run(batches):
        from pyspark import TaskContext

        w, p, task = sent.value, sent2.value, TaskContext.get().partitionId()
        scale = w.total + w.distinct + 1
        for number, ((doc_id, trains), hashes, lengths) in enumerate(Reader(model).runs(batches, 2)):
            name, n = task << 32 | number, len(lengths)
            keys, ids, counts = keys_of(hashes, lengths, w)
            at = np.repeat(np.arange(n, dtype=np.uint32), lengths)
            common = counts >= 0
            base = np.where(common, np.log10((np.maximum(counts, 0) + 1) / scale), 0.0)
            score = w.log_p[ids] + p.log_alpha[(keys >> SHIFT).astype(np.int64)]
            cold = np.ones(len(keys), bool)
            if len(p.hot_keys):
                place = np.minimum(np.searchsorted(p.hot_keys, keys), len(p.hot_keys) - 1)
                cold = p.hot_keys[place] != keys
                score += np.where(cold, 0.0, p.hot_values[place])
            sums = [np.bincount(at, v, n).tolist() for v in ((counts > 0).astype(float), base, score)]
            out = [(name, doc_id, [not t for t in trains], lengths.tolist(), *sums, 0, None, None, None, None, None)]
            h, own = codes_of(hashes, lengths, ids)
            asks = [(2, keys, None, cold & (h < TOP) & (own < TOP)), (3, own, np.where(h < TOP, h, NONE), own >= TOP), (4, h, own, h >= TOP)]
            for level, k, minor, some in asks:
                k, places = k[some], at[some]
                order = np.argsort(k, kind="stable")
                others = [places[order]] if minor is None else [minor[some][order], places[order]]
                for bucket, n_keys, k, *more in packed(k[order], others, buckets):
                    out.append((name, *(None,) * 6, level, bucket, n_keys, k, None if minor is None else more[0], more[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


class Bucket:
    """The table of a level's bucket, and its answers."""

    def __init__(self, level: int, parts: list, words: Words, pairs: Pairs):
        self.level, self.words = level, words
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)
        self.every, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # words and their counts
        if not parts:
            return
        self.keys, minor, counts, word_counts = (None if c[0] is None else np.concatenate(c) for c in zip(*parts))
        if level == 2:
            self.values = pairs.value(words, self.keys, counts)
        elif level == 3:
            w, n = self.keys, totals(self.keys, counts)
            log_p1, known = words.log_p1(n), minor < TOP
            self.every, first = np.unique(w, return_index=True)
            self.n = n[first]
            self.keys, self.minor = w[known], minor[known]
            self.values = pairs.gain(words, self.minor.astype(np.int64), counts[known], log_p1[known])
        else:
            self.minor = minor
            known = minor < TOP
            log_p1 = np.where(known, words.log_p[np.where(known, minor, 0).astype(np.int64)], words.log_p1(np.maximum(word_counts, 1)))
            self.histories, at = np.unique(self.keys, return_inverse=True)
            p2 = apply(pairs.d, counts)
            n = np.bincount(at, counts)
            self.log_alpha, scale = back_off(np.bincount(at, p2), np.bincount(at, 10.0**log_p1), n)
            self.values = np.log10(p2 * (scale / n)[at]) - self.log_alpha[at] - log_p1
        if level > 2:
            by = pair_hash(self.keys, self.minor)
            order = np.argsort(by)
            self.by, self.keys, self.minor, self.values = by[order], self.keys[order], self.minor[order], self.values[order]

    def find(self, k: np.ndarray, minor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(found, place) of keys."""
        if not len(self.keys):
            return np.zeros(len(k), bool), np.zeros(len(k), np.int64)
        have, want = (self.keys, k) if minor is None else (self.by, pair_hash(k, minor))
        place = np.minimum(np.searchsorted(have, want), len(have) - 1)
        found = self.keys[place] == k
        return found if minor is None else found & (self.minor[place] == minor), place

    def answer(self, k: np.ndarray, minor: np.ndarray | None, at: np.ndarray) -> tuple | None:
        """(places, known, base, score) to be added, known and base None for nothing; or None."""
        score = np.zeros(len(k))
        found, place = self.find(k, minor)
        score[found] = self.values[place[found]]
        if self.level == 3:
            w, n = self.words, np.zeros(len(k), np.int64)
            if len(self.every):
                place = np.minimum(np.searchsorted(self.every, k), len(self.every) - 1)
                n = np.where(self.every[place] == k, self.n[place], 0)
            score += np.where(n > 0, w.log_p1(np.maximum(n, 1)), w.log_unknown)
            return at, (n > 0).astype(float), np.log10((n + 1) / (w.total + w.distinct + 1)), score
        if self.level == 4 and len(self.keys):
            place = np.minimum(np.searchsorted(self.histories, k), len(self.histories) - 1)
            found = self.histories[place] == k
            score[found] += self.log_alpha[place[found]]
        return (at[found], None, None, score[found]) if found.any() else None


def answer_runs(sent, sent2):
    """Rows of a level and bucket, its table first (run -1) -> sums by run and place."""
    schema = arrow_schema(ANSWER)

    def run(batches):
        w, p = sent.value, sent2.value
        now, parts, table = None, [], None
        for batch in batches:
            out = []
            for level, bucket, name, size, k, minor, at, word_counts in zip(*(c.to_pylist() for c in batch.columns)):
                k = np.cumsum(unsqueeze(k, size, np.uint64), dtype=np.uint64)
                minor = None if minor is None else unsqueeze(minor, size, np.uint64)
                if now != (level, bucket):
                    now, parts, table = (level, bucket), [], None
                if name < 0:
                    counts = unsqueeze(at, size, np.uint64).astype(np.int64)
                    word_counts = np.zeros(size, np.int64) if word_counts is None else unsqueeze(word_counts, size, np.uint64).astype(np.int64)
                    parts.append((k, minor, counts, word_counts))
                    continue
                if table is None:
                    table, parts = Bucket(level, parts, w, p), []
                answer = table.answer(k, minor, unsqueeze(at, size, np.uint32))
                if answer is not None:
                    places, to = np.unique(answer[0], return_inverse=True)
                    gaps = np.diff(places, prepend=np.uint32(0)).astype(np.uint32)
                    out.append((name, len(places), squeeze(gaps), *(v if v is None else squeeze(np.bincount(to, v)) for v in answer[1:])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def sum_runs(total: int):
    """Rows of a run, its own first -> the run's rows of the result."""
    schema = arrow_schema(RESULT)

    def run(batches):
        held = None

        def done():
            doc_id, held_out, lengths, known, base, score = held
            columns = pa.array(doc_id, pa.int64()), held_out, lengths, np.rint(known).astype(np.int64), np.full(len(lengths), total), base, score
            return rows(schema, *columns)

        for batch in batches:
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in batch.columns]
                if values[7] == 0:
                    if held is not None:
                        yield done()
                    held = [*values[1:4], *map(np.array, values[4:7])]
                else:
                    size = values[8]
                    places = np.cumsum(unsqueeze(values[9], size, np.uint32))
                    for into, x in zip(held[3:], values[10:]):
                        if x is not None:
                            into[places] += unsqueeze(x, size, np.float64)
        if held is not None:
            yield done()

    return run
