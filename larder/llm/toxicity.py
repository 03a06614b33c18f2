"""Toxic spans by a linear-chain conditional random field.

Tokens are maximal runs of letters, digits and apostrophes, in lower case, tagged 1 (toxic) or 0. The
labels at hand mark whole documents, so token labels come from them: a word form, or a word beginning
of four or five letters, is marked where its documents are toxic far more often than chance allows; the
marked tokens of toxic documents are 1, every other token 0. The field has weights for the token, its
beginnings of 3 to 5 letters, its ending of 3, the tokens before and after it, and the four
transitions. It is fitted to the log-likelihood by AdaGrad on at most `most_labelled` labelled rows
(those with the least hash of doc_id); features that the fitting rows show fewer than `least_seen`
times are left out.

Scoring runs forward-backward over whole texts and gives each token's marginal. A document's features,
log(1 + sum of its marginals over a tenth) and its largest marginal, go through a logistic link fitted on the same
rows, which gives a score from 0 to 1. Marginals above one half make spans: character offsets in the
text.

Defined cases: a null or empty text has no tokens and gets the score of a text without toxic tokens;
repeated rows are scored alike; labels that are null, or whose doc_id is missing, teach nothing; with
no toxic or no harmless labelled row every score is 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.words import mix

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


@dataclass
class Field:
    """Fitted weights. `known` gives a token's own score at once for the tokens of the fitting rows."""

    word: dict[str, float] = field(default_factory=dict)
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    part: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    link: tuple[float, float, float] = (-30.0, 0.0, 0.0)


def parts(token: str) -> list[str]:
    return ["^" + token[:n] for n in (3, 4, 5) if len(token) > n - 1] + (["$" + token[-3:]] if len(token) > 2 else [])


class Emissions(dict):
    """token -> its own score, remembered for tokens met lately."""

    def __init__(self, model: Field, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, token: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        m = self.model
        value = m.bias + m.word.get(token, 0.0) + sum(m.part.get(p, 0.0) for p in parts(token))
        self[token] = value
        return value


def forward_backward(emission: np.ndarray, starts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(tag = 1) of each token, and P(tags of tokens i and i + 1) as rows 00, 01, 10, 11 (which mean
    nothing where i + 1 starts a document), for documents laid end to end; `starts` marks first tokens.

    The tokens are cut into lanes of equal length that advance together. Each lane first takes the
    product of its 2 x 2 matrices, the products are chained across lanes, and the lanes then run
    again from exact messages: the result does not depend on how the lanes fall.
    """
    n = len(emission)
    if not n:
        return emission, np.zeros((4, 0))
    wide = max(1, int(n**0.5))
    long = -(-n // wide)
    e = np.zeros(wide * long)
    e[:n] = np.exp(np.clip(emission, -60, 60))
    e[n:] = 1
    new = np.zeros(wide * long, bool)
    new[:n] = starts
    new[n:] = True
    e, new = e.reshape(wide, long).T, new.reshape(wide, long).T  # (place in lane, lane)
    t = np.exp(step)

    def through(emit, fresh, order):
        """Messages before each place, in `order` of places; a message is the pair of weights of tag 0 and 1."""
        a = np.ones(emit.shape[1]), np.zeros(emit.shape[1])
        b = np.zeros(emit.shape[1]), np.ones(emit.shape[1])

        def advance(x, k):
            x0, x1 = x
            y0, y1 = x0 * t[0, 0] + x1 * t[1, 0], x0 * t[0, 1] + x1 * t[1, 1]
            reset = fresh[k]
            total = x0 + x1
            return np.where(reset, total, y0), np.where(reset, total, y1) * emit[k]

        for k in order:
            a, b = advance(a, k), advance(b, k)
            s = a[0] + a[1] + b[0] + b[1]
            a, b = (a[0] / s, a[1] / s), (b[0] / s, b[1] / s)
        start0, start1 = np.empty(emit.shape[1]), np.empty(emit.shape[1])
        x0, x1 = 0.5, 0.5
        for lane in range(emit.shape[1]):
            start0[lane], start1[lane] = x0, x1
            x0, x1 = x0 * a[0][lane] + x1 * b[0][lane], x0 * a[1][lane] + x1 * b[1][lane]
            s = x0 + x1
            x0, x1 = x0 / s, x1 / s
        x = start0, start1
        out0, out1 = np.empty_like(emit), np.empty_like(emit)
        for k in order:
            x = advance(x, k)
            s = x[0] + x[1]
            x = x[0] / s, x[1] / s
            out0[k], out1[k] = x
        return out0, out1

    f0, f1 = through(e, new, range(long))
    # backward: the same recursion over the mirrored tokens, with transposed steps; a token after which a document starts is a first one there
    last = np.ones_like(new)
    flat_new = new.T.reshape(-1)
    flat_last = np.concatenate([flat_new[1:], [True]])
    last = flat_last[::-1].reshape(wide, long).T
    mirrored = e.T.reshape(-1)[::-1].reshape(wide, long).T
    forward, t = t, t.T.copy()
    b0, b1 = through(mirrored, last, range(long))
    f0, f1 = f0.T.reshape(-1), f1.T.reshape(-1)
    b0, b1 = b0.T.reshape(-1)[::-1], b1.T.reshape(-1)[::-1]
    own = e.T.reshape(-1)
    p1, p0 = f1 * b1 / own, f0 * b0  # both messages hold the token's own weight once
    pair = np.stack([x[: n - 1] * forward[i, j] * y[1:n] for i, x in enumerate((f0, f1)) for j, y in enumerate((b0, b1))])
    return (p1 / (p0 + p1))[:n], pair / pair.sum(0)


class Tagger:
    """Marginals and document features of many texts at once."""

    def __init__(self, model: Field):
        self.model, self.own = model, Emissions(model)

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        lengths = np.array([len(t) for t in texts])
        flat = [w for t in texts for w in t]
        n = len(flat)
        e = np.fromiter(map(self.own.__getitem__, flat), float, n)
        starts = np.zeros(n, bool)
        ends = np.cumsum(lengths)
        starts[(ends - lengths)[lengths > 0]] = True
        for table, by in ((self.model.before, 1), (self.model.after, -1)):
            if table:
                near = np.fromiter((table.get(w, 0.0) for w in flat), float, n)
                near = np.roll(near, by)
                edge = starts if by == 1 else np.roll(starts, -1)
                near[edge] = 0
                e += near
        return np.split(forward_backward(e, starts, self.model.step)[0], ends[:-1])

    def score(self, marginals: np.ndarray) -> float:
        a, b, c = self.model.link
        total, most = telling(marginals)
        x = a + b * total + c * most
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def telling(marginals: np.ndarray) -> tuple[float, float]:
    """A document's features; marginals under a tenth are background, of which long texts have more."""
    return (float(np.log1p(marginals[marginals > 0.1].sum())), float(marginals.max())) if len(marginals) else (0.0, 0.0)


@dataclass
class Labelled:
    """Tokenised documents as numbers of distinct tokens, which takes a tenth of the memory of strings."""

    number: dict[str, int] = field(default_factory=dict)
    texts: list[np.ndarray] = field(default_factory=list)
    toxic: list[float] = field(default_factory=list)

    def add(self, words: list[str], toxic: float) -> None:
        self.texts.append(np.fromiter((self.number.setdefault(w, len(self.number)) for w in words), np.int32, len(words)))
        self.toxic.append(float(toxic))


def mark_tokens(forms: list[str], texts: list[np.ndarray], toxic: np.ndarray, least_docs: int = 3) -> np.ndarray:
    """Which token forms are marked: those, or those whose beginning of 4 or 5 letters, stand in documents
    that are toxic far beyond chance: over nine tenths of them, with a log-likelihood ratio of more than the
    log of the number of forms tried (plus one). Of near copies (six of eight min-hashes of word pairs agree)
    one counts."""
    begins: dict[str, int] = {}
    starts = np.array([[begins.setdefault(f"{n}{w[:n]}", len(begins)) if len(w) > n else -1 for n in (4, 5)] for w in forms]).reshape(-1, 2) + len(forms)
    total, bad = (np.zeros(len(forms) + len(begins), np.int64) for _ in range(2))
    salt = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    met, n_met = np.zeros((len(texts), len(salt)), np.uint64), 0
    for words, y in zip(texts, toxic):
        pairs = np.unique(words[:-1].astype(np.uint64) << np.uint64(32) | words[1:].astype(np.uint64)) if len(words) > 1 else words.astype(np.uint64)
        with np.errstate(over="ignore"):
            least = np.array([mix(pairs ^ s).min() if len(pairs) else 0 for s in salt], np.uint64)
        if ((met[:n_met] == least).sum(1) >= 6).any():
            continue
        met[n_met], n_met = least, n_met + 1
        own = np.unique(words)
        more = np.unique(starts[own])
        seen = np.concatenate([own, more[more >= len(forms)]])
        total[seen] += 1
        if y:
            bad[seen] += 1
    share, n, k = toxic.mean(), np.maximum(total, 1), np.maximum(bad, 1)
    rest = np.maximum(n - k, 1e-9)
    ratio = k * np.log(k / n / share) + np.where(n > k, rest * np.log(rest / n / (1 - share)), 0.0)
    sure = np.log(max(1, int((total >= least_docs).sum()))) + 1
    good = np.append((bad >= least_docs) & (bad > 0.9 * total) & (ratio >= sure), False)
    starts[starts < len(forms)] = len(good) - 1
    return good[: len(forms)] | good[starts].any(1)


def fit(labelled: Labelled, rounds: int = 40, least_seen: int = 3, run_tokens: int = 200_000) -> Field:
    """A field from tokenised documents and their labels."""
    texts, toxic, forms = labelled.texts, np.array(labelled.toxic), list(labelled.number)
    if not len(forms) or toxic.all() or not toxic.any():
        return Field()
    flat = np.concatenate(texts)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    starts = np.zeros(len(flat), bool)
    starts[(ends - lengths)[lengths > 0]] = True
    y = (mark_tokens(forms, texts, toxic)[flat] & np.repeat(toxic > 0, lengths)).astype(float)
    # own features of each distinct token, as pairs of token and feature; neighbours' features are tokens
    often = np.bincount(flat, minlength=len(forms))
    seen: Counter = Counter()
    for w, k in zip(forms, often.tolist()):
        for x in ("=" + w, *parts(w)):
            seen[x] += k
    index: dict[str, int] = {}
    pairs = [(i, index.setdefault(x, len(index))) for i, w in enumerate(forms) for x in ("=" + w, *parts(w)) if seen[x] >= least_seen]
    token, feature = np.array(pairs, np.int64).reshape(-1, 2).T
    near = np.zeros(len(forms), bool)  # neighbours of marked tokens that are frequent enough to tell something
    at = np.flatnonzero(y)
    for by in (-1, 1):
        near[flat[np.clip(at + by, 0, len(flat) - 1)]] = True
    near &= often >= 10 * least_seen
    inside = ~starts[1:]
    sizes = len(index), len(forms), len(forms), 1, 4
    weights = [np.zeros(k) for k in sizes]
    weights[3][0] = -3.0
    gained = [np.full(k, 1e-2) for k in sizes]
    gold = np.zeros(4)
    np.add.at(gold, (2 * y[:-1] + y[1:])[inside].astype(int), 1)

    runs = np.unique(np.concatenate([[0], ends[np.searchsorted(ends, np.arange(run_tokens, len(flat), run_tokens))], [len(flat)]]))

    def tag() -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and the expected number of each pair of tags; a run of documents at a time."""
        own = np.bincount(token, weights[0][feature], len(forms)) + weights[3][0]
        p, joint = np.empty(len(flat)), np.zeros(4)
        for a, b in zip(runs, runs[1:]):
            words, within = flat[a:b], inside[a : b - 1]
            e = own[words]
            e[1:] += np.where(within, weights[1][words[:-1]], 0)
            e[:-1] += np.where(within, weights[2][words[1:]], 0)
            p[a:b], pair = forward_backward(e, starts[a:b], weights[4].reshape(2, 2))
            joint += pair[:, within].sum(1)
        return p, joint

    for _ in range(rounds):
        p, joint = tag()
        d = y - p
        gradients = [
            np.bincount(feature, np.bincount(flat, d, len(forms))[token], len(index)) - 0.02 * weights[0],
            np.bincount(flat[:-1], np.where(inside, d[1:], 0), len(forms)) * near - 0.02 * weights[1],
            np.bincount(flat[1:], np.where(inside, d[:-1], 0), len(forms)) * near - 0.02 * weights[2],
            np.array([d.sum()]),
            gold - joint,
        ]
        for w, g, gradient in zip(weights, gained, gradients):
            g += gradient**2
            w += 0.5 * gradient / np.sqrt(g)
    names = list(index)
    model = Field(
        word={names[k][1:]: float(v) for k, v in enumerate(weights[0]) if abs(v) > 1e-3 and names[k][0] == "="},
        part={names[k]: float(v) for k, v in enumerate(weights[0]) if abs(v) > 1e-3 and names[k][0] != "="},
        before={forms[k]: float(weights[1][k]) for k in np.flatnonzero(np.abs(weights[1]) > 1e-3)},
        after={forms[k]: float(weights[2][k]) for k in np.flatnonzero(np.abs(weights[2]) > 1e-3)},
        bias=float(weights[3][0]),
        step=weights[4].reshape(2, 2).copy(),
    )
    x = np.array([(1.0, *telling(m)) for m in np.split(tag()[0], ends[:-1])])
    w = np.zeros(3)
    for _ in range(60):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (toxic - p) - 0.5 * w)
    model.link = tuple(map(float, w))
    return model


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def train(docs: DataFrame, labels: DataFrame, usable: Column, most_labelled: int = 4000) -> Field:
    """A field from labelled rows of docs where `usable` holds: at most `most_labelled`, those with
    the least hash of doc_id. That bound is what keeps the fitting on one machine."""
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).where("labelled IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(usable).distinct()
    chosen = ids.join(known, F.col("doc_id") == F.col("labelled")).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    chosen = {r[0]: r[1] for r in chosen.toLocalIterator()}
    if not chosen:
        return Field()
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = docs.sparkSession.createDataFrame([(k,) for k in chosen], "chosen long")
    rows = picked.join(F.broadcast(sample), F.col("doc_id") == F.col("chosen")).groupBy("doc_id").agg(F.min("text").alias("text"))
    labelled = Labelled()
    for r in rows.orderBy("doc_id").toLocalIterator():
        labelled.add(tokens(r[1]), chosen[r[0]])
    return fit(labelled)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def score_columns(docs: DataFrame, model: Field, run_chars: int = 1_500_000) -> DataFrame:
    """docs, which have a string column text, with two more columns: score and spans."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def spans_of(text: str, m: np.ndarray) -> list[dict]:
        if not len(m) or m.max() <= 0.5:
            return []
        low, hot = text.lower(), m > 0.5
        where = [x.span() for x in TOKEN.finditer(low)] if len(low) == len(text) else place(text)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hot.astype(np.int8), [0]])))
        return [{"start": where[a][0], "end": where[b - 1][1], "marginal": float(m[a:b].max())} for a, b in zip(edge[::2], edge[1::2])]

    def run(batches):
        tagger = Tagger(sent.value)
        for batch in batches:
            size = np.cumsum([len(t.as_py() or "") for t in batch.column(at)]) // run_chars
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(at).to_pylist()]
                found = tagger.marginals([tokens(t) for t in texts])
                more = pa.array([tagger.score(m) for m in found], pa.float64()), pa.array([spans_of(t, m) for t, m in zip(texts, found)], SPANS)
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "score", "spans"])

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("score double, spans array<struct<start: long, end: long, marginal: double>>").fields])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score, spans: one row per row of docs."""
    return score_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model).drop("text")


def place(text: str) -> list[tuple[int, int]]:
    """Token offsets in a text whose lower case has another length."""
    at, back = [], []
    for i, c in enumerate(text):
        low = c.lower()
        at.append(low)
        back += [i] * len(low)
    back.append(len(text))
    return [(back[a], back[b - 1] + 1) for a, b in (m.span() for m in TOKEN.finditer("".join(at)))]
