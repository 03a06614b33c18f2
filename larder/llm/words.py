"""Words and 64-bit word hashes, on Arrow batches in Python workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

MASK = (1 << 64) - 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for words met lately; emptied when it grows past
    `limit` entries, so that a worker's memory does not grow with the vocabulary."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: bytes | None) -> list:
    """Maximal runs of bytes other than space, tab, \\n, \\v, \\f and \\r (bytes.split has just these)."""
    return text.split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """B^i and B^-i modulo 2^64 for an odd base B, grown on demand."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            step = np.full(size, self.BASE, np.uint64)
            back = np.full(size, self.INVERSE, np.uint64)
            step[0] = back[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


class WordScan:
    """64-bit hashes of all words of a text at once, without a Python object for each: a polynomial over
    a random number per byte, by prefix sums modulo 2^64. With `lower`, A-Z count as a-z."""

    PIECE = 1 << 16  # bytes that are looked at at once, and the rest of the last word

    def __init__(self, lower: bool = False):
        self.table = np.array([xxhash.xxh3_64_intdigest(bytes([b + 32 if lower and 65 <= b <= 90 else b])) for b in range(256)], np.uint64)
        self.space = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
        self.powers = Powers()

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the words in order."""
        hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(text):
            end = at + self.PIECE
            last = SPACE.search(text, end)
            piece = np.frombuffer(text, np.uint8, (last.start() if last else len(text)) - at, at)
            up, down = self.powers.get(len(piece) + 1)
            edge = np.flatnonzero(np.diff(np.concatenate([[True], self.space[piece], [True]])))
            first, after = edge[::2], edge[1::2]
            with np.errstate(over="ignore"):
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[piece] * up[:-1], dtype=np.uint64)])
                hashes.append(mix((prefix[after] - prefix[first]) * down[first] + (after - first).astype(np.uint64)))
            starts.append(first + at)
            at += len(piece)
            if last:
                at += 1
        return np.concatenate(hashes), np.concatenate(starts)


class RollingHash:
    """Hashes of word ranges: a polynomial over the word hashes, by prefix sums modulo 2^64."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(hashes) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        """The hash of every n consecutive words."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[n:] - self.prefix[:-n]) * self.down[: len(self.prefix) - n])


def grouped(batches, keys: int):
    """Consecutive rows with equal first `keys` columns, as lists of column lists, across batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) if i < keys else c for i, c in enumerate(batch.columns)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns[:keys]:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns[:keys])
            part = batch.slice(a, b - a)
            if held is not None and held[0] == key:
                held[1].append(part)
            else:
                if held is not None:
                    yield held
                held = (key, [part])
    if held is not None:
        yield held
