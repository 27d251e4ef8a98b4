"""Skip-and-fold: words of many texts at once, without making any string.

A text is read as a stream of code points through one lookup table that gives
0 for a character to skip and the lower-cased letter or digit otherwise. Runs
of non-zero entries are words; a rolling polynomial hash over each run stands
for the word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from idforge.llm.words import WORD

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower-casing depends on the context for the sigma and gives two characters for the dotted I.
_IN_CONTEXT = ("İ", "Σ")


@functools.cache
def fold_table() -> np.ndarray:
    """For each code point its folded letter or digit, 0 for all others."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and c != 0x130], np.uint32)
    low = points.tobytes().decode("utf-32-le").lower()
    folded = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    kept = np.zeros(len(points), bool)
    for m in WORD.finditer(low):
        kept[m.start() : m.end()] = True
    table = np.zeros(0x110000, np.uint32)
    table[points[kept]] = folded[kept]
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a list of texts in order; ``row`` numbers the texts from 0."""

    codes: np.ndarray  # folded characters of all words, one after the other
    start: np.ndarray  # where each word begins in codes
    size: np.ndarray  # characters of each word
    row: np.ndarray  # text of each word
    rows: int

    def hashes(self, base: np.uint64 = _BASE) -> np.ndarray:
        """Polynomial hash of each word, scrambled."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.codes)) - np.repeat(self.start, self.size)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(int(self.size.max()) + 1, base, np.uint64))
            return mix(np.add.reduceat(self.codes.astype(np.uint64) * power[at], self.start) ^ self.size.astype(np.uint64))

    def per_row(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.row, minlength=self.rows)


def split_words(texts: list[str | None]) -> Words:
    """Words of all texts; null and wordless texts have none."""
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    if any(c in joined for c in _IN_CONTEXT):
        texts = [t.lower() for t in texts]
        joined = "\n".join(texts)
    codes = fold_table()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    kept = codes > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    size = end - begin
    return Words(codes[kept], np.cumsum(size) - size, size, np.searchsorted(ends, begin, "right"), len(texts))


def runs_of(rows: np.ndarray, values: np.ndarray, width: int, salts: tuple[int, ...] = (0x8F1B, 0x7F4A7C15, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` consecutive values within a row, and its row."""
    n = len(values) - width + 1
    if n <= 0:
        return rows[:0], values[:0]
    whole = np.flatnonzero(rows[:n] == rows[width - 1 :])
    out = np.zeros(len(whole), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[whole + k] + np.uint64(salts[k % len(salts)]))
    return rows[whole], out


def distinct_in_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def sum_by_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by row (wrapping), rows sorted; 0 for rows without a value."""
    out = np.zeros(n, np.uint64)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        with np.errstate(over="ignore"):
            out[rows[first]] = np.add.reduceat(values, first)
    return out


def in_parts(texts: list[str | None], most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts with about ``most`` characters each, so that arrays stay small."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
