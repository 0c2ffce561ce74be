"""Vectorised views of a column of texts: UTF-8 bytes, words, word shingles and substring hashes.

All work on slices of an Arrow batch that hold a bounded number of bytes (or one text, if that alone
is longer), so the memory of a task follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
SLICE_BYTES = 1 << 19
#: Bytes that end a word: ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """The top 53 bits as a number in [0, 1)."""
    return (x >> U(11)).astype(np.float64) * 2.0 ** -53


def _power(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES + 1024), _BASE if kind == "up" else _INV, dtype=U)
        step[0] = 1
        have = _POWERS[kind] = np.cumprod(step, dtype=U)
    return have


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of runs of rows; a null counts as an empty text."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, what = column.buffers()
    if len(column) == 0:
        return
    offsets = np.frombuffer(where, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, offsets[a:b + 1] - offsets[a], data[offsets[a]:offsets[b]]
        a = b


class Substrings:
    """Hashes of any substring of a byte buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        self.inverse = _power("down", len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * _power("up", len(data) + 1)[:len(data)], dtype=U, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, hash of each word), words in order."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, Substrings(data)(starts, ends)


def shingles(text: np.ndarray, word: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text of fewer words has one shingle of all."""
    if not len(word):
        return text, word
    counts = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    h = np.zeros(len(word), dtype=U)
    padded = np.concatenate([word, np.zeros(size, dtype=U)])
    left = np.repeat(first + counts, counts) - np.arange(len(word))  # words from here to the end of the text
    for j in range(size):
        h = h * U(0x2545F4914F6CDD1D) + np.where(left > j, padded[j:j + len(word)], U(j + 1))
    keep = left >= size
    keep[first[(counts > 0) & (counts < size)]] = True
    return text[keep], mix(h[keep])
