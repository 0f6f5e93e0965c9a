"""Words and shingles of whole Arrow batches as 64-bit hashes, in numpy.

A word is a run of ASCII digits and letters and of all bytes over 0x7F; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(col: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of consecutive rows; a longer text is a chunk of its own."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the index of the first word of each row (with an end)."""
    inside = _IS_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(begin, lens)
    values = _LOWER[data[np.repeat(starts, lens) + place]] * _powers(int(lens.max()))[place]
    return mix(np.add.reduceat(values, begin) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of each word; 0 for shorter words."""
    full = ends - starts > size
    out = np.zeros(len(starts), np.uint64)
    at = starts[full]
    total = np.zeros(len(at), np.uint64)
    for k, p in enumerate(_powers(size)):
        total += _LOWER[data[at + k]] * p
    out[full] = mix(total + np.uint64(size * 0xA0761D6478BD642F % (1 << 64)))
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct sorted shingles of one text: ``size`` consecutive words; of fewer, but not none, all words are one."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k, p in enumerate(_powers(size + 1)[1:]):
        total += words[k : k + n] * (p + np.uint64(2 * k))
    return np.unique(mix(total))


def rows_of_words(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its word hashes) for each row of an Arrow string array."""
    for i, _, data, offsets in chunks(col):
        starts, ends, at = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        for k in range(len(offsets) - 1):
            yield i + k, hashes[at[k] : at[k + 1]]
