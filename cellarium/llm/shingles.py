"""Words, shingles and their hashes, for whole Arrow batches of texts at once.

A word is a run of bytes other than space and 0x09 to 0x0D; A to Z count as a to z. Hashes are polynomials modulo 2**64
over the bytes, taken from prefix sums, then mixed, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes handled at once; a longer text is handled alone.
BLOCK = 1_000_000
#: Position powers are needed up to the longest stretch handled at once; they restart for each block.
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1 << 20).bit_length()
    if size not in _powers:
        _powers.clear()
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """first row, bytes and row offsets of stretches of about `size` bytes; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the place of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    space = IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edge = rows[(rows > 0) & (rows < len(data))]  # a word ends with its row
    begins[edge] = ~space[edge]
    start = np.flatnonzero(begins)
    stops = ~space
    stops[:-1] &= space[1:]
    stops[edge - 1] = ~space[edge - 1]
    end = np.flatnonzero(stops) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(start, rows)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row (a shorter row: one run of all it has), and each row's first."""
    counts = np.diff(rows)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(counts)), n)
    at = rows[row] + np.arange(first[-1]) - first[row]
    length = np.minimum(counts[row], size)
    out = length.astype(np.uint64)
    for k in range(size):
        use = k < length
        word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, np.uint64)
        out = np.where(use, (out ^ word) * BASE + (out >> np.uint64(29)), out)
    return mix(out), first


def multisets(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, value and number of times of the distinct values of each row, ordered by row and value."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return row[at], values[at], np.diff(np.append(at, len(row)))
