"""Array helpers for texts in Arrow batches: blocks of bounded size, words and shingles as hashes.

Words follow one rule: A-Z in lower case, then runs of bytes other than blank and 0x09-0x0D.
All steps work on whole blocks of UTF-8 bytes; nothing runs word by word in Python.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once. A longer text is a block of its own.
BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A looser rule for passages: punctuation of ASCII parts words too.
LOOSE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def per_process(key: str, build):
    """A value kept as long as the Python worker lives, such as a tokenizer.

    The package travels to the workers by value, so its own globals do not outlive a task.
    """
    kept = sys.modules.setdefault("_clausegrid_kept", types.ModuleType("_clausegrid_kept")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (first, past the last) of at most ``limit`` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each row the number of its first word (one more entry than rows)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~blank[raw]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    starts[heads] = solid[heads]
    where = np.flatnonzero(solid)
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.flatnonzero(starts[where])
    sizes = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, sizes)
    power = np.cumprod(np.full(int(sizes.max()), _STEP), dtype=np.uint64)
    letters = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)[_LOWER[raw[where]]]
    sums = np.add.reduceat(letters * power[place], first)
    return mix(sums + sizes.astype(np.uint64) * _GOLD), np.searchsorted(begin, offsets)


def joined(words: np.ndarray, count: int) -> np.ndarray:
    """Hash of each run of ``count`` words."""
    if len(words) < count:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - count + 1].copy()
    for k in range(1, count):
        out = out * _STEP + words[k : len(words) - count + 1 + k]
    return mix(out + np.uint64(count))


def shingles(raw: np.ndarray, offsets: np.ndarray, count: int = SHINGLE_WORDS):
    """For each row of a block its shingle hashes in text order; a short row is one shingle, an empty row has none."""
    words, first = word_hashes(raw, offsets)
    runs = joined(words, count)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= count:
            yield runs[a : b - count + 1]
        elif b > a:
            yield joined(words[a:b], int(b - a))
        else:
            yield runs[:0]


def shingle_sets(column: pa.Array, count: int = SHINGLE_WORDS):
    """Sorted distinct shingle hashes of every row of a column, row by row."""
    raw, offsets = text_buffers(column)
    for a, b in row_blocks(offsets):
        part = offsets[a : b + 1]
        for runs in shingles(raw[part[0] : part[-1]], part - part[0], count):
            yield np.unique(runs)
