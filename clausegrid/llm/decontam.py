"""Benchmark passages in documents: SimHash over item-sized windows, Hamming blocks, then the exact similarity.

Every run of an item's number of words is a window. Its fingerprint is the sign, bit by bit, of the summed
shingle hashes, taken from running sums, and is looked up in a multi-index: 64 bits in eight blocks, each
block with the items that differ from it in two bits at most. Two fingerprints that differ in 23 bits or
fewer differ in two or fewer in some block, so the lookup finds all of them. Pairs within the radius are then
compared by weighted shingles: sum of the smaller counts over the sum of the larger ones.

A window without any shingle of any item has similarity zero and is passed over before it is hashed.
Items go to the workers in groups of bounded size, one group after the other.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.arrays import LOOSE, SHINGLE_WORDS, joined, row_blocks, text_buffers, word_hashes

RADIUS, BLOCKS, FLIPS = 23, 8, 2
#: UTF-8 bytes of item texts that are broadcast at once.
GROUP_BYTES = 8 << 20
_BITS = np.arange(64, dtype=np.uint64)
_VALUES = np.arange(256, dtype=np.uint8)
#: Windows whose running sums are held at once.
WINDOW_ROWS = 1 << 14


def _runs(words: np.ndarray, size: int, count: int) -> np.ndarray:
    """Shingles of ``count`` words; of ``size`` words if the item is shorter than that."""
    return joined(words, min(size, count))


def _signs(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int16) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


class ItemIndex:
    """The items of one group by their number of words, with the block tables of each size."""

    def __init__(self, items: list[tuple], count: int = SHINGLE_WORDS):
        self.count, self.sizes = count, {}
        column = pa.array([t for _, t in items], pa.string())
        raw, offsets = text_buffers(column)
        words, first = word_hashes(raw, offsets, LOOSE)
        by_size: dict[int, list] = {}
        for k, (name, _) in enumerate(items):
            own = words[first[k] : first[k + 1]]
            if len(own):
                by_size.setdefault(len(own), []).append((name, Counter(_runs(own, len(own), count).tolist())))
        for size, group in by_size.items():
            prints = np.concatenate([_fingerprints(_signs(np.array(list(c.elements()), np.uint64)).sum(axis=0, dtype=np.int32)[None]) for _, c in group])
            blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
            tables = [np.bitwise_count(_VALUES[:, None] ^ blocks[:, b]) <= FLIPS for b in range(BLOCKS)]
            self.sizes[size] = (group, prints, tables)
        self.known = {}
        for size, (group, _, _) in self.sizes.items():
            self.known.setdefault(min(size, count), set()).update(h for _, c in group for h in c)
        self.known = {k: np.sort(np.array(list(v), np.uint64)) for k, v in self.known.items()}

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item of that size) within the radius."""
        _, own, tables = self.sizes[size]
        parts = prints.view(np.uint8).reshape(-1, BLOCKS)
        maybe = tables[0][parts[:, 0]]
        for b in range(1, BLOCKS):
            maybe = maybe | tables[b][parts[:, b]]
        w, i = np.nonzero(maybe)
        close = np.bitwise_count(prints[w] ^ own[i]) <= RADIUS
        return w[close], i[close]



def _weighted(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def _marked(runs: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
    return known[at] == runs


def matches(words: np.ndarray, index: ItemIndex, least: float, seen: dict) -> dict:
    """Best similarity of each item that some window of the text reaches ``least`` with."""
    best: dict = {}
    for length, known in index.known.items():
        runs = joined(words, min(length, len(words))) if len(words) else words
        if not len(runs):
            continue
        marks = np.flatnonzero(_marked(runs, known))
        if not len(marks):
            continue
        sizes = [s for s in index.sizes if min(s, index.count) == length]
        reach = max(sizes) - length + 1
        cut = np.flatnonzero(np.diff(marks) > reach)
        for a, b in zip(np.append(0, cut + 1), np.append(cut, len(marks) - 1)):
            first, last = max(0, marks[a] - reach + 1), min(len(runs), marks[b] + reach)
            part = runs[first:last]
            name = (length, part.tobytes())
            if name not in seen:
                if len(seen) > 4096:
                    seen.clear()
                seen[name] = _region(part, sizes, length, index, least)
            for item, value in seen[name].items():
                best[item] = max(value, best.get(item, 0.0))
    return best


def _region(runs: np.ndarray, sizes: list[int], length: int, index: ItemIndex, least: float) -> dict:
    """All windows of all item sizes over a stretch of shingles; a stretch shorter than an item is one window."""
    found: dict = {}
    widest = max(sizes) - length + 1
    for at in range(0, len(runs), WINDOW_ROWS):
        part = runs[at : at + WINDOW_ROWS + widest]
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(_signs(part), axis=0, dtype=np.int32, out=sums[1:])
        for size in sizes:
            wide = min(size - length + 1, len(part))
            windows, items = index.near(size, _fingerprints(sums[wide:] - sums[:-wide]))
            for w, i in zip(windows.tolist(), items.tolist()):
                item, own = index.sizes[size][0][i]
                value = _weighted(own, Counter(part[w : w + wide].tolist()))
                if value >= least:
                    found[item] = max(value, found.get(item, 0.0))
    return found


def _groups(items: DataFrame, item: str, text: str):
    """The items in groups of bounded size, drawn by hash; each group is read when its turn comes."""
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * size / GROUP_BYTES))
    for k in range(parts if size else 0):
        mine = rows.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) if parts > 1 else rows
        yield [tuple(r) for r in mine.collect()]


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of docs with ``item_ids`` (sorted, no repeats), ``likeness`` (the best; 0 without any) and ``contaminated``.

    A word is a run of letters, digits and non-ASCII bytes in lower case; items shorter than five words are one
    shingle. Null or empty texts and items match nothing; an item whose id repeats matches by any of its texts.
    Input columns of these names are replaced.
    """
    docs = docs.drop("item_ids", "likeness", "contaminated")
    kind = items.schema[item].dataType.simpleString()
    out = docs.withColumn("item_ids", F.expr(f"cast(array() as array<{kind}>)")).withColumn("likeness", F.lit(0.0))
    names = [f.name for f in out.schema]
    place = docs.columns.index(text)

    def search(index):
        def run(batches):
            seen: dict = {}
            here = ItemIndex.__new__(ItemIndex)
            vars(here).update(index.value)
            for batch in batches:
                raw, offsets = text_buffers(batch.column(place))
                for a, b in row_blocks(offsets):
                    part = offsets[a : b + 1]
                    words, first = word_hashes(raw[part[0] : part[-1]], part - part[0], LOOSE)
                    hits = [matches(words[x:y], here, least, seen) for x, y in zip(first[:-1], first[1:])]
                    rows = batch.slice(a, b - a)
                    had, top = rows.column(len(names) - 2).to_pylist(), rows.column(len(names) - 1).to_pylist()
                    ids = [sorted({*x, *h}) for x, h in zip(had, hits)]
                    top = [max([x, *h.values()]) for x, h in zip(top, hits)]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-2], pa.array(ids, rows.schema.field(len(names) - 2).type), pa.array(top, pa.float64())], names)

        return run

    for group in _groups(items, item, item_text):
        index = docs.sparkSession.sparkContext.broadcast(vars(ItemIndex(group)))
        out = out.mapInArrow(search(index), out.schema)
    return out.withColumn("contaminated", F.size("item_ids") > 0)
