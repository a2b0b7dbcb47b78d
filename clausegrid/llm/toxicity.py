"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

One dictionary is trained on windows of ordinary texts, one on what only toxic texts repeat (words that recur in
toxic texts of the sample and never in its ordinary ones). A window is compressed with the ordinary dictionary
and with both in a row; bytes saved by the toxic part are evidence. The savings of all windows of a text give a
few figures, and a logistic curve fitted on rows that the dictionaries have not seen turns them into a score.
The curve is bent so that ``THRESHOLD`` is the cut that separates those rows best.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.arrays import per_process

#: Bound of the fit: about this many labelled rows of each class are drawn by hash, all if there are fewer.
FIT_ROWS = 3000
WINDOW_BYTES, OVERLAP = 96, 16
ORDINARY_BYTES, TOXIC_BYTES = 32768, 2048
THRESHOLD = 0.7
#: A word of the toxic sample must occur in so many of its texts.
RECURS = 3
FOLDS = 3
FIGURES = 12
#: Cuts whose predictions would be right less often than this are not taken; without any, hardly a row is predicted.
LEAST_PRECISION = 0.7
_WORDS = re.compile(r"\w+")
_PLAIN_HEAD = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"


def windows(text: str) -> list[bytes]:
    raw = text.lower().encode()
    return [raw[i : i + WINDOW_BYTES + OVERLAP] for i in range(0, max(1, len(raw) - OVERLAP), WINDOW_BYTES)] if raw else []


def train(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; with too few samples the samples themselves, the last ``size`` bytes."""
    samples = [s for s in samples if s]
    try:
        whole = zstd.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        at = whole.find(_PLAIN_HEAD)
        return whole[at + len(_PLAIN_HEAD) :] if at >= 0 else whole
    except zstd.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes) -> zstd.ZstdCompressor:
    settings = zstd.ZstdCompressionParameters(
        window_log=17, chain_log=15, hash_log=15, search_log=3, min_match=4, target_length=16, strategy=zstd.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    if len(content) < 8:
        return zstd.ZstdCompressor(compression_params=settings)
    known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=settings)
    return zstd.ZstdCompressor(compression_params=settings, dict_data=known)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    cut: float
    low: list[float]  # the range of each figure in the fit; figures beyond it count as its ends
    high: list[float]

    def measure(self, text: str, pair) -> np.ndarray:
        """Figures of one text from the bytes saved in each window."""
        plain, both = pair
        saved = np.array([len(plain(w)) - len(both(w)) for w in windows(text)] or [0], np.float64)
        top = np.sort(saved)[::-1]
        out = [1.0, top[0], top[:3].sum() / 3, top[:6].sum() / 6, 8 * saved.mean()]
        for least in (1, 3, 5):
            gain = np.maximum(saved - least, 0).sum()
            out += [8 * gain / len(saved), np.log1p(gain)]
        return np.array([*out, out[6] * np.log1p(len(saved))])  # length counts only together with evidence

    def pair(self):
        return compressor(self.ordinary).compress, compressor(self.toxic + self.ordinary).compress

    def score(self, figures: np.ndarray) -> float:
        p = 1 / (1 + np.exp(-np.clip(np.clip(figures, self.low, self.high) @ np.array(self.weights), -30, 30)))
        return float(THRESHOLD * p / self.cut if p < self.cut else THRESHOLD + (1 - THRESHOLD) * (p - self.cut) / (1 - self.cut))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge / 100] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w


def repeated_words(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """Words that recur in toxic texts and never stand in ordinary ones, with the number of toxic texts.
    A text that has half of its candidates from one earlier text is a copy and does not count again."""
    usual: set[str] = set()
    for t in ordinary:
        usual.update(_WORDS.findall(t.lower()))
    times, owner = Counter(), {}
    for k, t in enumerate(toxic):
        own = set(_WORDS.findall(t.lower())) - usual
        known = Counter(owner[w] for w in own if w in owner)
        if known and len(own) > 8 and max(known.values()) > len(own) / 2:
            continue
        times.update(own)
        for w in own:
            owner.setdefault(w, k)
    return {w: n for w, n in times.items() if n >= RECURS}


def dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    often = repeated_words(toxic, ordinary)
    only = [[w for w in _WORDS.findall(t.lower()) if w in often] for t in toxic]
    if sum(len(w.encode()) + 1 for w in often) <= TOXIC_BYTES:
        special = " ".join(sorted(often, key=lambda w: (often[w], w))).encode()
    else:
        special = train([" ".join(ws[k : k + 8]).encode() for ws in only for k in range(0, len(ws), 8)], TOXIC_BYTES, 16)
    return train([w for t in ordinary for w in windows(t)], ORDINARY_BYTES, 48), special


def fit(rows: list[tuple[str, int]], ordinary_weight: float = 1.0) -> Model:
    """A model from (text, label) rows, in an order that does not depend on the labels.

    Three times the dictionaries of two thirds measure the other third; the curve and the cut are fitted on
    these figures, and the dictionaries that stay see all rows. ``ordinary_weight`` says how many times an
    ordinary row of the sample counts against a toxic one when the cut is chosen (the sample is balanced, the
    corpus is not). Without enough rows of both classes every score is 0.
    """
    rows = list({t: y for t, y in rows if t}.items())
    y = np.array([float(v) for _, v in rows])
    if min((y == 1).sum(), (y == 0).sum()) < FOLDS:
        return Model(b"", b"", [-30.0] + [0.0] * (FIGURES - 1), 0.5, [1.0] + [0.0] * (FIGURES - 1), [1.0] * FIGURES)
    fold = np.empty(len(rows), int)
    for v in (0, 1):
        fold[y == v] = np.arange((y == v).sum()) % FOLDS
    x = np.empty((len(rows), FIGURES))
    for f in range(FOLDS):
        part = Model(*dictionaries([r for r, g in zip(rows, fold) if g != f]), [], 0.5, [], [])
        pair = part.pair()
        for k in np.flatnonzero(fold == f):
            x[k] = part.measure(rows[k][0], pair)
    weights = _logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    order = np.argsort(-p, kind="stable")
    hits, false = np.cumsum(y[order]), np.cumsum(1 - y[order]) * ordinary_weight
    quality = 2 * hits / (hits + false + y.sum())
    quality[hits < LEAST_PRECISION * (hits + false)] = 0
    k = int(quality.argmax())
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    cut = (p[order[k]] + below) / 2 if quality[k] else (1 + p.max()) / 2
    cut = float(np.clip(cut, 1e-3, 1 - 1e-6))
    return Model(*dictionaries(rows), weights.tolist(), cut, x.min(axis=0).tolist(), x.max(axis=0).tolist())


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the key as text, mod 3, is 1. False for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def draw(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[list[tuple[str, int]], float]:
    """A bounded sample of labelled texts outside the held-out rows, and how many ordinary rows of the corpus one
    of the sample stands for against a toxic one. The ids of the sample, at most about 2 * fit_rows, are
    broadcast to the one scan that fetches their texts."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(key, F.col(label).cast("int").alias("_y")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    share = F.create_map(*(F.lit(v) for y in (0, 1) for v in (y, min(1.0, fit_rows / max(1, counts.get(y, 0))))))
    place = F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1 << 20))
    chosen = known.filter(place < share[F.col("_y")] * (1 << 20))
    names = chosen.collect()
    few = docs.sparkSession.createDataFrame([tuple(r) for r in names], chosen.schema)
    got = docs.select(key, text).join(F.broadcast(few), key).select(F.xxhash64(key, F.lit("order")).alias("o"), text, "_y").collect()
    rows = [(r[1], r[2]) for r in sorted(got, key=lambda r: (r[0], r[1] or "", r[2])) if r[1]]
    drawn = Counter(y for _, y in rows)
    return rows, (counts.get(0, 0) / max(1, drawn[0])) / max(1e-9, counts.get(1, 0) / max(1, drawn[1]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on). Null and empty texts score as a
    text without evidence; input columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    place = docs.columns.index(text)
    schema = docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        own = Model(**sent.value)
        pair = per_process(f"toxicity:{hash((own.ordinary, own.toxic))}", own.pair)
        for batch in batches:
            scores = []
            for t in batch.column(place):
                scores.append(own.score(own.measure(t.as_py() or "", pair)))
            marks = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(marks, pa.int32())], [f.name for f in schema])

    return docs.mapInArrow(run, schema)
