"""Byte-level BPE with chunks that documents share encoded once.

A rolling hash over the bytes cuts texts where the content says so, so equal passages give equal chunks
wherever they stand. Documents are brought together by their smallest chunk hash; each task encodes a
distinct chunk once. Token runs across a cut may be wrong, so every cut is repaired: a window around it is
encoded anew and must agree with the chunks' own tokens on a whole piece at both ends, else it grows.

Window ends lie where a printable ASCII character is followed by a blank or a line feed. The
pre-tokenizer never joins these two, so tokens left and right of such a place do not depend on each other.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.arrays import per_process, text_buffers

#: Fixed value: the splitting pattern of this family of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT_BITS = 11
WINDOW = 16
CACHE_BYTES = 48 << 20
BATCH_ROWS = 512


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable bytes are
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE only)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, split = spec["model"]["type"], spec.get("pre_tokenizer") or {}
        if kind != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: a byte-level BPE vocabulary without prefix blank or normalizer is needed")
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if all(c in letters for c in word)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {w: i for w, i in vocab.items() if i not in set(self.special.values())}
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=self.special)
        words = vocab | {w.encode(): i for w, i in self.special.items()}
        size = max(words.values()) + 1
        table = [b""] * size
        for w, i in words.items():
            table[i] = w
        self.length = np.array([len(w) for w in table], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids of a piece of text. Letters beyond U+023F go to the reference encoder, as the two
        libraries may know different Unicode versions; up to there their classes are the same."""
        text = raw.decode()
        if raw and max(raw) >= 0xC9:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        elif any(s in text for s in self.special):
            ids = self.fast.encode(text, allowed_special="all")
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        size = self.length[ids]
        shift = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        raw = self.flat[shift + np.arange(len(shift))].tobytes()
        return raw.decode("utf-8", "replace").encode()


def cuts(raw: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places where a hash of the 16 bytes in front is zero in its top bits, moved to the next character."""
    if len(raw) <= WINDOW:
        return np.zeros(0, np.int64)
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step, reach = 0x2545F4914F6CDD1D, 1
    while reach < WINDOW:
        h[reach:] = h[reach:] + h[:-reach] * np.uint64(step)
        step, reach = step * step % (1 << 64), reach * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    found = np.flatnonzero(h[WINDOW - 1 : -1] >> np.uint64(64 - bits) == 0) + WINDOW
    inside = (raw & 0xC0) == 0x80
    while len(found) and inside[found].any():
        found = np.unique(found + inside[found])
        found = found[found < len(raw)]
    return found


def free_places(raw: np.ndarray) -> np.ndarray:
    """Places no token can span: a blank or line feed after a printable ASCII character."""
    here = (raw[1:] == 0x20) | (raw[1:] == 0x0A)
    return np.flatnonzero(here & (raw[:-1] >= 0x21) & (raw[:-1] <= 0x7E)) + 1


def chunks(raw: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    at = cuts(raw)
    ends = np.concatenate(([0], at, [len(raw)]))
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])], at


def repair(codec: Codec, raw: np.ndarray, parts: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Ids of the whole text from the ids of its chunks."""
    if len(parts) == 1:
        return parts[0]
    places = free_places(raw)
    ids = np.concatenate(parts)
    starts = np.append(0, np.cumsum(codec.length[ids]))
    out, done, past = [], 0, 0  # tokens taken so far, and the byte they reach
    for cut in at:
        if cut < past:
            continue
        left = int(np.searchsorted(places, cut, "right")) - 1
        if left >= 0 and places[left] == cut:
            continue  # a clean cut
        right, reach = left + 1, 1
        while True:
            a = int(places[left - reach]) if left - reach >= 0 else 0
            b = int(places[right + reach]) if right + reach < len(places) else len(raw)
            a = max(a, past)
            new = codec.encode(raw[a:b].tobytes())
            i, j = int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b))
            if starts[i] == a and starts[j] == b and _agree(codec, new, ids[i:j], a, b, past, len(raw), places, left, right, at):
                break
            if a == past and b == len(raw):
                j = len(ids)
                i = min(i, j)
                break
            reach *= 2
        out += [ids[done:i], new]
        done, past = j, b
    out.append(ids[done:])
    return np.concatenate(out)


def _agree(codec, new, old, a, b, past, size, places, left, right, at) -> bool:
    """Do the new tokens repeat the old ones up to the place in front of the cut and from the place behind it?
    Where the window ends at another cut, or starts where the last one ended, there is nothing to compare."""
    head = int(places[left]) - a if left >= 0 else 0
    tail = b - int(places[right]) if right < len(places) else 0
    inner = at[(at > a) & (at < b)]
    if len(inner) > 1 and right < len(places) and inner[-1] >= places[right]:
        return b == size  # another cut lies in the tail: grow past it
    n, o = np.cumsum(codec.length[new]), np.cumsum(codec.length[old])
    if head > 0:
        x, y = int(np.searchsorted(n, head)), int(np.searchsorted(o, head))
        if n[x] != head or o[y] != head or not np.array_equal(new[: x + 1], old[: y + 1]):
            return False
    if tail > 0:
        x, y = int(np.searchsorted(n, b - a - tail)), int(np.searchsorted(o, b - a - tail))
        if n[x] != b - a - tail or o[y] != b - a - tail or not np.array_equal(new[x + 1 :], old[y + 1 :]):
            return False
    return True


class ChunkEncoder:
    """Encodes texts chunk by chunk; a distinct chunk is encoded once while it is kept."""

    def __init__(self, codec: Codec):
        self.codec, self.kept, self.size, self.encoded, self.reused = codec, {}, 0, 0, 0

    def chunk(self, raw: bytes) -> np.ndarray:
        ids = self.kept.get(raw)
        if ids is not None:
            self.reused += 1
            return ids
        ids = self.codec.encode(raw)
        self.encoded += 1
        if self.size + len(raw) > CACHE_BYTES:
            self.kept, self.size = {}, 0
        self.kept[raw] = ids
        self.size += 2 * len(raw)
        return ids

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(raw):
            return np.zeros(0, np.uint32)
        texts, at = chunks(raw)
        return repair(self.codec, raw, [self.chunk(t) for t in texts], at)


def with_route(df: DataFrame, text: str = "text", route: str = "route") -> DataFrame:
    """The smallest chunk hash of each text; texts that share most chunks mostly share it."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            keys = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                keys.append(min(xxhash.xxh64_intdigest(c) for c in chunks(raw[a:b])[0]) - (1 << 63))
            yield batch.append_column(route, pa.array(keys, pa.int64()))

    return df.mapInArrow(run, df.withColumn(route, F.lit(0).cast("long")).schema)


def _prepared(df: DataFrame, text: str, keep: list[str], gather: bool) -> tuple[DataFrame, str]:
    """Rows for ``_encoded``, and the schema of the ``keep`` columns."""
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    if gather:
        rows = with_route(rows, "_text", "_route").hint("rebalance", F.col("_route"))
    return rows, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)


def _encoded(batches, vocabulary: str, keep: list[str]):
    """Batches of the ``keep`` columns, n_tokens and ids from batches with _text."""
    encoder = ChunkEncoder(per_process(f"bpe:{vocabulary}", lambda: Codec(vocabulary)))
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(first, BATCH_ROWS)
            raw, offsets = text_buffers(part.column(part.schema.get_field_index("_text")))
            ids = [encoder(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [part.column(part.schema.get_field_index(c)) for c in keep]
            columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids"])


def _decoded(batches, vocabulary: str, ids: str, out: str):
    """The batches with the text of their packed ids."""
    codec = per_process(f"bpe:{vocabulary}", lambda: Codec(vocabulary))
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(first, BATCH_ROWS)
            packed = part.column(part.schema.get_field_index(ids)).to_pylist()
            texts = [codec.decode(np.frombuffer(x or b"", "<u4")).decode() for x in packed]
            yield part.append_column(out, pa.array(texts, pa.string()))


def encode(df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, gather: bool = True) -> DataFrame:
    """``keep`` columns (default: all but the text), then n_tokens, ids (packed little-endian unsigned 32-bit).

    Null and empty texts have no tokens. Input columns of these names are replaced.
    ``gather`` brings texts with shared chunks together first; Spark cuts large groups by size.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c.lower() not in ("n_tokens", "ids")]
    rows, schema = _prepared(df, text, keep, gather)
    return rows.mapInArrow(lambda batches: _encoded(batches, vocabulary, keep), f"{schema}n_tokens long, ids binary")


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null ids give an empty text."""
    df = df.drop(out)
    return df.mapInArrow(lambda batches: _decoded(batches, vocabulary, ids, out), df.withColumn(out, F.lit("")).schema)


def encode_decode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The round trip of each row: key, n_tokens, ids_sha256, decoded_sha256, ids.

    The steps of ``encode`` and ``decode`` follow each other in one Python worker, which holds the vocabulary once; a
    step of its own each takes two workers for each core.
    """
    rows, schema = _prepared(df, text, [key], gather=True)

    def run(batches):
        return _decoded(_encoded(batches, vocabulary, [key]), vocabulary, "ids", "decoded")

    back = rows.mapInArrow(run, f"{schema}n_tokens long, ids binary, decoded string")
    return back.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")
