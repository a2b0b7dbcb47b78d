"""Language of words in code-switched text: a linear-chain conditional random field over words.

Features of a word are its letter runs of one to four (with marks for its start and end, so affixes are among
them) and its place in a lexicon of words that recur in the training texts. Transitions between the languages
of neighbouring words are learned on sequences glued from short spans of different texts. Forward-backward
gives every word its language distribution; a document has the language with the largest mean.

Everything runs on arrays: a block of texts is one array of code points. Forward-backward cuts each text into
pieces, multiplies the step matrices of all pieces at once, carries the products along, and fills the pieces
in, which is the same sum in another order and keeps very long texts from being a long loop.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.arrays import mix, per_process

#: Bound of the fit: about this many rows of each language are drawn by hash, all if there are fewer.
FIT_ROWS = 250
BLOCK_CHARS = 1 << 19
ORDERS, TABLE_BITS, LEXICON_BITS = 4, 15, 16
PIECE = 64
EPOCHS, BATCH, RATE = 4, 128, 0.15
_START, _END = 1, 2
UNKNOWN = "und"


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 2^17: is it a letter, and its lower case."""
    size = 1 << 17
    text = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(size)]
    letter = np.array([c.isalpha() for c in text])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text], np.uint32)
    return letter, lower


@dataclass
class Words:
    """Words of a block: their letters with marks around each word, and the text they belong to."""

    codes: np.ndarray  # letters of all words, each word between two marks
    first: np.ndarray  # place of each word's start mark; one more entry than words
    owner: np.ndarray  # number of the text
    begin: np.ndarray  # code point where the word begins in its text
    size: np.ndarray  # letters


def find_words(texts: list[str]) -> Words:
    letter, lower = per_process("letters", letter_tables)
    flat = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    top = np.minimum(flat, len(letter) - 1)
    solid = np.where(flat < len(letter), letter[top], flat < 0xE0000) if len(flat) else np.zeros(0, bool)
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = stop - begin
    starts = np.cumsum(lengths) - lengths
    owner = np.searchsorted(starts, begin, "right") - 1
    first = np.concatenate(([0], np.cumsum(size + 2)))
    codes = np.empty(first[-1], np.uint32)
    codes[first[:-1]], codes[first[1:] - 1] = _START, _END
    inside = np.ones(len(codes), bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    codes[inside] = np.where(flat < len(lower), lower[top], flat)[solid]
    return Words(codes, first, owner, begin - starts[owner], size)


def run_ids(words: Words) -> list[np.ndarray]:
    """For each order and each place the table slot of the letter run that starts there; slot 0 for none."""
    ids, ended = [], np.zeros(len(words.codes), bool)
    h = np.zeros(len(words.codes), np.uint64)
    for n in range(ORDERS):
        shifted = np.zeros(len(words.codes), np.uint32)
        shifted[: len(shifted) - n or None] = words.codes[n:]
        h = (h + shifted + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        slot = (h >> np.uint64(20)).astype(np.int64) % ((1 << TABLE_BITS) - 1) + 1
        slot[ended | (shifted == 0) | ((words.codes <= _END) & (n == 0))] = 0
        ids.append(slot)
        ended |= shifted == _END
    return ids


def word_names(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(words.size):
        return np.zeros(0, np.uint64)
    place = np.arange(len(words.codes)) - np.repeat(words.first[:-1], words.size + 2)
    power = np.cumprod(np.full(int(words.size.max()) + 2, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
    return mix(np.add.reduceat(mix(words.codes.astype(np.uint64)) * power[place], words.first[:-1]))


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    lexicon: np.ndarray | None = None  # word hash in each slot
    lexicon_weights: np.ndarray | None = None
    moves: np.ndarray | None = None

    def lexicon_slots(self, names: np.ndarray) -> np.ndarray:
        slot = (names >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        return np.where(self.lexicon[slot] == names, slot, 1 << LEXICON_BITS)

    def potentials(self, ids: list[np.ndarray], first: np.ndarray, lexical: np.ndarray) -> np.ndarray:
        total = self.tables[0][ids[0]]
        for table, slot in zip(self.tables[1:], ids[1:]):
            total = total + table[slot]
        return np.add.reduceat(total, first[:-1], axis=0) + self.lexicon_weights[lexical]


def _scaled(potentials: np.ndarray) -> np.ndarray:
    return np.maximum(np.exp((potentials - potentials.max(axis=-1, keepdims=True)).astype(np.float64)), 1e-30)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _filled(e: np.ndarray, live: np.ndarray, opening: np.ndarray, moves: np.ndarray, before: np.ndarray, behind: np.ndarray):
    """Forward and backward vectors inside pieces (pieces, steps, k), given what comes in from both sides.
    ``opening`` marks pieces that begin a text: their first step has no move in front."""
    pieces, steps, k = e.shape
    ahead, back = np.empty_like(e), np.empty_like(e)
    state = before
    for t in range(steps):
        moved = state @ moves
        if t == 0:
            moved = np.where(opening[:, None], state, moved)
        state = np.where(live[:, t, None], _unit(moved * e[:, t]), state)
        ahead[:, t] = state
    state = behind
    for t in range(steps - 1, -1, -1):
        back[:, t] = state
        moved = (state * e[:, t]) @ moves.T
        if t == 0:
            moved = np.where(opening[:, None], state * e[:, t], moved)
        state = np.where(live[:, t, None], _unit(moved), state)
    return ahead, back


def word_posteriors(potentials: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Language distribution of each word; ``owner`` (rising) parts the texts, which are independent."""
    n, k = potentials.shape
    if not n:
        return np.zeros((0, k))
    moves = np.exp(moves - moves.max())
    opens = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    sizes = np.diff(np.append(opens, n))
    count = -(-sizes // PIECE)
    piece_of = np.repeat(np.cumsum(count) - count, sizes) + (np.arange(n) - np.repeat(opens, sizes)) // PIECE
    step = (np.arange(n) - np.repeat(opens, sizes)) % PIECE
    pieces = int(count.sum())
    e, live = np.ones((pieces, PIECE, k)), np.zeros((pieces, PIECE), bool)
    e[piece_of, step], live[piece_of, step] = _scaled(potentials), True
    head = np.cumsum(count) - count
    opening = np.zeros(pieces, bool)
    opening[head] = True
    before = np.full((pieces, k), 1 / k)
    behind = np.full((pieces, k), 1 / k)
    if count.max() > 1:
        whole = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
        for t in range(PIECE):
            moved = (whole.reshape(-1, k) @ moves).reshape(pieces, k, k)
            if t == 0:
                moved[opening] = whole[opening]
            moved *= e[:, None, t]
            moved /= moved.sum(axis=(1, 2), keepdims=True)
            moved[~live[:, t]] = whole[~live[:, t]]
            whole = moved
        order = np.argsort(-count, kind="stable")
        head, left = head[order], count[order]
        for s in range(1, int(count.max())):
            at = head[left > s] + s
            before[at] = _unit(np.einsum("ni,nij->nj", before[at - 1], whole[at - 1]))
        tail = head + left - 1
        for s in range(1, int(count.max())):
            at = tail[left > s] - s
            behind[at] = _unit(np.einsum("nij,nj->ni", whole[at + 1], behind[at + 1]))
    ahead, back = _filled(e, live, opening, moves, before, behind)
    return _unit(ahead * back)[piece_of, step]


def _lexicon(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words that occur in three texts or more, one for each slot: the most frequent wins, then the larger hash."""
    seen = np.unique(np.stack([names, owner.astype(np.uint64)]), axis=1)[0]
    word, times = np.unique(seen, return_counts=True)
    word, times = word[times >= 3], times[times >= 3]
    out = np.zeros(1 << LEXICON_BITS, np.uint64)
    order = np.lexsort((word, times))
    out[(word[order] >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)] = word[order]
    return out


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Model:
    """A model from (text, language) rows; without any row it knows no language."""
    languages = sorted({y for _, y in rows})
    k = len(languages)
    model = Model(languages)
    if not k:
        return model
    texts = [t for t, _ in rows]
    words = find_words(texts)
    names = word_names(words)
    model.lexicon = _lexicon(names, words.owner)
    model.tables = [np.zeros((1 << TABLE_BITS, k), np.float32) for _ in range(ORDERS)]
    model.lexicon_weights = np.zeros(((1 << LEXICON_BITS) + 1, k), np.float32)
    model.moves = np.zeros((k, k))
    if not len(names):
        return model
    label = np.array([languages.index(y) for _, y in rows])[words.owner]
    ids, lexical = run_ids(words), model.lexicon_slots(names)
    draw = np.random.default_rng(seed)
    spans, at = [], 0
    opens = np.append(np.flatnonzero(np.concatenate(([True], words.owner[1:] != words.owner[:-1]))), len(names))
    for a, b in zip(opens[:-1], opens[1:]):
        at = a
        while at < b:
            end = min(b, at + int(draw.integers(4, 40)))
            spans.append((at, end))
            at = end
    order = np.concatenate([np.arange(*spans[s]) for s in draw.permutation(len(spans))])
    steps = min(PIECE, len(order))
    order = order[: len(order) // steps * steps]
    params = [*model.tables, model.lexicon_weights, model.moves]
    speed = [np.full(p.shape, 1e-2, p.dtype) for p in params]
    live = np.ones((BATCH, steps), bool)
    for _ in range(EPOCHS):
        groups = draw.permutation(len(order) // steps)
        for g in range(0, len(groups), BATCH):
            pick = np.concatenate([order[s * steps : (s + 1) * steps] for s in groups[g : g + BATCH]])
            width = words.size[pick] + 2
            first = np.concatenate(([0], np.cumsum(width)))
            place = np.repeat(words.first[pick] - first[:-1], width) + np.arange(first[-1])
            slots = [i[place] for i in ids]
            n = len(pick) // steps
            e = _scaled(model.potentials(slots, first, lexical[pick])).reshape(n, steps, k)
            moves = np.exp(model.moves - model.moves.max())
            even = np.full((n, k), 1 / k)
            ahead, back = _filled(e, live[:n], np.ones(n, bool), moves, even, even)
            belief = _unit(ahead * back)
            truth = np.eye(k)[label[pick]].reshape(n, steps, k)
            slope = (truth - belief).reshape(-1, k).astype(np.float32)
            pair = ahead[:, :-1, :, None] * moves * (e[:, 1:] * back[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            moved = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - pair.sum(axis=(0, 1))
            wide = np.repeat(slope, width, axis=0)
            slopes = [np.stack([np.bincount(s, wide[:, c], 1 << TABLE_BITS) for c in range(k)], axis=1) for s in slots]
            slopes.append(np.stack([np.bincount(lexical[pick], slope[:, c], (1 << LEXICON_BITS) + 1) for c in range(k)], axis=1))
            slopes.append(moved)
            for p, v, d in zip(params, speed, slopes):
                d = (d / len(pick) - 1e-6 * p).astype(p.dtype)
                v += d * d
                p += RATE * d / np.sqrt(v)
            for p in params[:-2]:
                p[0] = 0
            model.lexicon_weights[-1] = 0
    return model


def blocks(texts: list[str]):
    """Row ranges of at most BLOCK_CHARS code points, one row at least."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > BLOCK_CHARS:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def label_block(texts: list[str], model: Model) -> tuple[Words, np.ndarray]:
    """Words of the texts and the language distribution of each; equal words are weighed once."""
    words = find_words(texts)
    if not len(words.size) or not model.languages:
        return words, np.zeros((len(words.size), len(model.languages)))
    names, one, back = np.unique(word_names(words), return_index=True, return_inverse=True)
    width = words.size[one] + 2
    first = np.concatenate(([0], np.cumsum(width)))
    codes = words.codes[np.repeat(words.first[one] - first[:-1], width) + np.arange(first[-1])]
    single = Words(codes, first, words.owner[one], words.begin[one], words.size[one])
    weights = model.potentials(run_ids(single), first, model.lexicon_slots(names))
    return words, word_posteriors(weights[back], words.owner, model.moves)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text, mod 4, is 2. False for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def draw(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of (text, language) outside the held-out rows: a count by language, then one scan."""
    known = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(v) for y, n in sorted(counts.items()) for v in (y, min(1.0, fit_rows / n))))
    place = F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1 << 20))
    got = known.filter(place < share[F.col(lang)] * (1 << 20)).select(F.xxhash64(key, F.lit("order")).alias("o"), text, lang).collect()
    rows = [(r[1], r[2]) for r in sorted(got, key=lambda r: (r[0], r[1] or "", r[2])) if r[1]]
    return list(dict.fromkeys(rows))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (mean probability of that language over the words) and spans.

    ``spans`` lists the stretches of words with one language: start and end (code points), lang. Null texts and
    texts without a letter are ``und`` with score 0 and no spans; so is everything if no language was learned. Input
    columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    place = docs.columns.index(text)
    extra = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    schema = docs.withColumns({n: F.lit(None).cast(t) for n, t in (e.split(" ", 1) for e in extra.split(", "))}).schema
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    stretch = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        own = Model(**sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in blocks(texts):
                words, belief = label_block(texts[a:b], own)
                names, scores, spans = [UNKNOWN] * (b - a), [0.0] * (b - a), [[] for _ in range(b - a)]
                if len(belief) and own.languages:
                    opens = np.flatnonzero(np.concatenate(([True], words.owner[1:] != words.owner[:-1])))
                    sizes = np.diff(np.append(opens, len(belief)))
                    mean = np.add.reduceat(belief, opens, axis=0) / sizes[:, None]
                    best = mean.argmax(axis=1)
                    for row, lang, value in zip(words.owner[opens].tolist(), best.tolist(), mean.max(axis=1).tolist()):
                        names[row], scores[row] = own.languages[lang], min(1.0, value)
                    each = belief.argmax(axis=1)
                    turn = np.flatnonzero(np.concatenate(([True], (each[1:] != each[:-1]) | (words.owner[1:] != words.owner[:-1]))))
                    last = np.append(turn[1:], len(each)) - 1
                    for row, s, e, lang in zip(words.owner[turn].tolist(), words.begin[turn].tolist(), (words.begin[last] + words.size[last]).tolist(), each[turn].tolist()):
                        spans[row].append({"start": s, "end": e, "lang": own.languages[lang]})
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, stretch)], [f.name for f in schema])

    return docs.mapInArrow(run, schema)
