"""BPE, near duplicates, decontamination and fingerprints against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import bpe, decontam, fingerprint, neardup
from clausegrid.llm.arrays import shingle_sets

ODD = [
    None, "", " ", "\t\n", "a", "one two", "<|endoftext|>", "x <|endoftext|> y " * 300, "日本語 テキスト" * 400, "it's  they'll \n\n \t x  y" * 200,
    "a" * 9000, " " * 5000, "é  ñ" * 900, "a  b c\x1cd " * 400, "🙂 ok" * 500,
]


def docs_frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def babble(n, seed, words=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary_path())


def test_chunks_agree_with_the_whole(codec):
    draw = random.Random(1)
    letters = ["ab <|endoftext|>\n é日 'sd1", "abc  \n\t", "the of and "]
    texts = [t for t in ODD if t] + ["".join(draw.choice(a) for _ in range(30_000)) for a in letters]
    encoder = bpe.ChunkEncoder(codec)
    for text in texts:
        ids = encoder(np.frombuffer(text.encode(), np.uint8))
        want = codec.exact.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decode(ids).decode() == codec.exact.decode(want, skip_special_tokens=False)


def test_broken_ids_decode_like_the_library(codec):
    ids = [i for i in range(128, 256)] + [50256, 1000, 200]
    assert codec.decode(np.array(ids, np.uint32)).decode() == codec.exact.decode(ids, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once(codec):
    passage = babble(6000, 1)
    encoder = bpe.ChunkEncoder(codec)
    first = encoder(np.frombuffer(("A start. " + passage).encode(), np.uint8))
    before = encoder.encoded
    other = "Another, longer start of it. " + passage
    second = encoder(np.frombuffer(other.encode(), np.uint8))
    assert len(first) and encoder.encoded - before <= 2 and encoder.reused > 5
    assert second.tolist() == codec.exact.encode(other, add_special_tokens=False).ids


def test_round_trip_rows(spark, codec):
    texts = ODD + [babble(3000, 2)] * 3
    df = docs_frame(spark, texts).withColumn("ids", F.lit("own")).withColumn("n_tokens", F.lit(0)).union(
        spark.createDataFrame([(None, "no key", "x", 0)], "doc_id long, text string, ids string, n_tokens int"))
    rows = bpe.encode_decode(df, bpe.vocabulary_path()).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "no key" if r.doc_id is None else texts[r.doc_id] or ""
        ids = codec.exact.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), bpe.vocabulary_path()).count() == 0


def true_sets(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def true_components(sets, percent=85):
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [root(k) for k in range(len(sets))]


def edited(text, places, seed):
    words, draw = text.split(" "), random.Random(seed)
    for _ in range(places):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_match_brute_force(spark):
    base = babble(300, 3)
    short = babble(14, 4)
    passage = babble(150, 5)
    texts = [edited(base, 6, 100 + k) for k in range(60)] + [base] + [edited(base, 1, 300 + k) for k in range(20)] + [base] * 30
    texts += [short, short + " tail", "lead " + short, short.upper(), short]
    texts += [passage + " " + babble(200, 500 + k) for k in range(40)]
    texts += ODD + ["", "One two", "one  two", "three"]
    df = docs_frame(spark, texts).withColumn("component_id", F.lit("own")).withColumn("kept", F.lit(1))
    rows = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    sets = true_sets(texts)
    want = true_components(sets)
    assert [rows[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert [rows[k].component_id for k in range(len(texts))] == want
    assert all(rows[k].kept == (want[k] == k) for k in range(len(texts)))


def components_in_buckets(spark, texts, bands):
    """Numbers of the texts in each component if their band keys are the given ones."""
    df = docs_frame(spark, texts)
    place = {neardup.set_name(own): k for k, own in enumerate(shingle_sets(df.toArrow()["text"].combine_chunks(), 5))}
    rows = neardup.sketches(df, "doc_id", "text").collect()
    sets = spark.createDataFrame([(r.sid, r.id, r.n_shingles, bands[r.id], r.low) for r in rows], "sid binary, rep long, n long, bands array<long>, low binary")
    groups = {}
    labels = neardup.set_components(sets, df.withColumnRenamed("doc_id", "id"), 85)
    for r in labels.collect() if labels else []:
        groups.setdefault(bytes(r.label), set()).add(place[bytes(r.node)])
    return sorted(groups.values(), key=min)


def test_near_duplicates_of_a_crowded_template(spark, monkeypatch):
    """Fill-ins of one template, none like another, crowd the bucket of two less popular ones that are near copies."""
    monkeypatch.setattr(neardup, "BLOCK_SETS", 16)
    template = babble(300, 60).split()

    def filled(k, changed=()):
        words = list(template)
        for j, at in enumerate(range(7, 300, 19)):
            words[at] = f"v{k}x{j}"
        for at in changed:
            words[at] = f"u{at}"
        return " ".join(words)

    texts = [filled(k) for k in range(80)] + [filled(99), filled(99, (2, 150))]
    assert true_components(true_sets(texts)) == [*range(81), 80]
    assert components_in_buckets(spark, texts, [[1, 2, 3]] * 80 + [[1]] * 2) == [{80, 81}]


def test_near_duplicates_chained_beside_the_centres(spark):
    """One bucket of four sets, A~B, B~D, D~C: once A and then C were centres, only B~D is left."""
    base = [f"w{k}" for k in range(460)]
    texts = [" ".join(base[k : k + 400]) for k in (0, 20, 40, 60)]
    sets = true_sets(texts)
    assert true_components(sets) == [0] * 4 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.85
    assert components_in_buckets(spark, texts, [[1, 10, 11, 12], [1], [1], [1, 10, 11, 12]]) == [{0, 1, 2, 3}]


def test_common_counts_in_slices(monkeypatch):
    monkeypatch.setattr(neardup, "_SLICE", 7)
    draw = np.random.default_rng(1)
    one, two = ([np.unique(draw.integers(0, 90, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 40), (60, 1, 33, 0)))
    assert (neardup.common_counts(one, two) == [[len(np.intersect1d(a, b)) for b in two] for a in one]).all()


def test_near_duplicates_null_and_repeated_keys(spark):
    long = babble(50, 6)
    df = spark.createDataFrame([(None, long), (5, long), (5, long), (3, babble(50, 7)), (7, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, None, True), (5, 5, True), (5, 5, True), (3, 3, True), (7, 7, True)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_densification_keeps_equal_likelihood():
    import pyarrow as pa

    ranks = neardup.probe_ranks()
    one, two = shingle_sets(pa.array([babble(40, 8), babble(40, 8)]))
    assert (neardup.signature(one, ranks) == neardup.signature(two, ranks)).all()
    a, b = shingle_sets(pa.array([babble(44, 9), edited(babble(44, 9), 1, 1)]))
    share = (neardup.signature(a, ranks) == neardup.signature(b, ranks)).mean()
    assert abs(share - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.25


def loose(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def runs(words, size):
    n = min(size, 5)
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_matches(text, items, least=0.8):
    words, best = loose(text), {}
    for name, item in items:
        own = loose(item)
        if not own or not words:
            continue
        size = min(len(own), len(words))
        if min(5, len(own)) > size:
            continue
        want = runs(own, len(own))
        n = min(5, len(own))
        for i in range(len(words) - size + 1):
            part = words[i : i + size]
            have = Counter(tuple(part[j : j + n]) for j in range(len(part) - n + 1))
            common = sum((want & have).values())
            value = common / (sum(want.values()) + sum(have.values()) - common)
            if value >= least:
                best[name] = max(best.get(name, 0), value)
    return best


def test_items_match_brute_force(spark):
    items = [(k, babble(15 + k, 40 + k, 60 + 30 * k)) for k in range(30)] + [(100, "three short words"), (101, "solo"), (102, ""), (103, None), (104, "a b a b a b a b a b a b")]
    draw, texts = random.Random(9), []
    for k in range(120):
        name, item = items[draw.randrange(30)]
        inner = [item, edited(item, 1, k), item.upper().replace(" ", ", "), " ".join(item.split()[1:]), item + " " + item, babble(30, k, 100)][k % 6]
        texts.append(babble(draw.randrange(0, 60), 900 + k, 300) + " " + inner + " | " + babble(draw.randrange(0, 60), 1900 + k, 300))
    texts += [None, "", "three  SHORT words!", "x solo y", "a b a b a b a b a b", items[20][1], " ".join(items[25][1].split()[:-1])]
    df = docs_frame(spark, texts).withColumn("likeness", F.lit("own"))
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_items(df, table).collect()}
    for k, text in enumerate(texts):
        want = brute_matches(text, items)
        assert rows[k].item_ids == sorted(want), (k, text)
        assert rows[k].contaminated == bool(want)
        assert abs(rows[k].likeness - max(want.values(), default=0)) < 1e-12
    none = decontam.find_items(df, table.limit(0)).agg(F.sum(F.col("contaminated").cast("int"))).first()[0]
    assert none == 0 and decontam.find_items(df.limit(0), table).count() == 0


def test_blocks_find_all_within_radius():
    index = decontam.ItemIndex([(k, babble(20, k)) for k in range(50)])
    own = index.sizes[20][1]
    draw = np.random.default_rng(0)
    near = own[draw.integers(0, 50, 3000)]
    for _ in range(decontam.RADIUS):
        near = near ^ (np.uint64(1) << draw.integers(0, 64, 3000).astype(np.uint64))
    got = set(zip(*(x.tolist() for x in index.near(20, near))))
    dist = np.bitwise_count(near[:, None] ^ own[None])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(dist <= decontam.RADIUS))))


def test_edited_fingerprints(spark):
    texts = [babble(random.Random(k).choice([8, 30, 200, 600]), k) for k in range(60)] + [None, "", " ", "ab", "four words are here"] + [babble(300, 5)] * 3
    df = docs_frame(spark, texts, start=10).withColumn("fingerprint", F.lit("own"))
    rows = {r.doc_id - 10: r for r in fingerprint.edited_fingerprints(df).collect()}
    assert len(rows) == len(texts)
    sets, errors = true_sets([(t or "").lower() for t in texts]), []
    for k, text in enumerate(texts):
        own, behind = text or "", texts[k - 1] or ""
        cut = len(own) // 3
        new = own[: len(own) - cut] + behind[:cut]
        r = rows[k]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        other = true_sets([new.lower()])[0]
        if sets[k] and other:
            errors.append(r.near_edited - len(sets[k] & other) / len(sets[k] | other))
    assert np.sqrt(np.mean(np.square(errors))) < 0.1 and abs(np.mean(errors)) < 0.03
    assert rows[65].fingerprint == rows[66].fingerprint and rows[66].near_next == 1.0
    assert rows[60].fingerprint == "" and rows[61].near_edited == 1.0
    assert len(rows[64].fingerprint) == 2 * fingerprint.BINS
    assert fingerprint.edited_fingerprints(df.limit(0)).count() == 0


def test_edited_fingerprints_repeated_and_null_keys(spark):
    a, b = babble(40, 1), babble(40, 2)
    df = spark.createDataFrame([(1, a), (1, a), (None, b), (2, None)], "doc_id long, text string")
    rows = fingerprint.edited_fingerprints(df).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == sorted([("1", len(a)), ("1", len(a)), ("None", len(b)), ("2", 0)])
    ones = [r for r in rows if r.doc_id == 1]
    cut = len(a) // 3
    assert {r.edited_sha256 for r in ones} == {hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()}
    single = spark.createDataFrame([(1, a)], "doc_id long, text string")
    assert fingerprint.edited_fingerprints(single).first().near_next == 1.0


def test_round_trip_takes_one_worker_a_task(spark):
    """Encoding and decoding share a Python worker: one step for the routes and one for the round trip."""
    back = bpe.encode_decode(docs_frame(spark, ODD), bpe.vocabulary_path())
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
    apart = bpe.decode(bpe.encode(docs_frame(spark, ODD), bpe.vocabulary_path()), bpe.vocabulary_path())
    apart = apart.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256), "ids")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, apart.collect()))
