"""Sharding, source divergence and conversation repair against direct computations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import divergence, repair, sharding
from clausegrid.session import load, scratch_path

ARC = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def cheapest(rows):
    """(cost, audit) for rows of (initial, must go, truncated), by search from the end."""

    @lru_cache(None)
    def best(i, state, added):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def take(cost, edit, i, state, added=0):
            got = best(i, state, added)
            if got:
                found.append((cost + got[0], edit + got[1]))

        if added < 3:
            for c in "ua":
                if (c, state) in ARC:
                    take(3, "I", i, ARC[c, state], added + 1)
        if i < len(rows):
            c, gone, short = rows[i]
            take(4, "D", i + 1, state)
            if not gone:
                if (c, state) in ARC:
                    take(3 * short, "K", i + 1, ARC[c, state])
                for new in "ua":
                    if (new, state) in ARC:
                        take(3 + 3 * short, "R", i + 1, ARC[new, state])
        return min(found) if found else None

    return best(0, 0, 0)


def letter_of(c, fault):
    return chr(65 + 4 * "suax".index(c) + fault)


def test_parse_is_the_cheapest_repair():
    draw = random.Random(13)
    short = [list(x) for n in range(4) for x in itertools.product("sua", repeat=n)]
    for rows in [*[[(c, 0) for c in x] for x in short], *[[(draw.choice("suax"), draw.choice([0, 0, 1, 2, 3])) for _ in range(draw.randrange(12))] for _ in range(150)]]:
        want = cheapest(tuple((c, f in (1, 2), f == 3) for c, f in rows))
        assert repair.parse("".join(letter_of(c, f) for c, f in rows)) == want


def test_any_split_gives_the_same_cell():
    draw = random.Random(14)
    for _ in range(40):
        cells = [repair.row_cell(letter_of(draw.choice("suax"), draw.randrange(4))) for _ in range(7)]
        spans = {(i, i + 1): c for i, c in enumerate(cells)}
        for size in range(2, 8):
            for i in range(8 - size):
                got = [repair.combine(spans[i, k], spans[k, i + size]) for k in range(i + 1, i + size)]
                assert all(g == got[0] for g in got)
                spans[i, i + size] = got[0]


def test_long_conversation():
    cost, audit = repair.parse("".join(letter_of("ua"[k % 2], 0) for k in range(20_000)) + letter_of("u", 0))
    assert cost == 3 and len(audit) == 20_002 and audit[-1] == "I"


def told(rows):
    """Expected report of a conversation's rows (turn, role, text)."""
    left = []
    for key, turn, role, text in rows:
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in left:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(1 if not ends else 2 if (role, text) in seen else 3 if ends[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, *_ in left if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]
    cost, audit = cheapest(tuple((r[:1] if r[:1] in ("s", "u", "a") else "x", f in (1, 2), f == 3) for (_, r, _), f in zip(left, faults)))
    state, at, lines = 0, 0, []
    for e in audit:
        role, text = ("assistant" if state == 2 else "user"), ""
        if e != "I":
            _, own, text = left[at]
            at += 1
            if e == "D":
                continue
            role = own if e == "K" else role
        state = ARC[role[0], state]
        lines.append(f"{role}:{text}")
    return gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_damaged_conversations(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 3)
    draw, rows = random.Random(15), []
    for conv in [*range(30), None]:
        for k in range(draw.choice([1, 2, 5, 9])):
            turn = draw.choice([k, k, k, None, 0])
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(["Yes.", "No", "", " \n", None, "a.b", "Yes.", "x" * 50_000 + "!"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("other")).withColumn("at", F.lit(3))
    got = {r[0]: tuple(r[1:]) for r in repair.damaged_and_repaired(df).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((f"{' ' if conv is None else conv}:{' ' if turn is None else turn}", turn, role, text))
    assert got == {k: told(v) for k, v in groups.items()}


def test_repaired_rows_fit_the_grammar(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "tool", None), (3, 5, "assistant", "c")], "conv_id long, turn long, role string, text string")
    audits, rows = repair.repair(df)
    assert {r.conv_id: (r.cost, r.audit) for r in audits.collect()} == {1: (3, "KR"), 2: (4, "D"), 3: (4, "D")}
    assert [tuple(r) for r in rows.orderBy("conv", "position").collect()] == [("+1", 0, "user", "a."), ("+1", 1, "assistant", "b.")]


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.damaged_and_repaired(df).count() == 0


def placed(spark, topology, n=4000):
    return {r.k: r.shard for r in sharding.place(spark.range(n).withColumnRenamed("id", "k"), F.col("k"), topology).collect()}


def test_weights_decide_shares(spark):
    tree = [("east", "a", 0, 1.0), ("east", "a", 1, 3.0), ("east", "b", 2, 2.0), ("west", "c", 3, 2.0), ("west", "c", 4, 0.0)]
    count = Counter(placed(spark, tree).values())
    assert set(count) == {0, 1, 2, 3}
    for shard, share in ((0, 1 / 8), (1, 3 / 8), (2, 1 / 4), (3, 1 / 4)):
        assert abs(count[shard] / 4000 - share) < 0.03


def test_new_shard_takes_rows_only_into_itself(spark):
    tree = sharding.grid(8)
    before = placed(spark, tree)
    for k in (8, 9):
        grown = sharding.with_shard(tree, k)
        after = placed(spark, grown)
        assert all(after[x] in (before[x], k) for x in before) and abs(Counter(after.values())[k] / 4000 - 1 / (k + 1)) < 0.03
        tree, before = grown, after


def test_rows_move_only_between_subtrees_whose_weights_change(spark):
    tree = sharding.grid(12)
    before = placed(spark, tree)
    heavier = [(r, k, s, 2.0 if s == 5 else w) for r, k, s, w in tree]
    after = placed(spark, heavier)
    moved = [(before[x], after[x]) for x in before if before[x] != after[x]]
    assert moved and all(b in (4, 5, 6, 7) for _, b in moved)  # region of shard 5
    assert all(b in (4, 5) for a, b in moved if a in (6, 7)) and all(b == 5 for a, b in moved if a == 4)


def test_shards_of_odd_rows(spark):
    rows = [(1, "é"), (1, "é"), (None, None), (2, ""), (3, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine")).withColumn("size", F.lit(1))
    got = sharding.assign(df, sharding.grid(1), None).collect()
    assert sorted(r.slot for r in got) == list(range(5)) and {r.shard for r in got} == {0}
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sharding.assign(df.limit(0), sharding.grid(8)).count() == 0
    with pytest.raises(ValueError, match="each shard once"):
        sharding.place(df, F.col("doc_id"), [("a", "b", 1, 1.0), ("a", "c", 1, 1.0)])


def test_written_shards(spark, sf):
    docs = load(spark, sf, "documents")
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs, sharding.grid(3), path, rows_per_file=30)
    back = spark.read.parquet(path)
    assert Counter(tuple(r) for r in back.select(*docs.columns).collect()) == Counter(tuple(r) for r in docs.collect())
    want = {r.doc_id: r.shard for r in sharding.place(docs, F.col("doc_id"), sharding.grid(3)).collect()}
    assert {r.doc_id: r.shard for r in back.select("doc_id", "shard").collect()} == want


def report(rows, least=3, listed=200):
    """The audit by plain counting over (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(a, b, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(low)))) for a, b, t in rows]
    out = []
    for lang in {a for a, *_ in rows}:
        seen = Counter(t for a, _, c in terms if a == lang for t in c)
        kept = sorted(t for t, n in seen.items() if n >= least)
        groups = defaultdict(Counter)
        for a, b, c in terms:
            if a == lang:
                groups[b].update({t: n for t, n in c.items() if t in set(kept)})

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {b: shares(c) for b, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for b in groups:
            pair = [(o, sum((p[b][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != b]
            term = [(t, (p[b][t] - q[t]) ** 2 // q[t]) for t in kept if groups[b][t] and p[b][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, b, part, item, v, k + 1) for k, (item, v) in enumerate(found) if part == "pair" or k < listed]
    return sorted(out)


def test_words_of_many_documents_are_handed_on_together(spark):
    """Twelve documents of 50,000 words each, all distinct, in one task: one part a bucket, with every count right."""
    texts = [" ".join(f"w{k * 50_000 + j}" for j in range(50_000)) for k in range(12)] + [" \x0b Ab\tab\x1cC \xc4b aB ", "", None]
    rows = [("en", "s" if k % 2 else None, t) for k, t in enumerate(texts)]
    parts = divergence.chunk_counts(spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1), 4).collect()
    assert sorted(r.bucket for r in parts) == [0, 1, 2, 3]
    read = [pa.ipc.open_stream(r.part).read_all() for r in parts]
    assert all(zlib.crc32(c) % 4 == r.bucket for r, t in zip(parts, read) for c in t["chunk"].to_pylist())
    own = [r for r in pa.concat_tables(read).to_pylist() if not r["chunk"].startswith(b"w")]
    first = {r.pop("first") for r in own}
    same = {"lang": b"en", "source": b"", "docs": 1, "span": 0}
    want = [{**same, "chunk": c, "n": n} for c, n in Counter(texts[12].encode().lower().split()).items()]
    assert len(first) == 1 and sorted(map(str, (sorted(r.items()) for r in own))) == sorted(map(str, (sorted(r.items()) for r in want)))
    assert sum(t.num_rows for t in read) == 600_000 + len(want)


def test_divergence_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    draw = random.Random(16)
    words = ["Foo", "foo", "foo,", "foo-bar", "bar.", "it's", "42", "--", "Été", "été", "ÉTÉ", "日本", "a-a-a", "http://x.y/z", "don’t", "x y"]
    rows = [(draw.choice(["en", "de", None]), draw.choice(["s0", "s0", "s1", "s2", None]), draw.choice([" ", "\n", "\t "]).join(draw.choices(words, k=draw.choice([0, 1, 3, 30])))) for _ in range(60)]
    rows += [("fr", "s0", "seul"), ("fr", "s1", None), ("it", "s5", ""), *[("en", "s0", "foo bar")] * 3]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5).withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).withColumn("p", F.lit(3))
    for least, listed in ((3, 200), (1, 2)):
        assert sorted(tuple(r) for r in divergence.audit(df, least, listed).collect()) == report(rows, least, listed)
    assert divergence.audit(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="least"):
        divergence.audit(df, 4)


def test_chunk_counts_travel_packed_by_bucket(spark):
    """A row for each bucket and hand-on, not for each count; a count takes a fraction of its row's size."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(9)) + draw.choice(["", ".", "-x-x"]) for _ in range(6000)]
    rows = [(k % 2 and "en" or None, f"s{k % 5}", " ".join(draw.choice(words) for _ in range(300))) for k in range(200)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    counted = divergence.chunk_counts(df, 8).localCheckpoint()
    assert counted.count() <= 2 * 8
    chunks = {(lang, source, w) for lang, source, text in rows for w in text.split()}
    assert counted.selectExpr("sum(length(part))").first()[0] < 40 * len(chunks)
    want = Counter((lang or "", source, t) for lang, source, text in rows for t in re.findall("[a-z]+", text))
    got = divergence.term_rows(counted).groupBy("lang", "source", "term").sum("n").collect()
    assert {(r.lang, r.source, r.term): r["sum(n)"] for r in got} == want
