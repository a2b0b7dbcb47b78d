"""Language and toxicity models, the pipeline, and the SQL twins of the subpackage."""

import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from clausegrid.llm import ORACLES, QUERIES, language, neardup, sieve, toxicity
from clausegrid.session import load, scratch_path


def held(key, mod, rest):
    return zlib.crc32(str(key).encode()) % mod == rest


def test_posteriors_match_all_paths():
    draw = np.random.default_rng(3)
    k, sizes = 3, [1, 2, 5, 6]
    owner = np.repeat(np.arange(4), sizes)
    potentials, moves = draw.normal(size=(14, k)), draw.normal(size=(k, k))
    got = language.word_posteriors(potentials, owner, moves)
    at = 0
    for n in sizes:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(sum(potentials[at + i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            want[np.arange(n), list(path)] += w
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_pieces_do_not_change_posteriors(monkeypatch):
    draw = np.random.default_rng(4)
    owner = np.repeat([0, 1, 2, 3], [700, 1, 64, 130])
    potentials, moves = draw.normal(size=(len(owner), 4)) * 3, draw.normal(size=(4, 4))
    short = language.word_posteriors(potentials, owner, moves)
    monkeypatch.setattr(language, "PIECE", 1024)
    assert np.allclose(short, language.word_posteriors(potentials, owner, moves))


def test_words_are_runs_of_letters():
    words = language.find_words(["Été, a1b", "", "42", "日本 x"])
    assert words.owner.tolist() == [0, 0, 0, 3, 3]
    assert words.begin.tolist() == [0, 5, 7, 0, 3] and words.size.tolist() == [3, 1, 1, 2, 1]


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_language"](spark, sf).toPandas().set_index("doc_id")
    docs = load(spark, sf, "documents").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert all(got.held_out[k] == held(k, 4, 2) for k in got.index)
    mine = got[got.held_out]
    assert (mine.lang_pred == docs.lang[mine.index]).mean() > 0.96
    assert got.score.between(0, 1).all()


def test_language_switches_inside_a_text(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = language.draw(docs)
    model = language.fit(rows)
    pure = {}
    for text, lang in rows:
        if len(text) > 1500 and lang not in pure and "|" not in text:
            pure[lang] = text[:400].rsplit(" ", 1)[0]
    mixed = pure["en"] + " " + pure["de"]
    df = spark.createDataFrame([(1, mixed, "x"), (2, None, "x"), (3, "12 %", "x"), (4, "", "x"), (None, pure["fr"] * 300, "x")], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert out[1].spans[0].lang == "en" and out[1].spans[-1].lang == "de"
    cover = sum(s.end - s.start for s in out[1].spans if s.lang == ("en" if s.end <= len(pure["en"]) else "de"))
    assert cover > 0.9 * len(mixed)
    assert all((out[k].lang_pred, out[k].score, out[k].spans) == ("und", 0.0, []) for k in (2, 3, 4))
    assert out[None].lang_pred == "fr" and out[None].score > 0.6
    nothing = language.fit([])
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


def test_language_sample_is_bounded_and_clean(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    allowed = {(r.text, r.lang) for r in docs.collect() if not held(r.doc_id, 4, 2)}
    rows = language.draw(docs, fit_rows=20)
    assert set(rows) <= allowed and 20 < len(rows) < 160


def auc(score, label):
    ranks = pd.Series(score).rank().to_numpy()
    ones = int(label.sum())
    return (ranks[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "labels")
    model = toxicity.fit(*toxicity.draw(docs, labels))
    known = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(known, model).select("score", "predicted", "toxic").toPandas()
    assert auc(got.score, got.toxic.to_numpy()) > 0.85
    assert got.predicted[got.toxic == 1].mean() > 0.5 and got.predicted[got.toxic == 0].mean() < 0.06
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_toxic_words_are_found_and_clean_texts_stay(spark):
    draw = random.Random(2)
    plain = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8))) for _ in range(n))
    rude = ["zzorkle", "quimplex", "vruxnag"]
    bad = [plain(60) + " " + draw.choice(rude) + " " + plain(40) + " " + draw.choice(rude) for _ in range(120)]
    rows = [(plain(120), 0) for _ in range(400)] + [(t, 1) for t in bad]
    draw.shuffle(rows)
    model = toxicity.fit(rows)
    df = spark.createDataFrame([(1, plain(50) + " ".join(rude) + plain(50)), (2, plain(100)), (3, None), (4, ""), (5, plain(30_000)), (None, "!")], "doc_id long, text string").withColumn("score", F.lit("own"))
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert out[1].predicted == 1
    assert all(out[k].predicted == 0 and 0 <= out[k].score <= 1 for k in (2, 3, 4, 5, None))
    assert toxicity.score(df.limit(0), model).count() == 0
    none = toxicity.fit([("a", 1)])
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}


def test_labels_with_odd_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(30)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (3, None), (5, 7), (4, 0), (4, 0)], "doc_id long, toxic int")
    rows, weight = toxicity.draw(docs, labels)
    assert {t for t, _ in rows} == {f"text {k}" for k in range(30) if not held(k, 3, 1)} and weight == pytest.approx(1, abs=0.6)
    assert toxicity.draw(docs, labels.limit(0))[0] == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, sf, name):
    state, info, *_ = compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf)
    assert state == "ok", info


def planted_folder(spark):
    """sf0.001 with rows whose fate is known, extra columns and a clashing name."""
    sf, folder = "/root/testdata/sf0.001", scratch_path(spark, "planted")
    for table in ("labels", "benchmark"):
        load(spark, sf, table).write.parquet(f"{folder}/{table}.parquet")
    docs = load(spark, sf, "documents")
    first = docs.filter("lang = 'en' and n_chars between 800 and 4000").orderBy("doc_id").first()
    item = load(spark, sf, "benchmark").orderBy("item_id").first()
    more = [
        (10_001, first.text, "en"), (10_002, "12 34 %%", "en"), (10_003, None, "en"), (10_004, "", "de"),
        (10_005, "The and of it, " + item.text + " with that.", "en"), (10_006, None, None), (10_007, "The and of with it in that is.", "en"), (10_007, "The and of with it in that is.", "en"),
    ]
    rows = spark.createDataFrame([(i, t, l, "planted", len(t or "")) for i, t, l in more], docs.schema)
    docs.union(rows).withColumn("score", F.lit("own")).withColumn("kept", F.lit(5)).withColumn("Item_Ids", F.lit(None).cast("string")).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return folder, first.doc_id


def test_pipeline_stages(spark):
    folder, copied = planted_folder(spark)
    docs = load(spark, folder, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        path = scratch_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.filter("score = 'own' and kept = 5").count() == docs.count()
    assert not {10_002, 10_003, 10_004, 10_006} & set(seen["language"]) and len(seen["language"]) >= 200
    assert len(seen["toxicity"]) > 0.9 * len(seen["language"])
    assert copied in seen["near_duplicates"] and 10_001 not in seen["near_duplicates"]
    assert seen["near_duplicates"].count(10_007) == 1
    assert 10_005 in seen["near_duplicates"] and 10_005 not in seen["decontamination"]
    final = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in final.collect()) == sorted(seen["decontamination"])


def test_pipeline_drops_copies_from_four_fifths_on(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k : k + 300]) for k in (0, 31, 90)]  # 265 of 327 shingles in common: 0.81
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]
    assert [neardup.band_rows(p) for p in (85, 80, 50)] == [5, 4, 2]


def test_pipeline_judges_rows_of_a_repeated_key_by_their_texts(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, x), (5, x), (5, y), (5, y), (7, y), (8, z), (8, None), (None, x), (None, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("own"))
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(1, x), (5, y), (8, z), (8, None), (None, x), (None, x)]))


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.nodeName():
        return shuffled_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(k)) for k in range(plan.children().size()))


def test_pipeline_moves_no_texts_that_have_no_copy(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (400, texts[7]), (None, texts[9])], "doc_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [*range(400), None]))
        assert shuffled_rows(left._jdf.queryExecution().executedPlan()) < 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_sieve_passes_every_key(spark, monkeypatch):
    rows = spark.range(200_000).select(F.when(F.col("id") % 1000 != 1, F.col("id")).alias("k"))
    keys = rows.filter("k % 100 = 0").unionByName(rows.filter("k is null")).withColumn("k", F.col("k").cast("int"))
    for most in (sieve.MOST_BITS, sieve._ROW_BITS):
        monkeypatch.setattr(sieve, "MOST_BITS", most)
        maybe, sure = sieve.sifted(rows, "k", keys)
        own = F.coalesce(F.col("k") % 100 == 0, F.lit(False))
        assert maybe.filter(own).count() == 2_000 and sure.filter(own).count() == 0
        assert maybe.count() + sure.count() == 200_000
        assert most == sieve._ROW_BITS or maybe.count() < 12_000
    maybe, sure = sieve.sifted(rows, "k", keys.limit(0))
    assert maybe.count() == 0 and sure.count() == 200_000


def test_pipeline_keeps_texts_of_three_languages(spark, monkeypatch):
    judged = lambda d, model: d.withColumns({"lang_pred": F.when(F.col("doc_id") == 1, "und").otherwise("en"), "score": F.lit(0.34), "spans": F.lit(None)})
    monkeypatch.setattr(language, "draw", lambda docs: None)
    monkeypatch.setattr(language, "fit", lambda rows: None)
    monkeypatch.setattr(language, "predict", judged)
    docs = spark.createDataFrame([(1, "12"), (2, "one zwei trois")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.keep_language(spark, docs, "").collect()] == [2]


def test_pipeline_of_nothing(spark):
    folder = scratch_path(spark, "empty")
    for table in ("documents", "labels", "benchmark"):
        load(spark, "/root/testdata/sf0.001", table).limit(0).write.parquet(f"{folder}/{table}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
