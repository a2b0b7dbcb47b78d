import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.learn import cluster as U
from clausegrid.learn.embed import embed, embed_with
from clausegrid.operators import edits as E
from clausegrid.operators import panel as P
from clausegrid.operators import sampling as M
from clausegrid.operators import scan
from clausegrid.operators import spans as N
from clausegrid.operators import vectors as V
from clausegrid.sources import files as S


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(25, 4)) * 0.3 + c for c in rng.normal(size=(5, 4)) * 2] + [rng.normal(size=(15, 4)) * 3])
    x = np.concatenate([x, x[:20], x[:1].repeat(60, axis=0)])  # copies, one of them hot
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, vec array<double>, grp int")


def pairwise(x):
    return np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)


@pytest.mark.parametrize("block, held", [(4096, 0), (20, 0), (20, V.HELD_BYTES)])
def test_knn_is_exact(cloud, block, held):
    x, df = cloud
    p = V.points(df, "id", "vec", "grp", "euclidean")
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    par = np.arange(len(x)) % 2
    d[par[:, None] != par[None]] = np.inf
    got = V.knn(p, p, 3, exclude_self=True, block=block, held_bytes=held).toPandas().sort_values(["id", "rank"])
    assert (got.nid.to_numpy().reshape(-1, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


@pytest.mark.parametrize("block", [4096, 30])
def test_dbscan_equals_direct_search(cloud, block):
    x, df = cloud
    eps, need = 0.6, 4
    near = pairwise(x) <= eps
    core = near.sum(1) >= need
    label = -np.ones(len(x), int)
    c = 0
    for i in range(len(x)):
        if label[i] == -1 and core[i]:
            stack, label[i] = [i], c
            while stack:
                a = stack.pop()
                if core[a]:
                    for b in np.flatnonzero(near[a] & (label == -1)):
                        label[b] = c
                        stack.append(b)
            c += 1
    got = V.dbscan(df, "id", "vec", eps, need, block=block).toPandas().sort_values("id").label.to_numpy()
    assert (got == label).all() and (label == -1).any()


def test_components_of_a_long_path(spark):
    n = 40
    order = np.random.default_rng(3).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1) if i != 20], "a long, b long")
    nodes = spark.range(n).select("id")
    got = {r.id: r.comp for r in V.components(edges, nodes).collect()}
    left, right = {int(v) for v in order[:21]}, {int(v) for v in order[21:]}
    assert {got[i] for i in left} == {min(left)} and {got[i] for i in right} == {min(right)}


def dense_affinity(s, rounds):
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        t = a + s
        best = t.argmax(1)
        first = t[np.arange(n), best]
        t[np.arange(n), best] = -np.inf
        new = s - first[:, None]
        new[np.arange(n), best] = s[np.arange(n), best] - t.max(1)
        r = 0.5 * r + 0.5 * new
        pos = np.maximum(r, 0)
        np.fill_diagonal(pos, np.diag(r))
        avail = pos.sum(0)[None] - pos
        diag = np.diag(avail).copy()
        avail = np.minimum(avail, 0)
        np.fill_diagonal(avail, diag)
        a = 0.5 * a + 0.5 * avail
    ex = np.flatnonzero(np.diag(r) + np.diag(a) > 0)
    pick = ex[s[:, ex].argmax(1)]
    pick[ex] = ex
    return pick


def test_affinity_equals_dense_algorithm(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(6, 3)) * 0.4 + c for c in np.eye(3) * 4])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    edges = U.neighbour_similarities(df, "id", "vec", None, len(x) - 1)
    nodes = df.select(F.lit("").alias("g"), "id")
    got = {r.id: r.exemplar for r in U.affinity(edges, nodes).collect()}
    s = -pairwise(x) ** 2
    np.fill_diagonal(s, np.median(s[~np.eye(len(x), dtype=bool)]))
    want = dense_affinity(s, 100)
    assert [got[i] for i in range(len(x))] == list(want) and len(set(want)) == 3
    with pytest.raises(RuntimeError, match="settle"):
        U.affinity(edges, nodes, rounds=10)


def test_edit_join_is_exact(spark):
    words = ["tariff", "tariffs", "tarif", "traiff", "quota", "quotas", "", "a", "ab", "shared prefix one", "shared prefix two"] + [
        f"shared prefix {i}" for i in range(40)
    ]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words * 3], "w string")
    got = {(r.a, r.b): r.similarity for r in E.edit_distance_pairs(df, "w", 2).collect()}
    assert got == {(a, b): -lev(a, b) for a in words for b in words if a < b and lev(a, b) <= 2}


def test_fill_and_positions_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else "k", i, str(i) if i % 17 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos long, v string")
    filled = scan.forward_fill(df, ["k"], "pos", "v").toPandas().sort_values("pos")
    want = df.toPandas().sort_values("pos")
    assert (filled.v.fillna("-").to_numpy() == want.groupby("k").v.ffill().fillna("-").to_numpy()).all()
    placed = scan.position(df, ["k"], "pos", "n").toPandas().sort_values("pos")
    assert (placed.n.to_numpy() == want.groupby("k").cumcount().to_numpy() + 1).all()
    index = scan.global_index(df.select("pos"), [F.desc("pos")], "i").toPandas()
    assert (index.i.to_numpy() == 2999 - index.pos.to_numpy()).all()


def test_panel_drops_keys_of_one_agreement_and_counts_pairs(spark):
    held = spark.createDataFrame(
        [(1, ["C", "A", "B", "A"], "1996-01-01", None), (2, ["A", "B"], "1996-06-01", "1998-03-01"), (3, ["A", "B"], None, None)],
        "rta_id int, parties array<string>, dif string, din string",
    ).withColumn("dif", F.col("dif").cast("date")).withColumn("din", F.col("din").cast("date"))
    clauses = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "x"), (1, "only")], "rta_id int, clause_id string")
    kept = P.drop_singleton_keys(clauses, "clause_id", "rta_id")
    assert {r.clause_id for r in kept.collect()} == {"x"}
    assert P.party_pairs(held).count() == 3 + 1
    m = {"n": F.count(F.lit(1)), "new_n": F.count(F.lit(1))}
    out = {(r.party_a, r.party_b, r.year): (r.n, r.new_n) for r in P.pair_year_sums(kept, held, m, 1995, 1999).collect()}
    assert out[("A", "B", 1995)] == (0, 0) and out[("A", "B", 1996)] == (2, 2)
    assert out[("A", "B", 1997)] == (3, 0) and out[("A", "B", 1999)] == (2, 0) and out[("B", "C", 1997)] == (2, 0)
    short = P.pair_year_sums(kept, held, {"n": F.count(F.lit(1))}, 1995, 1999, only_active=True)
    assert {(r.party_a, r.party_b, r.year): r.n for r in short.collect()} == {k: v[0] for k, v in out.items() if v[0]}


def test_lag_respects_gaps(spark):
    df = spark.createDataFrame([("u", 1, 1.0), ("u", 2, 2.0), ("u", 4, 4.0)], "u string, year int, v double")
    got = {r.year: r.v_lag1 for r in P.lag_panel(df, ["u"], "year", ["v"], 1).collect()}
    assert got == {1: None, 2: 1.0, 4: None}


def test_splits_fitted_together_equal_single_fits(spark):
    import numpy as np

    from clausegrid.learn.splits import fit_splits, scored_splits, split_table

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.5, -1.0, 0.0] + rng.normal(size=300) > 0.3).astype(int)
    rows = [(i, x[i].tolist(), int(y[i])) for i in range(300)] + [(900, None, 1), (901, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "doc int, v array<double>, y int").repartition(5)
    seeds = 12
    beta = fit_splits(split_table(df, "doc", "v", "y", 3, 0.2, list(range(seeds))), 3, seeds)
    got = {r.seed: r for r in scored_splits(df, "doc", "v", "y", 3, seeds=seeds).collect()}
    z, shares = np.hstack([x, np.ones((300, 1))]), []
    for s in range(seeds):
        held = {r.doc for r in M.train_test_split(df.where("doc < 900"), "doc", 0.2, s).where("is_test").collect()}
        train = np.array([i not in held for i in range(300)])
        b = np.zeros(4)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-z[train] @ b))
            b -= np.linalg.solve((z[train].T * (mu * (1 - mu))) @ z[train] + np.eye(4), z[train].T @ (mu - y[train]) + b)
        assert np.allclose(beta[s], b, atol=1e-6)
        hits = int(((z[~train] @ b > 0) == (y[~train] == 1)).sum())
        assert (got[s].n_train, got[s].n_test, got[s].hits) == (300 - len(held), len(held), hits)
        shares.append(hits / len(held))
    assert abs(got[0].mean_accuracy - np.mean(shares)) < 1e-12


def test_splits_of_empty_and_one_class_tables(spark):
    from clausegrid.learn.splits import scored_splits

    empty = spark.createDataFrame([], "doc int, v array<double>, y int")
    assert {(r.n_train, r.n_test, r.accuracy, r.mean_accuracy) for r in scored_splits(empty, "doc", "v", "y", 2, seeds=3).collect()} == {(0, 0, None, None)}
    ones = spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(40)], "doc int, v array<double>, y int")
    assert all(r.accuracy == 1.0 for r in scored_splits(ones, "doc", "v", "y", 2, seeds=3).collect())


def test_split_is_stable_and_complete(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc")
    a = {r.doc: r.is_test for r in M.train_test_split(df, "doc", 0.25, 3).collect()}
    b = {r.doc: r.is_test for r in M.train_test_split(df.repartition(13), "doc", 0.25, 3).collect()}
    assert a == b and len(a) == 4000 and 0.2 < sum(a.values()) / 4000 < 0.3


def test_spans(spark):
    text = "Each Party shall  act now"
    df = spark.createDataFrame([(1, text)], "id int, t string").withColumn(
        "s", F.expr("array(named_struct('start', 2L, 'end', 17L, 'label', 'RIGHT'), named_struct('start', 11L, 'end', 21L, 'label', 'RIGHT'), "
                    "named_struct('start', 17L, 'end', 25L, 'label', 'OBLIGATION'), named_struct('start', 0L, 'end', 4L, 'label', 'PARTY'))"))
    got = N.prepare_spans(df, "id", "t", "s", ["RIGHT", "OBLIGATION"], "OBLIGATION").collect()
    assert [text[r.start : r.end] for r in got] == ["Party shall", "act now"]
    act = N.action_decompose(spark.createDataFrame([(1, "If needed, each Party shall not impose new duties. Nothing.")], "id int, t string"), "id", "t")
    first = act.where("pos = 0").first()
    assert (first.condition, first.subject, first.modal, first.verb, first.object) == ("If needed", "each Party", "shall not", "impose", "new duties")
    assert act.where("pos = 1").first().verb is None


def test_embeddings_share_equal_texts(spark):
    df = spark.createDataFrame([(1, "Rules of origin"), (2, "rules of ORIGIN!"), (3, "customs"), (4, None)], "id int, t string")
    got = {r.id: np.array(r.embedding) for r in embed(df, "id", "t", dims=32).collect()}
    assert np.allclose(got[1], got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-9 and not got[4].any()
    wide, narrow = ({r.id: np.array(r.embedding) for r in embed(df, "id", "t", dims=n).collect()} for n in (230, 112))
    head = wide[3][:112] / np.linalg.norm(wide[3][:112])  # further dimensions leave the first ones as they are
    assert len(wide[3]) == 230 and np.allclose(head, narrow[3]) and len({tuple(np.sign(wide[3][k : k + 112])) for k in (0, 112)}) == 2
    user = embed_with(df, "id", "t", lambda ts: np.array([[len(t), 1.0] for t in ts]))
    assert {r.id: r.embedding for r in user.collect()}[3] == [7.0, 1.0]


def test_scaled_and_projected(cloud, spark):
    x, df = cloud
    z = np.array([r.vec for r in U.scale_features(df, "id", "vec").orderBy("id").collect()])
    assert np.allclose(z, (x - x.mean(0)) / x.std(0))
    comp, share = U.pca_reduce(df, "id", "vec", 2)
    c = np.array([r.components for r in comp.orderBy("id").collect()])
    val = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(c.var(0, ddof=1), val[:2]) and np.allclose(share, val[:2] / val.sum())


def test_files(spark, tmp_path):
    for folder, name, body in [("acfta", "Chapter 1", "one\ntwo"), ("acfta", "Annex 2", "no"), (".git", "x", "no"), ("b fta", "Part é", "three")]:
        (tmp_path / "texts" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "texts" / folder / f"{name}.txt").write_text(body, encoding="utf-8")
    (tmp_path / "texts" / "acfta" / "mothertext.pdf").write_text("no")
    got = {(r.fta_name, r.title, r.text) for r in S.read_corpus(spark, str(tmp_path / "texts")).collect()}
    assert got == {("acfta", "Chapter 1", "one\ntwo"), ("b fta", "Part é", "three")}
    (tmp_path / "c.csv").write_bytes("﻿label,cat\n0,trade facilitation\n".encode())
    assert S.read_csv_typed(spark, str(tmp_path / "c.csv"), "label INT, cat STRING").collect()[0].label == 0
    tool = [{"data": {"text": '"Each shall"'}, "annotations": [{"result": [{"value": {"start": 0, "end": 4, "labels": ["RIGHT", "x"]}}]}]}]
    (tmp_path / "a.json").write_text(json.dumps(tool))
    row = S.read_annotations(spark, str(tmp_path / "a.json"), multiline=True).first()
    assert (row.text, row.start, row.end, row.label) == ("Each shall", 0, 4, "RIGHT")


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from clausegrid import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.scratch_root(Session())


def test_a_held_base_shuffles_no_vector(spark):
    """Ties, repeated query ids and more neighbours asked for than there are, the same by both ways."""
    base = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)], "id long, vec array<double>")
    query = spark.createDataFrame([(i % 20, [i % 5 + 0.5, 1.0]) for i in range(40)], "id long, vec array<double>")
    b, q = (V.points(df, "id", "vec", None, "euclidean") for df in (base, query))
    for k in (7, 50):
        ways = [V.knn(q, b, k, block=8, held_bytes=n) for n in (0, V.HELD_BYTES)]
        one, two = (sorted((r.id, r["rank"], r.nid, r.d) for r in w.collect()) for w in ways)
        assert one == two
    plan = ways[1]._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line and "v#" in line]
    assert not moved


@pytest.mark.parametrize("held", [0, V.HELD_BYTES])
def test_knn_tells_near_copies_apart(spark, held):
    base = spark.createDataFrame([(1, [1000.0, 1000.0]), (2, [1000.0005, 1000.0])], "id long, vec array<double>")
    query = spark.createDataFrame([(9, [1000.0004999, 1000.0])], "id long, vec array<double>")
    got = V.knn(V.points(query, "id", "vec", None, "euclidean"), V.points(base, "id", "vec", None, "euclidean"), 1, held_bytes=held).first()
    assert got.nid == 2 and abs(got.d - 1e-7) < 1e-9


def test_sparse_order_and_one_key_spread_over_ranges(spark):
    """Order values far apart, and no key at all: sums equal the plain running sum."""
    df = spark.range(1000).select((F.col("id") * 100_003).alias("pos"), (F.col("id") % 7).alias("v"))
    got = {r.pos: r.s for r in scan.running_sum(df, [], "pos", "v", "s").collect()}
    assert [got[i * 100_003] for i in range(1000)] == list(np.cumsum(np.arange(1000) % 7))


def test_csv_lines_keep_breaks_and_backslashes(spark, tmp_path):
    from clausegrid.sources import files

    texts = ["a\nb", "c\\nd", "\\", "e\r\nf \"q\"", "\\b\\", " lead, trail ", "", "\\0", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    files.write_csv(df, str(tmp_path / "c"), one_line=True)
    back = files.read_csv_typed(spark, str(tmp_path / "c"), "id LONG, text STRING", one_line=True)
    assert {r.id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_sparse_agreement_rows_give_the_same_counts(spark):
    from clausegrid import fixtures as fx
    from clausegrid.operators import panel as P

    held = fx.agreements(spark, "/root/testdata/sf0.001")
    rows = P.agreement_rows(held, 1999, 2001)
    long = P.unpivot_agreements(rows)
    key = lambda df, c: sorted(tuple(r) for r in df.select("party_a", "party_b", "year", *c).collect())
    assert key(long, ["rta_id", "active"]) == key(P.agreement_pair_years(held, 1999, 2001), ["rta_id", "active"])
    summed = long.groupBy("party_a", "party_b", "year").agg({"active": "sum"}).withColumnRenamed("sum(active)", "active_agreements")
    assert key(summed, ["active_agreements"]) == key(P.active_count(held, 1999, 2001), ["active_agreements"])
    assert all(r.agreements == sorted(r.agreements) for r in rows.collect())


def test_active_count_query_goes_through_the_whole_matrix(spark):
    from clausegrid.catalog import QUERIES
    from clausegrid.operators import panel as P

    rows = spark.createDataFrame(
        [("a", "b", 2000, [1, 9, 17], [1, 1, 0]), ("a", "b", 2001, [1, 9, 17], [0, 0, 0])],
        "party_a string, party_b string, year int, agreements array<int>, active array<int>",
    )
    counted = P.count_active(P.unpivot_agreements(rows))
    assert sorted((r.year, r.active_agreements) for r in counted.collect()) == [(2000, 2), (2001, 0)]
    plan = QUERIES["active_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" in plan and "collect_list" in plan


def _copies_a_row(spark, n):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(np.random.default_rng(5).normal(size=(n, 3)))]
    p = V.points(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", None, "euclidean")
    base, cells = V.build_cells(p, 16)
    everywhere = V._probe(p.select("id", "v", "g"), cells, lambda dist, radius, size, _: np.ones(len(dist), dtype=bool))
    return everywhere.count() / n


def test_copies_of_vectors_grow_with_the_rows_only(spark):
    assert _copies_a_row(spark, 4000) <= 3 * V.BLOCKS >= _copies_a_row(spark, 400)


def test_near_decides_by_differences_where_single_precision_does_not(spark):
    rng = np.random.default_rng(6)
    b = rng.normal(size=(300, 8)) + 100
    a = np.concatenate([b[:50] + np.eye(8)[0] * 0.5, b[50:100] + np.eye(8)[0] * (0.5 + 1e-9), rng.normal(size=(40, 8)) + 100])
    got = np.concatenate([close for _, close in V.Near(b).within(a, 0.5 + 1e-12)])
    assert (got == (np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) <= 0.5 + 1e-12)).all()


def test_span_ends_are_read_from_the_end(spark):
    from clausegrid.operators import spans as N

    texts = [(0, "shall pay" + " " * 400, 400), (1, "the " + "x" * 400 + "yz", 300), (2, "a b", 3), (3, "", 0), (4, "word " * 200 + "end", 1001)]
    rows = spark.createDataFrame(texts, "id long, text string, stop long")
    rows = rows.selectExpr("id", "text", "array(named_struct('start', 0L, 'end', stop, 'label', 'RIGHT')) AS spans")
    got = {r.id: (r.start, r.end) for r in N.prepare_spans(rows, "id", "text", "spans", ["RIGHT"], "RIGHT").collect()}
    assert got == {0: (0, 9), 1: (0, 3), 2: (0, 3), 4: (0, 999)}
    assert N._END == 256


def test_tokens_counted_a_row_at_a_time(spark):
    from clausegrid.functions.text import tokens
    from clausegrid.operators.tokens import counted_tokens

    rows = spark.createDataFrame([(1, "a b a\x1cc"), (1, " a "), (None, "d d"), (2, ""), (3, None)], "id int, text string")
    want = rows.select("id", F.explode(tokens("text")).alias("token")).groupBy("id", "token").count()
    got = counted_tokens(rows, "id", "text").groupBy("id", "token").agg(F.sum("n").alias("count"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pairs_meet_the_phrases_before_they_are_shuffled(spark):
    from clausegrid.operators.tokens import append_bigrams

    rows = spark.createDataFrame([(1, "a b a b c"), (2, "b c")], "id int, text string")
    got = append_bigrams(rows, "id", "text", spark.createDataFrame([("a", "b")], "token_a string, token_b string"))
    assert [tuple(r) for r in got.collect()] == [(1, "a_b", 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("HashAggregate") < plan.index("BroadcastHashJoin")


def test_perplexity_from_the_topic_distributions(spark):
    """The value of the model's own method (which starts each text elsewhere, so a little apart), from the distributions that are
    there; texts without known words count nothing."""
    import math

    from pyspark.ml.clustering import LDA

    from clausegrid.learn.cluster import _log_gamma, log_perplexity, word_vectors

    assert np.allclose(_log_gamma([1e-3, 0.1, 1.0, 2.5, 7.99, 8.0, 300.0]), [math.lgamma(x) for x in [1e-3, 0.1, 1.0, 2.5, 7.99, 8.0, 300.0]], rtol=1e-12, atol=1e-12)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 40, rng.integers(1, 60)) + 20 * (i % 3))) for i in range(120)]
    df = spark.createDataFrame([*rows, (900, ""), (901, "once")], "doc int, text string").repartition(3)
    data = word_vectors(df, "doc", "text", 30)
    for k in (2, 5):
        model = LDA(k=k, seed=7, maxIter=4).fit(data)
        assert abs(log_perplexity(model, model.transform(data), 1.0 / k) / model.logPerplexity(data) - 1) < 1e-4


def test_affinity_of_all_pairs_equals_dense_algorithm(spark):
    """Every pair of a group counts, not the nearest of a row; groups in one task and in blocks agree."""
    from clausegrid.learn import dense

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    rows = [(i, [float(v) for v in r], i // 30) for i, r in enumerate(x)] + [(40, [0.0, 0.0, 0.0], None), (41, None, 0)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp int")
    nodes = df.select(F.col("grp").cast("string").alias("g"), "id")
    pairs = U.neighbour_similarities(df, "id", "vec", "grp")
    got = {r.id: r.exemplar for r in U.affinity(pairs, nodes, untie=True).collect()}
    want = {40: 40, 41: 41}  # alone, and without a vector
    for part in (np.arange(30), np.arange(30, 40)):
        s = -pairwise(x[part]) ** 2
        np.fill_diagonal(s, np.median(s[~np.eye(len(part), dtype=bool)]))
        want.update(zip(part.tolist(), part[dense_affinity(s, 200)].tolist()))
    assert got == want
    cut = dense.dense_affinity(pairs, nodes, None, 0.5, 2000, 15, False, True, pairs=150, block_pairs=400)
    assert {r.id: r.exemplar for r in cut.collect()} == want
    with pytest.raises(RuntimeError, match="settle"):
        U.affinity(pairs, nodes, rounds=10)


def test_equal_rows_and_repeated_ids_have_exemplars(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], "a") for i in range(3)] + [(7, [5.0, 5.0], "b"), (8, [0.0, 1.0], "a"), (8, [0.0, 1.0], "a")], "id long, vec array<double>, g string")
    got = sorted((r.id, r.exemplar) for r in U.affinity(U.neighbour_similarities(df, "id", "vec", "g"), df.select("g", "id"), untie=True, partial=True).collect())
    assert [i for i, _ in got] == [0, 1, 2, 7, 8, 8] and got[3] == (7, 7)


def test_topics_learn_from_all_texts(spark):
    """Two sets of words that never meet: every text finds the topic of its set, and the words are well foretold."""
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 12, 30))) for i in range(120)]
    out, perplexity = U.lda_topics(spark.createDataFrame(texts, "id long, t string"), "id", "t", k=2)
    rows = out.collect()
    sides = [{r.topic for r in rows if r.id % 2 == j} for j in (0, 1)]
    assert len(rows) == 120 and [len(s) for s in sides] == [1, 1] and sides[0] != sides[1]
    assert min(r.weight for r in rows) > 0.9 and perplexity < 2.59  # 2.64 with rounds over a twentieth of the texts


def test_chosen_topics_have_the_bound_of_their_distributions(spark, monkeypatch):
    """The model's own method makes the expectations of the whole vocabulary for each text, so it is not called."""
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{w}" for w in rng.integers(0, 40, 25) + 20 * (i % 3))) for i in range(90)]
    df = spark.createDataFrame(texts, "id long, t string")
    data = U.word_vectors(df, "id", "t", 20000)
    want = {k: U._lda(data, k, 7, 4).logPerplexity(data) for k in (2, 3)}
    monkeypatch.setattr(U, "word_vectors", lambda *_: data)  # a round draws by the layout of the table
    monkeypatch.delattr(U.LDAModel, "logPerplexity")
    rows = U.choose_topics(df, "id", "t", [2, 3], rounds=4).collect()
    assert {r.k: r.log_perplexity for r in rows} == pytest.approx(want, rel=0.01)


def test_only_shared_remainders_move(spark):
    few = spark.createDataFrame([("tarif",), ("qu0ta",)], "a string")
    many = spark.createDataFrame([(f"filler number {i}",) for i in range(300)] + [("tariff",), ("quota",)], "b string")
    for left, right, cols in ((few, many, "ab"), (many, few, "ba")):
        joined = E.edit_join(left, cols[0], right, cols[1], 2)
        assert {(r.a, r.b, r.distance) for r in joined.collect()} == {("tarif", "tariff", 1), ("qu0ta", "quota", 1)}
        assert "bitmap_construct_agg" in joined._jdf.queryExecution().optimizedPlan().toString()
