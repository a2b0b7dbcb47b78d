"""Neighbour, pair and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.catalog.base import query
from clausegrid.catalog.text import clean_chain_sql, docs, tok
from clausegrid.functions.text import ascii_fold, tokens
from clausegrid.learn import classify as Y
from clausegrid.learn import cluster as U
from clausegrid.learn.embed import embed
from clausegrid.learn.splits import scored_splits as score_splits
from clausegrid.operators import edits as E
from clausegrid.operators import pairs as Q
from clausegrid.operators import vectors as V
from clausegrid.session import load

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
_DIST = "round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9)"


def vectors(spark, sf):
    return load(spark, sf, "embeddings")


@query("nearest_label", f"""WITH {_E}, s AS (SELECT a.vec_id, b.vec_id AS label_vec, round({_COS}, 9) AS c FROM e a JOIN e b
      ON a.label = b.label AND a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)
    SELECT vec_id, label_vec % 7 AS article, round(c, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label_vec) = 1""")
def nearest_label(spark, sf):
    e = vectors(spark, sf)
    known = e.where("vec_id % 3 <> 0").withColumn("article", F.col("vec_id") % 7)
    near = V.nearest_label(e.where("vec_id % 3 = 0"), known, "vec_id", "embedding", "label", "article")
    return near.withColumn("similarity", F.round("similarity", 6))


@query("knn_vote", f"""WITH {_E}, s AS (SELECT a.vec_id, b.label, {_DIST} AS d, b.vec_id AS nid FROM e a, e b WHERE a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0),
    n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, nid) <= 5),
    v AS (SELECT vec_id, label, count(*) AS c FROM n GROUP BY ALL)
    SELECT vec_id, label FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1""")
def knn_vote(spark, sf):
    e = vectors(spark, sf)
    return V.knn_vote(e.where("vec_id % 4 = 0"), e.where("vec_id % 4 <> 0"), "vec_id", "embedding", "label", 5)


@query("elementwise_similarity_stats", f"""WITH {_E}, s AS (SELECT a.vec_id, {_DIST} AS d FROM e a, e b WHERE a.vec_id <> b.vec_id),
    k AS (SELECT vec_id, d FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) = 10)
    SELECT round(d, 6) AS distance, row_number() OVER (ORDER BY d, vec_id) - 1 AS position FROM k""")
def elementwise_similarity_stats(spark, sf):
    from clausegrid.operators.scan import global_index

    curve = V.kth_distance(vectors(spark, sf), "vec_id", "embedding", 10)
    return global_index(curve, [F.col("d"), F.col("vec_id")], "position").select(F.round("d", 6).alias("distance"), "position")


@query("contrastive_pairs", """WITH an AS (SELECT quality, min(doc_id) AS anchor FROM labels GROUP BY quality)
    SELECT l.doc_id AS a, an.anchor AS b, CASE WHEN an.quality = l.quality THEN 0.9 ELSE 0.1 END::DOUBLE AS target
    FROM labels l JOIN an ON l.doc_id <> an.anchor""")
def contrastive_pairs(spark, sf):
    return Q.contrastive_pairs(load(spark, sf, "labels"), "doc_id", "quality")


@query("contrastive_pairs_light", """WITH an AS (SELECT label, min(vec_id) AS anchor FROM embeddings GROUP BY label)
    SELECT e.vec_id AS a, an.anchor AS b, 0.9::DOUBLE AS target FROM embeddings e JOIN an USING (label) WHERE e.vec_id <> an.anchor
    UNION ALL SELECT x.anchor, y.anchor, 0.1::DOUBLE FROM an x JOIN an y ON x.anchor < y.anchor""")
def contrastive_pairs_light(spark, sf):
    return Q.contrastive_pairs_light(vectors(spark, sf), "vec_id", "label")


@query("scale_features", f"""WITH {_E}, x AS (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS pos FROM e),
    s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY pos)
    SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((x - m) / s, 6) AS z FROM x JOIN s USING (pos)""")
def scale_features(spark, sf):
    z = U.scale_features(vectors(spark, sf), "vec_id", "embedding")
    return z.select("vec_id", F.posexplode("embedding").alias("pos", "z")).withColumn("z", F.round("z", 6))


@query("topic_representatives", f"""WITH {_E}, x AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM e),
    m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY pos) AS v FROM m GROUP BY label),
    s AS (SELECT a.label, a.vec_id, round({_COS}, 9) AS similarity FROM e a JOIN c b ON a.label = b.label),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT label, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 3""")
def topic_representatives(spark, sf):
    top = U.topic_representatives(vectors(spark, sf), "vec_id", "embedding", "label", 3)
    return top.withColumn("similarity", F.round("similarity", 6))


def embed_sql(source: str, key: str, text: str, dims: int = 64) -> str:
    """Twin of ``embed``: CTEs ending in ``embedded`` (key, v) for the rows of ``source``."""
    words = [f"CAST('0x' || substr(md5(token), {1 + 7 * b}, 7) AS BIGINT) AS h{b}" for b in range(-(-dims // 28))]
    sums = [f"sum(w * (1 - 2 * ((h{d // 28} >> {d % 28}) & 1)))" for d in range(dims)]
    return f"""cleaned AS (SELECT {key} AS key, {clean_chain_sql(text)} AS t FROM {source}),
    tfs AS (SELECT t, token, count(*) AS tf FROM (SELECT t, unnest({tok('t')}) AS token FROM (SELECT DISTINCT t FROM cleaned)) GROUP BY ALL),
    idfs AS (SELECT token, ln((1.0 + (SELECT count(DISTINCT t) FROM tfs)) / (1 + count(*))) + 1 AS idf, {', '.join(words)} FROM tfs GROUP BY token),
    summed AS (SELECT t, [{', '.join(sums)}] AS s FROM (SELECT t, tf * idf AS w, h0, h1, h2 FROM tfs JOIN idfs USING (token)) GROUP BY t),
    unit AS (SELECT t, CASE WHEN n > 0 THEN list_transform(s, lambda x: x / n) ELSE s END AS v FROM (SELECT *, sqrt(list_dot_product(s, s)) AS n FROM summed)),
    embedded AS (SELECT key, coalesce(v, list_transform(range({dims}), lambda x: 0.0::DOUBLE)) AS v FROM cleaned LEFT JOIN unit USING (t))"""


@query("embed_text", f"""WITH {embed_sql('documents', 'doc_id', 'text')}
    SELECT key AS doc_id, CAST(unnest(range(64)) AS INTEGER) AS pos, round(unnest(v), 6) AS value FROM embedded""")
def embed_text(spark, sf):
    """One row per dimension, as in ``scale_features``."""
    vectors = embed(docs(spark, sf), "doc_id", "text", dims=64)
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("pca_reduce")
def pca_reduce(spark, sf):
    return U.pca_reduce(vectors(spark, sf), "vec_id", "embedding", 25)[0]


@query("kmeans_elbow")
def kmeans_elbow(spark, sf):
    return U.kmeans_sweep(vectors(spark, sf), "embedding", list(range(30, 51)))


@query("kmeans_fixed")
def kmeans_fixed(spark, sf):
    return U.kmeans(vectors(spark, sf), "vec_id", "embedding", 41)


@query("hierarchical_clusters")
def hierarchical_clusters(spark, sf):
    return U.two_way_tree(vectors(spark, sf), "vec_id", "embedding")


def dbscan_sql(near: str, need: int) -> str:
    """Twin of ``dbscan``: CTEs ending in ``owned`` (id, label without noise), given all close pairs (a, b) with themselves."""
    return f"""near AS ({near}),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {need}),
    reach AS (SELECT id, id AS root FROM core UNION
      SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.id JOIN core c ON c.id = n.b),
    comp AS (SELECT id, min(root) AS comp FROM reach GROUP BY id),
    touched AS (SELECT * FROM comp UNION ALL
      SELECT n.a, min(c.comp) FROM near n JOIN comp c ON c.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a),
    owned AS (SELECT id, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM touched)"""


@query("dbscan", f"""WITH RECURSIVE {_E}, {dbscan_sql(f"SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE {_DIST} <= 0.7", 5)}
    SELECT vec_id, CAST(coalesce(o.label, -1) AS BIGINT) AS label FROM e LEFT JOIN owned o ON o.id = vec_id""")
def dbscan(spark, sf):
    return V.dbscan(vectors(spark, sf), "vec_id", "embedding", 0.7, 5)


@query("density_merge", f"""WITH RECURSIVE {_E},
    {dbscan_sql(f"SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND round({_COS}, 9) >= 0.85", 2)},
    named AS (SELECT vec_id, 'title ' || vec_id AS name, CAST(coalesce(o.label, -1) AS BIGINT) AS label FROM e LEFT JOIN owned o ON o.id = vec_id),
    short AS (SELECT label, name AS best FROM named WHERE label >= 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY length(name), name) = 1)
    SELECT vec_id, n.label, coalesce(best, name) AS merged FROM named n LEFT JOIN short s ON s.label = n.label""")
def density_merge(spark, sf):
    named = vectors(spark, sf).withColumn("name", F.concat(F.lit("title "), F.col("vec_id").cast("string")))
    return U.density_merge(named, "vec_id", "name", "embedding", "label", 0.15)


@query("affinity_propagation")
def affinity_propagation(spark, sf):
    e = vectors(spark, sf)
    edges = U.neighbour_similarities(e, "vec_id", "embedding", "label")  # all pairs
    nodes = e.select(F.col("label").cast("string").alias("g"), F.col("vec_id").alias("id"))
    return U.affinity(edges, nodes, damping=0.7, untie=True)  # copies of a vector are tied


@query("affinity_on_edit_distance")
def affinity_on_edit_distance(spark, sf):
    """Exemplars after 30 rounds: similarities of whole edits have many ties and take hundreds of rounds to settle."""
    words = load(spark, sf, "benchmark").select(F.explode(tokens(ascii_fold("text"))).alias("word")).distinct()
    near = E.edit_distance_pairs(words, "word", 2)
    s = F.col("similarity").cast("double").alias("s")
    edges = near.select(F.lit("").alias("g"), F.col("a").alias("i"), F.col("b").alias("k"), s).unionByName(
        near.select(F.lit("").alias("g"), F.col("b").alias("i"), F.col("a").alias("k"), s)
    )
    return U.affinity(edges, words.select(F.lit("").alias("g"), F.col("word").alias("id")), rounds=30, partial=True)


@query("classify_embeddings")
def classify_embeddings(spark, sf):
    return Y.classify_vectors(vectors(spark, sf), "vec_id", "embedding", "label", Y.vector_classifiers())


def labelled(spark, sf):
    return docs(spark, sf).join(load(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality")


@query("classify_text_train")
def classify_text_train(spark, sf):
    return Y.evaluate_text_classifier(labelled(spark, sf), "doc_id", "text", "quality")[1]


@query("classify_text_infer")
def classify_text_infer(spark, sf):
    model = Y.train_text_classifier(labelled(spark, sf), "text", "quality")
    names = {0: "isNotSubstantive", 1: "isSubstantive"}
    return Y.classify_text(model, docs(spark, sf).select("doc_id", "text"), "text", "isSubstantive_predict", names)


@query("scored_splits")
def scored_splits(spark, sf):
    """Accuracy on the held-out fifth of each of 100 random splits, and its mean."""
    known = load(spark, sf, "labels").select("doc_id", "quality").where(F.col("quality").isNotNull())
    texts = docs(spark, sf).select("doc_id", "text").join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    return score_splits(embed(texts, "doc_id", "text", dims=64).join(known, "doc_id"), "doc_id", "embedding", "quality", 64)


@query("lda_topics")
def lda_topics(spark, sf):
    return U.lda_topics(docs(spark, sf), "doc_id", "text", k=10)[0]


@query("choose_topics")
def choose_topics(spark, sf):
    return U.choose_topics(docs(spark, sf), "doc_id", "text", [5, 10])
