"""Scaling, projection and clustering of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans, LDAModel
from pyspark.ml.feature import PCA, CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.econ.glm import _digamma
from clausegrid.functions.text import tokens
from clausegrid.learn.dense import AllPairs, dense_affinity
from clausegrid.operators.labels import shortest_name
from clausegrid.operators.scan import global_index
from clausegrid.operators.vectors import components, dbscan, dot, knn, points
from clausegrid.session import materialize


def as_vector(col: str):
    return array_to_vector(F.col(col).cast("array<double>"))


def scale_features(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec): z-scores per dimension, with the population deviation; constant dimensions become 0."""
    rows = df.select(key, F.col(vec).cast("array<double>").alias(vec))
    stats = rows.select(Summarizer.metrics("mean", "std", "count").summary(as_vector(vec)).alias("s")).first()["s"]
    mean, n = stats["mean"].toArray(), stats["count"]
    std = stats["std"].toArray() * (((n - 1) / n) ** 0.5 if n > 1 else 0.0)
    m, s = F.lit([float(x) for x in mean]), F.lit([float(x) if x > 0 else 1.0 for x in std])
    z = F.zip_with(F.zip_with(vec, m, lambda x, a: x - a), s, lambda x, b: x / b)
    return rows.select(key, z.alias(vec))


def pca_reduce(df: DataFrame, key: str, vec: str, k: int) -> tuple[DataFrame, list[float]]:
    """(key, components) of the centred data, and the explained variance shares."""
    rows = df.select(key, as_vector(vec).alias("v"))
    mean = rows.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    centre = F.zip_with(vector_to_array("v"), F.lit([float(x) for x in mean]), lambda x, m: x - m)
    centred = rows.select(key, array_to_vector(centre).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    return model.transform(centred).select(key, vector_to_array("p").alias("components")), list(model.explainedVariance)


def kmeans_sweep(df: DataFrame, vec: str, ks: list[int], seed: int = 7) -> DataFrame:
    """(k, cost): within-cluster sum of squares for each k."""
    rows = df.select(as_vector(vec).alias("features")).cache()
    costs = [(k, float(KMeans(k=k, seed=seed, maxIter=20).fit(rows).summary.trainingCost)) for k in ks]
    rows.unpersist()
    return df.sparkSession.createDataFrame(costs, "k int, cost double")


def kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 7) -> DataFrame:
    rows = df.select(key, as_vector(vec).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def two_way_tree(df: DataFrame, key: str, vec: str, k: int = 2, seed: int = 7) -> DataFrame:
    """Top-down clustering into k leaves."""
    rows = df.select(key, as_vector(vec).alias("features"))
    model = BisectingKMeans(k=k, seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster"))


def word_vectors(df: DataFrame, key: str, col: str, vocabulary: int) -> DataFrame:
    """(key, features): counts of the most frequent words seen in two texts or more. Written once."""
    rows = df.select(key, tokens(F.lower(col)).alias("words"))
    vectorizer: CountVectorizerModel = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2).fit(rows)
    return materialize(vectorizer.transform(rows).select(key, "features"), "features")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function: Stirling's series from 8 on, smaller values by the recurrence."""
    x = np.asarray(x, float)
    step = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        step, x = step - np.where(small, np.log(np.where(small, x, 1.0)), 0.0), x + small
    z = 1 / (x * x)
    return step + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x


def log_perplexity(model: LDAModel, scored: DataFrame, eta: float) -> float:
    """Log perplexity of rows with features and topicDistribution, by the bound of ``model.logPerplexity``.

    That method infers each text's topics from another start, so it differs in the fifth digit or beyond. A text's topic weights add up to its words and the prior, so its distribution gives them back. The words' expectations are
    made once, where the model's own method makes those of the whole vocabulary for every text. ``eta`` is the prior of the words.
    """
    topics, alpha = model.topicsMatrix().toArray(), model.estimatedDocConcentration().toArray()
    words, prior = _digamma(topics) - _digamma(topics.sum(0)), alpha.sum()
    sent = scored.sparkSession.sparkContext.broadcast(words)

    def part(batches):
        words, bound, tokens = sent.value, 0.0, 0.0
        for batch in batches:
            for dist, at, counts in zip(batch["dist"], batch["indices"], batch["values"]):
                tokens += counts.sum()
                if not counts.any():
                    continue
                weight = dist * (prior + counts.sum())
                topic = _digamma(weight) - _digamma(weight.sum())
                each = topic + words[at]
                top = each.max(1)
                bound += counts @ (top + np.log(np.exp(each - top[:, None]).sum(1))) + ((alpha - weight) * topic).sum()
                bound += (_log_gamma(weight) - _log_gamma(alpha)).sum() + _log_gamma(prior) - _log_gamma(weight.sum())
        yield pd.DataFrame({"bound": [float(bound)], "tokens": [float(tokens)]})

    rows = scored.select(vector_to_array("topicDistribution").alias("dist"), F.unwrap_udt("features").alias("f"))
    rows = rows.select("dist", "f.indices", "f.values").mapInPandas(part, "bound double, tokens double")
    total = rows.agg(F.sum("bound"), F.sum("tokens")).first()
    bound = total[0] + ((eta - topics) * words).sum() + (_log_gamma(topics) - _log_gamma(eta)).sum()
    bound += (_log_gamma(eta * len(topics)) - _log_gamma(topics.sum(0))).sum()
    return float(-bound / total[1])


def _lda(data: DataFrame, k: int, seed: int, rounds: int, **how: float) -> LDAModel:
    return LDA(k=k, seed=seed, maxIter=rounds, topicConcentration=1.0 / k, **how).fit(data)


def lda_topics(df: DataFrame, key: str, col: str, k: int = 10, seed: int = 7, vocabulary: int = 20000, passes: int = 20):
    """((key, topic, weight), log perplexity): the strongest of k topics per text. Each pass learns from all texts, and the first
    ones move the topics most; otherwise a round would draw a twentieth of the texts and move the topics by 3 %."""
    data = word_vectors(df, key, col, vocabulary)
    model = _lda(data, k, seed, passes, subsamplingRate=1.0, learningOffset=1.0)
    scored = model.transform(data)
    dist = vector_to_array("topicDistribution")
    best = F.array_max(dist)
    out = scored.select(key, (F.array_position(dist, best) - 1).cast("int").alias("topic"), best.alias("weight"))
    return out, log_perplexity(model, scored, 1.0 / k)


def choose_topics(df: DataFrame, key: str, col: str, ks: list[int], seed: int = 7, vocabulary: int = 20000, rounds: int = 10) -> DataFrame:
    """(k, log_perplexity) for each k; the smallest value is the choice. The words are counted once for all k."""
    data = word_vectors(df, key, col, vocabulary)
    models = ((k, _lda(data, k, seed, rounds)) for k in ks)
    rows = [(k, log_perplexity(model, model.transform(data), 1.0 / k)) for k, model in models]
    return df.sparkSession.createDataFrame(rows, "k int, log_perplexity double")


def topic_representatives(df: DataFrame, key: str, vec: str, topic: str, k: int = 3) -> DataFrame:
    """(topic, key, similarity, rank): the k rows closest to the centre of their topic, by cosine."""
    p = points(df, key, vec, topic, "euclidean", carry=[topic])
    centre = p.groupBy(topic).agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("c"))
    cosine = dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("c"), F.col("c")))
    scored = p.join(centre, topic).select(topic, F.col("id").alias(key), F.round(cosine, 9).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("similarity"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def density_merge(df: DataFrame, key: str, name: str, vec: str, group: str, eps: float) -> DataFrame:
    """(key, label, merged): names of one group that are close in cosine share the shortest one."""
    labels = dbscan(df, key, vec, eps, 2, metric="cosine", group=group)
    named = df.select(key, name).join(labels, key)
    return shortest_name(named, "label", name, "merged").select(key, "label", "merged")


def neighbour_similarities(df: DataFrame, key: str, vec: str, group: str | None, k: int | None = None, block: int = 2048) -> DataFrame | AllPairs:
    """(g, i, k, s): similarity (negative squared distance) to the k nearest rows of the same group; without ``k`` to all of
    them, which ``affinity`` takes without a row for a pair."""
    p = points(df, key, vec, group, "euclidean")
    if k is None:
        return AllPairs(p)
    near = knn(p, p, k, exclude_self=True, block=block)
    return near.join(p.select("id", "g"), "id").select(
        "g", F.col("id").alias("i"), F.col("nid").alias("k"), (-F.col("d") * F.col("d")).alias("s")
    )


def group_medians(edges: DataFrame) -> DataFrame:
    """(g, median) of the similarities; exact, by position in a distributed sort."""
    ranked = global_index(edges.select("g", "s", "i", "k"), [F.col("g"), F.col("s"), F.col("i"), F.col("k")], "pos")
    bounds = ranked.groupBy("g").agg(F.min("pos").alias("lo"), F.count(F.lit(1)).alias("n"))
    mid = ranked.join(bounds, "g").withColumn("at", F.col("pos") - F.col("lo"))
    half = mid.where((F.col("at") == F.floor((F.col("n") - 1) / 2)) | (F.col("at") == F.floor(F.col("n") / 2)))
    return half.groupBy("g").agg(F.avg("s").alias("median"))


#: Similarities of one component that a task may hold, with their messages.
MAX_PART = 2_000_000


class _Messages:
    """The messages of whole components, in arrays: the same rounds as in ``_settled_joins``."""

    def __init__(self, rows: pd.DataFrame):
        ids = pd.factorize(pd.concat([rows["i"], rows["k"]], ignore_index=True))[0]
        order = np.argsort(ids[: len(rows)], kind="stable")
        self.rows = rows.iloc[order].reset_index(drop=True)
        self.i, self.k = ids[: len(rows)][order], ids[len(rows) :][order]
        self.t, self.r, self.a = (self.rows[c].to_numpy(dtype="float64").copy() for c in "tra")
        self.own = self.i == self.k
        self.begin = np.flatnonzero(np.diff(self.i, prepend=-1))
        self.seg = np.cumsum(np.diff(self.i, prepend=-1) != 0) - 1
        self.n = int(ids.max()) + 1

    def marks(self) -> np.ndarray:
        return self.own & (self.r + self.a > 0)

    def round(self, keep: float) -> None:
        new = 1.0 - keep
        total = self.a + self.t
        best = np.maximum.reduceat(total, self.begin)
        top = np.flatnonzero(total == best[self.seg])
        rest = total.copy()
        rest[top[np.diff(self.seg[top], prepend=-1) > 0]] = -np.inf  # the first of the best
        following = np.maximum.reduceat(rest, self.begin)
        following[np.isneginf(following)] = 0.0  # no other offer
        other = np.where(total >= best[self.seg], following[self.seg], best[self.seg])
        self.r = keep * self.r + new * (self.t - other)
        mine = np.maximum(self.r, 0.0)
        support = np.bincount(self.k, np.where(self.own, 0.0, mine), self.n)
        selves = np.full(self.n, -np.inf)
        np.maximum.at(selves, self.k[self.own], self.r[self.own])
        selves[np.isneginf(selves)] = np.inf
        avail = np.where(self.own, support[self.k], np.minimum(0.0, selves[self.k] + support[self.k] - mine))
        self.a = keep * self.a + new * avail


def _rounds_in_parts(state: DataFrame, first: int, last: int, keep: float) -> DataFrame:
    """Messages after the rounds ``first`` + 1 to ``last`` and, for every fifth round, a row per part with its number of
    exemplars and whether they changed. Written once."""
    cols = ["i", "k", "s", "t", "r", "a", "part"]
    schema = ", ".join([f"{c} {t}" for c, t in state.select(*cols).dtypes] + ["check int", "marks long", "changed boolean"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = _Messages(rows)
        before, seen = m.marks(), []
        for it in range(first + 1, last + 1):
            m.round(keep)
            if it % 5 == 0:
                now = m.marks()
                seen.append((rows["part"].iloc[0], it, int(now.sum()), bool((now != before).any())))
                before = now
        out = m.rows[cols].assign(r=m.r, a=m.a, check=None, marks=None, changed=None)
        notes = pd.DataFrame(seen, columns=["part", "check", "marks", "changed"]).reindex(columns=out.columns)
        return pd.concat([out.astype(object), notes.astype(object)], ignore_index=True)

    return materialize(state.select(*cols).groupBy("part").applyInPandas(run, schema), "messages")


def _settled_parts(state: DataFrame, keep: float, rounds: int, settle: int, span: int = 100) -> tuple[DataFrame, bool]:
    """Rounds until the exemplars of all parts together stay the same for ``settle`` rounds, and whether they did."""
    start, quiet, known = 0, 0, False
    while start < rounds:
        upto = min(start + span, rounds)
        after = _rounds_in_parts(state, start, upto, keep)
        notes = after.where(F.col("check").isNotNull()).groupBy("check").agg(F.sum("marks"), F.max("changed")).orderBy("check").collect()
        for it, marks, changed in notes:
            quiet = quiet + 5 if known and not changed and marks else 0
            known = True
            if quiet >= settle:
                if it < upto:
                    after = _rounds_in_parts(state, start, it, keep)
                return after.where(F.col("check").isNull()), True
        state, start = after.where(F.col("check").isNull()), upto
    return state, False


def _settled_joins(state: DataFrame, keep: float, rounds: int, settle: int) -> tuple[DataFrame, bool]:
    """The same rounds by joins, for components of any size."""
    new = 1.0 - keep
    before, quiet = None, 0
    for it in range(1, rounds + 1):
        total = F.col("a") + F.col("t")
        # best and second-best offer per row; the two are picked ahead of the shuffle
        rival = Window.partitionBy("i").orderBy(F.desc("_o"))
        offers = state.select("i", total.alias("_o")).withColumn("_n", F.row_number().over(rival)).where(F.col("_n") <= 2)
        top = offers.groupBy("i").agg(F.max("_o").alias("_best"), F.max(F.when(F.col("_n") == 2, F.col("_o"))).alias("_next"))
        other = F.coalesce(F.when(total >= F.col("_best"), F.col("_next")).otherwise(F.col("_best")), F.lit(0.0))
        sent = state.join(top, "i").withColumn("r", keep * F.col("r") + new * (F.col("t") - other)).drop("_best", "_next")
        # a candidate may be named by any number of rows, so its messages are aggregated and joined back
        support = sent.groupBy("k").agg(
            F.sum(F.when(F.col("i") != F.col("k"), F.greatest("r", F.lit(0.0))).otherwise(0.0)).alias("_sum"),
            F.max(F.when(F.col("i") == F.col("k"), F.col("r"))).alias("_rkk"),
        )
        mine = F.greatest("r", F.lit(0.0))
        avail = F.when(F.col("i") == F.col("k"), F.col("_sum")).otherwise(
            F.least(F.lit(0.0), F.col("_rkk") + F.col("_sum") - mine)
        )
        state = sent.join(support, "k").withColumn("a", keep * F.col("a") + new * avail).select("i", "k", "s", "t", "r", "a")
        state = materialize(state, "messages")
        if it % 5 == 0:
            marks = state.where((F.col("i") == F.col("k")) & (F.col("r") + F.col("a") > 0)).select("i")
            now = marks.agg(F.count(F.lit(1)), F.sum(F.xxhash64("i").cast("decimal(38,0)"))).first()
            quiet = quiet + 5 if now == before and now[0] else 0
            before = now
            if quiet >= settle:
                return state, True
    return state, False


def affinity(
    edges: DataFrame | AllPairs,
    nodes: DataFrame,
    preference: float | None = None,
    damping: float = 0.5,
    rounds: int = 2000,
    settle: int = 15,
    partial: bool = False,
    part_size: int = MAX_PART,
    untie: bool = False,
) -> DataFrame:
    """(id, exemplar): exemplar clustering by message passing over given similarities.

    ``edges`` (g, i, k, s) lists the similarities that exist, e.g. of nearest neighbours
    or of strings within some edits; with all pairs listed this is the dense algorithm. ``AllPairs`` stands for
    all pairs of a group: there each group settles on its own, its damping grows where the exemplars swing, and ``part_size`` does not matter.
    ``nodes`` (g, id). The preference is the median similarity of the group unless given.
    Messages never leave a component of the similarities. Where no component has more than MAX_PART of them, components are
    spread over tasks that run many rounds each; otherwise a round is one aggregation by row and one by candidate. Work per
    round is linear in the edges either way. Ends when the
    exemplars stay the same for ``settle`` rounds; running out of rounds is an error (a higher
    damping, such as 0.9, helps similarities with many ties), unless ``partial`` asks for the state reached. Equal
    similarities, as between copies, can swap exemplars for ever; with ``untie`` the messages see each similarity raised by a
    fixed share below 1e-12 (the choice among exemplars does not).
    """
    if isinstance(edges, AllPairs):
        return dense_affinity(edges, nodes, preference, damping, rounds, settle, partial, untie)
    if preference is None:
        medians = group_medians(edges)
        own = nodes.join(medians, "g", "left").select("g", F.col("id").alias("i"), F.col("id").alias("k"), F.coalesce("median", F.lit(0.0)).alias("s"))
    else:
        own = nodes.select("g", F.col("id").alias("i"), F.col("id").alias("k"), F.lit(float(preference)).alias("s"))
    state = edges.where("i != k").select("i", "k", "s").unionByName(own.select("i", "k", "s"))
    state = state.where(F.col("i").isNotNull() & F.col("k").isNotNull())
    shift = 1e-12 * F.pmod(F.xxhash64("i", "k"), F.lit(1_000_003)) / 1_000_003 if untie else F.lit(0.0)
    state = state.withColumn("t", F.col("s") * (1 + shift))
    state = materialize(state.withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0)), "messages")
    ids = state.select(F.col("i").alias("id")).union(state.select("k")).distinct()
    comp = components(state.where("i != k").select(F.col("i").alias("a"), F.col("k").alias("b")).distinct(), ids)
    sizes = materialize(state.select("i").join(comp.withColumnRenamed("id", "i"), "i").groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    if (largest or 0) <= part_size:
        cores = state.sparkSession.sparkContext.defaultParallelism
        parts = max(cores, 2 * (total or 0) // part_size)
        part = F.pmod(F.xxhash64("comp"), F.lit(parts)).cast("int").alias("part")
        state = materialize(state.join(comp.select(F.col("id").alias("i"), part), "i"), "messages")
        state, settled = _settled_parts(state, damping, rounds, settle)
    else:
        state, settled = _settled_joins(state, damping, rounds, settle)
    if not settled and not partial:
        raise RuntimeError(f"the exemplars did not settle in {rounds} rounds")
    exemplars = materialize(state.where((F.col("i") == F.col("k")) & (F.col("r") + F.col("a") > 0)).select(F.col("k")), "exemplars")
    choice = state.join(exemplars, "k").groupBy("i").agg(F.min_by("k", F.struct(-F.col("s"), F.col("k"))).alias("k"))
    selves = exemplars.select(F.col("k").alias("i"), F.col("k").alias("_self"))
    out = nodes.select(F.col("id").alias("i")).join(choice, "i", "left").join(selves, "i", "left")
    # a row with no exemplar among its listed similarities stands for itself
    return out.select(F.col("i").alias("id"), F.coalesce("_self", "k", "i").alias("exemplar"))
