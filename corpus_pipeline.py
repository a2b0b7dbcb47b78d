"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all its predecessor kept. The filters drop rows and return the columns of documents as they
came; input columns that share a name with an operator's result are set aside and put back. Rows with a null
doc_id take part where a text is all that counts and are never taken for copies of others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm import bpe, decontam, language, neardup, toxicity
from clausegrid.operators.sieve import sifted
from clausegrid.session import load, materialize, passing_tables

#: Texts are copies from this similarity of their word shingles on.
COPY_PERCENT = 80


def _passing(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], passes: Column, made: tuple[str, ...]) -> DataFrame:
    """Rows that pass; ``made`` are the columns that the judge adds."""
    aside = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c.lower() in made}
    judged = judge(docs.withColumnsRenamed(aside)).filter(passes)
    return judged.drop(*made).withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go; null and empty texts are among them. Texts that mix languages stay."""
    model = language.fit(language.draw(docs))
    return _passing(docs, lambda d: language.predict(d, model), F.col("lang_pred") != language.UNKNOWN, ("lang_pred", "score", "spans"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts at or over the toxicity threshold go."""
    model = toxicity.fit(*toxicity.draw(docs, load(spark, sf_dir, "labels")))
    return _passing(docs, lambda d: toxicity.score(d, model), F.col("predicted") == 0, ("score", "predicted"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays; of repeated rows (doc_id and text) one stays.
    Rows of a repeated doc_id are judged each by its own text. Only rows whose doc_id may be repeated or of a copy move."""
    with passing_tables(spark):
        judged = neardup.near_duplicates(docs.select("doc_id", "text"), percent=COPY_PERCENT, named=True)
        judged = materialize(judged.select("doc_id", "sid", "kept"), "kept", lasting=True)
    gone = judged.filter(~F.col("kept")).select("doc_id", "sid").distinct()
    again = materialize(judged.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    docs, stay = sifted(docs, "doc_id", gone.select("doc_id").union(again))
    left = docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return stay.union(left)
    once = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    names = neardup.sketches(once.select("text").distinct(), "text", "text").select(F.col("id").alias("text"), "sid")
    copies = gone.join(again, "doc_id").join(names, "sid").select("doc_id", "text")
    once = once.join(copies, ["doc_id", "text"], "left_anti").select(*docs.columns)
    return stay.union(left.join(again, "doc_id", "left_anti").select(*docs.columns)).union(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go."""
    items = load(spark, sf_dir, "benchmark")
    return _passing(docs, lambda d: decontam.find_items(d, items), ~F.col("contaminated"), ("item_ids", "likeness", "contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the packed ids."""
    return bpe.encode_decode(docs, bpe.vocabulary_path())


STAGES = [
    ("language", keep_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Learned classifiers and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
