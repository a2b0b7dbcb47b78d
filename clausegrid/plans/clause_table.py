"""Corpus -> clause table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import segment as G
from clausegrid.functions import text as X
from clausegrid.operators import lookups as J
from clausegrid.operators import tokens as K
from clausegrid.operators.frames import blanks_to_null
from clausegrid.operators.scan import forward_fill
from clausegrid.session import materialize


def national_clauses(docs: DataFrame, agreement: str, title: str, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Text corpus -> (clause_no, agreement, title, chapter, article, clauseno, text).

    Articles found, titles inferred and filled down, titles taken out of the text, number words out
    of chapters, first copy of each clause kept, then numbers taken out of the text (clauses that differ
    in a number are no copies). Titles are filled within the sub-document too, as files have no order. With a
    (token, n) vocabulary, run-together words in the titles are split.
    """
    rows = G.text_clauses(docs, agreement, title, text)
    rows = rows.withColumn("article", G.infer_title("article", "clauseno", "text"))
    rows = blanks_to_null(rows).where(F.col("chapter").isNotNull())
    rows = materialize(rows, "clauses")
    rows = forward_fill(rows, [agreement, title, "chapter", "art_identifier"], "clauseno", "article")
    rows = rows.withColumn("text", F.trim(G.strip_leading_title("article", "text")))
    rows = rows.withColumn("chapter", X.strip_number_words(G.before_section("chapter")))
    if vocabulary is not None:
        vocabulary = materialize(vocabulary, "vocabulary")  # each split reads it twice
        rows = split_titles(split_titles(rows, "chapter", vocabulary), "article", vocabulary)
    place = F.struct(agreement, title, "art_identifier", "clauseno")
    first = rows.groupBy("text").agg(F.min(place).alias("_at")).select("_at.*")
    kept = rows.join(first, [agreement, title, "art_identifier", "clauseno"], "left_semi")
    return kept.withColumn("text", X.drop_cardinals("text")).select(agreement, title, "chapter", "article", "clauseno", "text")


def split_titles(df: DataFrame, col: str, vocabulary: DataFrame) -> DataFrame:
    """Split run-together words of a title column; titles are few, so they are repaired once each."""
    titles = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_id", F.md5(F.col(col).cast("binary")))
    titles = materialize(titles, "titles")
    words = titles.select(F.explode(X.tokens(col)).alias("word"))
    cuts = K.split_words(words, "word", vocabulary).select("word", F.coalesce(F.array_join("parts", " "), "word").alias("fixed"))
    repaired = K.map_tokens(titles, "_id", col, cuts, "word", "fixed", out="_fixed").join(titles, "_id").select(col, "_fixed")
    return df.join(repaired, col, "left").withColumn(col, F.coalesce("_fixed", col)).drop("_fixed")


def treaty_clauses(treaties: DataFrame) -> DataFrame:
    """Rows of ``read_treaties`` -> one row per clause with its number in the article."""
    cut = treaties.select("*", F.posexplode(G.inline_clauses(G.xml_text("text"))).alias("_i", "_clause"))
    return cut.withColumn("text", F.col("_clause")).withColumn("clauseno", F.col("_i") + 1).drop("_i", "_clause")


def fill_from_registry(clauses: DataFrame, registry: DataFrame, aliases: DataFrame, order: str = "fta_name") -> DataFrame:
    """Missing parties and start dates from a registry of (rta_id, signatories, dif, order column)."""
    codes = J.map_country_codes(registry, "rta_id", "signatories", aliases)
    known = registry.drop("signatories").join(codes, "rta_id", "left")
    return J.backfill(clauses, known, "rta_id", ["parties", "dif"], order)


def unite(national: DataFrame, world: DataFrame, left_out: list[str]) -> DataFrame:
    """National rows first, world rows of other agreements after them, without the named agreements."""
    return J.prefer(national, world, "rta_id").where(~F.col("fta_name").isin(left_out))


