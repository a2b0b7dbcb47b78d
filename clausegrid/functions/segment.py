"""Splitting treaty texts into chapters, articles, clauses, paragraphs and sentences.

Column functions on whole texts; pieces stay in arrays of one row until a
caller explodes them, so segmentation itself never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import lexicon as L
from clausegrid.functions.text import clean, squeeze_blanks


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also inside a lambda (where Spark shares nothing)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^{L.BLANK}+|{L.BLANK}+$", "")


def split_in_turn(c: str | Column, patterns: Sequence[str]) -> Column:
    """Split by the first pattern, the pieces by the second, and so on."""
    return reduce(
        lambda acc, p: F.flatten(F.transform(acc, lambda piece: F.split(piece, p, -1))),
        patterns,
        F.array(_col(c)),
    )


def article_pieces(c: str | Column) -> Column:
    """Preamble followed by one piece per article."""
    return split_in_turn(c, L.ARTICLE_HEADINGS)


def chapter_title(preamble: str | Column, fallback: str | Column) -> Column:
    """Letters between the first and the second "chapter" of the preamble, else the fallback."""
    parts = F.split(_col(preamble), "(?i)chapter", -1)
    found = F.trim(F.regexp_replace(F.get(parts, F.lit(1)), "[^A-Za-z]+", " "))
    return F.when(F.size(parts) > 1, found).otherwise(_col(fallback))


_BEFORE_NUMBER = r"(?s)^(.*?)[ \d]\. "


def _first_line(c: Column) -> Column:
    """First line that is not blank, null if there is none."""
    lines = F.filter(F.split(c, "\n", -1), lambda s: ~s.rlike(f"^{L.BLANK}*$"))
    return F.get(lines, F.lit(0))


def raw_article_title(piece: str | Column) -> Column:
    """First non-blank line in front of the first clause number; null if there is none."""
    piece = _col(piece)
    head = F.when(piece.rlike(_BEFORE_NUMBER), F.regexp_extract(piece, _BEFORE_NUMBER, 1)).otherwise(piece)
    return strip(_first_line(head))


def article_title(raw: str | Column) -> Column:
    """Letters and hyphens of the title line."""
    return F.trim(F.regexp_replace(_col(raw), r"[^A-Za-z\-]+", " "))


def _drop_first(arr: Column, item: Column) -> Column:
    at = F.array_position(arr, item).cast("int")
    cut = F.concat(F.slice(arr, F.lit(1), at - 1), F.slice(arr, at + 1, F.greatest(F.size(arr) - at, F.lit(0))))
    return F.when(at > 0, cut).otherwise(arr)


def article_clauses(piece: str | Column, raw_title: str | Column) -> Column:
    """Clauses of an article in order, newlines as blanks, without the title line."""
    parts = split_in_turn(piece, L.CLAUSE_MARKS)
    tidy = F.transform(parts, lambda s: strip(F.replace(s, F.lit("\n"), F.lit(" "))))
    return let(tidy, lambda t: _drop_first(t, _col(raw_title)))


def xml_text(c: str | Column, keep_words_apart: bool = True) -> Column:
    """Flatten tabs, newlines and hard blanks of an XML article.

    By default tabs and newlines become blanks; otherwise they vanish, which
    joins words across lines.
    """
    if keep_words_apart:
        return F.translate(_col(c), "\t\n\u00a0", "   ")
    return F.translate(_col(c), "\u00a0\t\n", " ")


def inline_clauses(c: str | Column) -> Column:
    """Clauses of running text, split at ". n."; ends stripped of blanks, dots and ones."""
    return F.transform(
        F.split(_col(c), L.INLINE_CLAUSE_MARK, -1), lambda s: F.btrim(strip(s), F.lit("1. "))
    )


def paragraphs(c: str | Column) -> Column:
    return F.transform(F.split(_col(c), L.PARAGRAPH_BREAK, -1), lambda s: F.replace(s, F.lit("\n"), F.lit(" ")))


_BEFORE_MARK = r"(?s)^(.*?) \d\. "


def infer_title(title: str | Column, number: str | Column, text: str | Column) -> Column:
    """For an untitled first clause, the fewer than ten words in front of its number."""
    guess = F.when(_col(text).rlike(_BEFORE_MARK), F.regexp_extract(_col(text), _BEFORE_MARK, 1)).otherwise("")
    words = F.size(F.filter(F.split(squeeze_blanks(guess), " "), lambda t: t != ""))
    return F.when((_col(title) == "") & (_col(number) == 1) & (words < 10), guess).otherwise(_col(title))


def strip_leading_title(title: str | Column, text: str | Column) -> Column:
    """Remove a title the clause starts with, then a leading clause number."""
    title, text = F.coalesce(_col(title), F.lit("")), F.coalesce(_col(text), F.lit(""))
    cut = F.when(text.startswith(title), F.substr(text, F.length(title) + 1)).otherwise(text)
    return F.regexp_replace(cut, r"^ *\d+\.", "")


def before_section(c: str | Column) -> Column:
    """Chapter name up to the word "section"."""
    return F.get(F.split(_col(c), "(?i)section", -1), F.lit(0))


def sentences(c: str | Column) -> Column:
    """Pieces between full stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(c), r"\.", -1), strip), lambda s: s != "")


def distribute_list(c: str | Column) -> Column:
    """Prefix each "(a)" item with the words in front of the list; plain texts stay single."""
    parts = F.split(_col(c), r"\([a-z]\)", -1)
    lead = F.get(parts, F.lit(0))
    items = F.transform(F.filter(parts, lambda s: s != lead), lambda s: strip(F.concat(lead, s)))
    return F.when(F.size(parts) == 1, F.transform(parts, strip)).otherwise(items)


def strip_list_marks(c: str | Column) -> Column:
    """Remove "(a)" marks and keep one text."""
    return squeeze_blanks(F.regexp_replace(_col(c), r"\([a-z]\)", " "))


def middle(arr: str | Column, k: int) -> Column:
    """The k items around the centre (k + 1 if k is even)."""
    arr = _col(arr)
    start = F.floor(F.size(arr) / 2).cast("int") - k // 2
    stop = F.floor(F.size(arr) / 2).cast("int") + k // 2 + 1
    # a negative start counts from the end, as in sequence slicing
    start = F.when(start < 0, F.greatest(start + F.size(arr), F.lit(0))).otherwise(start)
    return F.slice(arr, start + 1, F.greatest(F.least(stop, F.size(arr)) - start, F.lit(0)))


# Order of cleaning steps for clauses of the text corpus.
CLAUSE_STEPS = ["remove_special_character", "remove_whitespace", "normalize_unicode", "remove_url"]


def text_clauses(docs: DataFrame, agreement: str, title: str, text: str) -> DataFrame:
    """One row per clause of a text corpus: the structured rows, then the fallback paragraphs.

    Columns: agreement, title, chapter, article, art_identifier, clauseno, text.
    A document that yields no clause this way gives its paragraphs with null structure.
    """
    flat = F.replace(F.col(text), F.lit("\u00a0"), F.lit(" "))
    base = docs.select(F.col(agreement), F.col(title), flat.alias("_text")).withColumn("_p", article_pieces("_text"))
    pieces = F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0)))
    titled = base.select(
        agreement,
        title,
        "_text",
        chapter_title(F.get("_p", F.lit(0)), F.col(title)).alias("_chapter"),
        F.transform(
            pieces, lambda x, i: F.struct(i.alias("art"), x.alias("piece"), raw_article_title(x).alias("raw"))
        ).alias("_a"),
    )
    cut = titled.withColumn(
        "_a",
        F.transform(
            F.filter("_a", lambda s: s["raw"].isNotNull()),
            lambda s: F.struct(s["art"], s["raw"], article_clauses(s["piece"], s["raw"]).alias("clauses")),
        ),
    )
    structured = F.exists("_a", lambda s: F.size(s["clauses"]) > 0)
    plain = F.struct(
        F.lit(None).cast("int").alias("art"),
        F.lit(None).cast("string").alias("raw"),
        paragraphs("_text").alias("clauses"),
    )
    listed = cut.select(
        agreement, title, "_chapter", F.explode(F.when(structured, F.col("_a")).otherwise(F.array(plain))).alias("_a")
    )
    rows = listed.select(
        agreement, title, "_chapter", "_a.art", "_a.raw", F.posexplode("_a.clauses").alias("_i", "_row")
    )
    in_article = F.col("art").isNotNull()
    return rows.select(
        agreement,
        title,
        F.when(in_article, F.col("_chapter")).alias("chapter"),
        article_title("raw").alias("article"),
        F.col("art").alias("art_identifier"),
        F.when(in_article, F.col("_i") + 1).alias("clauseno"),
        clean("_row", CLAUSE_STEPS).alias("text"),
    )
