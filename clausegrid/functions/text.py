"""Text cleaning as column functions; every function maps a string column to a string column.

All of them stay in the JVM and need no shuffle. ``clean`` chains them by name.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausegrid.functions import lexicon as L


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_lower(c: str | Column) -> Column:
    return F.lower(_col(c))


def remove_number(c: str | Column) -> Column:
    """Drop digit runs of any script."""
    return F.regexp_replace(_col(c), r"\p{Nd}+", "")


def remove_bullets(c: str | Column) -> Column:
    """Replace list markers by one blank."""
    return F.regexp_replace(_col(c), L.BULLET, " ")


def remove_url(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), L.URL, "")


def remove_punctuation(c: str | Column, chars: str = L.PUNCTUATION) -> Column:
    return F.translate(_col(c), chars, "")


def remove_special(c: str | Column, chars: str = L.SPECIAL_CHARACTERS) -> Column:
    return F.translate(_col(c), chars, "")


def keep_alphanumeric(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", "")


def squeeze_blanks(c: str | Column, collapse: bool = True) -> Column:
    """Trim, and turn runs of blanks into one blank unless told otherwise."""
    if collapse:
        return F.trim(F.regexp_replace(_col(c), f"{L.BLANK}+", " "))
    return F.regexp_replace(_col(c), f"^{L.BLANK}+|{L.BLANK}+$", "")


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding, computed from the Unicode database.

    Returns characters that fold to one ASCII character, their images, and
    the characters that fold to several.
    """
    one_from, one_to, many = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.decomposition(ch) == "":
            continue
        image = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(image) == 1:
            one_from.append(ch)
            one_to.append(image)
        elif image:
            many[ch] = image
    return "".join(one_from), "".join(one_to), many


def ascii_fold(c: str | Column) -> Column:
    """Accents and compatibility forms become plain ASCII, everything else outside ASCII goes.

    One-to-one images take one ``translate``. Ligatures and the like are rare, so
    the per-character lookup runs only for texts that still hold one.
    """
    one_from, one_to, many = _fold_tables()
    src = F.translate(_col(c), one_from, one_to)
    lookup = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    several = F.array_join(
        F.transform(F.split(src, ""), lambda ch: F.coalesce(F.try_element_at(lookup, ch), ch)), ""
    )
    full = F.when(src.rlike(_as_class(many)), several).otherwise(src)
    plain = F.regexp_replace(full, NOT_ASCII, "")
    return F.when(_col(c).rlike(NOT_ASCII), F.when(src.rlike(NOT_ASCII), plain).otherwise(src)).otherwise(_col(c))


NOT_ASCII = r"[^\x00-\x7F]"


def _as_class(chars: Iterable[str]) -> str:
    """Character class of the given characters, neighbours joined into ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def tokens(c: str | Column) -> Column:
    """Words between blanks, without empty entries."""
    inner = F.btrim(_col(c), F.lit(L.BLANK_CHARS))
    return F.when(inner != "", F.split(inner, f"{L.BLANK}+")).when(inner.isNotNull(), F.array().cast("array<string>"))


def remove_stopwords(c: str | Column, words: Sequence[str] = tuple(L.STOP_WORDS)) -> Column:
    words = list(words)
    return F.array_join(F.filter(tokens(c), lambda t: ~t.isin(words)), " ")


def treat_tokens(c: str | Column, words: Sequence[str] = tuple(L.STOP_WORDS)) -> Column:
    """Drop stop words, turn punctuation into blanks, drop 1-character and all-digit words."""
    kept = remove_stopwords(c, words)
    spaced = F.translate(kept, L.PUNCTUATION, " " * len(L.PUNCTUATION))
    return F.array_join(
        F.filter(tokens(spaced), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{Nd}+$")), " "
    )


def drop_long_tokens(c: str | Column, longest: int = 20) -> Column:
    return F.array_join(F.filter(tokens(c), lambda t: F.length(t) <= longest), " ")


def is_noise_paragraph(c: str | Column) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).rlike(p) for p in L.NOISE_PARAGRAPHS])


def strip_number_words(c: str | Column) -> Column:
    """Remove number words as substrings, one after the other (so "sixteen" leaves "teen")."""
    return reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit("")), L.NUMBER_WORDS, _col(c))


def drop_cardinals(c: str | Column) -> Column:
    """Remove stand-alone numbers of two or more digits, such as page numbers."""
    return F.regexp_replace(_col(c), r"(?<![\p{L}\p{N}_.])\d{2,}(?![\p{L}\p{N}_.])", "")


def country_name(c: str | Column) -> Column:
    """Spell out "Rep." and keep the part before the first comma."""
    return F.split_part(F.replace(_col(c), F.lit("Rep."), F.lit("Republic")), F.lit(","), F.lit(1))


# Names under which the steps can be listed in a chain.
CLEANERS: dict[str, Callable[[Column], Column]] = {
    "to_lower": to_lower,
    "remove_number": remove_number,
    "remove_itemized_bullet_and_numbering": remove_bullets,
    "remove_url": remove_url,
    "remove_punctuation": remove_punctuation,
    "remove_special_character": remove_special,
    "keep_alpha_numeric": keep_alphanumeric,
    "remove_whitespace": squeeze_blanks,
    "normalize_unicode": ascii_fold,
    "remove_stopword": remove_stopwords,
    "treat_tokens": treat_tokens,
    "drop_long_tokens": drop_long_tokens,
    "strip_number_words": strip_number_words,
    "drop_cardinals": drop_cardinals,
}


def clean(c: str | Column, steps: Sequence[str]) -> Column:
    """Apply the named steps in order; a null text counts as empty."""
    unknown = [s for s in steps if s not in CLEANERS]
    if unknown:
        raise KeyError(f"no such cleaning step: {', '.join(unknown)}")
    return reduce(lambda acc, s: CLEANERS[s](acc), steps, F.coalesce(_col(c), F.lit("")))
