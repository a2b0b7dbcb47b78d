"""Porter stemming of single words as a column expression.

Follows the published algorithm (M. F. Porter, 1980) with the customary
extensions for short words and irregular forms. A word is described by
consonant runs (C) and vowel runs (V); "measure" counts the VC changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONS = "[^aeiou]"
_VOW = "[aeiouy]"
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"

MEASURE_GT0 = f"^({_C})?{_V}{_C}"
MEASURE_GT1 = f"^({_C})?{_V}{_C}{_V}{_C}"
MEASURE_EQ1 = f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL = f"^({_C})?{_VOW}"
# consonant, vowel, consonant other than w, x, y - or a two-letter vowel-consonant word
ENDS_CVC = f"{_CONS}{_VOW}[^aeiouwxy]$|^[aeiou][^aeiou]$"
DOUBLE_CONS = r"([^aeiou])\1$"

# Words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# Suffix and replacement; the first suffix that fits decides.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


def _ends(w: Column, suffix: str) -> Column:
    return w.endswith(F.lit(suffix))


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda acc, cv: acc.when(cv[0], cv[1]), cases, F).otherwise(default)


def _swap(w: Column, suffix: str, new: str, measure: str) -> tuple[Column, Column]:
    base = _cut(w, len(suffix))
    return _ends(w, suffix), F.when(base.rlike(measure), F.concat(base, F.lit(new))).otherwise(w)


def _plural(w: Column) -> Column:
    return _chain(
        [
            (_ends(w, "ies") & (F.length(w) == 4), _cut(w, 1)),
            (_ends(w, "sses"), _cut(w, 2)),
            (_ends(w, "ies"), _cut(w, 2)),
            (_ends(w, "ss"), w),
            (_ends(w, "s"), _cut(w, 1)),
        ],
        w,
    )


def _tidy_past(b: Column) -> Column:
    """After "ed" or "ing" went away."""
    return _chain(
        [
            (b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e"))),
            (b.rlike(DOUBLE_CONS), F.when(b.rlike("[lsz]$"), b).otherwise(_cut(b, 1))),
            (b.rlike(MEASURE_EQ1) & b.rlike(ENDS_CVC), F.concat(b, F.lit("e"))),
        ],
        b,
    )


def _past(w: Column) -> Column:
    ee, ed, ing = _cut(w, 3), _cut(w, 2), _cut(w, 3)
    return _chain(
        [
            (_ends(w, "ied"), F.when(F.length(w) == 4, _cut(w, 1)).otherwise(_cut(w, 2))),
            (_ends(w, "eed"), F.when(ee.rlike(MEASURE_GT0), _cut(w, 1)).otherwise(w)),
            (_ends(w, "ed") & ed.rlike(HAS_VOWEL), _tidy_past(ed)),
            (_ends(w, "ing") & ing.rlike(HAS_VOWEL), _tidy_past(ing)),
        ],
        w,
    )


def _final_y(w: Column) -> Column:
    base = _cut(w, 1)
    consonant = base.rlike("[^aeiouy]$") | base.rlike("(^|[aeiou])y$")
    return F.when(_ends(w, "y") & (F.length(base) > 1) & consonant, F.concat(base, F.lit("i"))).otherwise(w)


def _step2_rules(w: Column) -> Column:
    cases = [_swap(w, s, r, MEASURE_GT0) for s, r in STEP2]
    log = _cut(w, 3)
    cases.append((_ends(w, "logi"), F.when(log.rlike(MEASURE_GT0), _cut(w, 1)).otherwise(w)))
    return _chain(cases, w)


def _step4(w: Column) -> Column:
    cases = []
    for s in STEP4:
        base = _cut(w, len(s))
        ok = base.rlike(MEASURE_GT1)
        if s == "ion":
            ok = ok & base.rlike("[st]$")
        cases.append((_ends(w, s), F.when(ok, base).otherwise(w)))
    return _chain(cases, w)


def _final_e(w: Column) -> Column:
    base = _cut(w, 1)
    gone = base.rlike(MEASURE_GT1) | (base.rlike(MEASURE_EQ1) & ~base.rlike(ENDS_CVC))
    return F.when(_ends(w, "e") & gone, base).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(_ends(w, "ll") & _cut(w, 1).rlike(MEASURE_GT1), _cut(w, 1)).otherwise(w)


def stem_steps() -> list:
    """The steps as (name, function of a word column), for a chain of projections.

    Each step reads its input several times; as separate projections the
    intermediate word is computed once instead of being spelled out in place.
    """
    alli = lambda w: F.when(_ends(w, "alli") & _cut(w, 4).rlike(MEASURE_GT0), _cut(w, 2)).otherwise(w)
    three = lambda w: _chain([_swap(w, s, r, MEASURE_GT0) for s, r in STEP3], w)
    return [_plural, _past, _final_y, alli, _step2_rules, three, _step4, _final_e, _final_ll]
