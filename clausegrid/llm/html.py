"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped first: scripts, styles, forms, and containers that say they are menus, headers, footers,
sidebars, notices, adverts or comments leave an empty line (an inline element a blank), unless they hold an article or
main element; those that say so by class, id or role only stay as well if they hold the page's leading run of
paragraphs. That is the longest run of those in the fewest such containers, so comments never count for it while any
paragraph stands outside. A name says so if it begins or ends with such a word and its other words are those of
layout: cookie-notice and main-nav do, has-sidebar and related-work do not. A header inside article or main is the
article's own. Every block element is a line; a section border
is a gap of empty lines. Text lengths (outside article and main, link text does not count) are summed over
sliding windows of lines.
Where the sums rise from nothing to the surge length is a surge point, where they fall to nothing again a
dive point; text between the two is a candidate. Candidates inside an article or main element beat all
others; of the rest, all from the first to the last that hold a fair share of the longest one are kept.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_LINES = 3
#: A candidate is strong from this share of the longest one's length on.
FAIR_SHARE = 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_OPEN_TAG = re.compile(r"<(?=[/!?a-zA-Z])")
_HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BETWEEN = re.compile(r"[-_:]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "xmp"}
_AROUND = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "object", "canvas", "audio", "video", "datalist", "fieldset"}
_SECTION = {"html", "body", "main", "article", "section", "div", "td", "table"}
_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "tr", "th", "tbody", "thead", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "hr", "br", "caption", "center"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Words in class, id and role that mark what is around the article.
_SAYS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "widget", "complementary",
    "comment", "comments", "disqus", "respond", "replies", "footer", "masthead", "topbar", "toolbar", "header", "contentinfo",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "search", "form", "copyright", "disclaimer", "skip",
}


#: Words that such names have beside them.
_LAYOUT = {
    "list", "lists", "section", "container", "box", "bar", "area", "wrap", "wrapper", "left", "right", "top", "bottom", "site", "main", "post", "posts",
    "page", "button", "buttons", "block", "panel", "inner", "outer", "group", "item", "items", "row", "column", "global", "primary", "secondary", "article", "articles",
}


def _says(attributes: str) -> set[str]:
    """The words by which a class, id or role says that it is around the article."""
    found = set()
    for m in _HINT.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _parts(name)
            if words and (words[0] in _SAYS or words[-1] in _SAYS) and all(x in _SAYS or x in _LAYOUT for x in words):
                found.update(x for x in words if x in _SAYS)
    return found


def _parts(name: str) -> list[str]:
    return [x for x in _BETWEEN.split(name) if x]


def _lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, length that counts, inside article or main) of each line, empty lines for gaps."""
    out: list[tuple[str, int, bool]] = []
    held, linked, links, core, at = [], 0, 0, 0, 0
    whole = page.rfind(">") + 1
    tail = _OPEN_TAG.split(page[whole:], maxsplit=1)[0]  # a tag that never ends is no text
    page = page[:whole]
    tokens = list(_TOKEN.finditer(page))
    if tokens and tokens[-1][0].startswith("<!--") and not tokens[-1][0].endswith("-->"):
        tail = ""
    names = [(m[2] or m[5] or "").lower() for m in tokens]
    closing = [(m[1] if m[2] else m[4]) == "/" for m in tokens]

    end_of = _ends(names, closing)
    said = [_says(m[3] or m[6] or "") if n and not c and n not in _VOID and n not in _RAW and n not in _AROUND else set() for m, n, c in zip(tokens, names, closing)]
    says = [bool(x) for x in said]
    cores = _cores(names, closing, says)
    leading = _leading(page, tokens, names, closing, says, end_of)

    def around(k: int) -> bool:
        if closing[k] or not (says[k] or names[k] in _AROUND) or names[k] in _VOID:
            return False
        if k not in end_of:
            return names[k] not in ("html", "body", "main", "article")
        if cores[end_of[k]] > cores[k + 1]:
            return False
        if core and (names[k] == "header" or says[k] and said[k] == {"header"}):
            return False
        return names[k] in _AROUND or not k < leading < end_of[k]

    def flush(gap: bool) -> None:
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            out.append((text, len(text) if core else max(0, len(text) - linked), core > 0))
        if gap and out and out[-1][0]:
            out.extend([("", 0, False)] * WINDOW_LINES)
        held, linked = [], 0

    k = 0
    while k < len(tokens):
        m, name = tokens[k], names[k]
        if m.start() < at:
            k += 1
            continue
        text = entities.unescape(page[at : m.start()])
        held.append(text)
        if links:
            linked += len(text)
        at = m.end()
        if name and not closing[k] and name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at, tail = (stop.end(), tail) if stop else (len(page), "")
            if name not in ("svg", "math"):
                flush(name != "script")
        elif around(k):
            stop = end_of.get(k)
            if stop is not None and name not in _SECTION and name not in _BLOCK and name not in _AROUND:
                held.append(" ")
            else:
                flush(True)
            if stop is not None:
                at, k = tokens[stop].end(), stop
        elif name == "a":
            links = max(0, links + (-1 if closing[k] else 1))
        elif name in _SECTION or name in _BLOCK:
            links = 0
            flush(name in _SECTION and (name != "div" or _alone(names, closing, k)))
            if name in ("article", "main"):
                core = max(0, core + (-1 if closing[k] else 1))
        k += 1
    held.append(entities.unescape(page[at:] + tail))
    flush(True)
    return out


def _cores(names: list[str], closing: list[bool], says: list[bool]) -> list[int]:
    """Before each token and past the last: article and main elements begun that do not say they are around the article."""
    out = [0]
    for name, close, said in zip(names, closing, says):
        out.append(out[-1] + (not close and name in ("article", "main") and not said))
    return out


def _leading(page: str, tokens: list[re.Match], names: list[str], closing: list[bool], says: list[bool], end_of: dict[int, int]) -> int:
    """The token that begins the leading run: paragraphs that follow one another without another block in between,
    in the fewest containers that are or say they are around the article, and the longest of those. -1 without paragraphs."""
    best, run, deep, ends = (0, 0, -1), None, 0, []
    raw_until = -1
    for k, name in enumerate(names):
        while ends and ends[-1] < k:
            ends.pop()
            deep -= 1
        if k < raw_until or not name:
            continue
        if not closing[k] and name in _RAW:
            raw_until = end_of.get(k, k)
        if not closing[k] and (says[k] or name in _AROUND) and name not in _VOID and k in end_of:
            deep, run = deep + 1, None
            ends.append(end_of[k])
        elif name == "p":
            if not closing[k]:
                stop = tokens[k + 1 : k + 2]
                last = end_of.get(k)
                until = tokens[last].start() if last is not None else (stop[0].start() if stop else len(page))
                if run is None:
                    run = [0, k]
                run[0] += until - tokens[k].end()
                if best[2] < 0 or (-deep, run[0]) > best[:2]:
                    best = (-deep, run[0], run[1])
        elif name in _SECTION or name in _BLOCK:
            run = None
    return best[2]


def _ends(names: list[str], closing: list[bool]) -> dict[int, int]:
    """For each token that opens an element the token that closes it, if there is one; one pass over the page."""
    begun: dict[str, list[int]] = {}
    ends = {}
    for k, name in enumerate(names):
        if not closing[k]:
            begun.setdefault(name, []).append(k)
        elif begun.get(name):
            ends[begun[name].pop()] = k
    return ends


def _alone(names: list[str], closing: list[bool], k: int) -> bool:
    """A div that holds other blocks is a section border; one that holds bare text is a line like a paragraph."""
    j = k + 1 if not closing[k] else k - 1
    return 0 <= j < len(names) and (names[j] in _SECTION or names[j] in _BLOCK)


def main_text(page: str | None) -> str:
    """Blocks of the article joined by one blank; empty for null, empty pages and pages without text."""
    lines = _lines(page or "")
    lengths = [n for _, n, _ in lines]
    sums = [sum(lengths[k : k + WINDOW_LINES]) for k in range(len(lines))]
    spans, begin = [], None
    for k, total in enumerate(sums):
        if begin is None and total and lengths[k]:
            begin = k  # surge
        if begin is not None and (not total or k + 1 == len(sums)):
            spans.append((begin, k + 1 if total else k))  # dive
            begin = None
    if not spans:
        return ""
    core = [s for s in spans if any(lines[k][2] for k in range(*s))]
    spans = core or spans
    weight = [sum(lengths[a:b]) for a, b in spans]
    least = 0 if core else FAIR_SHARE * max(weight)
    strong = [k for k, w in enumerate(weight) if w >= least]
    return " ".join(lines[k][0] for a, b in spans[strong[0] : strong[-1] + 1] for k in range(a, b) if lines[k][0])


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of each page and its length in code points (``n_chars``); whole pages, one by one.
    Input columns of these names are replaced."""
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))

    @F.pandas_udf("string")
    def pick(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None).astype(object)

    return df.withColumn(out, pick(page)).withColumn("n_chars", F.length(out).cast("long"))
