"""HTML extraction, WARC archives, URL rules and chat formatting."""

import base64
import gzip
import hashlib
import html as entities
import random
import re

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from clausegrid.llm import chat, html, urls, warc
from clausegrid.session import load, scratch_path

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site name</h2></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, accept them all please.</p></div>
<main><article><h1>Head &amp; line</h1><p>First  <b>para</b>graph&nbsp;here.</p><div class="ad">Buy it now</div><p>Second<br>line, with a <a href="x">link</a>.
<script>var t = "</p>";</script></p><form><p>Your name</p><input></form><blockquote>Quoted</blockquote></article>
<section id="comments"><p>I disagree with all that was written above.</p></section></main>
<aside><p>Read this too, it is long enough to count as text.</p></aside><footer>&copy; us</footer></body></html>"""


def test_article_of_a_page():
    assert html.main_text(PAGE) == "Head & line First paragraph here. Second line, with a link. Quoted"


def test_links_in_articles_are_text():
    links = "".join(f"<p><a href='{k}'>Source {k}</a></p>" for k in range(4))
    listed = "Source 0 Source 1 Source 2 Source 3"
    page = f"<nav><a>Home</a></nav><article><h1><a href='x'>Title</a></h1><p>First.</p>{links}<p>Second.</p>{links}</article><p><a>More</a></p>"
    assert html.main_text(page) == f"Title First. {listed} Second. {listed}"


LONG = "<p>" + "A sentence of the text. " * 20 + "</p>"


@pytest.mark.parametrize("tag", [
    "div class='content has-sidebar'", "div id='page' class='header-fixed'", "section class='search-result'", "section id='related-work'",
    "div class='search'", "body class='comments-open'", "article class='post comments-open'", "article class='comment'",
])
def test_hints_that_hold_the_text(tag):
    words = html.main_text(LONG)
    assert html.main_text(f"<html><div class='ad'><p>Buy it</p></div><{tag}>{LONG}</{tag.split()[0]}></html>") == words
    assert html.main_text(f"<div class='search'><p>Find</p><article>{LONG}</article></div>") == words
    assert html.main_text(f"<form id='page'><div><article>{LONG}</article></div></form>") == words


def test_whole_hints_are_cut():
    words = html.main_text(LONG)
    around = "".join(f"<div class='{c}'>{LONG[:90]}</p></div>" for c in ("box ad", "cookie-notice", "social_share", "comments"))
    assert html.main_text(f"<body><div>{LONG}{LONG}</div>{around}</body>") == f"{words} {words}"
    assert html.main_text(f"<article>{LONG}<section id='comments'><article class='comment'><p>No.</p></article></section></article>") == words


def test_short_sections_between_long_ones_stay():
    page = f"<section><p>Before.</p></section><section>{LONG}</section><section><h2>Short</h2><p>One.</p></section><section>{LONG}</section><section><p>After.</p></section>"
    words = html.main_text(LONG)
    assert html.main_text(page) == f"{words} Short One. {words}"


def test_many_elements_that_never_end():
    """Adverts without an end, their texts too short to count; a page of them is read in one pass."""
    page = "<p>Start of the text.</p>" + "<div class='ad'>x" * 20000
    assert html.main_text(page) == "Start of the text."
    names, closing = ["div", "p", "div", "div", "p"], [False, False, False, True, True]
    assert html._ends(names, closing) == {2: 3, 1: 4}


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<", "<!-- open", "<script>x", "<div class='", "<nav><a>only</a></nav>"])
def test_pages_without_text(page):
    assert html.main_text(page) in ("", "<")


def test_plain_and_broken_pages():
    assert html.main_text("just  text\nhere") == "just text here"
    assert html.main_text("<p>one<p>two &lt;3 <b>three") == "one two <3 three"
    assert html.main_text("<nav><p>never closed, so it is text") == "never closed, so it is text"
    assert html.main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert len(html.main_text("<p>" + "word " * 200_000 + "</p>")) == 5 * 200_000 - 1
    assert html.main_text("<p class=\"" * 3000)[:1] in ("", "<")


def test_pages_of_the_table(spark, sf):
    pages = load(spark, sf, "pages").withColumn("text", F.lit(1)).withColumn("N_chars", F.lit(1))
    for r in html.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(?:p|h1|br)>", "\n", article)
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert r.text == want and r["n_chars"] == len(want)
    assert html.extract(pages.limit(0)).count() == 0


def pages_frame(spark):
    draw = random.Random(5)
    noise = "".join(chr(draw.randrange(1, 0x300)) for _ in range(60_000))
    rows = [(k, f"http://h/{k} é%", f"<p>{k % 7}</p>" * (k % 5)) for k in range(200)]
    rows += [(500, None, None), (501, "", ""), (502, "u", noise), (503, "u", "\x1f\x8b\x08" * 500), (None, "n", "nothing else has this"), (None, "n", ""), (504, "u", "x"), (504, "u", "x"), (600, "u", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 22])
def test_archives_read_back(spark, range_bytes):
    df, rows = pages_frame(spark)
    got = warc.archive_pages(df.repartition(3), range_bytes=range_bytes).collect()
    assert len(got) == len(rows)
    payloads = [(h or "").encode() for _, _, h in rows]
    largest = {}
    for (key, _, _), p in zip(rows, payloads):
        largest[p] = max(largest.get(p, -1), -1 if key is None else key)
    want = []
    for (key, url, _), p in zip(rows, payloads):
        own = -1 if key is None else key
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        other = None if own == largest[p] else largest[p]
        want.append((key, url, digest, len(p), "response" if other is None else "revisit", other, p if other is None else None))
    order = lambda r: (str(r[0]), r[2], str(r[5]))
    have = [(r.key, r.target, r.digest, r.payload_length, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(have, key=order) == sorted(want, key=order)


def test_archive_files_are_plain_gzip(spark):
    df, rows = pages_frame(spark)
    folder = scratch_path(spark, "warc-test")
    report = warc.write_archive(warc.plan_records(df, "page_id", "url", "html"), folder).collect()
    text = b"".join(gzip.decompress(fs.LocalFileSystem().open_input_file(r.path).read()) for r in report)
    assert text.count(b"WARC/1.1\r\n") == len(rows) == sum(r.records for r in report)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.key: r.refers_to for r in warc.archive_pages(df, least=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("org", "", "block"), ("org", "/ok", "allow"), ("org", "/ok/no", "block")]


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c < "\x80" else c for c in host), slash + path
    fits = [(h.count(".") + 1, len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def test_rules_match_brute_force(spark):
    seen = [
        None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en", "http://example.com/en/", "http://a.example.com/en/1",
        "http://notexample.com/en/", "http://b.net/es/?x", "http://b.net/esx", "http://x.org", "http://x.org/okay/1", "http://x.org/ok/nope", "http://x.org/ok/n", "x://y?z://com/", "http://a..com//en/", "http://É.com/Ü", "://org#", "http://" + "a." * 3000 + "com/" + "p/" * 5000,
    ]
    df = spark.createDataFrame([(k, u, "own", "own") for k, u in enumerate(seen * 2)], "page_id long, url string, path string, RULE string")
    for r in urls.judge(df, RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(seen[r.page_id % len(seen)]), r
    assert urls.judge(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        urls.build_trie([("a", "/", "allow"), ("a", "/", "block")])


def test_reply_tree_ranks_branches(spark):
    rows = [("t", 1, None, 1.0, "user", "root"), ("t", 2, 1, 5.0, "assistant", "good"), ("t", 3, 1, None, "assistant", "bad"), ("t", 4, 3, 9.0, "user", "best <turn:x> & end"), ("t", 5, 99, 2.0, "user", "orphan"), ("u", 1, None, 0.0, "user", "alone")]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    found = chat.paths(messages)
    out = chat.format_paths(messages, found)
    got = {(r.tree, r.leaf): (r.branch_rank, r.branch_score, r.turns) for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert got[("t", 4)][:2] == (1, 10.0) and [t.text for t in got[("t", 4)][2]] == ["root", "bad", "best <turn:x> & end"]
    assert got[("t", 2)][:2] == (2, 6.0) and got[("t", 5)][:2] == (3, 2.0) and got[("u", 1)][:2] == (1, 0.0)
    assert {(r.tree, r.leaf) for r in chat.paths(messages, keep=1).collect()} == {("t", 4), ("u", 1)}


def test_long_threads_and_circles(spark):
    rows = [("t", k, k - 1 if k else None, 1.0, "assistant" if k % 2 else "user", str(k)) for k in range(300)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    out = chat.format_paths(messages, chat.paths(messages))
    r = out.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).first()
    assert [t.text for t in r.turns] == [str(k) for k in range(300)]
    assert r.learned == "".join(str(k) for k in range(1, 300, 2))
    circle = spark.createDataFrame([("t", 1, 2, 0.0, "a", "x"), ("t", 2, 1, 0.0, "a", "y")], messages.schema)
    with pytest.raises(ValueError):
        chat.paths(circle)


def test_threads_with_odd_rows(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b"), (1, None, "user", "a"), (1, 1, "assistant", "b"), (1, 1, None, None), (None, 0, "user", odd), (None, 1, "assistant", odd), (2, 0, "we>ird<\n", "&lt;")]
    messages = chat.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_paths(messages, chat.paths(messages)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss")))
    got = {r.tree: ([tuple(t) for t in r.turns], r.learned) for r in out.collect()}
    assert got["+1"] == ([("user", "a"), ("", ""), ("assistant", "b"), ("assistant", "b")], "bb")
    assert got["-"] == ([("user", odd), ("assistant", odd)], odd)
    assert got["+2"] == ([("we>ird<\n", "&lt;")], "")
    assert chat.paths(messages.limit(0)).count() == 0


def _page(name, around="{}"):
    good = "".join(f"<p>Good paragraph number {k} has some words in it, and more.</p>" for k in range(6))
    bad = "".join(f"<p>Badly longer paragraph number {k} has many more words in it than the others have.</p>" for k in range(8))
    return around.format(good) + f"<div class='{name}'>{bad}</div>", around.format(good + f"<section class='{name}'>{bad}</section>")


AROUND = "comment-list comments-section post-comments related-posts site-footer share-buttons ad-container cookie-bar sidebar-left main-nav widget-area comments"


@pytest.mark.parametrize("name", AROUND.split())
def test_names_around_the_article(name):
    for around in ("<div class='content'>{}</div>", "<article>{}</article>"):
        for page in _page(name, around):
            text = html.main_text(f"<html><body>{page}</body></html>")
            assert text.count("Good") == 6 and "Badly" not in text


def test_names_of_the_article():
    for name in ("content has-sidebar", "comments-open", "header-fixed", "no-sidebar", "search-result"):
        for page in _page("footer", f"<div class='{name}'>" + "{}</div>")[:1]:
            assert html.main_text(page).count("Good") == 6
    wrapped = html.main_text("<div class='sidebar'><p>All there is on the page is in here.</p></div>")
    assert wrapped == "All there is on the page is in here."


def test_inline_adverts_and_headers_inside_an_article():
    assert html.main_text("<div><p>hello <span class='ad'>x</span> world, here is more.</p></div>") == "hello world, here is more."
    assert html.main_text("<article><header><h1>Title</h1></header><p>Text of it.</p></article>") == "Title Text of it."
