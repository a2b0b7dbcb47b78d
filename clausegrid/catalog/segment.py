"""Segmentation queries over treaty-shaped texts derived from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.catalog.base import query
from clausegrid.catalog.text import LINES, NUMBERED, WS, docs, lines, numbered, tok
from clausegrid.functions import lexicon as L
from clausegrid.functions import segment as G
from clausegrid.functions.text import tokens
from clausegrid.operators.frames import blanks_to_null
from clausegrid.operators.scan import forward_fill, position, running_sum
from clausegrid.session import load, spread


def sections(spark, sf):
    """One sub-document per turn: a chapter, two articles and numbered clauses; every 7th has no heading."""
    c = spread(load(spark, sf, "conversations"), "conv_id")
    turn = F.col("turn").cast("string")
    body = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n2. "))
    treaty = F.concat(
        F.lit("CHAPTER two Section "), F.col("conv_id").cast("string"),
        F.lit("\nARTICLE "), turn, F.lit(" \n"), F.col("role"), F.lit("\n1. "), body,
        F.lit("\n Rule 4."), turn, F.lit(" :\nmore about "), F.col("role"), F.lit("\n"), F.col("text"),
    )
    plain = F.concat(F.col("role"), F.lit(" \n \n"), F.col("text"))
    return c.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("fta_name"),
        F.concat(F.lit("part "), turn).alias("title"),
        F.when(F.col("conv_id") % 7 == 0, plain).otherwise(treaty).alias("text"),
    )


SECTIONS = """sections AS (SELECT 'conv' || conv_id AS fta_name, 'part ' || turn AS title,
    CASE WHEN conv_id % 7 = 0 THEN role || ' ' || chr(10) || ' ' || chr(10) || text ELSE
    'CHAPTER two Section ' || conv_id || chr(10) || 'ARTICLE ' || turn || ' ' || chr(10) || role || chr(10) || '1. '
    || replace(text, '.' || chr(10), '.' || chr(10) || '2. ') || chr(10) || ' Rule 4.' || turn || ' :' || chr(10)
    || 'more about ' || role || chr(10) || text END AS text FROM conversations)"""


def _in_turn(expr: str, patterns: list[str]) -> str:
    for p in patterns:
        expr = f"flatten(list_transform({expr}, lambda x: regexp_split_to_array(x, '{p}')))"
    return expr


_ART = _in_turn("[text]", L.ARTICLE_HEADINGS)
_STRIP = f"regexp_replace({{}}, '^{WS}+|{WS}+$', '', 'g')"


def strip_sql(x: str) -> str:
    return _STRIP.replace("{}", x)


BASE = f"""WITH {SECTIONS}, p AS (SELECT fta_name, title, text, {_ART} AS p FROM sections),
  h AS (SELECT *, regexp_split_to_array(p[1], '(?i)chapter') AS c FROM p),
  head AS (SELECT fta_name, title, text, p, CASE WHEN len(c) > 1
     THEN trim(regexp_replace(c[2], '[^A-Za-z]+', ' ', 'g')) ELSE title END AS chapter FROM h),
  art AS (SELECT fta_name, title, chapter, unnest(p[2:]) AS piece, unnest(range(len(p) - 1)) AS art_identifier FROM head),
  art2 AS (SELECT *, CASE WHEN regexp_matches(piece, '(?s)^(.*?)[ \\d]\\. ') THEN regexp_extract(piece, '(?s)^(.*?)[ \\d]\\. ', 1)
     ELSE piece END AS front FROM art),
  art3 AS (SELECT *, {strip_sql(f"list_filter(string_split(front, chr(10)), lambda s: NOT regexp_matches(s, '^{WS}*$'))[1]")} AS raw FROM art2),
  titled AS (SELECT fta_name, title, chapter, CAST(art_identifier AS INTEGER) AS art_identifier, piece, raw,
     trim(regexp_replace(raw, '[^A-Za-z\\-]+', ' ', 'g')) AS article FROM art3 WHERE raw IS NOT NULL),
  cl AS (SELECT *, list_transform({_in_turn("[piece]", L.CLAUSE_MARKS)},
     lambda s: {strip_sql("replace(s, chr(10), ' ')")}) AS cs FROM titled),
  cl2 AS (SELECT *, CASE WHEN list_position(cs, raw) IS NULL OR list_position(cs, raw) = 0 THEN cs
     ELSE list_concat(cs[:list_position(cs, raw) - 1], cs[list_position(cs, raw) + 1:]) END AS ds FROM cl),
  clause AS (SELECT fta_name, title, chapter, article, art_identifier, unnest(ds) AS text0,
     CAST(unnest(range(1, len(ds) + 1)) AS INTEGER) AS clauseno FROM cl2)"""

CLEAN_SQL = (
    f"regexp_replace(regexp_replace(strip_accents(trim(regexp_replace(translate(@, '{L.SPECIAL_CHARACTERS}', ''), '{WS}+', ' ', 'g'))), "
    f"'[^\\x00-\\x7F]', '', 'g'), '{L.URL}', '', 'g')"
)


def pieces(spark, sf):
    return sections(spark, sf).withColumn("p", G.article_pieces("text"))


def articles(spark, sf):
    head = pieces(spark, sf).select(
        "fta_name", "title", G.chapter_title(F.get("p", F.lit(0)), "title").alias("chapter"), "p"
    )
    rows = head.select(
        "fta_name", "title", "chapter",
        F.posexplode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("art_identifier", "piece"),
    ).withColumn("raw", G.raw_article_title("piece"))
    return rows.where(F.col("raw").isNotNull())


@query("split_articles", BASE + " SELECT fta_name, title, CAST(art_identifier AS INTEGER) AS art_identifier, piece FROM art")
def split_articles(spark, sf):
    return pieces(spark, sf).select(
        "fta_name", "title",
        F.posexplode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("art_identifier", "piece"),
    )


@query("extract_chapter_title", BASE + " SELECT fta_name, title, chapter FROM head")
def extract_chapter_title(spark, sf):
    return pieces(spark, sf).select(
        "fta_name", "title", G.chapter_title(F.get("p", F.lit(0)), "title").alias("chapter")
    )


@query("extract_article_title", BASE + " SELECT fta_name, title, art_identifier, article FROM titled")
def extract_article_title(spark, sf):
    return articles(spark, sf).select("fta_name", "title", "art_identifier", G.article_title("raw").alias("article"))


@query("split_clauses_text", BASE + " SELECT fta_name, title, art_identifier, clauseno, text0 AS clause FROM clause")
def split_clauses_text(spark, sf):
    return articles(spark, sf).select(
        "fta_name", "title", "art_identifier",
        F.posexplode(G.article_clauses("piece", "raw")).alias("i", "clause"),
    ).select("fta_name", "title", "art_identifier", (F.col("i") + 1).alias("clauseno"), "clause")


_PARA = f"""fallback AS (SELECT fta_name, title, unnest(list_transform(regexp_split_to_array(text, '{L.PARAGRAPH_BREAK}'),
     lambda s: replace(s, chr(10), ' '))) AS text0 FROM p
     WHERE (fta_name, title) NOT IN (SELECT (fta_name, title) FROM clause))"""


@query(
    "split_paragraphs",
    BASE + ", " + _PARA + f""" SELECT fta_name, title, chapter, article, art_identifier, clauseno,
      {CLEAN_SQL.replace('@', 'text0')} AS text FROM clause
    UNION ALL SELECT fta_name, title, NULL, NULL, NULL, NULL, {CLEAN_SQL.replace('@', 'text0')} FROM fallback""",
)
def split_paragraphs(spark, sf):
    return G.text_clauses(sections(spark, sf), "fta_name", "title", "text")


def untitled(spark, sf):
    """Clauses whose article name was lost where the identifier is even, as after a bad conversion."""
    rows = G.text_clauses(sections(spark, sf), "fta_name", "title", "text").where(F.col("clauseno").isNotNull())
    lost = (F.col("art_identifier") % 2 == 0) & (F.col("clauseno") % 2 == 1)
    return rows.withColumn("article", F.when(lost, F.lit("")).otherwise(F.col("article"))).withColumn(
        "text", F.concat("article", F.lit(" intro "), F.col("clauseno").cast("string"), F.lit(". "), "text")
    )


_UNTITLED = BASE + f""", u AS (SELECT fta_name, title, chapter, art_identifier, clauseno,
     CASE WHEN art_identifier % 2 = 0 AND clauseno % 2 = 1 THEN '' ELSE article END AS article,
     {CLEAN_SQL.replace('@', 'text0')} AS t FROM clause),
   untitled AS (SELECT * EXCLUDE (t), article || ' intro ' || clauseno || '. ' || t AS text FROM u),
   guess AS (SELECT *, CASE WHEN regexp_matches(text, '(?s)^(.*?) \\d\\. ') THEN regexp_extract(text, '(?s)^(.*?) \\d\\. ', 1) ELSE '' END AS g FROM untitled),
   inferred AS (SELECT * EXCLUDE (g, article), CASE WHEN article = '' AND clauseno = 1
      AND len({tok('g')}) < 10 THEN g ELSE article END AS article FROM guess)"""


@query("infer_article_title", _UNTITLED + " SELECT fta_name, title, art_identifier, clauseno, article FROM inferred")
def infer_article_title(spark, sf):
    return untitled(spark, sf).select(
        "fta_name", "title", "art_identifier", "clauseno", G.infer_title("article", "clauseno", "text").alias("article")
    )


@query(
    "strip_leading_title",
    _UNTITLED + r""" SELECT fta_name, title, art_identifier, clauseno, regexp_replace(CASE WHEN starts_with(text, article)
      THEN substr(text, length(article) + 1) ELSE text END, '^ *\d+\.', '') AS text FROM
      (SELECT * REPLACE (CASE WHEN clauseno % 3 = 0 THEN '' ELSE article END AS article) FROM inferred)""",
)
def strip_leading_title(spark, sf):
    rows = untitled(spark, sf).withColumn("article", G.infer_title("article", "clauseno", "text"))
    rows = rows.withColumn("article", F.when(F.col("clauseno") % 3 == 0, F.lit("")).otherwise(F.col("article")))
    return rows.select(
        "fta_name", "title", "art_identifier", "clauseno", G.strip_leading_title("article", "text").alias("text")
    )


@query(
    "trim_section_suffix",
    BASE + " SELECT DISTINCT fta_name, title, regexp_split_to_array(chapter, '(?i)section')[1] AS chapter FROM clause",
)
def trim_section_suffix(spark, sf):
    return articles(spark, sf).select("fta_name", "title", G.before_section("chapter").alias("chapter")).distinct()


@query(
    "ffill_group",
    _UNTITLED + """ SELECT fta_name, title, art_identifier, clauseno, last_value(nullif(trim(article), '') IGNORE NULLS)
      OVER (PARTITION BY fta_name, title, chapter, art_identifier ORDER BY clauseno) AS article FROM untitled""",
)
def ffill_group(spark, sf):
    rows = blanks_to_null(untitled(spark, sf).select("fta_name", "title", "chapter", "art_identifier", "clauseno", "article"))
    filled = forward_fill(rows, ["fta_name", "title", "chapter", "art_identifier"], "clauseno", "article")
    return filled.select("fta_name", "title", "art_identifier", "clauseno", "article")


@query("blank_to_null", f"""WITH {LINES} SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^\\s*$') THEN NULL ELSE line END AS line
    FROM (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN '  ' ELSE line END AS line FROM lines)""")
def blank_to_null(spark, sf):
    rows = lines(spark, sf).withColumn("line", F.when(F.col("pos") % 5 == 0, F.lit("  ")).otherwise(F.col("line")))
    return blanks_to_null(rows)


INLINE = f"""list_transform(regexp_split_to_array(text, '{L.INLINE_CLAUSE_MARK}'),
    lambda s: trim({strip_sql('s')}, '1. '))"""
_FLAT = f"flat AS (SELECT doc_id, replace(replace(replace(text, chr(9), ' '), chr(10), ' '), chr(160), ' ') AS text FROM numbered)"


@query(
    "split_clauses_xml",
    f"""WITH {NUMBERED}, {_FLAT}, c AS (SELECT doc_id, {INLINE} AS cs FROM flat)
    SELECT doc_id, CAST(unnest(range(1, len(cs) + 1)) AS INTEGER) AS clauseno, unnest(cs) AS clause FROM c""",
)
def split_clauses_xml(spark, sf):
    return (
        numbered(spark, sf)
        .select("doc_id", F.posexplode(G.inline_clauses(G.xml_text("text"))).alias("i", "clause"))
        .select("doc_id", (F.col("i") + 1).alias("clauseno"), "clause")
    )


@query("split_sentences", f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'),
    lambda s: {strip_sql('s')}), lambda s: s <> '') AS ss FROM documents)
    SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS pos, unnest(ss) AS sentence FROM s""")
def split_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(G.sentences("text")).alias("pos", "sentence"))


def listed(spark, sf):
    return docs(spark, sf).select(
        "doc_id", "lang", F.concat(F.lit("Parties shall: (a) "), F.replace(F.col("text"), F.lit(".\n"), F.lit("; (b) "))).alias("text")
    )


_LISTED = """listed AS (SELECT doc_id, lang, 'Parties shall: (a) ' || replace(text, '.' || chr(10), '; (b) ') AS text FROM documents)"""


@query("distribute_sublist", f"""WITH {_LISTED}, s AS (SELECT doc_id, regexp_split_to_array(text, '\\([a-z]\\)') AS p FROM listed),
    i AS (SELECT doc_id, CASE WHEN len(p) = 1 THEN list_transform(p, lambda x: {strip_sql('x')}) ELSE
      list_transform(list_filter(p, lambda x: x <> p[1]), lambda x: {strip_sql('p[1] || x')}) END AS xs FROM s)
    SELECT doc_id, CAST(unnest(range(len(xs))) AS INTEGER) AS pos, unnest(xs) AS item FROM i""")
def distribute_sublist(spark, sf):
    return listed(spark, sf).select("doc_id", F.posexplode(G.distribute_list("text")).alias("pos", "item"))


@query("strip_list_marks", f"""WITH {_LISTED} SELECT doc_id,
    trim(regexp_replace(regexp_replace(text, '\\([a-z]\\)', ' ', 'g'), '{WS}+', ' ', 'g')) AS text FROM listed""")
def strip_list_marks(spark, sf):
    return listed(spark, sf).select("doc_id", G.strip_list_marks("text").alias("text"))


@query("paragraph_offsets", """WITH n AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) AS n FROM documents)
    SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS first_row, CAST(sum(n) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS last_row FROM n""")
def paragraph_offsets(spark, sf):
    n = docs(spark, sf).select(
        "doc_id", F.size(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")).cast("bigint").alias("n")
    )
    return running_sum(n, [], "doc_id", "n", "upto").select(
        "doc_id", (F.col("upto") - F.col("n")).alias("first_row"), (F.col("upto") - 1).alias("last_row")
    )


@query("middle_k", f"""WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents),
    b AS (SELECT doc_id, t, CASE WHEN len(t) // 2 - 2 < 0 THEN greatest(len(t) // 2 - 2 + len(t), 0) ELSE len(t) // 2 - 2 END AS s,
       least(len(t) // 2 + 3, len(t)) AS e FROM t)
    SELECT doc_id, CASE WHEN e > s THEN array_to_string(list_slice(t, s + 1, e), ' ') ELSE '' END AS middle FROM b""")
def middle_k(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(G.middle(tokens("text"), 4), " ").alias("middle"))


@query("clause_number", f"""WITH {LINES} SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS clauseno
    FROM lines WHERE line <> ''""")
def clause_number(spark, sf):
    rows = lines(spark, sf).where(F.col("line") != "")
    return position(rows, ["doc_id"], "pos", "clauseno")


@query("raw_clean_lookup", f"""WITH c AS (SELECT doc_id, text AS original, trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')) AS treated FROM documents)
    SELECT a.doc_id, a.treated, b.original FROM c a JOIN
      (SELECT treated, arg_min(original, doc_id) AS original FROM c GROUP BY treated) b USING (treated)""")
def raw_clean_lookup(spark, sf):
    from clausegrid.functions.text import clean

    rows = docs(spark, sf).select(
        "doc_id", F.col("text").alias("original"), clean("text", ["to_lower", "remove_whitespace"]).alias("treated")
    )
    lookup = rows.groupBy("treated").agg(F.min_by("original", "doc_id").alias("original"))
    return rows.drop("original").join(lookup, "treated").select("doc_id", "treated", "original")


_KEEP, _DROP = "^/", "pol|terms"
_CUT = ["the", "/", "%20"]
_NAME = "link"
for _c in _CUT:
    _NAME = f"regexp_replace({_NAME}, '(?i){_c}', '', 'g')"


@query("extract_links", f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)
    SELECT page_id, link, {_NAME} AS name FROM l WHERE regexp_matches(link, '{_KEEP}') AND NOT regexp_matches(link, '{_DROP}')""")
def extract_links(spark, sf):
    from clausegrid.functions.links import extract_links as links

    return links(load(spark, sf, "pages"), "page_id", "html", keep=[_KEEP], drop=[_DROP], cut=_CUT)
