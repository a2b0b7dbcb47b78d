"""Cleaning queries: each runs one step over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.catalog.base import query
from clausegrid.functions import lexicon as L
from clausegrid.functions import text as X
from clausegrid.operators import tokens as K
from clausegrid.session import load, spread

WS = L.BLANK
TOK = f"list_filter(string_split(trim(regexp_replace(@c@, '{WS}+', ' ', 'g')), ' '), lambda t: t <> '')"
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOP_WORDS)
PUNCT = L.PUNCTUATION.replace("'", "''")


def tok(c: str) -> str:
    return TOK.replace("@c@", c)


def docs(spark, sf):
    return spread(load(spark, sf, "documents"), "doc_id")


def on_docs(fn):
    return lambda spark, sf: docs(spark, sf).select("doc_id", fn("text").alias("clean"))


def numbered(spark, sf):
    """Documents with clause numbers: "1. " in front, ". 2. " at line ends, and an "(a) " mark."""
    body = F.replace(F.col("text"), F.lit(".\n"), F.lit(". 2. "))
    return docs(spark, sf).select("doc_id", F.concat(F.lit("1. "), body, F.lit(" (a) iv) 17 end 2001.")).alias("text"))


NUMBERED = """numbered AS (SELECT doc_id, '1. ' || replace(text, '.' || chr(10), '. 2. ')
    || ' (a) iv) 17 end 2001.' AS text FROM documents)"""

query("clean_lower", "SELECT doc_id, lower(text) AS clean FROM documents")(on_docs(X.to_lower))

query("clean_remove_number", r"SELECT page_id, regexp_replace(html, '\p{Nd}+', '', 'g') AS clean FROM pages")(
    lambda spark, sf: load(spark, sf, "pages").select("page_id", X.remove_number("html").alias("clean"))
)

query(
    "clean_remove_bullets",
    f"WITH {NUMBERED} SELECT doc_id, regexp_replace(text, '{L.BULLET}', ' ', 'g') AS clean FROM numbered",
)(lambda spark, sf: numbered(spark, sf).select("doc_id", X.remove_bullets("text").alias("clean")))

query(
    "clean_remove_url",
    f"SELECT page_id, regexp_replace('see ' || url || ' in ' || html, '{L.URL}', '', 'g') AS clean FROM pages",
)(
    lambda spark, sf: load(spark, sf, "pages").select(
        "page_id", X.remove_url(F.concat(F.lit("see "), "url", F.lit(" in "), "html")).alias("clean")
    )
)

query("clean_remove_punct", f"SELECT doc_id, translate(text, '{PUNCT}', '') AS clean FROM documents")(
    on_docs(X.remove_punctuation)
)
query(
    "clean_remove_special", f"SELECT doc_id, translate(text, '{L.SPECIAL_CHARACTERS}', '') AS clean FROM documents"
)(on_docs(X.remove_special))
query(
    "clean_keep_alnum", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') AS clean FROM documents"
)(on_docs(X.keep_alphanumeric))
query(
    "clean_whitespace", f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS clean FROM documents"
)(on_docs(X.squeeze_blanks))
query(
    "clean_ascii_fold",
    r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS clean FROM documents",
)(on_docs(X.ascii_fold))
query(
    "clean_stopwords",
    f"SELECT doc_id, array_to_string(list_filter({tok('text')}, lambda w: w NOT IN ({STOPS})), ' ') AS clean FROM documents",
)(on_docs(X.remove_stopwords))

_TREATED = f"array_to_string(list_filter({tok('text')}, lambda w: w NOT IN ({STOPS})), ' ')"
query(
    "treat_tokens",
    f"""WITH a AS (SELECT doc_id, translate({_TREATED}, '{PUNCT}', repeat(' ', {len(L.PUNCTUATION)})) AS t FROM documents)
    SELECT doc_id, array_to_string(list_filter({tok('t')},
      lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\\p{{Nd}}+')), ' ') AS clean FROM a""",
)(on_docs(X.treat_tokens))

query(
    "drop_long_tokens",
    f"""WITH a AS (SELECT doc_id, array_to_string(list_filter({tok('text')}, lambda w: length(w) <= 20), ' ') AS clean
    FROM documents) SELECT * FROM a WHERE length(clean) < 30000""",
)(
    lambda spark, sf: docs(spark, sf)
    .select("doc_id", X.drop_long_tokens("text").alias("clean"))
    .where(F.length("clean") < 30000)
)


def lines(spark, sf):
    """Document lines, some behind a tariff code, a table mark or a page number."""
    rows = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kind = (F.col("doc_id") + F.col("pos")) % 6
    marked = (
        F.when(kind == 1, F.concat(F.lit("8471.30 "), "line"))
        .when(kind == 2, F.concat(F.lit("1 - - "), "line"))
        .when(kind == 3, F.lit("7 "))
        .when(kind == 4, F.concat(F.lit("42"), "line"))
        .otherwise(F.col("line"))
    )
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), marked.alias("line"))


LINES = """lines AS (SELECT doc_id, pos, CASE (doc_id + pos) % 6 WHEN 1 THEN '8471.30 ' || line
    WHEN 2 THEN '1 - - ' || line WHEN 3 THEN '7 ' WHEN 4 THEN '42' || line ELSE line END AS line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""

query(
    "drop_noise_paragraphs",
    f"WITH {LINES} SELECT doc_id, pos, line FROM lines WHERE "
    + " AND ".join(f"NOT regexp_matches(line, '{p}')" for p in L.NOISE_PARAGRAPHS),
)(lambda spark, sf: lines(spark, sf).where(~X.is_noise_paragraph("line")))

_CHAIN = ["to_lower", "remove_url", "remove_special_character", "normalize_unicode", "remove_punctuation", "remove_number", "remove_whitespace"]


def clean_chain_sql(c: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(translate(regexp_replace(strip_accents(translate(
      regexp_replace(lower({c}), '{L.URL}', '', 'g'), '{L.SPECIAL_CHARACTERS}', '')), '[^\\x00-\\x7F]', '', 'g'),
      '{PUNCT}', ''), '\\p{{Nd}}+', '', 'g'), '{WS}+', ' ', 'g'))"""


query("clean_chain", f"SELECT doc_id, {clean_chain_sql('text')} AS clean FROM documents")(lambda spark, sf: docs(spark, sf).select("doc_id", X.clean("text", _CHAIN).alias("clean")))


def section_titles(spark, sf):
    return load(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("chapter sixteen "), "role", F.lit(" two part twenty "), "text").alias("title"),
    )


_NUM = "'chapter sixteen ' || role || ' two part twenty ' || text"
for _w in L.NUMBER_WORDS:
    _NUM = f"replace({_NUM}, '{_w}', '')"

query("strip_number_words", f"SELECT conv_id, turn, {_NUM} AS title FROM conversations")(
    lambda spark, sf: section_titles(spark, sf).select("conv_id", "turn", X.strip_number_words("title").alias("title"))
)

_CARD = r"'(^|[^\p{L}\p{N}_.])[0-9]{2,}($|[^\p{L}\p{N}_.])', '\1\2', 'g'"


def paged(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", F.concat("line", F.lit(" 12 34 5 2001x page 118")).alias("line"))


query(
    "drop_page_numbers",
    f"""WITH {LINES}, paged AS (SELECT doc_id, pos, line || ' 12 34 5 2001x page 118' AS line FROM lines)
    SELECT doc_id, pos, regexp_replace(regexp_replace(line, {_CARD}), {_CARD}) AS line FROM paged""",
)(lambda spark, sf: paged(spark, sf).withColumn("line", X.drop_cardinals("line")))

query(
    "country_prefix_clean",
    """SELECT c_custkey, split_part(replace(c_name || ' Rep., ' || c_mktsegment, 'Rep.', 'Republic'), ',', 1) AS name
    FROM customer""",
)(
    lambda spark, sf: load(spark, sf, "customer").select(
        "c_custkey", X.country_name(F.concat("c_name", F.lit(" Rep., "), "c_mktsegment")).alias("name")
    )
)

query("clean_stem")(lambda spark, sf: K.stem_text(docs(spark, sf), "doc_id", "text"))


def rewrites(spark, sf):
    """A rewriting table made of the benchmark words: each word maps to its first three letters."""
    words = load(spark, sf, "benchmark").select(F.explode(X.tokens("text")).alias("word")).distinct()
    return words.select("word", F.left("word", F.lit(3)).alias("short"))


query(
    "dict_token_map",
    f"""WITH words AS (SELECT DISTINCT unnest({tok('text')}) AS word FROM benchmark),
    t AS (SELECT doc_id, unnest({tok('text')}) AS token, unnest(range(len({tok('text')}))) AS pos FROM documents),
    j AS (SELECT t.doc_id, t.pos, coalesce(left(w.word, 3), t.token) AS token FROM t LEFT JOIN words w ON w.word = t.token),
    g AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS mapped FROM j GROUP BY doc_id)
    SELECT d.doc_id, coalesce(g.mapped, '') AS mapped FROM documents d LEFT JOIN g USING (doc_id)""",
)(lambda spark, sf: K.map_tokens(docs(spark, sf), "doc_id", "text", rewrites(spark, sf), "word", "short"))


def vocabulary(spark, sf):
    words = docs(spark, sf).select(X.remove_punctuation(X.to_lower("text")).alias("t"))
    return K.word_counts(words, "t").where(F.col("n") >= 2)


def glued(spark, sf):
    """Every two neighbouring benchmark words written as one."""
    t = load(spark, sf, "benchmark").select(X.tokens(X.remove_punctuation(X.to_lower("text"))).alias("t"))
    return t.select(
        F.explode(F.expr("transform(slice(t, 1, greatest(size(t) - 1, 0)), (x, i) -> concat(x, t[i + 1]))")).alias("word")
    )


_LOWPUNCT = f"translate(lower(text), '{PUNCT}', '')"
query(
    "split_joined_words",
    f"""WITH v AS (SELECT token, count(*) AS n FROM (SELECT unnest({tok(_LOWPUNCT)}) AS token FROM documents)
       GROUP BY token HAVING count(*) >= 2),
    b AS (SELECT {tok(_LOWPUNCT)} AS t FROM benchmark),
    w AS (SELECT DISTINCT a || c AS word FROM (SELECT unnest(t[:-2]) AS a, unnest(t[2:]) AS c FROM b)),
    cut AS (SELECT word, unnest(range(1, length(word))) AS pos FROM w),
    s AS (SELECT cut.word, cut.pos, l.token AS "left", r.token AS "right", l.n::DOUBLE * r.n AS score
       FROM cut JOIN v l ON l.token = left(cut.word, cut.pos) JOIN v r ON r.token = substr(cut.word, cut.pos + 1)),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, pos) = 1),
    x AS (SELECT w.word, best."left", best."right", best.score > coalesce(v.n, 0)::DOUBLE * (SELECT sum(n) FROM v) AS wins
       FROM w LEFT JOIN best ON best.word = w.word LEFT JOIN v ON v.token = w.word)
    SELECT word, CASE WHEN wins THEN "left" END AS "left", CASE WHEN wins THEN "right" END AS "right" FROM x""",
)(lambda spark, sf: K.split_joined(glued(spark, sf), "word", vocabulary(spark, sf)))


def run_together(spark, sf):
    """Every two, three and four neighbouring benchmark words written as one."""
    t = load(spark, sf, "benchmark").select(X.tokens(X.remove_punctuation(X.to_lower("text"))).alias("t"))
    several = F.expr("flatten(transform(array(2, 3, 4), k -> transform(slice(t, 1, greatest(size(t) - k + 1, 0)), (x, i) -> array_join(slice(t, i + 1, k), ''))))")
    return t.select(F.explode(several).alias("word"))


query("split_run_together")(
    lambda spark, sf: K.split_words(run_together(spark, sf), "word", vocabulary(spark, sf)).withColumn("parts", F.array_join("parts", " "))
)

_BI = f"""WITH t AS (SELECT doc_id, {tok('lower(text)')} AS t FROM documents),
    p AS (SELECT doc_id, unnest(t[:-2]) AS token_a, unnest(t[2:]) AS token_b FROM t),
    n1 AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM t) GROUP BY token),
    n2 AS (SELECT token_a, token_b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 20),
    ph AS (SELECT n2.*, (n2.n - 20) * CAST((SELECT count(*) FROM n1) AS DOUBLE) / (a.n * b.n) AS score
       FROM n2 JOIN n1 a ON a.token = token_a JOIN n1 b ON b.token = token_b)"""


def lowered(spark, sf):
    return docs(spark, sf).select("doc_id", F.lower("text").alias("text"))


query(
    "bigrams",
    _BI + " SELECT token_a, token_b, n, round(score, 6) AS score FROM ph WHERE score > 10",
)(
    lambda spark, sf: K.bigrams(lowered(spark, sf), "doc_id", "text").withColumn("score", F.round("score", 6))
)
query(
    "append_bigrams",
    _BI + """ SELECT p.doc_id, p.token_a || '_' || p.token_b AS phrase, count(*) AS n FROM p
       JOIN ph ON ph.token_a = p.token_a AND ph.token_b = p.token_b AND ph.score > 10 GROUP BY ALL""",
)(
    lambda spark, sf: K.append_bigrams(
        lowered(spark, sf), "doc_id", "text", K.bigrams(lowered(spark, sf), "doc_id", "text")
    )
)
