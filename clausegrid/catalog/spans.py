"""Span queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.catalog.base import query
from clausegrid.catalog.segment import strip_sql
from clausegrid.catalog.text import WS, docs
from clausegrid.functions.lexicon import NON_BLANK
from clausegrid.operators import spans as N
from clausegrid.operators.frames import map_rows

LEXICON = ["that", "with", "qui", "que", "und", "mit", "les"]
_OBL = N.lexicon_pattern(LEXICON)


@query("span_extract", f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.;]'), lambda s: {strip_sql('s')}),
      lambda s: regexp_matches(s, '{_OBL}')) AS s FROM documents)
    SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS obl FROM s""")
def span_extract(spark, sf):
    return N.extract_spans(docs(spark, sf), "doc_id", "text", _OBL)


def span_rows(spark, sf):
    """Per text: the first word, a span that starts inside it, one padded with blanks, one overlap, one of another label."""
    one = (F.instr("text", " ") - 1).cast("bigint")
    n = F.length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")

    def span(a, b, label):
        return F.struct(a.alias("start"), F.greatest(a, F.least(b, n)).alias("end"), F.lit(label).alias("label"))

    spans = F.array(
        span(zero, one, "OBLIGATION"),
        span(F.least(zero + 2, n), one + 14, "RIGHT"),
        span(F.least(one + 20, n), one + 41, "RIGHT"),
        span(F.least(one + 30, n), one + 50, "OBLIGATION"),
        span(F.least(one + 60, n), n - 1, "PARTY"),
        span(F.least(one + 60, n), n - 1, "RIGHT"),
    )
    return docs(spark, sf).select("doc_id", "text", spans.alias("spans"))


def _sp(a: str, b: str, label: str) -> str:
    return f"{{'start': CAST({a} AS BIGINT), 'end': CAST(greatest({a}, least({b}, n)) AS BIGINT), 'label': '{label}'}}"


_PIECE = 'substr(text, s."start" + 1, s."end" - s."start")'
_SPANS = f"""base AS (SELECT doc_id, text, instr(text, ' ') - 1 AS one, length(text) AS n FROM documents),
  raw AS (SELECT doc_id, text, [{_sp('0', 'one', 'OBLIGATION')}, {_sp('least(2, n)', 'one + 14', 'RIGHT')},
    {_sp('least(one + 20, n)', 'one + 41', 'RIGHT')}, {_sp('least(one + 30, n)', 'one + 50', 'OBLIGATION')},
    {_sp('least(one + 60, n)', 'n - 1', 'PARTY')}, {_sp('least(one + 60, n)', 'n - 1', 'RIGHT')}] AS spans FROM base),
  one_row AS (SELECT doc_id, text, unnest(spans) AS s, unnest(range(6)) AS ord FROM raw),
  kept AS (SELECT doc_id, text, ord, s FROM one_row WHERE s.label IN ('OBLIGATION', 'RIGHT')),
  lead AS (SELECT doc_id, text, ord, least(s."start" + length(regexp_extract({_PIECE}, '^{WS}*')), s."end") AS a0,
     s."end" - length(regexp_extract({_PIECE}, '{WS}*$')) AS b0 FROM kept),
  trimmed AS (SELECT doc_id, text, ord, a0, greatest(a0, b0) AS b0 FROM lead),
  inside AS (SELECT doc_id, ord,
     a0 + length(CASE WHEN a0 > 0 AND regexp_matches(substr(text, a0, 1), '^{NON_BLANK}') THEN regexp_extract(substr(text, a0 + 1), '^{NON_BLANK}*{WS}*')
        ELSE regexp_extract(substr(text, a0 + 1), '^{WS}*') END) AS a,
     length(regexp_replace(CASE WHEN regexp_matches(substr(text, b0 + 1, 1), '^{NON_BLANK}') THEN regexp_replace(left(text, b0), '{NON_BLANK}*$', '')
        ELSE left(text, b0) END, '{WS}*$', '')) AS b FROM trimmed),
  whole AS (SELECT doc_id, list([{{'a': a, 'b': b}}] ORDER BY ord) AS l FROM inside WHERE a < b GROUP BY doc_id),
  greedy AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: x[1].a < k.b AND k.a < x[1].b)) > 0
     THEN acc ELSE list_concat(acc, x) END) AS l FROM whole),
  prepared AS (SELECT doc_id, unnest(l) AS s FROM greedy)"""


@query("span_prepare", f"""WITH {_SPANS} SELECT doc_id, s.a AS start, s.b AS "end", 'OBLIGATION' AS label FROM prepared""")
def span_prepare(spark, sf):
    return N.prepare_spans(span_rows(spark, sf), "doc_id", "text", "spans", ["RIGHT", "OBLIGATION"], "OBLIGATION")


_TAGS = {"en": "the, with", "fr": "les, que", "de": "und, ich", "es": "los, de la"}
_TAG_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TAGS.items()) + " ELSE '-' END"


@query("find_span", f"""WITH t AS (SELECT doc_id, text, unnest(string_split({_TAG_SQL}, ', ')) AS tag FROM documents)
    SELECT doc_id, tag, CAST(instr(text, tag) - 1 AS INTEGER) AS start, CAST(instr(text, tag) - 1 + length(tag) AS INTEGER) AS "end"
    FROM t WHERE instr(text, tag) > 0""")
def find_span(spark, sf):
    tags = F.create_map(*[F.lit(x) for kv in _TAGS.items() for x in kv])
    rows = docs(spark, sf).select("doc_id", "text", F.coalesce(F.try_element_at(tags, "lang"), F.lit("-")).alias("tag"))
    found = map_rows(rows, "tag").withColumn("s", N.find_span("text", "tag"))
    return found.where(F.col("s").isNotNull()).select("doc_id", "tag", "s.start", "s.end")


_ACT = N.action_pattern(LEXICON)


def _part(i: int, name: str) -> str:
    return f"CASE WHEN hit THEN regexp_extract(sentence, '{_ACT}', {i}) END AS {name}"


@query("action_decompose", f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'),
      lambda s: {strip_sql('s')}), lambda s: s <> '') AS ss FROM documents),
    r AS (SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS pos, unnest(ss) AS sentence FROM s),
    h AS (SELECT *, regexp_matches(sentence, '{_ACT}') AS hit FROM r)
    SELECT doc_id, pos, {', '.join(_part(i + 1, n) for i, n in enumerate(['condition', 'subject', 'modal', 'verb', 'object']))} FROM h""")
def action_decompose(spark, sf):
    return N.action_decompose(docs(spark, sf), "doc_id", "text", LEXICON)


@query("span_score", f"""WITH {_SPANS}, gold AS (SELECT DISTINCT doc_id, s.a AS a, s.b AS b, CASE WHEN doc_id % 2 = 0 THEN 'OBLIGATION' ELSE 'RIGHT' END AS label FROM prepared),
    pred AS (SELECT DISTINCT doc_id, s."start" AS a, s."end" AS b, CASE WHEN doc_id % 2 = 0 THEN 'OBLIGATION' ELSE 'RIGHT' END AS label FROM kept),
    c AS (SELECT coalesce(p.label, g.label) AS label, count(*) FILTER (WHERE p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp,
      count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn
      FROM pred p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.a = g.a AND p.b = g.b AND p.label = g.label GROUP BY 1)
    SELECT label, tp, fp, fn, tp / (tp + fp) AS p, tp / (tp + fn) AS r, 2 * tp / (2 * tp + fp + fn) AS f FROM c""")
def span_score(spark, sf):
    name = F.when(F.col("doc_id") % 2 == 0, F.lit("OBLIGATION")).otherwise(F.lit("RIGHT"))
    rows = span_rows(spark, sf)
    gold = N.prepare_spans(rows, "doc_id", "text", "spans", ["RIGHT", "OBLIGATION"], "OBLIGATION").withColumn("label", name)
    raw = rows.select("doc_id", F.explode(N.relabel("spans", ["RIGHT", "OBLIGATION"], "OBLIGATION")).alias("s"))
    pred = raw.select("doc_id", "s.start", "s.end", name.alias("label"))
    return N.span_score(pred, gold, ["doc_id", "start", "end", "label"])
