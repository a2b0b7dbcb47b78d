"""The registered queries of the subpackage, one or more for each operator, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.llm import bpe, chat, decontam, divergence, fingerprint, html, language, neardup, repair, sharding, toxicity, urls, warc
from clausegrid.session import load

QUERIES, ORACLES = {}, {}

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_bpe(spark, sf_dir):
    """Ids of every document and their text again, as digests."""
    return bpe.encode_decode(load(spark, sf_dir, "documents"), bpe.vocabulary_path()).drop("ids")


@query()
def op2_html(spark, sf_dir):
    """Main text of every page."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


@query()
def op3_decontam(spark, sf_dir):
    """Benchmark items found in each document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_items(docs, load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "item_ids", "likeness")


@query("""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT a AS node, b AS seen FROM ways UNION SELECT r.node, w.b FROM r JOIN ways w ON r.seen = w.a),
m AS (SELECT node, min(seen) AS low FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(low, s.doc_id)) AS kept
FROM s LEFT JOIN m ON s.doc_id = m.node
""")
def op4_near_duplicates(spark, sf_dir):
    """Groups of near duplicates and the document of each that stays."""
    return neardup.near_duplicates(load(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hexed FROM p),
b AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hexed, (5 * (i // 4) + 1)::INT, 5))::INT >> ((3 - i % 4) * 5)::INT) & 31), 1)), 'string_agg', '') AS payload_digest
  FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM m
""")
def op5_warc(spark, sf_dir):
    """Archives of all pages, read back in byte ranges."""
    records = warc.archive_pages(load(spark, sf_dir, "pages"))
    return records.select(
        F.col("key").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to",
    )


@query()
def op6_fingerprint(spark, sf_dir):
    """Fingerprints of every document and its edited text."""
    return fingerprint.edited_fingerprints(load(spark, sf_dir, "documents"))


@query()
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.draw(docs, load(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 15 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op8_chat(spark, sf_dir):
    """Every conversation formatted, then read back."""
    odd = "\\### Assistant: </turn> ok"
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    messages = chat.thread(rows)
    out = chat.format_paths(messages, chat.paths(messages, keep=1))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    key = F.when(F.col("tree").startswith("+"), F.expr("substr(tree, 2)").cast("long"))
    return out.select(
        key.alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("""
WITH s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS rest FROM s),
t AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r),
u AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM t)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM u
""")
def op9_urls(spark, sf_dir):
    """The rule and verdict for every page's url."""
    return urls.judge(load(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_language(spark, sf_dir):
    """Language of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.draw(docs))
    labelled = language.predict(docs.select("doc_id", "text"), model)
    return labelled.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("""
WITH table_ AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) AS r(i))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) AS bytes, string_split(hex(encode(coalesce(text, ''))), '') AS c FROM documents),
b AS (SELECT doc_id, bytes, list_transform(range(1, bytes + 1), lambda i: 16 * (strpos('0123456789ABCDEF', c[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', c[2 * i]) - 1) AS c FROM d),
s AS (
  SELECT doc_id, bytes + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, c), lambda crc, byte: xor(crc >> 8, t[1 + (xor(crc, byte) & 255)]))) AS text_crc32 FROM b, table_),
node(parent, name, weight, since) AS (
  SELECT 'root', 'region' || r, 4.0, 8 FROM range(2) AS x(r)
  UNION ALL SELECT 'region' || (k // 2), 'region' || (k // 2) || '/rack' || k, 2.0, 8 FROM range(4) AS x(k)
  UNION ALL SELECT 'region' || (n // 4) || '/rack' || (n // 2), 'region' || (n // 4) || '/rack' || (n // 2) || '/' || n, 1.0, 8 FROM range(8) AS x(n)
  UNION ALL VALUES ('root', 'own-shard8', 1.0, 9), ('own-shard8', 'own-shard8/own-shard8', 1.0, 9), ('own-shard8/own-shard8', 'own-shard8/own-shard8/8', 1.0, 9)),
i AS (SELECT doc_id, coalesce('+' || doc_id::VARCHAR, '-') AS key FROM documents),
w AS (
  SELECT doc_id, shards, parent, arg_min(name, -ln((('0x' || substr(md5(name || '|' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496) / weight) AS name
  FROM i, node, (VALUES (8), (9)) AS v(shards) WHERE since <= shards GROUP BY ALL),
p AS (
  SELECT a.doc_id, a.shards, string_split(c.name, '/')[3]::INT AS shard
  FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.shards = a.shards AND b.parent = a.name JOIN w c ON c.doc_id = b.doc_id AND c.shards = b.shards AND c.parent = b.name WHERE a.parent = 'root')
SELECT s.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, o.shard, row_number() OVER (PARTITION BY o.shard ORDER BY s.doc_id) - 1 AS slot, g.shard AS grown_shard
FROM s JOIN p o ON o.doc_id = s.doc_id AND o.shards = 8 JOIN p g ON g.doc_id = s.doc_id AND g.shards = 9
""")
def op11_shards(spark, sf_dir):
    """The shard of every document among eight, and among nine."""
    eight = sharding.grid(8)
    placed = sharding.assign(load(spark, sf_dir, "documents"), eight, sharding.with_shard(eight, 8))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
size AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n)::HUGEINT AS total FROM l GROUP BY lang),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(gn.total, 0) + v) AS p
  FROM g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT l.lang, l.term, 1 + 1000000000 * (l.n + 1) // (total + v) AS q FROM l JOIN ln USING (lang) JOIN size USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
pairs AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM terms WHERE rank <= 200
""")
def op12_divergence(spark, sf_dir):
    """How far the sources of a language are apart, and the terms that mark each."""
    return divergence.audit(load(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1),
    lambda i: list_transform(range(8), lambda b: ((ascii(substr(key, i, 1)) >> b::INT) & 1)::BIGINT)))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1)))) % 20 AS kind FROM k),
d AS (
  SELECT coalesce('+' || conv_id::VARCHAR, '-') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS c FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS seen FROM o),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2
    WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(c) OVER (PARTITION BY conv ORDER BY i) || c AS two FROM r),
arc(p, c, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
added(p, q, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (3, 2, 3, 'I'), (2, 3, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
edit AS (
  SELECT conv, i, p, p AS q, 4 AS cost, 'D' AS edits FROM f, range(4) AS s(p)
  UNION ALL SELECT conv, i, p, q, CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'K' FROM f JOIN arc USING (c) WHERE fault IN (0, 3)
  UNION ALL SELECT conv, i, p, q, 3 + CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'R' FROM f JOIN arc ON arc.c IN ('u', 'a') WHERE fault IN (0, 3)),
way AS (
  SELECT conv, 0::BIGINT AS i, q, lpad(added.cost::VARCHAR, 12, '0') || edits AS best FROM (SELECT DISTINCT conv FROM f), added WHERE p = 0
  UNION ALL
  SELECT way.conv, way.i + 1, added.q, min(lpad((substr(best, 1, 12)::BIGINT + edit.cost + added.cost)::VARCHAR, 12, '0') || substr(best, 13) || edit.edits || added.edits)
  FROM way JOIN edit ON edit.conv = way.conv AND edit.i = way.i + 1 AND edit.p = way.q JOIN added ON added.p = edit.q GROUP BY way.conv, way.i, added.q),
n AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv),
least AS (SELECT n.*, w.best FROM n JOIN (SELECT conv, i, min(best) AS best FROM way WHERE q IN (0, 3) GROUP BY ALL) w ON w.conv = n.conv AND w.i = n.n),
walk AS (
  SELECT conv, 0::BIGINT AS pos, 0::BIGINT AS i, 0 AS state, NULL::VARCHAR AS line, substr(best, 13) AS audit FROM least
  UNION ALL
  SELECT walk.conv, pos + 1, walk.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE WHEN e = 'D' THEN state WHEN e = 'K' AND f.c = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
    CASE e WHEN 'D' THEN NULL WHEN 'K' THEN f.role || ':' || f.text ELSE CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN f.text ELSE '' END END, audit
  FROM (SELECT *, substr(audit, (pos + 1)::INT, 1) AS e FROM walk WHERE pos < length(audit)) walk LEFT JOIN f ON f.conv = walk.conv AND f.i = walk.i + 1),
told AS (SELECT conv, string_agg(line, chr(10) ORDER BY pos) AS lines FROM walk GROUP BY conv),
every AS (SELECT DISTINCT conv_id, coalesce('+' || conv_id::VARCHAR, '-') AS conv FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(best, 1, 12)::BIGINT, 0) AS cost, coalesce(substr(best, 13), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM every LEFT JOIN least USING (conv) LEFT JOIN told USING (conv)
""")
def op13_repair(spark, sf_dir):
    """Damaged conversations, their faults and cheapest repair."""
    return repair.damaged_and_repaired(load(spark, sf_dir, "conversations"))
