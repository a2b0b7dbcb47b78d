"""Filters, lookups, labels, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid import fixtures as fx
from clausegrid.catalog.base import query, with_cte
from clausegrid.catalog.text import LINES, docs, lines, lowered, tok
from clausegrid.functions.text import ascii_fold, tokens
from clausegrid.operators import corpus as C
from clausegrid.operators import edits as E
from clausegrid.operators import frames as R
from clausegrid.operators import labels as B
from clausegrid.operators import lookups as J
from clausegrid.operators import sampling as M
from clausegrid.session import load

# --- projections and filters


@query("filter_nulls", with_cte("agreement", "SELECT rta_id, fta_name, dif, din FROM agreement WHERE dif IS NOT NULL AND din IS NOT NULL"))
def filter_nulls(spark, sf):
    return fx.agreements(spark, sf).select("rta_id", "fta_name", "dif", "din").na.drop(subset=["dif", "din"])


@query("filter_min_words", f"WITH {LINES} SELECT doc_id, pos, line FROM lines WHERE len({tok('line')}) > 5")
def filter_min_words(spark, sf):
    return lines(spark, sf).where(R.min_words("line", 5))


@query("filter_label", with_cte("clause", """SELECT doc_id, clause_id, topic_no FROM
    (SELECT doc_id, clause_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id % 7 END AS topic_no FROM clause)
    WHERE topic_no <> -1 AND clause_id <> 'src0_en'"""))
def filter_label(spark, sf):
    topic = F.when(F.col("doc_id") % 7 == 0, F.lit(-1)).otherwise(F.col("doc_id") % 7)
    df = fx.clauses(spark, sf).select("doc_id", "clause_id", topic.alias("topic_no"))
    return df.where((F.col("topic_no") != -1) & (F.col("clause_id") != "src0_en"))


@query("filter_isin", with_cte("clause", """SELECT doc_id, clause_id FROM clause
    WHERE rta_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
      AND clause_id NOT IN (SELECT DISTINCT source || '_fr' FROM documents)"""))
def filter_isin(spark, sf):
    df = fx.clauses(spark, sf).select("doc_id", "rta_id", "clause_id")
    solvent = load(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("rta_id"))
    french = docs(spark, sf).select(F.concat("source", F.lit("_fr")).alias("clause_id")).distinct()
    return df.join(solvent, "rta_id", "left_semi").join(french, "clause_id", "left_anti").select("doc_id", "clause_id")


@query("make_key", "SELECT d.doc_id, d.source || '_' || CAST(l.quality AS VARCHAR) AS clause_id FROM documents d LEFT JOIN labels l USING (doc_id)")
def make_key(spark, sf):
    df = docs(spark, sf).join(load(spark, sf, "labels"), "doc_id", "left")
    return df.select("doc_id", R.compound_key("source", F.col("quality").cast("string")).alias("clause_id"))


@query("conditional_override", """SELECT doc_id, CASE source WHEN 'src5' THEN 'trade in goods' WHEN 'src7' THEN 'e-commerce'
    ELSE lang END AS chapter_cat FROM documents""")
def conditional_override(spark, sf):
    cases = {"src5": "trade in goods", "src7": "e-commerce"}
    return docs(spark, sf).select("doc_id", R.override("lang", cases, by="source").alias("chapter_cat"))


@query("coalesce_labels", "SELECT d.doc_id, coalesce(l.toxic, l.quality, -1) AS label FROM documents d LEFT JOIN (SELECT doc_id, quality, nullif(toxic, 0) AS toxic FROM labels) l USING (doc_id)")
def coalesce_labels(spark, sf):
    lab = load(spark, sf, "labels").select("doc_id", "quality", F.nullif("toxic", F.lit(0)).alias("toxic"))
    return docs(spark, sf).join(lab, "doc_id", "left").select("doc_id", F.coalesce("toxic", "quality", F.lit(-1)).alias("label"))


@query("rename_project", with_cte("clause", "SELECT doc_id AS clauseno, chapter_cat AS chapter, article_cat AS article, weight AS isMandatory_prob FROM clause"))
def rename_project(spark, sf):
    names = {"doc_id": "clauseno", "chapter_cat": "chapter", "article_cat": "article", "weight": "isMandatory_prob"}
    return fx.clauses(spark, sf).select(*names).withColumnsRenamed(names)


@query("parse_category_list", "SELECT doc_id, unnest([lang, source]) AS tag FROM documents")
def parse_category_list(spark, sf):
    cells = docs(spark, sf).select("doc_id", F.concat("lang", F.lit(", "), "source").alias("tag"))
    return R.map_rows(cells, "tag")


# --- joins


@query("join_lookup", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_lookup(spark, sf):
    table = load(spark, sf, "labels").withColumnRenamed("doc_id", "label_doc")
    return J.join_lookup(docs(spark, sf).select("doc_id", "lang"), table, "doc_id", "label_doc")


_NULLABLE = """d AS (SELECT doc_id, nullif(lang, 'de') AS lang, source FROM documents),
    s AS (SELECT lang, source, count(*) AS n FROM d GROUP BY ALL)"""


@query("join_multi_key", f"WITH {_NULLABLE} SELECT d.*, s.n FROM d LEFT JOIN s ON d.lang IS NOT DISTINCT FROM s.lang AND d.source = s.source")
def join_multi_key(spark, sf):
    d = docs(spark, sf).select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"), "source")
    s = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return J.join_null_safe(d, s, ["lang", "source"])


@query("join_dim_twice", """SELECT l.l_orderkey, l.l_linenumber, e.n_name AS exporter, i.n_name AS importer FROM lineitem l
    JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
    LEFT JOIN nation e ON e.n_nationkey = s.s_nationkey LEFT JOIN nation i ON i.n_nationkey = c.c_nationkey""")
def join_dim_twice(spark, sf):
    nation = load(spark, sf, "nation")
    rows = (
        load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        .join(load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("j")), "o_custkey")
        .join(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("i")), "l_suppkey")
    )
    seller = nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("exporter"))
    buyer = nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("importer"))
    both = J.join_lookup(J.join_lookup(rows, seller, "i", "code"), buyer, "j", "code")
    return both.select("l_orderkey", "l_linenumber", "exporter", "importer")


@query("join_backfill", with_cte("agreement", """, gaps AS (SELECT rta_id, CASE WHEN rta_id % 3 = 0 THEN NULL ELSE array_to_string(parties, ' ') END AS parties,
      CASE WHEN rta_id % 4 = 0 THEN NULL ELSE dif END AS dif FROM agreement)
    SELECT g.rta_id, coalesce(g.parties, array_to_string(a.parties, ' ')) AS parties, coalesce(g.dif, a.dif) AS dif
    FROM gaps g JOIN agreement a USING (rta_id)"""))
def join_backfill(spark, sf):
    reg = fx.agreements(spark, sf).select("rta_id", F.array_join("parties", " ").alias("parties"), "dif", "fta_name")
    gaps = reg.select(
        "rta_id",
        F.when(F.col("rta_id") % 3 != 0, F.col("parties")).alias("parties"),
        F.when(F.col("rta_id") % 4 != 0, F.col("dif")).alias("dif"),
    )
    doubled = reg.unionByName(reg.withColumn("fta_name", F.concat("fta_name", F.lit(" (second name)"))))
    return J.backfill(gaps, doubled, "rta_id", ["parties", "dif"], order="fta_name")


_HALVES = """, national AS (SELECT doc_id, rta_id, clause_id, 'national' AS origin FROM clause WHERE rta_id % 3 = 0),
    world AS (SELECT doc_id, rta_id, clause_id, weight, 'world' AS origin FROM clause WHERE rta_id % 2 = 0)"""


def national(spark, sf):
    return fx.clauses(spark, sf).where(F.col("rta_id") % 3 == 0).select("doc_id", "rta_id", "clause_id", F.lit("national").alias("origin"))


def world(spark, sf):
    return fx.clauses(spark, sf).where(F.col("rta_id") % 2 == 0).select("doc_id", "rta_id", "clause_id", "weight", F.lit("world").alias("origin"))


@query("join_anti_prefer", with_cte("clause", _HALVES + """SELECT doc_id, rta_id, clause_id, origin, NULL::DOUBLE AS weight FROM national
    UNION ALL SELECT doc_id, rta_id, clause_id, origin, weight FROM world WHERE rta_id NOT IN (SELECT rta_id FROM national)"""))
def join_anti_prefer(spark, sf):
    return J.prefer(national(spark, sf), world(spark, sf), "rta_id")


@query("join_outer_many", """WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1),
    s AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1),
    b AS (SELECT s_nationkey AS nation, count(*) AS debtors FROM supplier WHERE s_acctbal < 0 GROUP BY 1),
    k AS (SELECT c_nationkey AS nation, count(*) AS households FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY 1)
    SELECT * FROM c FULL JOIN s USING (nation) FULL JOIN b USING (nation) FULL JOIN k USING (nation)""")
def join_outer_many(spark, sf):
    cust, supp = load(spark, sf, "customer"), load(spark, sf, "supplier")

    def per(df, key, name):
        return df.groupBy(F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias(name))

    return R.outer_merge(
        [
            per(cust.where("c_acctbal < 0"), "c_nationkey", "customers"),
            per(supp, "s_nationkey", "suppliers"),
            per(supp.where("s_acctbal < 0"), "s_nationkey", "debtors"),
            per(cust.where("c_mktsegment = 'HOUSEHOLD'"), "c_nationkey", "households"),
        ]
    )


def aliases(spark, sf):
    """Customer names as country names with a code, and market segments as groups of them."""
    c = load(spark, sf, "customer")
    single = c.select(F.col("c_name").alias("name"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"))
    group = c.where("c_acctbal > 9000").select(
        F.concat("c_mktsegment", F.lit(" group")).alias("name"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code")
    )
    return single.unionByName(group)


def registry(spark, sf):
    """One signatory list per supplier: an exact name, a name with a typing error, a group and an unknown name."""
    s = load(spark, sf, "supplier")
    name = F.regexp_replace("s_name", "Supplier", "Customer")
    typo = F.regexp_replace("s_name", "Supplier#", "Customxr #")
    return s.select(
        "s_suppkey",
        F.concat_ws(
            "; ", name,
            F.when(F.col("s_suppkey") % 3 == 0, typo).otherwise(F.lit("Atlantis")),
            F.when(F.col("s_suppkey") % 5 == 0, F.lit("BUILDING group")).otherwise(name),
        ).alias("signatories"),
    )


_ALIAS = """alias AS (SELECT c_name AS name, 'C' || c_custkey AS code FROM customer
      UNION ALL SELECT c_mktsegment || ' group', 'C' || c_custkey FROM customer WHERE c_acctbal > 9000),
    sig AS (SELECT s_suppkey, unnest([replace(s_name, 'Supplier', 'Customer'),
      CASE WHEN s_suppkey % 3 = 0 THEN replace(s_name, 'Supplier#', 'Customxr #') ELSE 'Atlantis' END,
      CASE WHEN s_suppkey % 5 = 0 THEN 'BUILDING group' ELSE replace(s_name, 'Supplier', 'Customer') END]) AS name FROM supplier),
    names AS (SELECT DISTINCT name FROM sig),
    near AS (SELECT n.name, a.name AS alias, levenshtein(n.name, a.name) AS d FROM names n JOIN (SELECT DISTINCT name FROM alias) a
      ON levenshtein(n.name, a.name) <= 2 QUALIFY row_number() OVER (PARTITION BY n.name ORDER BY d, a.name) = 1)"""


@query("map_country_codes", f"""WITH {_ALIAS} SELECT s.s_suppkey, (SELECT array_to_string(list_sort(list_distinct(list(a.code))), ' ')
      FROM sig g JOIN near n ON n.name = g.name JOIN alias a ON a.name = n.alias WHERE g.s_suppkey = s.s_suppkey) AS parties FROM supplier s""")
def map_country_codes(spark, sf):
    got = J.map_country_codes(registry(spark, sf), "s_suppkey", "signatories", aliases(spark, sf))
    return got.withColumn("parties", F.array_join("parties", " "))


@query("unmatched_names", f"WITH {_ALIAS} SELECT name FROM names WHERE name NOT IN (SELECT name FROM near)")
def unmatched_names(spark, sf):
    rows = registry(spark, sf).select(F.explode(F.split("signatories", "; ")).alias("name"))
    return J.match_names(rows, "name", aliases(spark, sf)).where(F.col("code").isNull()).select("name")


_ASCII = r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')"


@query("edit_distance_pairs", f"""WITH w AS (SELECT DISTINCT unnest({tok(_ASCII)}) AS word FROM benchmark)
    SELECT a.word AS a, b.word AS b, CAST(-levenshtein(a.word, b.word) AS INTEGER) AS similarity
    FROM w a JOIN w b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 2 AND levenshtein(a.word, b.word) <= 2""")
def edit_distance_pairs(spark, sf):
    words = load(spark, sf, "benchmark").select(F.explode(tokens(ascii_fold("text"))).alias("word"))
    return E.edit_distance_pairs(words, "word", 2)


@query("zip_by_position", "SELECT d.doc_id, d.lang, length(d.text) AS n FROM documents d")
def zip_by_position(spark, sf):
    d = docs(spark, sf)
    result = d.select("doc_id", F.length("text").cast("bigint").alias("n"))
    return d.select("doc_id", "lang").join(result, "doc_id")


# --- aggregations


@query("mode_label", with_cte("clause", """, n AS (SELECT chapter_cat, article_cat, count(*) AS n FROM clause GROUP BY ALL)
    SELECT chapter_cat, article_cat AS article_label FROM n QUALIFY row_number() OVER (PARTITION BY chapter_cat ORDER BY n DESC, article_cat) = 1"""))
def mode_label(spark, sf):
    return B.mode_label(fx.clauses(spark, sf), ["chapter_cat"], "article_cat", "article_label")


@query("dense_group_id", with_cte("clause", """SELECT doc_id, chapter_cat, article_cat,
    dense_rank() OVER (ORDER BY chapter_cat, article_cat) - 1 AS clause_no FROM clause"""))
def dense_group_id(spark, sf):
    rows, _ = B.dense_group_id(fx.clauses(spark, sf).select("doc_id", "chapter_cat", "article_cat"), ["chapter_cat", "article_cat"], "clause_no")
    return rows


@query("distinct_values", "SELECT DISTINCT text FROM documents")
def distinct_values(spark, sf):
    return docs(spark, sf).select("text").distinct()


@query("dedup_first", "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(spark, sf):
    return B.dedup_first(docs(spark, sf), ["text"], "doc_id")


@query("duplicate_audit", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def duplicate_audit(spark, sf):
    return B.duplicate_audit(docs(spark, sf), ["text"], "doc_id").select("doc_id", "lang", "source")


@query("one_hot", """SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_BUILDING, CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS c_mktsegment_FURNITURE,
    CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS c_mktsegment_HOUSEHOLD, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_MACHINERY FROM customer""")
def one_hot(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return B.one_hot(c, "c_mktsegment", B.bounded_values(c, "c_mktsegment", 100)).drop("c_mktsegment")


@query("confusion_matrix", """WITH p AS (SELECT l.quality AS y, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS yhat FROM labels l JOIN documents d USING (doc_id))
    SELECT y, yhat, count(*) AS n, (SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) FROM p)::DOUBLE AS accuracy FROM p GROUP BY y, yhat""")
def confusion_matrix(spark, sf):
    rule = docs(spark, sf).select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("yhat"))
    rows = load(spark, sf, "labels").join(rule, "doc_id").select(F.col("quality").alias("y"), "yhat")
    return B.confusion_matrix(rows, "y", "yhat")


@query("cluster_members", """WITH m AS (SELECT DISTINCT label, lpad(CAST(vec_id AS VARCHAR), 8, '0') AS member FROM embeddings),
    r AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY member) - 1) // 20 AS line FROM m)
    SELECT label, line, string_agg(member, ', ' ORDER BY member) AS members FROM r GROUP BY label, line""")
def cluster_members(spark, sf):
    e = load(spark, sf, "embeddings").select("label", F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("member"))
    return B.cluster_members(e, "label", "member", width=20)


@query("shortest_name", """WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size = 1 THEN -1 ELSE p_size END AS cluster FROM part),
    b AS (SELECT cluster, p_name FROM p WHERE cluster <> -1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY length(p_name), p_name) = 1)
    SELECT p.p_partkey, p.cluster, p.p_name, coalesce(b.p_name, p.p_name) AS final_name FROM p LEFT JOIN b USING (cluster)""")
def shortest_name(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") == 1, -1).otherwise(F.col("p_size")).alias("cluster"))
    return B.shortest_name(p, "cluster", "p_name", "final_name")


_LOWTOK = f"SELECT doc_id, source, lang, {tok('lower(text)')} AS t FROM documents"


@query("topic_keywords", f"""WITH t AS ({_LOWTOK}), n AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(t) AS word FROM t) GROUP BY ALL),
    s AS (SELECT source, sum(n) AS size FROM n GROUP BY source), f AS (SELECT word, sum(n) AS f FROM n GROUP BY word),
    x AS (SELECT n.source, n.word, round(n.n::DOUBLE / s.size::DOUBLE * ln(1 + ((SELECT sum(size)::DOUBLE / count(*) FROM s)) / f.f::DOUBLE), 9) AS score
      FROM n JOIN s USING (source) JOIN f USING (word)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, word) AS INTEGER) AS rank FROM x)
    SELECT source, word, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def topic_keywords(spark, sf):
    d = docs(spark, sf).select("source", F.lower("text").alias("text"))
    return C.topic_keywords(d, "source", "text", 10).withColumn("score", F.round("score", 6))


@query("bag_of_words", f"""WITH t AS ({_LOWTOK}), n AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(t) AS token FROM t) GROUP BY ALL),
    v AS (SELECT token, row_number() OVER (ORDER BY token COLLATE "C") - 1 AS token_id FROM (SELECT DISTINCT token FROM n))
    SELECT doc_id, token_id, n FROM n JOIN v USING (token)""".replace(' COLLATE "C"', ""))
def bag_of_words(spark, sf):
    return C.bag_of_words(lowered(spark, sf), "doc_id", "text")


@query("sequence_encode", f"""WITH t AS ({_LOWTOK}), w AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM t),
    n AS (SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 999),
    v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM n),
    s AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM w JOIN v USING (token) GROUP BY doc_id),
    k AS (SELECT d.doc_id, coalesce(s.ids, []) AS ids FROM documents d LEFT JOIN s USING (doc_id)),
    e AS (SELECT doc_id, CASE WHEN len(ids) > 150 THEN ids[-150:] ELSE ids END AS ids FROM k)
    SELECT doc_id, array_to_string(list_concat(list_transform(range(150 - len(ids)), lambda x: 0), ids), ' ') AS ids FROM e""")
def sequence_encode(spark, sf):
    enc = C.sequence_encode(lowered(spark, sf), "doc_id", "text", 1000, 150)
    return enc.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))


# --- windows, sorts, samples


@query("ffill_row", "SELECT d.doc_id, d.lang AS a, coalesce(l.quality::VARCHAR, d.lang) AS b, coalesce(nullif(l.toxic, 0)::VARCHAR, l.quality::VARCHAR, d.lang) AS c FROM documents d LEFT JOIN labels l USING (doc_id)")
def ffill_row(spark, sf):
    df = docs(spark, sf).join(load(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("lang").alias("a"), F.col("quality").cast("string").alias("b"), F.nullif("toxic", F.lit(0)).cast("string").alias("c")
    )
    return df.select("doc_id", *R.fill_across(["a", "b", "c"]))


@query("argbest", """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst
    FROM orders GROUP BY o_custkey""")
def argbest(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct(price, -key)).alias("best"), F.min_by("o_orderkey", F.struct(price, key)).alias("worst")
    )


@query("top_k_sorted", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def top_k_sorted(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("sample_rows", "SELECT doc_id, source, text FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 1000")
def sample_rows(spark, sf):
    return M.sample_rows(docs(spark, sf).select("doc_id", "source", "text"), "doc_id", 1000, seed=7)


def _split_sql(seed: int, share: float) -> str:
    return f"('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < {share}"


@query("train_test_split", f"SELECT doc_id, quality, {_split_sql(1, 0.25)} AS is_test FROM labels")
def train_test_split(spark, sf):
    return M.train_test_split(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 0.25, seed=1)


@query("repeated_splits", "SELECT doc_id, quality, CAST(seed AS INTEGER) AS seed, ('0x' || substr(md5(seed || ':' || doc_id), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < 0.2 AS is_test FROM labels, unnest(range(100)) AS r(seed)")
def repeated_splits(spark, sf):
    return M.repeated_splits(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 0.2, list(range(100)))


# --- set operations


@query("union_by_name", with_cte("clause", _HALVES + "SELECT doc_id, rta_id, clause_id, origin, NULL::DOUBLE AS weight FROM national UNION ALL SELECT doc_id, rta_id, clause_id, origin, weight FROM world"))
def union_by_name(spark, sf):
    return R.stack([national(spark, sf), world(spark, sf)])


@query("intersect_keys", with_cte("clause", _HALVES + "SELECT rta_id FROM national INTERSECT SELECT rta_id FROM world"))
def intersect_keys(spark, sf):
    return national(spark, sf).select("rta_id").intersect(world(spark, sf).select("rta_id"))


@query("except_keys", with_cte("clause", _HALVES + "SELECT clause_id FROM world EXCEPT SELECT clause_id FROM national WHERE rta_id % 9 = 0"))
def except_keys(spark, sf):
    return world(spark, sf).select("clause_id").subtract(national(spark, sf).where(F.col("rta_id") % 9 == 0).select("clause_id"))
