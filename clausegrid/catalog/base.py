"""Registry of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# SQL twins of the builders in clausegrid.fixtures; later entries may use earlier ones.
CTE = {
    "agreement": """
        SELECT s.s_suppkey AS rta_id, 'Agreement ' || s.s_suppkey AS fta_name,
               list_sort(list_distinct(list(m.n_name))) AS parties,
               CASE WHEN s.s_suppkey % 10 <> 9
                    THEN make_date(1995 + s.s_suppkey % 5, 1 + s.s_suppkey % 12, 1) END AS dif,
               CASE WHEN s.s_suppkey % 2 = 1 THEN make_date(1999 + s.s_suppkey % 3, 6, 30) END AS din
        FROM supplier s JOIN nation h ON h.n_nationkey = s.s_nationkey
        JOIN nation m ON m.n_regionkey = h.n_regionkey OR m.n_regionkey = s.s_suppkey % 5
        GROUP BY s.s_suppkey""",
    "clause": """
        SELECT d.doc_id, d.doc_id // 20 AS rta_id, d.source AS chapter_cat, d.lang AS article_cat,
               d.source || '_' || d.lang AS clause_id,
               coalesce(CAST(l.quality AS DOUBLE), 0.5) AS weight, d.text
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "kept": """
        SELECT * FROM clause WHERE clause_id NOT IN
          (SELECT clause_id FROM clause GROUP BY clause_id HAVING count(DISTINCT rta_id) = 1)""",
    "party": "SELECT rta_id, dif, din, unnest(parties) AS party FROM agreement",
    "pair": """
        SELECT a.rta_id, a.dif, a.din, a.party AS party_a, b.party AS party_b
        FROM party a JOIN party b ON a.rta_id = b.rta_id AND a.party < b.party""",
    "yr": "SELECT CAST(unnest(range(1995, 2021)) AS INTEGER) AS year",
    "cell": """
        SELECT p.*, y.year,
               CASE WHEN make_date(y.year, 1, 1) >= p.dif
                     AND make_date(y.year, 1, 1) <= coalesce(p.din, DATE '2050-01-01') THEN 1 ELSE 0 END AS active,
               CASE WHEN make_date(y.year, 1, 1) = p.dif THEN 1 ELSE 0 END AS fresh
        FROM pair p CROSS JOIN yr y""",
    "panel": """
        SELECT c.party_a, c.party_b, c.year, k.clause_id,
               CAST(sum(c.active) AS BIGINT) AS cumulative, CAST(sum(c.fresh) AS BIGINT) AS delta,
               CAST(sum(c.active * k.weight) AS DOUBLE) AS w_cumulative,
               CAST(sum(c.fresh * k.weight) AS DOUBLE) AS w_delta, max(c.active) AS present
        FROM kept k JOIN cell c ON c.rta_id = k.rta_id GROUP BY ALL""",
    "shipment": """
        SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, e.n_name AS exporter, i.n_name AS importer,
               l.l_partkey, CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS v
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
        JOIN nation e ON e.n_nationkey = s.s_nationkey JOIN nation i ON i.n_nationkey = c.c_nationkey
        WHERE s.s_nationkey <> c.c_nationkey""",
    "trade": """
        SELECT exporter, importer, year, CAST(sum(v) AS DOUBLE) AS export_value
        FROM shipment GROUP BY exporter, importer, year""",
}

NEEDS = {
    "kept": ["clause"],
    "party": ["agreement"],
    "pair": ["party"],
    "cell": ["pair", "yr"],
    "panel": ["kept", "cell"],
    "trade": ["shipment"],
}


def with_cte(names: str, body: str) -> str:
    """``WITH`` clause holding the named fixtures (and what they need) in front of ``body``."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for dep in NEEDS.get(name, []):
            visit(dep)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in wanted) + "\n" + body
