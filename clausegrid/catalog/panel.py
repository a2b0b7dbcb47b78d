"""Panel queries: year grid, pairs, counts, pivots, lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid import fixtures as fx
from clausegrid.catalog.base import query, with_cte
from clausegrid.operators import panel as P
from clausegrid.operators.labels import bounded_values
from clausegrid.session import load, materialize

LO, HI = fx.YEARS
SOURCES = [f"src{i}" for i in range(20)]  # for the SQL twins; the queries take theirs from the table
LANGS = ["en", "fr", "de", "es"]


def chapters(spark, sf):
    return bounded_values(load(spark, sf, "documents"), "source", 1000)


def languages(spark, sf):
    return bounded_values(load(spark, sf, "documents"), "lang", 1000)


def kept_clauses(spark, sf):
    return P.drop_singleton_keys(fx.clauses(spark, sf), "clause_id", "rta_id")


def counts(spark, sf, only_active=False):
    return P.pair_year_sums(
        kept_clauses(spark, sf).select("rta_id", "clause_id"),
        fx.agreements(spark, sf),
        {"cumulative": F.count(F.lit(1))},
        LO,
        HI,
        only_active=only_active,
    )


def chapter_counts(spark, sf):
    """Counts per chapter instead of clause id, active cells only."""
    return P.pair_year_sums(
        kept_clauses(spark, sf).select("rta_id", "chapter_cat"),
        fx.agreements(spark, sf),
        {"cumulative": F.count(F.lit(1))},
        LO,
        HI,
        key="chapter_cat",
        only_active=True,
    )


def wide_trade_panel(spark, sf):
    """Trade rows next to the clause counts per chapter of the pair in the year."""
    names = chapters(spark, sf)
    wide = P.pivot_panel(chapter_counts(spark, sf), [*P.PAIR, "year"], "chapter_cat", names, ["cumulative"])
    return P.panel_left_join(fx.trade(spark, sf), wide, [f"{s}_cumulative" for s in names])


_WIDE_SQL = ", ".join(
    f"CAST(coalesce(sum(cumulative) FILTER (WHERE clause_id LIKE '{s}\\_%' ESCAPE '\\'), 0) AS BIGINT) AS {s}_cumulative"
    for s in SOURCES
)
_FILL_SQL = ", ".join(f"coalesce(w.{s}_cumulative, 0) AS {s}_cumulative" for s in SOURCES)
_WIDE_TRADE = f"""
, w AS (SELECT party_a, party_b, year, {_WIDE_SQL} FROM panel GROUP BY party_a, party_b, year)
, wide AS (SELECT t.*, least(t.exporter, t.importer) AS party_a, greatest(t.exporter, t.importer) AS party_b, {_FILL_SQL}
  FROM trade t LEFT JOIN w ON w.party_a = least(t.exporter, t.importer)
   AND w.party_b = greatest(t.exporter, t.importer) AND w.year = t.year)
"""


@query("shared_clauses_with_trade", with_cte("panel trade", _WIDE_TRADE + "SELECT * FROM wide"))
def shared_clauses_with_trade(spark, sf):
    return wide_trade_panel(spark, sf)


@query("expand_years", with_cte("agreement", """
    SELECT rta_id, fta_name, dif, din, CAST(y AS INTEGER) AS year
    FROM agreement, unnest(range(1995, 2021)) AS t(y)"""))
def expand_years(spark, sf):
    return P.expand_years(fx.agreements(spark, sf).select("rta_id", "fta_name", "dif", "din"), 1995, 2020)


@query("country_pairs", with_cte("pair", "SELECT rta_id, party_a, party_b FROM pair"))
def country_pairs(spark, sf):
    held = fx.agreements(spark, sf).select("rta_id", P.canonical_parties("parties").alias("parties"))
    return held.join(P.party_pairs(held), "parties").select("rta_id", "party_a", "party_b")


@query("interval_active", with_cte("agreement", """
    SELECT rta_id, CAST(y AS INTEGER) AS year FROM agreement, unnest(range(1995, 2021)) AS t(y)
    WHERE make_date(y, 1, 1) >= dif AND make_date(y, 1, 1) <= coalesce(din, DATE '2050-01-01')"""))
def interval_active(spark, sf):
    df = fx.agreements(spark, sf).select("rta_id", "dif", "din")
    return P.active_years(df, "dif", "din", 1995, 2020).select("rta_id", "year")


@query("active_flag", with_cte("agreement", """
    SELECT rta_id, CAST(y AS INTEGER) AS year,
      CASE WHEN make_date(y, 1, 1) >= dif AND make_date(y, 1, 1) <= coalesce(din, DATE '2050-01-01')
           THEN 1 ELSE 0 END AS active
    FROM agreement, unnest(range(1948, 2022)) AS t(y)"""))
def active_flag(spark, sf):
    grid = P.expand_years(fx.agreements(spark, sf).select("rta_id", "dif", "din"), 1948, 2021)
    return grid.select("rta_id", "year", P.is_active("year", "dif", "din").alias("active"))


@query("drop_singleton_keys", with_cte("kept", "SELECT doc_id, rta_id, clause_id FROM kept"))
def drop_singleton_keys(spark, sf):
    return kept_clauses(spark, sf).select("doc_id", "rta_id", "clause_id")


@query("pair_year_counts", with_cte("panel", "SELECT party_a, party_b, year, clause_id, cumulative FROM panel"))
def pair_year_counts(spark, sf):
    return counts(spark, sf)


@query("pair_year_weighted", with_cte("panel", """
    SELECT party_a, party_b, year, clause_id, w_cumulative AS cumulative, w_delta AS delta FROM panel"""))
def pair_year_weighted(spark, sf):
    return P.pair_year_sums(
        kept_clauses(spark, sf).select("rta_id", "clause_id", "weight"),
        fx.agreements(spark, sf),
        {"cumulative": F.sum("weight"), "new_delta": F.sum("weight")},
        LO,
        HI,
    ).withColumnRenamed("new_delta", "delta")


@query("binary_presence", with_cte("panel", "SELECT party_a, party_b, year, clause_id, present FROM panel"))
def binary_presence(spark, sf):
    return P.binary_presence(kept_clauses(spark, sf), fx.agreements(spark, sf), LO, HI)


@query("bilateral_totals", with_cte("trade", """
    SELECT importer, exporter, year, round(export_value, 2) AS export_value FROM trade"""))
def bilateral_totals(spark, sf):
    return (
        fx.product_trade(spark, sf)
        .groupBy("importer", "exporter", "year")
        .agg(F.round(F.sum("v").cast("double"), 2).alias("export_value"))
    )


_PIVOT2 = ", ".join(
    f"CAST(coalesce(sum(cumulative) FILTER (WHERE clause_id = '{s}_{g}'), 0) AS BIGINT) AS {s}_{g}_cumulative, "
    f"CAST(coalesce(sum(delta) FILTER (WHERE clause_id = '{s}_{g}'), 0) AS BIGINT) AS {s}_{g}_delta"
    for s in SOURCES
    for g in LANGS
)


@query("pivot_panel", with_cte("panel", f"SELECT party_a, party_b, year, {_PIVOT2} FROM panel GROUP BY ALL"))
def pivot_panel(spark, sf):
    long = P.pair_year_sums(
        kept_clauses(spark, sf).select("rta_id", "clause_id"),
        fx.agreements(spark, sf),
        {"cumulative": F.count(F.lit(1)), "new_delta": F.count(F.lit(1))},
        LO,
        HI,
    ).withColumnRenamed("new_delta", "delta")
    ids = [f"{s}_{g}" for s in chapters(spark, sf) for g in languages(spark, sf)]
    return P.pivot_panel(long, [*P.PAIR, "year"], "clause_id", ids, ["cumulative", "delta"])


@query("pivot_agreements", with_cte("cell", """
    SELECT party_a, party_b, year, string_agg(CAST(rta_id AS VARCHAR), ',' ORDER BY rta_id) AS agreements,
      string_agg(CAST(active AS VARCHAR), ',' ORDER BY rta_id) AS active
    FROM cell GROUP BY party_a, party_b, year"""))
def pivot_agreements(spark, sf):
    rows = P.agreement_rows(fx.agreements(spark, sf), LO, HI)
    told = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("agreements", "active")]
    return rows.select(*P.PAIR, "year", *told)


@query("active_count", with_cte("cell", """
    , wide AS (SELECT party_a, party_b, year, list(rta_id ORDER BY rta_id) AS agreements, list(active ORDER BY rta_id) AS active
      FROM cell GROUP BY party_a, party_b, year),
    long AS (SELECT party_a, party_b, year, unnest(agreements) AS rta_id, unnest(active) AS active FROM wide)
    SELECT party_a, party_b, year, CAST(sum(active) AS BIGINT) AS active_agreements FROM long GROUP BY party_a, party_b, year"""))
def active_count(spark, sf):
    """The dummy matrix of all agreements, turned long again and totalled."""
    wide = P.agreement_rows(fx.agreements(spark, sf), LO, HI)
    return P.count_active(P.unpivot_agreements(wide))


@query("jump_detect", with_cte("cell", """
    , n AS (SELECT party_a, party_b, year, sum(active) AS k FROM cell GROUP BY ALL)
    SELECT a.party_a, a.party_b, CAST(max(a.k - b.k) AS BIGINT) AS max_rise
    FROM n a JOIN n b ON a.party_a = b.party_a AND a.party_b = b.party_b AND a.year = b.year + 1
    GROUP BY a.party_a, a.party_b HAVING max(a.k - b.k) > 1"""))
def jump_detect(spark, sf):
    counts_ = P.active_count(fx.agreements(spark, sf), LO, HI)
    return P.jump_units(counts_, P.PAIR, "year", "active_agreements")


@query("panel_left_join", with_cte("panel trade", """
    , f AS (SELECT party_a, party_b, year, CAST(sum(cumulative) AS BIGINT) AS n_clauses,
                   CAST(sum(present) AS BIGINT) AS n_types FROM panel GROUP BY ALL)
    SELECT t.exporter, t.importer, t.year, t.export_value, coalesce(f.n_clauses, 0) AS n_clauses,
           coalesce(f.n_types, 0) AS n_types
    FROM trade t LEFT JOIN f ON f.party_a = least(t.exporter, t.importer)
      AND f.party_b = greatest(t.exporter, t.importer) AND f.year = t.year"""))
def panel_left_join(spark, sf):
    feats = (
        counts(spark, sf, only_active=True)
        .groupBy(*P.PAIR, "year")
        .agg(F.sum("cumulative").alias("n_clauses"), F.count(F.when(F.col("cumulative") > 0, 1)).alias("n_types"))
    )
    joined = P.panel_left_join(fx.trade(spark, sf), feats, ["n_clauses", "n_types"])
    return joined.drop(*P.PAIR)


@query("panel_lag", with_cte("trade", """
    SELECT t.*, l.export_value AS export_value_lag1, m.export_value AS export_value_lag2 FROM trade t
    LEFT JOIN trade l ON l.exporter = t.exporter AND l.importer = t.importer AND l.year = t.year - 1
    LEFT JOIN trade m ON m.exporter = t.exporter AND m.importer = t.importer AND m.year = t.year - 2"""))
def panel_lag(spark, sf):
    df = materialize(fx.trade(spark, sf), "trade")  # read by both sides of both lags
    unit = ["exporter", "importer"]
    one = P.lag_panel(df, unit, "year", ["export_value"], 1)
    two = P.lag_panel(df, unit, "year", ["export_value"], 2).drop("export_value")
    return one.join(two, [*unit, "year"])


_YEARS = [str(y) for y in range(LO, HI + 1)]


@query("melt_years", with_cte("trade", """
    SELECT exporter, importer, CAST(year AS INTEGER) AS year, export_value FROM trade"""))
def melt_years(spark, sf):
    wide = fx.trade(spark, sf).groupBy("exporter", "importer").pivot("year", [int(y) for y in _YEARS]).agg(F.first("export_value"))
    wide = wide.withColumn("attribute", F.lit("Value"))
    long = wide.where(F.col("attribute") == "Value").unpivot(["exporter", "importer"], _YEARS, "year", "export_value")
    return long.where(F.col("export_value").isNotNull()).withColumn("year", F.col("year").cast("int"))


@query("period_filter", with_cte("trade", "SELECT * FROM trade WHERE year >= 1998"))
def period_filter(spark, sf):
    return fx.trade(spark, sf).where(F.col("year") >= 1998)


_SRC1 = [s for s in SOURCES if s.startswith("src1")]


@query("select_by_prefix", with_cte("panel trade", _WIDE_TRADE + f"""
    SELECT exporter, importer, year, {', '.join(s + '_cumulative' for s in _SRC1)},
           {len(_SRC1)} AS n_selected FROM wide"""))
def select_by_prefix(spark, sf):
    from clausegrid.operators.frames import columns_like

    wide = wide_trade_panel(spark, sf)
    chosen = columns_like(wide, "^src1")
    return wide.select("exporter", "importer", "year", *chosen, F.lit(len(chosen)).alias("n_selected"))


@query("cast_numeric_cols", with_cte("panel trade", _WIDE_TRADE + f"""
    SELECT exporter, importer, party_a, party_b, year, export_value,
    {', '.join(f'CAST({s}_cumulative AS INTEGER) AS {s}_cumulative' for s in SOURCES)} FROM wide"""))
def cast_numeric_cols(spark, sf):
    from clausegrid.operators.frames import cast_numeric

    return cast_numeric(wide_trade_panel(spark, sf), "int", keep=["export_value"])


@query("default_date", with_cte("agreement", """
    SELECT rta_id, dif, coalesce(din, DATE '2050-01-01') AS din, CAST(year(dif) AS INTEGER) AS start_year FROM agreement"""))
def default_date(spark, sf):
    return fx.agreements(spark, sf).select(
        "rta_id",
        "dif",
        F.coalesce("din", F.lit(P.OPEN_END).cast("date")).alias("din"),
        F.year("dif").alias("start_year"),
    )
