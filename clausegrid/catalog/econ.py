"""Regression queries on the trade panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid import fixtures as fx
from clausegrid.catalog.base import query, with_cte
from clausegrid.catalog.panel import kept_clauses, languages
from clausegrid.econ import glm, hdfe, ols, pcr
from clausegrid.operators import panel as P
from clausegrid.operators.lookups import join_null_safe
from clausegrid.plans import gravity
from clausegrid.session import load, materialize

EFFECTS = [["exporter", "importer"], ["exporter", "year"], ["importer", "year"]]
PAIR = [["exporter", "importer"]]
TOL = 1e-6


def trade_with_counts(spark, sf):
    """Directed trade next to the clause counts of the pair: all clauses, and those in English."""
    held = fx.agreements(spark, sf)
    rows = kept_clauses(spark, sf)
    sums = P.pair_year_sums(
        rows.withColumn("all", F.lit("all")),
        held,
        {"n_clauses": F.count(F.lit(1)), "n_english": F.sum(F.when(F.col("article_cat") == "en", 1).otherwise(0))},
        *fx.YEARS,
        key="all",
        only_active=True,
    )
    return materialize(P.panel_left_join(fx.trade(spark, sf), sums.drop("all"), ["n_clauses", "n_english"]), "trade")


_X = """, x AS (SELECT t.exporter, t.importer, t.year, t.export_value, coalesce(f.n_clauses, 0) AS n_clauses
    FROM trade t LEFT JOIN (SELECT party_a, party_b, year, sum(cumulative) AS n_clauses FROM panel GROUP BY ALL) f
      ON f.party_a = least(t.exporter, t.importer) AND f.party_b = greatest(t.exporter, t.importer) AND f.year = t.year)
  , d AS (SELECT *, export_value - avg(export_value) OVER (PARTITION BY exporter, importer) AS yt,
      n_clauses - avg(n_clauses) OVER (PARTITION BY exporter, importer) AS xt FROM x)"""


@query("within_one_effect", with_cte("panel trade", _X + """SELECT exporter, importer, year, round(xt, 6) AS n_clauses FROM d"""))
def within_one_effect(spark, sf):
    df = trade_with_counts(spark, sf).select("exporter", "importer", "year", "n_clauses")
    flat = hdfe.residualize(df, ["n_clauses"], PAIR)
    return flat.select("exporter", "importer", "year", F.round("n_clauses", 6).alias("n_clauses"))


@query("within_residualize")
def within_residualize(spark, sf):
    df = trade_with_counts(spark, sf).select("exporter", "importer", "year", "export_value", "n_clauses")
    return hdfe.residualize(df, ["export_value", "n_clauses"], EFFECTS)


@query("fe_ols_one_way", with_cte("panel trade", _X + """SELECT 'n_clauses' AS term, round(sum(xt * yt) / sum(xt * xt), 6) AS estimate FROM d"""))
def fe_ols_one_way(spark, sf):
    fit = ols.fe_ols(trade_with_counts(spark, sf), "export_value", ["n_clauses"], PAIR)
    return fit.tidy(spark).select("term", F.round("estimate", 6).alias("estimate"))


@query("fe_ols")
def fe_ols(spark, sf):
    effects = [["exporter", "importer"], ["year"]]
    return ols.fe_ols(trade_with_counts(spark, sf), "export_value", ["n_clauses", "n_english"], effects, clusters=effects).tidy(spark)


@query("fe_glm")
def fe_glm(spark, sf):
    return glm.fe_glm(
        trade_with_counts(spark, sf), "export_value", ["n_clauses", "n_english"], EFFECTS, "poisson",
        clusters=[["exporter", "year"], ["importer", "year"]], tol=TOL,
    ).tidy(spark, "poisson")


@query("fe_glm_gaussian")
def fe_glm_gaussian(spark, sf):
    return glm.fe_glm(trade_with_counts(spark, sf), "export_value", ["n_clauses", "n_english"], EFFECTS, "gaussian", tol=TOL).tidy(spark, "gaussian")


@query("fe_glm_negbin")
def fe_glm_negbin(spark, sf):
    return glm.fe_glm(trade_with_counts(spark, sf), "export_value", ["n_clauses"], EFFECTS, "negbin", tol=TOL).tidy(spark, "negbin")


def _wide(spark, sf):
    """The article types, and trade rows with one clause count for each (the languages, whose counts differ between agreements)."""
    sums = P.pair_year_sums(
        kept_clauses(spark, sf).select("rta_id", "article_cat"),
        fx.agreements(spark, sf),
        {"cumulative": F.count(F.lit(1))},
        *fx.YEARS,
        key="article_cat",
        only_active=True,
    )
    langs = languages(spark, sf)
    wide = P.pivot_panel(sums, [*P.PAIR, "year"], "article_cat", langs, ["cumulative"])
    return langs, materialize(P.panel_left_join(fx.trade(spark, sf), wide, [f"{c}_cumulative" for c in langs]), "wide")


@query("sub_regressions")
def sub_regressions(spark, sf):
    langs, wide = _wide(spark, sf)
    return gravity.chapter_regressions(wide, langs, tol=TOL)


@query("lagged_regression")
def lagged_regression(spark, sf):
    df = trade_with_counts(spark, sf)
    fit = glm.lagged_regression(df, "export_value", ["n_clauses"], 2, ["exporter", "importer"], "year", EFFECTS, tol=TOL)
    return fit.tidy(spark, "lag2")


@query("rank_check", "SELECT CAST(count(DISTINCT lang) + 1 AS INTEGER) AS n_columns, CAST(count(DISTINCT lang) AS INTEGER) AS rank, 'twice' AS collinear FROM documents")
def rank_check(spark, sf):
    langs, wide = _wide(spark, sf)
    cols = [f"{s}_cumulative" for s in langs]
    doubled = wide.withColumn("twice", 2 * F.col(cols[0]))
    rank, collinear = ols.rank_check(doubled, [*cols, "twice"])
    return spark.createDataFrame([(len(cols) + 1, rank, ", ".join(collinear))], "n_columns int, rank int, collinear string")


@query("coef_table")
def coef_table(spark, sf):
    langs, wide = _wide(spark, sf)
    fit = ols.fe_ols(wide, "export_value", [f"{s}_cumulative" for s in langs], [["exporter", "importer"]])
    names = load(spark, sf, "documents").select(
        F.concat("lang", F.lit("_cumulative")).alias("term"), F.col("lang").alias("article_cat")
    ).distinct()
    return join_null_safe(fit.tidy(spark, "all"), names, ["term"])


@query("pc_regression")
def pc_regression(spark, sf):
    return pcr.pc_regression(load(spark, sf, "embeddings"), "label", "embedding")


@query("pc_regression_choice")
def pc_regression_choice(spark, sf):
    return pcr.best_k(pcr.pc_regression(load(spark, sf, "embeddings"), "label", "embedding"))
