"""Labelled clauses and agreements -> trade panel -> regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.econ.glm import sub_regressions
from clausegrid.operators import panel as P
from clausegrid.operators.frames import columns_like, compound_key

# The effects of the gravity model.
GRAVITY_EFFECTS = [["exporter", "importer"], ["exporter", "year"], ["importer", "year"]]


def clause_panel(clauses: DataFrame, agreements: DataFrame, lo: int, hi: int, only_active: bool = True) -> DataFrame:
    """(pair, year, clause_id, cumulative) of clauses (rta_id, chapter_cat, topic, topic_no)."""
    keyed = clauses.where(F.col("topic_no") != -1).withColumn("clause_id", compound_key("chapter_cat", "topic"))
    kept = P.drop_singleton_keys(keyed, "clause_id", "rta_id")
    return P.pair_year_sums(kept, agreements, {"cumulative": F.count(F.lit(1))}, lo, hi, only_active=only_active)


def design(trade: DataFrame, panel: DataFrame, clause_ids: list[str]) -> DataFrame:
    """Trade rows with one count column per clause id, zero where the pair shares none."""
    wide = P.pivot_panel(panel, [*P.PAIR, "year"], "clause_id", clause_ids, ["cumulative"])
    return P.panel_left_join(trade, wide, [f"{c}_cumulative" for c in clause_ids])


def chapter_regressions(
    panel: DataFrame, chapters: list[str], y: str = "export_value", effects: list | None = None, family: str = "poisson",
    tol: float = 1e-8,
) -> DataFrame:
    """One regression per chapter on the columns that start with its name, all in the same jobs."""
    groups = {c: columns_like(panel, f"^{c}_") for c in chapters}
    return sub_regressions(panel, y, {c: xs for c, xs in groups.items() if xs}, effects or GRAVITY_EFFECTS, family, tol=tol)
