"""Agreements -> country pairs -> year grid -> clause counts (the panel operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: an agreement without an end date counts as running until 2050.
OPEN_END = "2050-01-01"

PAIR = ["party_a", "party_b"]


def canonical_parties(col: str | Column) -> Column:
    """Sorted, distinct, null-free party codes, so equal sets compare equal."""
    return F.array_sort(F.array_distinct(F.array_compact(col)))


def party_pairs(df: DataFrame, col: str = "parties") -> DataFrame:
    """One row per distinct party set and unordered pair inside it (party_a < party_b).

    The work is done once per distinct set, not once per agreement. A set holds
    countries of one agreement, so its length is bounded by the number of countries.
    """
    sets = df.select(canonical_parties(col).alias(col)).distinct()
    pairs = F.expr(
        f"flatten(transform({col}, (x, i) -> transform("
        f"slice({col}, i + 2, size({col})), y -> struct(x AS party_a, y AS party_b))))"
    )
    return sets.select(col, F.explode(pairs).alias("p")).select(col, "p.party_a", "p.party_b")


def ordered_pair(left: str | Column, right: str | Column) -> list[Column]:
    """Direction-free pair key of two country columns."""
    return [
        F.least(left, right).alias("party_a"),
        F.greatest(left, right).alias("party_b"),
    ]


def expand_years(df: DataFrame, lo: int, hi: int, col: str = "year") -> DataFrame:
    """Every row once per year lo..hi."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(lo), F.lit(hi))))


def is_active(year: str | Column, start: str | Column, end: str | Column) -> Column:
    """1 if 1 January of the year lies in [start, end]; open end = 2050, no start = never."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    jan1 = F.make_date(year, F.lit(1), F.lit(1))
    inside = (jan1 >= start) & (jan1 <= F.coalesce(end, F.lit(OPEN_END).cast("date")))
    return F.coalesce(inside, F.lit(False)).cast("int")


def first_active_year(start: str | Column) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    return F.year(start) + F.when(start > F.trunc(start, "year"), 1).otherwise(0)


def active_years(
    df: DataFrame, start: str, end: str, lo: int, hi: int, col: str = "year"
) -> DataFrame:
    """Only the active years of each row: the bounds go into the generator,
    so inactive grid cells are never created."""
    first = F.greatest(F.lit(lo), first_active_year(start))
    last = F.least(F.lit(hi), F.year(F.coalesce(F.col(end), F.lit(OPEN_END).cast("date"))))
    years = F.when(F.col(start).isNotNull() & (first <= last), F.sequence(first, last))
    return df.withColumn(col, F.explode(years))


def drop_singleton_keys(df: DataFrame, key: str, unit: str) -> DataFrame:
    """Drop rows whose key occurs with exactly one unit.

    min/max equality detects "exactly one" without a distinct count: one
    map-side combined pass. Keys that never have a unit are kept, and so are null keys.
    """
    single = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(unit).alias("_lo"), F.max(unit).alias("_hi"))
        .where(F.col("_lo") == F.col("_hi"))
        .select(key)
    )
    return df.join(single, key, "left_anti")


def pair_year_sums(
    clauses: DataFrame,
    agreements: DataFrame,
    measures: dict[str, Column],
    lo: int,
    hi: int,
    key: str = "clause_id",
    agreement: str = "rta_id",
    start: str = "dif",
    end: str = "din",
    only_active: bool = False,
) -> DataFrame:
    """Sum ``measures`` by (pair, year, key) over the agreements that hold the pair.

    ``measures`` are aggregates over clause rows. A measure whose name starts
    with ``new_`` counts only in the year that begins on the start date;
    the others count in each active year.

    Rows shrink before they grow: clauses are summed per agreement, then per
    (party set, dates), then per (party set, year); only this last table meets
    the pair list. ``only_active`` leaves out cells that are zero throughout.
    """
    names = list(measures)
    per_agreement = clauses.groupBy(agreement, key).agg(*[c.alias(n) for n, c in measures.items()])
    held = agreements.select(
        F.col(agreement), canonical_parties("parties").alias("parties"), start, end
    )
    per_set = (
        per_agreement.join(held, agreement)
        .groupBy("parties", start, end, key)
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    if only_active:
        grid = active_years(per_set, start, end, lo, hi)
    else:
        grid = expand_years(per_set, lo, hi)
    live = is_active("year", start, end)
    fresh = F.coalesce(F.make_date("year", F.lit(1), F.lit(1)) == F.col(start), F.lit(False)).cast("int")
    per_year = grid.groupBy("parties", "year", key).agg(
        *[F.sum(F.col(n) * (fresh if n.startswith("new_") else live)).alias(n) for n in names]
    )
    return (
        per_year.join(party_pairs(held), "parties")
        .groupBy(*PAIR, "year", key)
        .agg(*[F.sum(n).alias(n) for n in names])
    )


def binary_presence(
    clauses: DataFrame,
    agreements: DataFrame,
    lo: int,
    hi: int,
    key: str = "clause_id",
    agreement: str = "rta_id",
    start: str = "dif",
    end: str = "din",
) -> DataFrame:
    """1 if any agreement of the pair holds the key in the year, else 0."""
    held = agreements.select(agreement, canonical_parties("parties").alias("parties"), start, end)
    per_set = (
        clauses.select(agreement, key).distinct().join(held, agreement).select("parties", start, end, key).distinct()
    )
    per_year = (
        expand_years(per_set, lo, hi)
        .groupBy("parties", "year", key)
        .agg(F.max(is_active("year", start, end)).alias("present"))
    )
    return (
        per_year.join(party_pairs(held), "parties")
        .groupBy(*PAIR, "year", key)
        .agg(F.max("present").alias("present"))
    )


def pivot_panel(
    df: DataFrame, index: list[str], col: str, values: list[str], measures: list[str]
) -> DataFrame:
    """Wide table, one column per value and measure, 0-filled.

    The value list is explicit, so no extra pass looks for it and a value
    without rows still gets its column.
    """
    if len(measures) == 1:
        aggs = [F.sum(measures[0])]
        wide = df.groupBy(*index).pivot(col, values).agg(*aggs)
        wide = wide.withColumnsRenamed({v: f"{v}_{measures[0]}" for v in values})
    else:
        wide = df.groupBy(*index).pivot(col, values).agg(*[F.sum(m).alias(m) for m in measures])
    return wide.na.fill(0, [f"{v}_{m}" for v in values for m in measures])


def agreement_dummies(
    agreements: DataFrame,
    ids: list,
    lo: int,
    hi: int,
    agreement: str = "rta_id",
    start: str = "dif",
    end: str = "din",
    prefix: str = "rta_",
) -> DataFrame:
    """(pair, year) x agreement 0/1 matrix for an explicit list of agreements."""
    long = agreement_pair_years(agreements, lo, hi, agreement, start, end)
    wide = long.groupBy(*PAIR, "year").pivot(agreement, ids).agg(F.max("active"))
    wide = wide.withColumnsRenamed({str(i): f"{prefix}{i}" for i in ids})
    return wide.na.fill(0, [f"{prefix}{i}" for i in ids])


def agreement_pair_years(
    agreements: DataFrame, lo: int, hi: int, agreement: str = "rta_id", start: str = "dif", end: str = "din"
) -> DataFrame:
    """Long form of the matrix: (pair, year, agreement, active)."""
    held = agreements.select(agreement, canonical_parties("parties").alias("parties"), start, end)
    grid = expand_years(held, lo, hi).withColumn("active", is_active("year", start, end))
    return (
        grid.join(party_pairs(held), "parties")
        .groupBy(*PAIR, "year", agreement)
        .agg(F.max("active").alias("active"))
    )


def agreement_rows(
    agreements: DataFrame, lo: int, hi: int, agreement: str = "rta_id", start: str = "dif", end: str = "din"
) -> DataFrame:
    """The matrix as sparse wide rows for any number of agreements: (pair, year, agreements, active), the sorted ids of
    the agreements that hold the pair, and 0 or 1 for each. Agreements of one party set and year are put together
    before they meet the pairs."""
    held = agreements.select(agreement, canonical_parties("parties").alias("parties"), start, end)
    each = expand_years(held, lo, hi).groupBy("parties", "year", agreement).agg(F.max(is_active("year", start, end)).alias("active"))
    per_set = each.groupBy("parties", "year").agg(F.collect_list(F.struct(agreement, "active")).alias("cells"))
    rows = per_set.join(party_pairs(held), "parties").groupBy(*PAIR, "year").agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
    return rows.select(*PAIR, "year", F.col(f"cells.{agreement}").alias("agreements"), F.col("cells.active").alias("active"))


def unpivot_agreements(rows: DataFrame, agreement: str = "rta_id") -> DataFrame:
    """(pair, year, agreement, active) of the sparse wide rows."""
    cell = F.explode(F.arrays_zip("agreements", "active")).alias("_c")
    return rows.select(*PAIR, "year", cell).select(*PAIR, "year", F.col("_c.agreements").alias(agreement), F.col("_c.active").alias("active"))


def count_active(rows: DataFrame) -> DataFrame:
    """(pair, year, active_agreements): total of the long dummy matrix, zero rows kept."""
    return rows.groupBy(*PAIR, "year").agg(F.sum("active").cast("bigint").alias("active_agreements"))


def active_count(
    agreements: DataFrame, lo: int, hi: int, start: str = "dif", end: str = "din"
) -> DataFrame:
    """Number of active agreements per (pair, year), zero rows kept."""
    held = agreements.select(canonical_parties("parties").alias("parties"), start, end)
    per_year = (
        expand_years(held, lo, hi)
        .groupBy("parties", "year")
        .agg(F.sum(is_active("year", start, end)).alias("active_agreements"))
    )
    return (
        per_year.join(party_pairs(held), "parties")
        .groupBy(*PAIR, "year")
        .agg(F.sum("active_agreements").alias("active_agreements"))
    )


def panel_left_join(trade: DataFrame, features: DataFrame, measures: list[str]) -> DataFrame:
    """Directed trade rows with the features of their unordered pair and year; missing = 0."""
    keyed = trade.select("*", *ordered_pair("exporter", "importer"))
    return keyed.join(features, [*PAIR, "year"], "left").na.fill(0, measures)


def lag_panel(df: DataFrame, unit: list[str], time: str, cols: list[str], k: int) -> DataFrame:
    """Value of each column k time steps earlier in the same unit, null if that step is absent.

    A self equi-join on (unit, time - k): no ordering, no per-unit window, and
    gaps in the time axis give nulls instead of older values.
    """
    past = df.select(
        *unit, (F.col(time) + k).alias(time), *[F.col(c).alias(f"{c}_lag{k}") for c in cols]
    )
    return df.join(past, [*unit, time], "left")


def jump_units(df: DataFrame, unit: list[str], time: str, col: str, step: int = 1) -> DataFrame:
    """Units whose value ever rises by more than ``step`` from one year to the next."""
    lagged = lag_panel(df.select(*unit, time, col), unit, time, [col], 1)
    rise = F.col(col) - F.col(f"{col}_lag1")
    return lagged.groupBy(*unit).agg(F.max(rise).alias("max_rise")).where(F.col("max_rise") > step)
