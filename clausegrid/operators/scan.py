"""Ordered operators (running values, fills, positions) that hold for hot keys.

A window over a key puts the whole key into one task. Here rows are cut into ranges
of (keys, order) first: each range is summarised, the few summaries of a key are carried
forward, and rows see only their own range plus the carry. No key and no spacing of
the order column makes a range larger than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.session import materialize


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """Rows range partitioned, the partition number written down with them, so that
    later steps agree on it even if a task is run again."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def forward_fill(df: DataFrame, keys: list[str], order: str, col: str) -> DataFrame:
    """Last non-null value of ``col`` so far, per keys in the order of a column.

    ``order`` is unique within the keys. Rows with a null key keep their value.
    """
    rows = _ranged(df, *[F.col(c) for c in [*keys, order]])
    seen = F.when(F.col(col).isNotNull(), F.col(order))
    tails = rows.groupBy(*keys, "_part").agg(F.max_by(col, seen).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_part", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    inner = Window.partitionBy(*keys, "_part").orderBy(order)
    filled = F.last(col, ignorenulls=True).over(inner)
    known = rows.join(carry, [*keys, "_part"], "left")
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    out = known.withColumn("_fill", F.coalesce(filled, "_carry"))
    return out.withColumn(col, F.when(keyed, F.col("_fill")).otherwise(F.col(col))).select(*df.columns)


def running_sum(df: DataFrame, keys: list[str], order: str, value: str | Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows up to and including this one. Without keys, one row a
    range meets in the carry."""
    value = F.col(value) if isinstance(value, str) else value
    rows = _ranged(df.withColumn("_v", value), *[F.col(c) for c in [*keys, order]])
    totals = rows.groupBy(*keys, "_part").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    inner = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_in", F.sum("_v").over(inner)).join(carry, [*keys, "_part"])
    return joined.withColumn(out, F.col("_in") + F.col("_carry")).select(*df.columns, out)


def position(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """1-based position within the keys."""
    return running_sum(df, keys, order, F.lit(1), out)


def global_index(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based position of each row in a total order (``order`` must be unique).

    Each range is numbered by itself and shifted by the rows in front of it.
    """
    fixed = _ranged(df, *order)
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy("_part").orderBy(*order)
    return (
        fixed.withColumn("_row", F.row_number().over(inner))
        .join(shift, "_part")
        .select(*df.columns, (F.col("_shift") + F.col("_row") - 1).alias(out))
    )
