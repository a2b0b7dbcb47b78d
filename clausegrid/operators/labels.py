"""Labels, duplicates and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.scan import global_index


def mode_label(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Most frequent value per keys; the smallest value wins a tie."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(col))).alias("_b")).select(
        *keys, F.col(f"_b.{col}").alias(out)
    )


def dense_group_id(df: DataFrame, keys: list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a 0-based id per key combination in sort order, and the key table."""
    distinct = df.select(*keys).na.drop().distinct()
    table = global_index(distinct, [F.col(k) for k in keys], out)
    return df.join(table, keys, "left"), table


def dedup_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per keys; ``order`` is a unique column. Only (keys, order) are aggregated."""
    first = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def duplicate_audit(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose keys were seen before, by ``order``."""
    first = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_anti")


def bounded_values(df: DataFrame, col: str, limit: int) -> list:
    """Sorted distinct values, for use as columns; more than ``limit`` of them is an error."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, col: str, levels: list, drop_first: bool = True) -> DataFrame:
    """0/1 column per level, the first level left out by default."""
    used = levels[1:] if drop_first else levels
    return df.select("*", *[(F.col(col) == lv).cast("int").alias(f"{col}_{lv}") for lv in used])


def confusion_matrix(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y, yhat, n) with the overall accuracy next to each cell. The cells are few, whatever the rows."""
    cells = df.groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(_everything())
    right = F.sum(F.when(F.col(y) == F.col(yhat), F.col("n")).otherwise(0)).over(_everything())
    return cells.select(y, yhat, "n", (right / total).alias("accuracy"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def cluster_members(df: DataFrame, cluster: str, member: str, width: int = 100) -> DataFrame:
    """(cluster, line, members): distinct members in order, joined by ", ", at most ``width`` per line.

    Lines keep a huge cluster from becoming one cell.
    """
    distinct = df.select(cluster, member).na.drop().distinct()
    rows = global_index(distinct, [F.col(cluster), F.col(member)], "_i")
    starts = rows.groupBy(cluster).agg(F.min("_i").alias("_start"))
    lines = rows.join(starts, cluster).withColumn("line", F.floor((F.col("_i") - F.col("_start")) / width))
    text = F.array_join(F.array_sort(F.collect_list(member)), ", ")
    return lines.groupBy(cluster, "line").agg(text.alias("members"))


def shortest_name(df: DataFrame, cluster: str, name: str, out: str, noise: int = -1) -> DataFrame:
    """Rows with the shortest name of their cluster; noise keeps its own name."""
    best = (
        df.where(F.col(cluster) != noise)
        .groupBy(cluster)
        .agg(F.min(F.struct(F.length(name), F.col(name).alias("name"))).alias("_b"))
        .select(cluster, F.col("_b.name").alias("_short"))
    )
    return df.join(best, cluster, "left").withColumn(out, F.coalesce("_short", name)).drop("_short")
