"""Agreement, clause and trade tables derived from the given tables.

Each builder has a SQL twin of the same name in ``catalog.base.CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.session import load

YEARS = (1995, 2020)


def agreements(spark: SparkSession, sf: str) -> DataFrame:
    """One agreement per supplier: the nations of its home region and of one more region."""
    supplier, nation = load(spark, sf, "supplier"), load(spark, sf, "nation")
    key = F.col("s_suppkey")
    home = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("home"))
    regions = (
        supplier.select("s_suppkey", "s_nationkey")
        .join(home, "s_nationkey")
        .select("s_suppkey", F.explode(F.array_distinct(F.array(F.col("home").cast("bigint"), key % 5))).alias("region"))
    )
    members = nation.select(F.col("n_regionkey").cast("bigint").alias("region"), "n_name")
    return (
        regions.join(members, "region")
        .groupBy("s_suppkey")
        .agg(F.array_sort(F.collect_set("n_name")).alias("parties"))
        .select(
            key.alias("rta_id"),
            F.concat(F.lit("Agreement "), key.cast("string")).alias("fta_name"),
            "parties",
            F.when(key % 10 != 9, F.make_date(1995 + key % 5, 1 + key % 12, F.lit(1))).alias("dif"),
            F.when(key % 2 == 1, F.make_date(1999 + key % 3, F.lit(6), F.lit(30))).alias("din"),
        )
    )


def clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as clauses: 20 per agreement, chapter = source, article = language."""
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    labels = load(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.expr("doc_id div 20").alias("rta_id"),
        F.col("source").alias("chapter_cat"),
        F.col("lang").alias("article_cat"),
        F.concat("source", F.lit("_"), "lang").alias("clause_id"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("weight"),
        "text",
    )


def product_trade(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments between two nations per year and brand."""
    nation = load(spark, sf, "nation").select("n_nationkey", "n_name")
    items = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customer = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supplier = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    part = load(spark, sf, "part").select("p_partkey", "p_brand")
    value = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    by_key = (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .where(F.col("s_nationkey") != F.col("c_nationkey"))
        .groupBy("year", "s_nationkey", "c_nationkey", "p_brand")
        .agg(F.sum(value).alias("v"))
    )
    seller = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("exporter"))
    buyer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("importer"))
    return (
        by_key.join(seller, "s_nationkey")
        .join(buyer, "c_nationkey")
        .select("year", "exporter", "importer", F.col("p_brand").alias("product"), "v")
    )


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Directed yearly totals (exporter, importer, year, export_value)."""
    nation = load(spark, sf, "nation").select("n_nationkey", "n_name")
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customer = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supplier = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    value = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    by_key = (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .where(F.col("s_nationkey") != F.col("c_nationkey"))
        .groupBy("year", "s_nationkey", "c_nationkey")
        .agg(F.sum(value).cast("double").alias("export_value"))
    )
    seller = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("exporter"))
    buyer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("importer"))
    return (
        by_key.join(seller, "s_nationkey")
        .join(buyer, "c_nationkey")
        .select("exporter", "importer", "year", "export_value")
    )
