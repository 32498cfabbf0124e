"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without `sql` its results are checked by unit tests instead."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(c: str | Column) -> Column:
    """Exact, order-independent sum of amounts with two decimals, as a double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


# Customer spend per year.
CUSTOMER_YEARS = """
cy AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend, COUNT(*) AS n_orders
  FROM orders GROUP BY 1, 2)"""


def customer_years(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"))
        .agg(money("o_totalprice").alias("spend"), F.count("*").alias("n_orders"))
    )


# Customer spend per year and order priority: several rows of an entity may share a season.
CUSTOMER_YEAR_ROWS = """
cyp AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS program,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend, COUNT(*) AS n_orders
  FROM orders GROUP BY 1, 2, 3)"""


def customer_year_rows(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_custkey").alias("entity"),
            F.year("o_orderdate").alias("season"),
            F.col("o_orderpriority").alias("program"),
        )
        .agg(money("o_totalprice").alias("spend"), F.count("*").alias("n_orders"))
    )


# Supplier revenue per year.
SUPPLIER_YEARS = """
sy AS (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS season,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
         COUNT(*) AS n_lines, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned
  FROM lineitem GROUP BY 1, 2)"""


def supplier_years(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("season"))
        .agg(
            money("l_extendedprice").alias("revenue"),
            F.count("*").alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        )
    )
