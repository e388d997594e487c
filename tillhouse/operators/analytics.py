"""Read queries over the marts and the warehouse totals."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tillhouse.functions.numbers import amount, cents


# Default and highest limits of the read queries.
DAILY_LIMIT, MONTHLY_LIMIT, CUSTOMER_LIMIT = 30, 100, 10
MOST_SALES, MOST_CUSTOMERS = 1000, 100


def _within(limit: int, most: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must be a whole number from 1 to {most}, not {limit!r}")
    return limit


def daily_sales(daily_mart: DataFrame, store_id: str | None = None, limit: int = DAILY_LIMIT) -> DataFrame:
    """Newest daily sales, of one store if given; stores of a day in id order."""
    wanted = _within(limit, MOST_SALES)
    rows = daily_mart.filter(F.col("store_id") == store_id) if store_id else daily_mart
    return rows.orderBy(F.desc("date_key"), "store_id").limit(wanted)


def monthly_by_category(monthly_mart: DataFrame, limit: int = MONTHLY_LIMIT) -> DataFrame:
    """Newest months; categories of a month in name order."""
    wanted = _within(limit, MOST_SALES)
    return monthly_mart.orderBy(F.desc("year_month"), "category").limit(wanted)


def top_customers(customer_mart: DataFrame, limit: int = CUSTOMER_LIMIT) -> DataFrame:
    """Customers with the highest lifetime revenue, ties in id order."""
    wanted = _within(limit, MOST_CUSTOMERS)
    return customer_mart.orderBy(F.desc("lifetime_revenue"), "customer_id").limit(wanted)


def find_customer(customer_mart: DataFrame, customer_id: str) -> DataFrame:
    """The summary of one customer, or no row."""
    return customer_mart.filter(F.col("customer_id") == customer_id).limit(1)


def one_customer(customer_mart: DataFrame, customer_id: str) -> Row:
    """The summary of one customer; ``KeyError`` when there is none."""
    row = find_customer(customer_mart, customer_id).first()
    if row is None:
        raise KeyError(f"no customer {customer_id}")
    return row


def daily_net_revenue(daily_mart: DataFrame) -> DataFrame:
    """Net revenue per date over all stores."""
    return (
        daily_mart.groupBy("date_key")
        .agg(F.sum(cents(F.col("net_revenue"))).alias("_cents"))
        .select("date_key", amount(F.col("_cents")).alias("net_revenue"))
    )


def profit_by_category(monthly_mart: DataFrame) -> DataFrame:
    """Gross profit per category over all months, highest first."""
    return (
        monthly_mart.groupBy("category")
        .agg(F.sum(cents(F.col("gross_profit"))).alias("_cents"))
        .select("category", amount(F.col("_cents")).alias("gross_profit"))
        .orderBy(F.desc("gross_profit"), "category")
    )


def totals(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and the money totals of the fact, as (metric, value)."""
    fact = tables["fact_sales"]
    money = fact.agg(*(F.sum(cents(F.col(m))).alias(m) for m in ("net_revenue", "gross_profit"))).select(
        F.explode(
            F.create_map(
                F.lit("net_revenue"), amount(F.col("net_revenue")),
                F.lit("gross_profit"), amount(F.col("gross_profit")),
            )
        ).alias("metric", "value")
    )
    counts = [
        frame.agg(F.count("*").cast("double").alias("value")).select(F.lit(f"rows_{name}").alias("metric"), "value")
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts, money)
