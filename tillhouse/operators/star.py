"""Dimensions and the sales fact."""

from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.functions.numbers import amount, exact, half_up_div, rounded
from tillhouse.operators.skew import HEAVY_ROWS, fits_broadcast, lookup

# Prices in whole millionths, for the exact quotient of two of them.
MILLIONTHS = 1_000_000


def dim_store(stores: DataFrame, as_of: date | None = None) -> DataFrame:
    """Stores with their age in calendar years at ``as_of`` (default: today, UTC)."""
    year = (as_of or datetime.now(timezone.utc).date()).year
    return stores.select(
        "store_id",
        "region",
        "store_format",
        "opened_year",
        (F.lit(year).cast("bigint") - F.col("opened_year")).alias("store_age_years"),
    )


def dim_product(products: DataFrame) -> DataFrame:
    """Products with their margin in percent of the price; null where the price is 0."""
    price, cost = (
        (exact(F.col(name), name) * MILLIONTHS).cast("decimal(18,0)") for name in ("unit_price", "unit_cost")
    )
    return products.select(
        "product_id",
        "category",
        "unit_cost",
        "unit_price",
        amount(half_up_div((price - cost) * 10_000, price)).alias("margin_pct"),
    )


def dim_date(transactions: DataFrame) -> DataFrame:
    """One row per date that has a clean transaction."""
    day = F.to_date("date_key")
    return (
        transactions.select(F.col("transaction_date").alias("date_key"))
        .distinct()
        .select(
            "date_key",
            F.year(day).alias("year"),
            F.month(day).alias("month"),
            F.date_format(day, "EEEE").alias("day_of_week"),
            (F.weekday(day) >= 5).cast("int").alias("is_weekend"),
        )
    )


def staged(clean: DataFrame) -> DataFrame:
    """Clean transactions with the date as ``yyyy-MM-dd`` text, as they are stored."""
    return clean.withColumn("transaction_date", F.col("transaction_date").cast("string"))


def fact_sales(
    transactions: DataFrame,
    products: DataFrame,
    min_rows: int = HEAVY_ROWS,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """One row per staged transaction with its money measures, each rounded once.

    Profit is rounded from the unrounded revenue and cost. Exact for prices of up to six
    decimals (finer ones are an error), discounts of up to four decimals of a percent (finer
    ones are rounded to that), and any line that ``decimal(29,6)`` holds; a larger quantity
    than ten digits or price than twelve raises.
    """
    priced = products.select(
        "product_id",
        exact(F.col("unit_price"), "unit_price").alias("_price"),
        exact(F.col("unit_cost"), "unit_cost").alias("_cost"),
    )
    # Scales are chosen so that no product has to give up digits.
    quantity = F.col("quantity").cast("decimal(10,0)")
    gross, cost = quantity * F.col("_price"), quantity * F.col("_cost")
    paid = F.lit(1) - F.col("discount_pct").cast("decimal(9,4)") * F.lit(Decimal("0.01"))
    net = (gross * paid.cast("decimal(8,6)")).cast("decimal(36,12)")
    lines = lookup(transactions, priced, "product_id", "inner", fits_broadcast(products), min_rows, keys_of)
    return lines.select(
        "transaction_id",
        F.col("transaction_date").alias("date_key"),
        "store_id",
        "product_id",
        "customer_id",
        "quantity",
        "discount_pct",
        rounded(gross).alias("gross_revenue"),
        rounded(net).alias("net_revenue"),
        rounded(cost).alias("cost_of_goods"),
        rounded(net - cost).alias("gross_profit"),
    )
