"""The three marts.

The fact is summed to the grain of its own key before a dimension is joined, so the
join sees a few rows per key however many sales the key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.functions.numbers import amount, cents, half_up_div
from tillhouse.operators.skew import sized

MONEY = ("gross_revenue", "net_revenue", "gross_profit")


def _sums() -> list[Column]:
    return [
        F.count("*").alias("n_transactions"),
        F.sum("quantity").alias("total_quantity"),
        *(F.sum(cents(F.col(m))).alias(m) for m in MONEY),
    ]


def _amounts() -> list[Column]:
    return [amount(F.col(m)).alias(m) for m in MONEY]


def daily_sales_by_store(fact: DataFrame, stores: DataFrame) -> DataFrame:
    """Sales per date and store."""
    per_store = fact.groupBy("date_key", "store_id").agg(*_sums())
    regions = sized(stores.select("store_id", "region"), stores)
    return per_store.join(regions, "store_id").select(
        "date_key", "store_id", "region", "n_transactions", "total_quantity", *_amounts()
    )


def monthly_sales_by_category(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Sales per month and category; the margin is averaged over sales, not products."""
    month = F.substring("date_key", 1, 7).alias("year_month")
    per_product = fact.groupBy(month, "product_id").agg(*_sums())
    margins = products.select("product_id", "category", cents(F.col("margin_pct")).alias("_margin"))
    return (
        per_product.join(sized(margins, products), "product_id")
        .groupBy("year_month", "category")
        .agg(
            F.sum("n_transactions").alias("n_transactions"),
            F.sum("total_quantity").alias("total_quantity"),
            *(F.sum(m).alias(m) for m in MONEY),
            F.sum(F.col("_margin") * F.col("n_transactions")).alias("_margin"),
        )
        .select(
            "year_month",
            "category",
            "n_transactions",
            "total_quantity",
            *_amounts(),
            amount(half_up_div(F.col("_margin"), F.col("n_transactions"))).alias("avg_margin_pct"),
        )
    )


def customer_summary(fact: DataFrame) -> DataFrame:
    """Purchases per registered customer; guests have no customer id."""
    day = F.to_date("date_key")  # dates, unlike text, aggregate in a hash table
    revenue, n = F.col("_revenue"), F.col("n_transactions")
    return (
        fact.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.min(day).alias("_first"),
            F.max(day).alias("_last"),
            F.count("*").alias("n_transactions"),
            F.sum(cents(F.col("net_revenue"))).alias("_revenue"),
        )
        .select(
            "customer_id",
            F.col("_first").cast("string").alias("first_purchase"),
            F.col("_last").cast("string").alias("last_purchase"),
            "n_transactions",
            amount(revenue).alias("lifetime_revenue"),
            amount(half_up_div(revenue, n)).alias("avg_order_value"),
        )
    )


# The same marts, brought up to date from what was added and what was withdrawn. Sums are
# whole cents and so add up without a trace of the order; ``fact`` rows come signed.

COUNTED = ("n_transactions", "total_quantity", *MONEY)


def signed(added: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Fact rows with ``_sign``: 1 if they came, -1 if they went."""
    return added.withColumn("_sign", F.lit(1)).unionByName(withdrawn.withColumn("_sign", F.lit(-1)))


def _signed_sums() -> list[Column]:
    sign = F.col("_sign")
    return [
        F.sum(sign).cast("bigint").alias("n_transactions"),
        F.sum(sign * F.col("quantity")).cast("bigint").alias("total_quantity"),
        *(F.sum(sign * cents(F.col(m))).alias(m) for m in MONEY),
    ]


def _stored_sums(mart: DataFrame, *keys: str) -> DataFrame:
    return mart.select(*keys, "n_transactions", "total_quantity", *(cents(F.col(m)).alias(m) for m in MONEY))


def merge_daily(mart: DataFrame, change: DataFrame, stores: DataFrame, layout: Sequence[str] = ()) -> DataFrame:
    """:func:`daily_sales_by_store` after ``change``, from the mart before; days without sales go.

    With a ``layout`` of the two keys the rows are cut into ranges of it before they are merged,
    and stay there while the stores are broadcast: the one shuffle of the mart.
    """
    keys = ("date_key", "store_id")
    both = _stored_sums(mart, *keys).unionByName(change.groupBy(*keys).agg(*_signed_sums()))
    if layout:
        both = both.repartitionByRange(*layout)
    sums = both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTED)).filter("n_transactions > 0")
    regions = sized(stores.select("store_id", "region"), stores)
    return sums.join(regions, "store_id").select("date_key", "store_id", "region", "n_transactions", "total_quantity", *_amounts())


def monthly_margins(fact: DataFrame, products: DataFrame) -> DataFrame:
    """What the monthly mart does not show: the margins of all its sales, summed, in cents."""
    return _monthly_change(fact.withColumn("_sign", F.lit(1)), products).select("year_month", "category", "margin")


def _monthly_change(change: DataFrame, products: DataFrame) -> DataFrame:
    month = F.substring("date_key", 1, 7).alias("year_month")
    per_product = change.groupBy(month, "product_id").agg(*_signed_sums())
    margins = products.select("product_id", "category", cents(F.col("margin_pct")).alias("_margin"))
    joined = per_product.join(sized(margins, products), "product_id")
    return joined.groupBy("year_month", "category").agg(
        *(F.sum(c).alias(c) for c in COUNTED), F.sum(F.col("_margin") * F.col("n_transactions")).alias("margin")
    )


def merge_monthly(
    mart: DataFrame, margins: DataFrame, change: DataFrame, products: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """:func:`monthly_sales_by_category` and :func:`monthly_margins` after ``change``."""
    keys = ("year_month", "category")
    before = _stored_sums(mart, *keys).join(margins, [*keys])
    both = before.unionByName(_monthly_change(change, products))
    sums = both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (*COUNTED, "margin"))).filter("n_transactions > 0")
    average = amount(half_up_div(F.col("margin"), F.col("n_transactions"))).alias("avg_margin_pct")
    return sums.select(*keys, "n_transactions", "total_quantity", *_amounts(), average), sums.select(*keys, "margin")


def merge_customers(mart: DataFrame, change: DataFrame, fact: DataFrame) -> DataFrame:
    """:func:`customer_summary` after ``change``; ``fact`` is the fact after it.

    Sums add up. A first or last day moves out with an added sale; where the first or the
    last sale of a customer was withdrawn, only the fact knows the next one, and these
    customers, no others, are summed up from it again.
    """
    day = F.to_date("date_key")
    came = F.when(F.col("_sign") > 0, day)
    went = F.when(F.col("_sign") < 0, day)
    changes = change.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.min(came).alias("_first"), F.max(came).alias("_last"), F.min(went).alias("_gone_first"), F.max(went).alias("_gone_last"),
        F.sum("_sign").cast("bigint").alias("_n"), F.sum(F.col("_sign") * cents(F.col("net_revenue"))).alias("_cents"),
    )
    before = mart.select(
        "customer_id", F.to_date("first_purchase").alias("first"), F.to_date("last_purchase").alias("last"),
        "n_transactions", cents(F.col("lifetime_revenue")).alias("revenue"),
    )
    both = before.join(changes, "customer_id", "full")
    lost = (F.col("_gone_first") <= F.col("first")) | (F.col("_gone_last") >= F.col("last"))
    again = both.filter(lost).select("customer_id")
    n = F.coalesce("n_transactions", F.lit(0)) + F.coalesce("_n", F.lit(0))
    revenue = F.coalesce("revenue", F.lit(0)) + F.coalesce("_cents", F.lit(0))
    kept = both.filter(~F.coalesce(lost, F.lit(False))).select(
        "customer_id", F.least("first", "_first").cast("string").alias("first_purchase"),
        F.greatest("last", "_last").cast("string").alias("last_purchase"), n.alias("n_transactions"), revenue.alias("_revenue"),
    )
    kept = kept.filter("n_transactions > 0").select(
        "customer_id", "first_purchase", "last_purchase", "n_transactions", amount(F.col("_revenue")).alias("lifetime_revenue"),
        amount(half_up_div(F.col("_revenue"), F.col("n_transactions"))).alias("avg_order_value"),
    )
    return kept.unionByName(customer_summary(fact.join(sized(again), "customer_id", "left_semi")))
