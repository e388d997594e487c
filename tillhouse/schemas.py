"""Declared schemas of the raw exports and of the eleven warehouse tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

STRING, DOUBLE, LONG, INT = StringType(), DoubleType(), LongType(), IntegerType()


@dataclass(frozen=True)
class Table:
    """A warehouse table: its columns, its primary key (empty: none) and how it is sorted at rest."""

    name: str
    schema: StructType
    keys: tuple[str, ...] = ()
    layout: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


def _columns(required: dict[str, DataType], optional: tuple[str, ...] = ()) -> StructType:
    return StructType([StructField(n, t, n in optional) for n, t in required.items()])


# Column names of the exports and tables.
# Raw exports. Nothing is required here: the gate and the contracts decide.
STORES = StructType(
    [
        StructField("store_id", STRING),
        StructField("region", STRING),
        StructField("store_format", STRING),
        StructField("opened_year", LONG),
    ]
)
PRODUCTS = StructType(
    [
        StructField("product_id", STRING),
        StructField("category", STRING),
        StructField("unit_cost", DOUBLE),
        StructField("unit_price", DOUBLE),
    ]
)
TRANSACTIONS = StructType(
    [
        StructField("transaction_id", STRING),
        StructField("transaction_date", STRING),
        StructField("store_id", STRING),
        StructField("product_id", STRING),
        StructField("customer_id", STRING),
        StructField("quantity", LONG),
        StructField("discount_pct", DOUBLE),
    ]
)

_STORE = {"store_id": STRING, "region": STRING, "store_format": STRING, "opened_year": LONG}
_PRODUCT = {"product_id": STRING, "category": STRING, "unit_cost": DOUBLE, "unit_price": DOUBLE}
_SALES = {"n_transactions": LONG, "total_quantity": LONG, "gross_revenue": DOUBLE,
          "net_revenue": DOUBLE, "gross_profit": DOUBLE}

# A text primary key may hold a null, so key columns are required only where the
# warehouse says so.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table("stg_stores", _columns(_STORE, ("store_id",)), ("store_id",)),
        Table("stg_products", _columns(_PRODUCT, ("product_id",)), ("product_id",)),
        Table(
            "stg_transactions",
            _columns(
                {f.name: f.dataType for f in TRANSACTIONS.fields},
                ("transaction_id", "customer_id"),
            ),
            ("transaction_id",),
        ),
        Table(
            "stg_quarantined_transactions",
            _columns(
                {f.name: f.dataType for f in TRANSACTIONS.fields} | {"dq_reasons": STRING},
                tuple(TRANSACTIONS.names),
            ),
        ),
        Table("dim_store", _columns(_STORE | {"store_age_years": LONG}, ("store_id",)), ("store_id",)),
        Table("dim_product", _columns(_PRODUCT | {"margin_pct": DOUBLE}, ("product_id",)), ("product_id",)),
        Table(
            "dim_date",
            _columns(
                {"date_key": STRING, "year": INT, "month": INT, "day_of_week": STRING, "is_weekend": INT},
                ("date_key",),
            ),
            ("date_key",),
        ),
        Table(
            "fact_sales",
            _columns(
                {"transaction_id": STRING, "date_key": STRING, "store_id": STRING, "product_id": STRING,
                 "customer_id": STRING, "quantity": LONG, "discount_pct": DOUBLE, "gross_revenue": DOUBLE,
                 "net_revenue": DOUBLE, "cost_of_goods": DOUBLE, "gross_profit": DOUBLE},
                ("transaction_id", "customer_id"),
            ),
            ("transaction_id",),
        ),
        Table(
            "mart_daily_sales_by_store",
            _columns({"date_key": STRING, "store_id": STRING, "region": STRING} | _SALES),
            ("date_key", "store_id"),
            layout=("store_id", "date_key"),
        ),
        Table(
            "mart_monthly_sales_by_category",
            _columns({"year_month": STRING, "category": STRING} | _SALES | {"avg_margin_pct": DOUBLE}),
            ("year_month", "category"),
        ),
        Table(
            "mart_customer_summary",
            _columns(
                {"customer_id": STRING, "first_purchase": STRING, "last_purchase": STRING,
                 "n_transactions": LONG, "lifetime_revenue": DOUBLE, "avg_order_value": DOUBLE},
                ("customer_id",),
            ),
            ("customer_id",),
            layout=("customer_id",),
        ),
    )
}
