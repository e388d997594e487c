"""Raw exports with known defects, derived from the generated test tables.

Stores come from suppliers, products from parts, transactions from order lines. The
defects follow the order key; ``oracle`` states the same rules in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.operators.skew import lookup
from tillhouse.plans.refresh import Exports

# No two order lines are equal in all of these, so they put the lines in one order.
LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]

# Columns read from each test table. Declared, so that opening a table runs no job.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def padded(prefix: str, key: str, width: int) -> str:
    """SQL for an id: a prefix and the key with leading zeros; longer keys keep all their digits."""
    text = f"cast({key} as string)"
    return f"concat('{prefix}', lpad({text}, greatest({width}, length({text})), '0'))"


def unless(divisor: int, rest: int, defect: str, value: str) -> str:
    """SQL for ``value``, but ``defect`` on the order keys that leave ``rest``."""
    return f"CASE WHEN l_orderkey % {divisor} = {rest} THEN {defect} ELSE {value} END"


# The three ids of an order line.
KEYS = [
    f"concat({padded('TXN-', 'l_orderkey', 8)}, '-', cast(l_linenumber as string)) AS transaction_id",
    f"{unless(89, 1, repr('ST-9999'), padded('ST-', 'l_suppkey', 4))} AS store_id",
    f"{unless(83, 2, repr('PRD-99999'), padded('PRD-', 'l_partkey', 5))} AS product_id",
]


class TestView:
    """The derived exports of one folder of test tables."""

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(COLUMNS[name]).parquet(f"{self._folder}/{name}.parquet")

    @cached_property
    def stores(self) -> DataFrame:
        nations = self._table("nation").join(self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        suppliers = self._table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        return suppliers.selectExpr(
            f"{padded('ST-', 's_suppkey', 4)} AS store_id",
            "r_name AS region",
            "CASE s_suppkey % 3 WHEN 0 THEN 'flagship' WHEN 1 THEN 'standard' ELSE 'express' END AS store_format",
            "2005 + s_suppkey % 20 AS opened_year",
        )

    @cached_property
    def products(self) -> DataFrame:
        # One part in ten has a price of four decimals; costs have four throughout.
        fine = "CASE WHEN p_partkey % 10 = 7 THEN 0.1234 ELSE 0.0000 END"
        price = f"cast(cast(p_retailprice AS decimal(12,2)) + {fine} AS decimal(12,4))"
        cost = f"round({price} * cast(42 + p_partkey % 40 AS decimal(3,0)) * cast(0.01 AS decimal(3,2)), 4)"
        return self._table("part").selectExpr(
            f"{padded('PRD-', 'p_partkey', 5)} AS product_id",
            "p_type AS category",
            f"cast({cost} AS double) AS unit_cost",
            f"cast({price} AS double) AS unit_price",
        )

    @cached_property
    def keys(self) -> DataFrame:
        """The three ids of every transaction, from the order lines alone."""
        return self._table("lineitem").selectExpr(*KEYS)

    @cached_property
    def transactions(self) -> DataFrame:
        """The raw transactions followed by the ``LINE_ORDER`` columns."""
        # Lines and orders both grow with the data: shuffle and sort, never broadcast.
        orders = self._table("orders").withColumnRenamed("o_orderkey", "l_orderkey").hint("merge")
        transaction_id, store_id, product_id = KEYS
        quantity = "cast(l_quantity AS bigint)"
        discount = "cast(cast(l_discount * 100 AS decimal(5,1)) AS double)"
        return lookup(self._table("lineitem"), orders, "l_orderkey", "inner", small=False).selectExpr(
            transaction_id,
            f"{unless(97, 0, repr('not-a-date'), 'cast(cast(l_shipdate AS date) AS string)')} AS transaction_date",
            store_id,
            product_id,
            f"{unless(50, 3, 'NULL', padded('CUST-', 'o_custkey', 6))} AS customer_id",
            f"{unless(79, 4, f'-({quantity} % 4)', quantity)} AS quantity",
            f"{unless(73, 5, '200.0D', discount)} AS discount_pct",
            *LINE_ORDER,
        )

    @property
    def exports(self) -> Exports:
        return Exports(self.stores, self.products, self.transactions, LINE_ORDER)
