"""Every query over the test tables, as plain DataFrame compositions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.fixtures.testview import LINE_ORDER, TestView
from tillhouse.operators import analytics, contracts, marts, quality, star
from tillhouse.operators.quality import Gate, NullGate, SCHEDULED_GATE
from tillhouse.operators.skew import mark_repeats
from tillhouse.plans.delta import run_delta
from tillhouse.plans.refresh import (
    Exports,
    query,
    run_pipeline,
    run_sql_models,
    stored_tables,
    validate,
    write_report,
)
from tillhouse.schemas import TABLES, TRANSACTIONS
from tillhouse.sources import csv_files
from tillhouse.sources.tables import scratch_folder, scratch_scope

AS_OF = date(2026, 1, 1)
# Days at which loads of shipments begin and end.
DELTAS = ("0001-01-01", "1998-01-01", "1999-01-01", "2000-06-01", "9999-01-01")
STORE_ID = "ST-0001"
CUSTOMER_ID = "CUST-000007"


class Views(TestView):
    """The warehouse tables of one folder of test tables, each from the raw rows."""

    @cached_property
    def annotated(self) -> DataFrame:
        return quality.annotate(
            self.transactions, self.stores, self.products, LINE_ORDER, keys_of=self.keys
        )

    @cached_property
    def report(self) -> DataFrame:
        return quality.report(self.annotated)

    @property
    def stg_stores(self) -> DataFrame:
        return self.stores

    @property
    def stg_products(self) -> DataFrame:
        return self.products

    @cached_property
    def stg_transactions(self) -> DataFrame:
        return star.staged(quality.clean(self.annotated))

    @property
    def stg_quarantined_transactions(self) -> DataFrame:
        return quality.quarantined(self.annotated)

    @cached_property
    def dim_store(self) -> DataFrame:
        return star.dim_store(self.stores, AS_OF)

    @cached_property
    def dim_product(self) -> DataFrame:
        return star.dim_product(self.products)

    @property
    def dim_date(self) -> DataFrame:
        return star.dim_date(self.stg_transactions)

    @cached_property
    def fact_sales(self) -> DataFrame:
        return star.fact_sales(self.stg_transactions, self.products, keys_of=self.keys)

    @property
    def mart_daily_sales_by_store(self) -> DataFrame:
        return marts.daily_sales_by_store(self.fact_sales, self.stores)

    @property
    def mart_monthly_sales_by_category(self) -> DataFrame:
        return marts.monthly_sales_by_category(self.fact_sales, self.dim_product)

    @property
    def mart_customer_summary(self) -> DataFrame:
        return marts.customer_summary(self.fact_sales)

    @property
    def raw(self) -> DataFrame:
        return self.transactions.select(TRANSACTIONS.names)

    def gate(self, gate: Gate) -> DataFrame:
        """What a gate decides on the report of these exports."""
        rate = self.report.first()["quarantine_rate"]
        return self.spark.range(1).select(
            F.lit(gate.max_rate).alias("max_rate"),
            F.lit(rate).alias("quarantine_rate"),
            F.lit(gate.stops(rate)).alias("stops"),
        )

    def warehouse(self) -> str:
        """Where the refresh job wrote these exports, once per session."""
        key = (self.spark.sparkContext.applicationId, self._folder)
        if key not in _WAREHOUSES:
            root = f"{scratch_folder(self.spark)}/warehouse"
            run_pipeline(self.spark, self.exports, root, AS_OF)
            _WAREHOUSES[key] = root
        return _WAREHOUSES[key]

    def stored(self) -> Mapping[str, DataFrame]:
        """The tables the refresh job writes for these exports."""
        return stored_tables(self.spark, self.warehouse())

    def twice(self) -> Mapping[str, DataFrame]:
        """The tables after two runs of the job into one folder."""
        root = f"{scratch_folder(self.spark)}/warehouse"
        for _ in range(2):
            run_pipeline(self.spark, self.exports, root, AS_OF)
        return stored_tables(self.spark, root)

    def _once(self, kind: str, build: Callable[[str], None]) -> Mapping[str, DataFrame]:
        """Tables that ``build`` writes into a folder, once per session."""
        key = (self.spark.sparkContext.applicationId, f"{kind} {self._folder}")
        if key not in _WAREHOUSES:
            root = f"{scratch_folder(self.spark)}/warehouse"
            build(root)
            _WAREHOUSES[key] = root
        return stored_tables(self.spark, _WAREHOUSES[key])

    def _shipped(self, low: str, high: str) -> DataFrame:
        return self.transactions.filter((F.col("l_shipdate") >= low) & (F.col("l_shipdate") < high))

    def by_deltas(self) -> Mapping[str, DataFrame]:
        """The tables after a refresh with the first shipments and three loads of later ones."""

        def build(root: str) -> None:
            run_pipeline(self.spark, Exports(self.stores, self.products, self._shipped(*DELTAS[:2]), LINE_ORDER), root, AS_OF)
            for low, high in zip(DELTAS[1:], DELTAS[2:]):
                run_delta(self.spark, root, self._shipped(low, high), LINE_ORDER)

        return self._once("deltas", build)

    def withdrawn(self) -> Mapping[str, DataFrame]:
        """The tables after a load that takes back the ids that end in 7 and adds later shipments without such."""

        def build(root: str) -> None:
            first, rest = self._shipped(DELTAS[0], DELTAS[2]), self._shipped(DELTAS[2], DELTAS[-1])
            run_pipeline(self.spark, Exports(self.stores, self.products, first, LINE_ORDER), root, AS_OF)
            sevenths = F.col("transaction_id").endswith("7")
            run_delta(self.spark, root, rest.filter(~sevenths), LINE_ORDER, self.keys.filter(sevenths))

        return self._once("withdrawn", build)

    def csv_exports(self) -> list[str]:
        """The exports as CSV files, written in line order so that file order is that order."""
        folder = scratch_folder(self.spark)
        paths = [f"{folder}/{name}" for name in ("stores", "products", "transactions")]
        ordered = self.transactions.orderBy(*LINE_ORDER).select(TRANSACTIONS.names)
        for rows, path in zip((self.stores, self.products, ordered), paths):
            csv_files.write(rows, path)
        return paths

    def refreshed(self, paths: list[str]) -> DataFrame:
        """The daily mart of a refresh from those files."""
        root = f"{scratch_folder(self.spark)}/warehouse"
        run_pipeline(self.spark, Exports.from_csv(self.spark, *paths), root, AS_OF)
        return stored_tables(self.spark, root)["mart_daily_sales_by_store"]

    def first_copies(self, more: int) -> DataFrame:
        """First copies of ids that two folders have in files of equal names.

        Folder ``day=<more>`` has two unrelated rows more for each id. A task writes a file
        of the same name into either folder.
        """
        copies = F.explode(F.array(*[F.struct(F.lit(d).alias("day"), F.lit(p).alias("prefix")) for d, p in (
            (1, ""), (2, ""), (more, "X-"), (more, "Y-"))]))
        rows = self.keys.select("transaction_id").distinct().select("transaction_id", copies.alias("copy")).select(
            F.concat("copy.prefix", "transaction_id").alias("transaction_id"),
            F.lit("2026-01-01").alias("transaction_date"),
            F.lit("S").alias("store_id"),
            F.lit("P").alias("product_id"),
            F.concat(F.lit("DAY-"), F.col("copy.day")).alias("customer_id"),
            F.lit(1).alias("quantity"),
            F.lit(0.0).alias("discount_pct"),
            F.col("copy.day").alias("day"),
        )
        path = scratch_folder(self.spark)
        # Ids in a row shrink to an eighth; a file is what one task writes, so none is too large to be read whole.
        rows.write.partitionBy("day").option("header", True).option("compression", "gzip").csv(path)
        read = csv_files.read_transactions(self.spark, path)
        marked = mark_repeats(read, "transaction_id", csv_files.FILE_ORDER, "_again")
        return marked.filter("not _again").select("transaction_id", "customer_id")

    def from_floats(self) -> DataFrame:
        """Transactions by way of a CSV with other column order, whole numbers as ``2.0`` and null texts."""
        path = scratch_folder(self.spark)
        columns = {c: F.col(c) for c in reversed(TRANSACTIONS.names)}
        columns["quantity"] = F.when(F.col("quantity") > 0, F.col("quantity").cast("double").cast("string")).otherwise("NA")
        columns["customer_id"] = F.coalesce("customer_id", F.lit("None"))
        csv_files.write(self.raw.select(F.lit("x").alias("note"), *(c.alias(n) for n, c in columns.items())), path)
        return csv_files.read_transactions(self.spark, path).drop(*csv_files.FILE_ORDER)

    def report_from_json(self) -> DataFrame:
        """The published report, read back."""
        path = scratch_folder(self.spark)
        with scratch_scope(self.spark):
            write_report(validate(self.spark, self.exports).report, path)
        names = [rule.name for rule in quality.RULES]
        flat = ("total_rows", "clean_rows", "quarantined_rows", "null_customer_id_count")
        schema = f"table string, quarantine_rate double, {', '.join(f'{n} bigint' for n in flat)}, " + (
            f"violation_counts struct<{','.join(f'{n}:bigint' for n in names)}>"
        )
        read = self.spark.read.schema(schema).json(path)
        return read.select("table", *flat, "quarantine_rate", "violation_counts.*")

    def from_sql_file(self) -> DataFrame:
        """A table that a ``.sql`` file builds from the stored ones."""
        root = self.warehouse()
        (name,) = run_sql_models(self.spark, root, str(Path(__file__).parent / "models"))
        return stored_tables(self.spark, root)[name]

    def limits(self) -> DataFrame:
        """Rows that each read query returns at and beyond its limits; null if it refuses."""
        tables, rows = self.stored(), []
        for name, read, mart, most in (
            ("daily", lambda t, n: analytics.daily_sales(t, limit=n), "mart_daily_sales_by_store", analytics.MOST_SALES),
            ("monthly", analytics.monthly_by_category, "mart_monthly_sales_by_category", analytics.MOST_SALES),
            ("top", analytics.top_customers, "mart_customer_summary", analytics.MOST_CUSTOMERS),
        ):
            for wanted in (0, 1, most, most + 1):
                try:
                    rows.append((name, wanted, read(tables[mart], wanted).count()))
                except ValueError:
                    rows.append((name, wanted, None))
        return self.spark.createDataFrame(rows, "query string, wanted bigint, n_rows bigint")

    def smoke(self) -> DataFrame:
        """What the check after a load says of the fact, and of one without rows."""
        fact, rows = self.stored()["fact_sales"], []
        for name, frame in (("fact_sales", fact), ("fact_sales after 2999", fact.filter("date_key > '2999'"))):
            try:
                contracts.require_rows({name: frame})
                rows.append((name, True))
            except contracts.ContractError:
                rows.append((name, False))
        return self.spark.createDataFrame(rows, "table_name string, passes boolean")


# Roots of warehouses written for the queries, by session and folder of test tables.
_WAREHOUSES: dict[tuple[str, str], str] = {}


def _csv(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_folder(spark)
        views = Views(spark, folder)
        csv_files.write({"stores": views.stores, "products": views.products, "transactions": views.raw}[name], path)
        rows = getattr(csv_files, f"read_{name}")(spark, path)
        return rows.drop(*csv_files.FILE_ORDER)

    return run


def _view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: getattr(Views(spark, folder), name)


def _of(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Views(spark, folder))


_REGION_SALES = """
SELECT region, sum(n_transactions) AS n_transactions
FROM mart_daily_sales_by_store WHERE date_key >= :since GROUP BY region
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _view(name) for name in TABLES} | {
    "raw_stores_csv": _csv("stores"),
    "raw_products_csv": _csv("products"),
    "raw_transactions_csv": _csv("transactions"),
    "dq_duplicates": _of(lambda v: quality.repeats(v.transactions, LINE_ORDER, keys_of=v.keys)),
    "dq_invalid_date": _of(lambda v: v.raw.filter(quality.bad_date())),
    "dq_non_positive_quantity": _of(lambda v: v.raw.filter(quality.bad_quantity())),
    "dq_unknown_store": _of(
        lambda v: quality.mark_known(v.raw, v.stores, "store_id", "known", keys_of=v.keys).filter("not known").drop("known")
    ),
    "dq_unknown_product": _of(
        lambda v: quality.mark_known(v.raw, v.products, "product_id", "known", keys_of=v.keys).filter("not known").drop("known")
    ),
    "dq_discount_range": _of(lambda v: v.raw.filter(quality.bad_discount())),
    "orphan_stores": _of(lambda v: quality.orphans(v.raw, v.stores, "store_id", keys_of=v.keys)),
    "orphan_products": _of(lambda v: quality.orphans(v.raw, v.products, "product_id", keys_of=v.keys)),
    "dq_annotated": _of(lambda v: v.annotated),
    "dq_clean": _of(lambda v: quality.clean(v.annotated)),
    "dq_quarantined": _of(lambda v: quality.quarantined(v.annotated)),
    "dq_report": _of(lambda v: v.report),
    "dq_reason_counts": _of(lambda v: quality.reason_counts(v.annotated)),
    "dq_partition_check": _of(
        lambda v: quality.partition_check(v.raw, quality.clean(v.annotated), quality.quarantined(v.annotated))
    ),
    "gate_default": _of(lambda v: v.gate(Gate())),
    "gate_scheduled": _of(lambda v: v.gate(SCHEDULED_GATE)),
    "contract_not_null": _of(lambda v: contracts.null_counts(v.stored())),
    "contract_unique_keys": _of(lambda v: contracts.repeated_keys(v.stored())),
    "warehouse_totals": _of(lambda v: analytics.totals(v.stored())),
    "q_daily_sales": _of(lambda v: analytics.daily_sales(v.mart_daily_sales_by_store)),
    "q_daily_sales_store": _of(lambda v: analytics.daily_sales(v.mart_daily_sales_by_store, STORE_ID)),
    "q_monthly_by_category": _of(lambda v: analytics.monthly_by_category(v.mart_monthly_sales_by_category)),
    "q_customer_lookup": _of(lambda v: analytics.find_customer(v.mart_customer_summary, CUSTOMER_ID)),
    "q_top_customers": _of(lambda v: analytics.top_customers(v.mart_customer_summary)),
    "q_sql_region_sales": _of(
        lambda v: query(
            v.spark,
            {"mart_daily_sales_by_store": v.mart_daily_sales_by_store},
            _REGION_SALES,
            {"since": "1998-01-01"},
        )
    ),
    "nb_daily_net_revenue": _of(lambda v: analytics.daily_net_revenue(v.mart_daily_sales_by_store)),
    "nb_profit_by_category": _of(lambda v: analytics.profit_by_category(v.mart_monthly_sales_by_category)),
    "refresh_daily_mart": _of(lambda v: v.refreshed(v.csv_exports())),
    "refresh_twice": _of(lambda v: analytics.totals(v.twice())),
    "delta_totals": _of(lambda v: analytics.totals(v.by_deltas())),
    "delta_daily_mart": _of(lambda v: v.by_deltas()["mart_daily_sales_by_store"]),
    "delta_monthly_mart": _of(lambda v: v.by_deltas()["mart_monthly_sales_by_category"]),
    "delta_customer_mart": _of(lambda v: v.by_deltas()["mart_customer_summary"]),
    "withdrawn_totals": _of(lambda v: analytics.totals(v.withdrawn())),
    "withdrawn_monthly_mart": _of(lambda v: v.withdrawn()["mart_monthly_sales_by_category"]),
    "withdrawn_customer_mart": _of(lambda v: v.withdrawn()["mart_customer_summary"]),
    "gate_null_rate": _of(lambda v: NullGate(columns=tuple(TRANSACTIONS.names)).rates(v.raw)),
    "raw_transactions_csv_floats": _of(Views.from_floats),
    "dq_first_copy_more_in_first": _of(lambda v: v.first_copies(1)),
    "dq_first_copy_more_in_second": _of(lambda v: v.first_copies(2)),
    "contract_not_null_raw": _of(
        lambda v: contracts.null_counts(
            {"stg_transactions": v.raw.withColumn("quantity", F.when(F.col("quantity") > 0, F.col("quantity")))}
        )
    ),
    "contract_unique_keys_raw": _of(lambda v: contracts.repeated_keys({"stg_transactions": v.raw})),
    "report_json": _of(Views.report_from_json),
    "sql_model_files": _of(Views.from_sql_file),
    "limit_bounds": _of(Views.limits),
    "smoke_check": _of(Views.smoke),
    "stored_daily_sales": _of(lambda v: analytics.daily_sales(v.stored()["mart_daily_sales_by_store"])),
    "stored_daily_sales_store": _of(
        lambda v: analytics.daily_sales(v.stored()["mart_daily_sales_by_store"], STORE_ID)
    ),
    "stored_monthly_by_category": _of(
        lambda v: analytics.monthly_by_category(v.stored()["mart_monthly_sales_by_category"])
    ),
    "stored_customer_lookup": _of(
        lambda v: analytics.find_customer(v.stored()["mart_customer_summary"], CUSTOMER_ID)
    ),
    "stored_top_customers": _of(lambda v: analytics.top_customers(v.stored()["mart_customer_summary"])),
}
