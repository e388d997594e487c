import json
from datetime import date
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from exports import GATE_PRODUCTS, GATE_ROWS, GATE_STORES, SALES_ROWS
from pyspark.errors import PySparkException

from tillhouse.operators import analytics, contracts
from tillhouse.operators.contracts import ContractError
from tillhouse.operators.quality import SCHEDULED_GATE, Gate, QualityGateError
from tillhouse.plans.refresh import Exports, query, run_pipeline, run_sql_models, stored_tables, validate
from tillhouse.schemas import TABLES
from tillhouse.session import settings, shuffle_partitions, shuffle_width, stored_bytes
from tillhouse.sources import csv_files
from tillhouse.sources.tables import materialize, read_table, release, write_table

AS_OF = date(2026, 1, 1)


@pytest.fixture
def exports(make):
    def build(rows=GATE_ROWS, stores=GATE_STORES, products=GATE_PRODUCTS):
        return Exports(make.stores(stores), make.products(products), make.transactions(rows), ["line"])

    return build


def contents(spark, root):
    return {name: sorted(map(tuple, frame.collect()), key=str) for name, frame in stored_tables(spark, root).items()}


def test_whole_job(spark, exports, tmp_path):
    root = str(tmp_path / "warehouse")
    summary = run_pipeline(spark, exports(), root, AS_OF)
    assert summary["warehouse_path"] == root
    assert summary["dq_report"]["quarantine_rate"] == 0.6667
    assert summary["dq_report"]["violation_counts"]["unknown_store_id"] == 1
    first = contents(spark, root)
    assert {n: len(rows) for n, rows in first.items()} == {
        "stg_stores": 2, "stg_products": 2, "stg_transactions": 2, "stg_quarantined_transactions": 4,
        "dim_store": 2, "dim_product": 2, "dim_date": 2, "fact_sales": 2,
        "mart_daily_sales_by_store": 2, "mart_monthly_sales_by_category": 2, "mart_customer_summary": 1,
    }
    assert set(first) == set(TABLES)
    run_pipeline(spark, exports(), root, AS_OF)
    assert contents(spark, root) == first
    run_pipeline(spark, exports(), root, AS_OF, min_rows=0)  # all keys take the heavy path
    assert contents(spark, root) == first

    written = [json.loads(p.read_text()) for p in Path(root, "dq_report").glob("*.json")]
    assert written == [summary["dq_report"]]

    tables = stored_tables(spark, root)
    assert contracts.null_counts(tables).filter("n_nulls > 0").count() == 0
    assert contracts.repeated_keys(tables).filter("n_repeated > 0").count() == 0
    contracts.require_not_null(tables)
    assert analytics.one_customer(tables["mart_customer_summary"], "CUST-1").lifetime_revenue == 27.0


def test_from_csv(spark, exports, tmp_path):
    plain = exports()
    csv_files.write(plain.stores, f"{tmp_path}/stores")
    csv_files.write(plain.products, f"{tmp_path}/products")
    csv_files.write(plain.transactions.coalesce(1).orderBy("line").drop("line"), f"{tmp_path}/transactions")
    run_pipeline(spark, plain, f"{tmp_path}/a", AS_OF)
    read = Exports.from_csv(spark, *(f"{tmp_path}/{n}" for n in ("stores", "products", "transactions")))
    run_pipeline(spark, read, f"{tmp_path}/b", AS_OF)
    assert contents(spark, f"{tmp_path}/a") == contents(spark, f"{tmp_path}/b")


@pytest.mark.parametrize("gate", [Gate(enabled=True), SCHEDULED_GATE])
def test_gate_stops_before_the_tables_change(spark, exports, tmp_path, gate):
    root = str(tmp_path / "warehouse")
    run_pipeline(spark, exports(SALES_ROWS), root, AS_OF, gate)
    before, scratch = contents(spark, root), scratch_left(spark)
    with pytest.raises(QualityGateError):
        run_pipeline(spark, exports(), root, AS_OF, gate)
    assert contents(spark, root) == before and scratch_left(spark) == scratch
    written = [json.loads(p.read_text()) for p in Path(root, "dq_report").glob("*.json")]
    assert written[0]["total_rows"] == len(GATE_ROWS)  # the report of the stopped run


def scratch_left(spark):
    return {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).iterdir()}


def stopped(spark, exports, tmp_path, reason, rows=SALES_ROWS, **inputs):
    """A run that breaks a contract changes no table and leaves no scratch."""
    root = str(tmp_path / "warehouse")
    run_pipeline(spark, exports(SALES_ROWS), root, AS_OF)
    before, scratch = contents(spark, root), scratch_left(spark)
    with pytest.raises(ContractError, match=reason):
        run_pipeline(spark, exports(rows, **inputs), root, AS_OF)
    assert contents(spark, root) == before and scratch_left(spark) == scratch


@pytest.mark.parametrize("column", ["quantity", "discount_pct"])
def test_null_measure_stops_the_load(spark, exports, tmp_path, column):
    row = list(SALES_ROWS[0])
    row[5 if column == "quantity" else 6] = None
    stopped(spark, exports, tmp_path, f"stg_transactions.{column}", rows=[tuple(row)])


def test_price_of_zero_stops_the_load(spark, exports, tmp_path):
    products = [*GATE_PRODUCTS, ("PRD-3", "Toys", 1.0, 0.0)]
    stopped(spark, exports, tmp_path, "dim_product.margin_pct", products=products)


def test_repeated_store_stops_the_load(spark, exports, tmp_path):
    stopped(spark, exports, tmp_path, "stg_stores", stores=GATE_STORES * 2)


def test_nothing_clean_fails_the_smoke_check(spark, exports, tmp_path):
    with pytest.raises(ContractError, match="fact_sales"):
        run_pipeline(spark, exports(GATE_ROWS[3:]), str(tmp_path / "w"), AS_OF)


def test_null_id_is_loaded_once(spark, exports, tmp_path):
    rows = [(None, *SALES_ROWS[0][1:]), (None, *SALES_ROWS[1][1:])]
    run_pipeline(spark, exports(rows), str(tmp_path / "w"), AS_OF)
    tables = stored_tables(spark, str(tmp_path / "w"))
    assert [r.transaction_id for r in tables["fact_sales"].collect()] == [None]
    contracts.require_unique_keys(tables)


def test_sql_and_sql_models(spark, exports, tmp_path):
    root = str(tmp_path / "warehouse")
    run_pipeline(spark, exports(SALES_ROWS), root, AS_OF)
    tables = stored_tables(spark, root)
    text = "SELECT net_revenue FROM mart_daily_sales_by_store WHERE store_id = :store ORDER BY date_key"
    assert [r.net_revenue for r in query(spark, tables, text, {"store": "ST-0001"}).collect()] == [27.0, 42.75]
    text = "SELECT count(*) AS n FROM fact_sales WHERE store_id = ? AND quantity > ?"
    assert query(spark, tables, text, ["ST-0001", 2]).first().n == 1
    assert query(spark, tables, "SELECT count(*) AS n FROM dim_store").first().n == 2

    models = tmp_path / "models"
    models.mkdir()
    (models / "b_regions.sql").write_text("SELECT region, sum(net_revenue) AS net FROM mart_daily_sales_by_store GROUP BY region")
    (models / "a_lines.sql").write_text("SELECT count(*) AS n FROM fact_sales")
    assert run_sql_models(spark, root, str(models)) == ["a_lines", "b_regions"]
    assert {tuple(r) for r in stored_tables(spark, root)["b_regions"].collect()} == {("North", 69.75), ("South", 150.0)}


def test_validate(spark, exports):
    checked = validate(spark, exports())
    assert checked.clean.count() == 2 and checked.quarantined.count() == 4
    assert checked.report.first().total_rows == 6
    assert dict(checked.clean.dtypes)["transaction_date"] == "date"
    assert all(folder.startswith(spark.sparkContext.getCheckpointDir()) for folder in checked.scratch)


def test_shuffle_width_follows_the_data(spark):
    assert shuffle_partitions(0) == 1
    assert shuffle_partitions(1 << 40) == 3 * (1 << 40) // (256 << 20)
    assert shuffle_partitions(1 << 50) == 100_000
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    assert shuffle_width(spark, 77) == {key: "77"}
    assert shuffle_width(spark, 1) == {key: before}
    with pytest.raises(KeyError), settings(spark, {key: "77"}):
        assert spark.conf.get(key) == "77"
        raise KeyError
    assert spark.conf.get(key) == before


def test_released_scratch_is_gone(spark, tmp_path):
    folder = str(tmp_path / "t")
    materialize(spark.range(1000), folder)
    assert stored_bytes(spark, folder) > 0
    release(spark, folder)
    release(spark, folder)
    assert not Path(folder).exists()


def test_money_raises_where_the_session_has_ansi_off(spark, exports, tmp_path):
    rows = [(*SALES_ROWS[0][:5], 10**12, 0.0)]
    with settings(spark, {"spark.sql.ansi.enabled": "false"}), pytest.raises(PySparkException, match="OVERFLOW|OUT_OF_RANGE"):
        run_pipeline(spark, exports(rows), str(tmp_path / "w"), AS_OF)


def test_views_of_the_session_are_left_alone(spark, exports, tmp_path):
    root = str(tmp_path / "warehouse")
    run_pipeline(spark, exports(SALES_ROWS), root, AS_OF)
    spark.range(7).createOrReplaceTempView("fact_sales")
    count = query(spark, stored_tables(spark, root), "SELECT count(*) AS n FROM fact_sales, dim_store")
    assert count.first().n == 6
    assert spark.table("fact_sales").count() == 7
    assert "dim_store" not in {t.name for t in spark.catalog.listTables()}
    spark.catalog.dropTempView("fact_sales")


def test_stored_marts_are_in_order_of_their_keys(spark, tmp_path):
    """Ranges of keys do not overlap between files, so a lookup opens one of them."""
    rows = spark.range(4000).selectExpr(
        "concat('C', lpad(cast((id * 7919) % 4000 AS string), 5, '0')) AS customer_id", "'2026-01-01' AS first_purchase",
        "'2026-01-01' AS last_purchase", "1L AS n_transactions", "1.0D AS lifetime_revenue", "1.0D AS avg_order_value",
    ).repartition(4)
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        write_table(rows, str(tmp_path), "mart_customer_summary")
    ranges = []
    for file in Path(tmp_path, "mart_customer_summary").glob("*.parquet"):
        groups = pq.ParquetFile(file).metadata
        for i in range(groups.num_row_groups):
            if groups.row_group(i).num_rows:
                ranges.append((groups.row_group(i).column(0).statistics.min, groups.row_group(i).column(0).statistics.max))
    assert len(ranges) > 2 and sum(low <= "C02000" <= high for low, high in ranges) == 1
    found = analytics.find_customer(read_table(spark, str(tmp_path), "mart_customer_summary"), "C02000")
    assert found.count() == 1 and "EqualTo(customer_id,C02000)" in found._jdf.queryExecution().toString()


def test_conform(spark):
    table = TABLES["stg_quarantined_transactions"]
    rows = spark.createDataFrame([("T1", "bad", "x", 5)], "transaction_id string, dq_reasons string, more string, quantity int")
    found = contracts.conform(rows, table)
    assert found.columns == table.columns
    assert found.first().asDict() == dict.fromkeys(table.columns) | {"transaction_id": "T1", "dq_reasons": "bad", "quantity": 5}
    with pytest.raises(PySparkException, match="dq_reasons"):
        contracts.conform(rows.withColumn("dq_reasons", rows["more"].substr(9, 1)).replace("", None), table).collect()
