"""Readers see one whole version of the warehouse, whatever happens to the run after it."""

import os
import subprocess
import sys
import textwrap
from datetime import date
from pathlib import Path

import pytest
from exports import GATE_PRODUCTS, GATE_ROWS, GATE_STORES, SALES_ROWS

from tillhouse.operators.contracts import ContractError
from tillhouse.plans import refresh
from tillhouse.plans.refresh import Exports, ModelCycleError, model_order, run_pipeline, run_sql_models, table_references
from tillhouse.schemas import TABLES
from tillhouse.sources.versions import ConflictError, Run, new_version, prune, stored_tables, version

AS_OF = date(2026, 1, 1)


@pytest.fixture
def exports(make):
    def build(rows):
        return Exports(make.stores(GATE_STORES), make.products(GATE_PRODUCTS), make.transactions(rows), ["line"])

    return build


def contents(tables):
    return {name: sorted(map(tuple, frame.collect()), key=str) for name, frame in tables.items()}


class Killed(BaseException):
    """As if the process ended: nothing below handles it."""


def test_a_run_killed_after_any_table_changes_nothing(spark, exports, tmp_path, monkeypatch):
    """After every table that a run writes a new reader finds the old set: what a kill there would leave."""
    root = str(tmp_path / "w")
    run_pipeline(spark, exports(SALES_ROWS), root, AS_OF)
    before, paths = contents(stored_tables(spark, root)), version(spark, root)
    write, written = Run.write, []

    def watched(run, rows, name):
        n = write(run, rows, name)
        written.append(name)
        assert version(spark, root) == paths and name in run.tables
        return n

    def killed(run):
        raise Killed

    with monkeypatch.context() as patched:
        patched.setattr(Run, "write", watched)
        patched.setattr(Run, "publish", killed)
        patched.setattr(Run, "discard", lambda run: None)  # a killed process cleans nothing up
        with pytest.raises(Killed):
            run_pipeline(spark, exports(GATE_ROWS), root, AS_OF)
    assert set(written) == set(TABLES)
    assert contents(stored_tables(spark, root)) == before and len(list(Path(root, "data").iterdir())) == 2

    run_pipeline(spark, exports(GATE_ROWS), root, AS_OF)
    assert version(spark, root).number == 2 and stored_tables(spark, root)["fact_sales"].count() == 2
    assert len(list(Path(root, "data").iterdir())) == 3  # the dead run's folder is young
    prune(spark, root, keep=2, min_age_hours=-1)
    assert len(list(Path(root, "data").iterdir())) == 2


def test_a_reader_keeps_the_version_it_opened(spark, exports, tmp_path):
    root = str(tmp_path / "w")
    run_pipeline(spark, exports(SALES_ROWS), root, AS_OF)
    opened = stored_tables(spark, root)
    before = contents(opened)
    run_pipeline(spark, exports(GATE_ROWS), root, AS_OF)
    assert contents(opened) == before == contents(stored_tables(spark, root, 1)) != contents(stored_tables(spark, root))
    run_pipeline(spark, exports(GATE_ROWS), root, AS_OF)  # keeps two versions
    assert version(spark, root, 1) is None and version(spark, root, 2).number == 2
    with pytest.raises(FileNotFoundError):
        stored_tables(spark, root, 1)
    with pytest.raises(FileNotFoundError):
        stored_tables(spark, str(tmp_path / "none"))


def test_two_runs_at_once_conflict(spark, tmp_path):
    root = str(tmp_path / "w")
    with new_version(spark, root) as run:
        run.write(spark.range(3), "numbers")
    with pytest.raises(ConflictError), new_version(spark, root) as slow:
        with new_version(spark, root) as fast:
            fast.write(spark.range(5), "numbers")
        slow.write(spark.range(4), "numbers")
    assert stored_tables(spark, root)["numbers"].count() == 5
    assert len(list(Path(root, "data").iterdir())) == 2  # the slow run left nothing


def test_tables_that_a_run_does_not_write_stay(spark, tmp_path):
    root = str(tmp_path / "w")
    with new_version(spark, root) as run:
        run.write(spark.range(3), "a")
        run.write(spark.range(4), "b")
    with new_version(spark, root) as run:
        assert run.write(spark.range(9), "b") == 9
    tables = stored_tables(spark, root)
    assert (tables["a"].count(), tables["b"].count(), tables["a"].count()) == (3, 9, 3)
    prune(spark, root, keep=1)
    assert tables["a"].count() == 3  # of a run whose other table is gone from the log
    with pytest.raises(KeyError):
        tables["c"]


def test_nulls_are_counted_while_a_table_is_written(spark, tmp_path):
    rows = spark.range(10).selectExpr(
        "concat('C', id) AS customer_id", "if(id > 6, null, '2026-01-01') AS first_purchase", "'2026-01-01' AS last_purchase",
        "1L AS n_transactions", "if(id = 1, null, 1.0D) AS lifetime_revenue", "1.0D AS avg_order_value",
    )
    with pytest.raises(ContractError, match="3 nulls in mart_customer_summary.first_purchase; 1 nulls in mart_customer_summary.lifetime"):
        with new_version(spark, str(tmp_path)) as run:
            run.write(rows, "mart_customer_summary")
    assert version(spark, str(tmp_path)) is None and not list(Path(tmp_path, "data").iterdir())


def test_models_run_in_order_of_what_they_read(spark, exports, tmp_path):
    root, folder = str(tmp_path / "w"), tmp_path / "models"
    run_pipeline(spark, exports(SALES_ROWS), root, AS_OF)
    folder.mkdir()
    models = {
        "a_share": "SELECT region, net / (SELECT sum(net) FROM Z_regions) AS share FROM z_regions WHERE region IN (SELECT region FROM m_known)",
        "m_known": "WITH a_share AS (SELECT DISTINCT region FROM dim_store) SELECT region FROM a_share",
        "z_regions": "SELECT region, sum(net_revenue) AS net FROM mart_daily_sales_by_store GROUP BY region",
    }
    for name, text in models.items():
        (folder / f"{name}.sql").write_text(text)
    assert table_references(spark, models["a_share"]) == {"z_regions", "m_known"}
    assert table_references(spark, models["m_known"]) == {"dim_store"}
    assert run_sql_models(spark, root, str(folder)) == ["m_known", "z_regions", "a_share"]
    found = {r["region"]: round(r["share"], 4) for r in stored_tables(spark, root)["a_share"].collect()}
    assert found == {"North": round(69.75 / 219.75, 4), "South": round(150 / 219.75, 4)}

    before = version(spark, root)
    with pytest.raises(ModelCycleError, match="a.*b|b.*a"):
        model_order(spark, {"a": "SELECT * FROM b", "b": "SELECT * FROM c JOIN a", "c": "SELECT 1"})
    (folder / "q_broken.sql").write_text("SELECT no_such_column FROM z_regions")
    with pytest.raises(Exception, match="no_such_column"):
        run_sql_models(spark, root, str(folder))
    assert version(spark, root) == before


def test_observed_counts_are_those_of_a_second_scan(spark, exports):
    checked = refresh.validate(spark, exports(GATE_ROWS))
    again = refresh.quality.report(checked.quarantined.unionByName(
        checked.clean.withColumn("transaction_date", checked.clean["transaction_date"].cast("string")).selectExpr("*", "'' AS dq_reasons")
    ))
    assert checked.report.collect() == again.select(checked.report.columns).collect()
    assert checked.report.dtypes == again.select(checked.report.columns).dtypes
    assert checked.partition["holds"] and checked.partition["total_rows"] == len(GATE_ROWS)
    empty = refresh.validate(spark, exports([]))
    assert empty.report.first()["quarantine_rate"] == 0.0 and empty.partition["holds"]


def test_tasks_that_run_again_are_counted_once(tmp_path):
    """The first attempt of every task fails behind the counting; needs a session that retries."""
    script = textwrap.dedent(
        """
        import sys
        from pyspark import TaskContext
        from pyspark.sql import Observation, SparkSession, functions as F
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")

        def failing(batches):
            yield from batches
            if TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("first attempt")

        counts = Observation()
        rows = spark.range(0, 1000, 1, 4).repartition(4, "id").observe(counts, F.count(F.lit(1)).alias("n"))
        rows.mapInArrow(failing, "id bigint").write.parquet(sys.argv[1])
        print("counted", counts.get["n"], spark.read.parquet(sys.argv[1]).count())
        """
    )
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run(
        [sys.executable, "-c", script, str(tmp_path / "out")], capture_output=True, text=True, env=env, timeout=300
    )
    assert "counted 1000 1000" in done.stdout, done.stderr[-2000:]
