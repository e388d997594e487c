"""What keeps the jobs linear: one shuffle of a mart, folders added, bounded partitions."""

from tillhouse.operators import marts
from tillhouse.session import MERGED_BYTES, job_width, settings
from tillhouse.sources.tables import Ranged
from tillhouse.sources.versions import Run


def test_partitions_are_not_merged_beyond_what_a_task_holds(spark):
    key, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    width = job_width(spark, 1 << 30)
    assert int(width[key]) == 96 and int(width[merged]) == MERGED_BYTES
    with settings(spark, {merged: "1m"}):
        assert int(job_width(spark, 0)[merged]) == 1 << 20


def test_rows_cut_into_ranges_are_not_cut_again(spark, tmp_path):
    """Sums in the ranges of the layout: one exchange from the sales to the sorted table."""
    fact = spark.range(1000).selectExpr(
        "concat('2026-01-', lpad(cast(id % 28 + 1 AS string), 2, '0')) AS date_key", "concat('ST-', id % 50) AS store_id",
        "1L AS quantity", "1.0D AS gross_revenue", "1.0D AS net_revenue", "0.5D AS gross_profit",
    )
    stores = spark.range(50).selectExpr("concat('ST-', id) AS store_id", "'North' AS region")
    daily = marts.daily_sales_by_store(fact.repartitionByRange(3, "store_id", "date_key"), stores)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan
    run = Run(spark, str(tmp_path), None)
    name = "mart_daily_sales_by_store"
    n = run.write(Ranged(daily), name)
    assert sorted(run.tables[name].collect()) == sorted(marts.daily_sales_by_store(fact, stores).collect()) and n == 700
    run.append(run.tables[name].limit(3), name)
    assert len(run.tables.folders[name]) == 2 and run.last(name).count() == 3 and run.tables[name].count() == 703
