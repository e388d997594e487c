"""What comes to the driver is bounded by what the code has counted, not by Spark's guess at a table's size."""

from datetime import date

import pytest
from exports import GATE_PRODUCTS, GATE_STORES

from tillhouse.operators import quality, skew, star
from tillhouse.plans.delta import run_delta
from tillhouse.plans.refresh import Exports, run_pipeline

ROW = ("T1", "2026-01-01", "ST-0001", "PRD-00001", "C1", 1, 0.0)
KEY = "spark.sql.autoBroadcastJoinThreshold"


def broadcast_bytes(frame):
    """Bytes of each table that a query has broadcast, as Spark's metric has them."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.queryExecution().toRdd().count()
    found = []

    def visit(node):
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(node.metrics().apply("dataSize").value())
        if kind == "AdaptiveSparkPlanExec":
            visit(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            visit(node.plan())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(plan)
    return found


def test_a_filter_is_broadcast_as_its_bits(spark, monkeypatch):
    """About twice its bits, as memory comes in powers of two, not a hash entry for each word."""
    n = 300_000
    monkeypatch.setattr(skew, "FILTER_BITS", 64)
    keys = spark.range(n).selectExpr("concat('T', id) AS transaction_id").localCheckpoint()
    rows = spark.range(0, 2 * n, 100).selectExpr("concat('T', id) AS transaction_id").localCheckpoint()
    out, maybe = skew.filtered(rows, keys, "transaction_id")
    (size,) = broadcast_bytes(maybe)
    assert size <= 2.5 * n * skew.FILTER_BITS // 8
    assert out.intersect(keys).count() == 0 and maybe.intersect(keys).count() == n // 100


@pytest.mark.parametrize("job", ["refresh", "delta"])
def test_jobs_broadcast_nothing_uncounted(spark, make, tmp_path, monkeypatch, job):
    """Tables beyond the count are not broadcast, however small their files are; the setting is put back."""
    stores, products = make.stores(GATE_STORES), make.products(GATE_PRODUCTS)
    exports = Exports(stores, products, make.transactions([ROW]), ["line"])
    plans = []

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    fact_sales, unknown_keys = star.fact_sales, quality.unknown_keys
    monkeypatch.setattr(star, "fact_sales", lambda *a, **b: seen(fact_sales(*a, **b)))
    monkeypatch.setattr(quality, "unknown_keys", lambda *a: seen(unknown_keys(*a)))
    for module in (star, quality):
        monkeypatch.setattr(module, "fits_broadcast", lambda side: False)
    before = spark.conf.get(KEY)
    run_pipeline(spark, exports, str(tmp_path), date(2026, 1, 1))
    if job == "delta":
        plans.clear()
        run_delta(spark, str(tmp_path), make.transactions([("T2", *ROW[1:])]), ["line"])
    # Two lists of unknown keys and the prices.
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)
    assert spark.conf.get(KEY) == before
