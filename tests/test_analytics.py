import pytest

from tillhouse.operators import analytics


@pytest.fixture
def daily(spark):
    rows = [(f"2026-01-{d:02d}", s, "North", 1, 1, 1.0, float(d), 0.5) for d in range(1, 32) for s in ("B", "A")]
    return spark.createDataFrame(
        rows,
        "date_key string, store_id string, region string, n_transactions bigint, total_quantity bigint, "
        "gross_revenue double, net_revenue double, gross_profit double",
    )


@pytest.fixture
def customers(spark):
    return spark.createDataFrame([("c2", 5.0), ("c1", 5.0), ("c3", 9.0)], "customer_id string, lifetime_revenue double")


def test_daily_sales(daily):
    rows = analytics.daily_sales(daily).collect()
    assert len(rows) == 30
    assert [(r.date_key, r.store_id) for r in rows[:3]] == [("2026-01-31", "A"), ("2026-01-31", "B"), ("2026-01-30", "A")]
    assert {r.store_id for r in analytics.daily_sales(daily, "B", 5).collect()} == {"B"}
    assert analytics.daily_sales(daily, "", 1000).count() == 62
    assert analytics.daily_sales(daily, "none").count() == 0


@pytest.mark.parametrize("limit", [0, -1, 1001, True, "5", 1.5])
def test_limits(daily, limit):
    with pytest.raises(ValueError):
        analytics.daily_sales(daily, limit=limit)
    with pytest.raises(ValueError):
        analytics.monthly_by_category(daily, limit=limit)


def test_top_customers(customers):
    assert [r.customer_id for r in analytics.top_customers(customers, 2).collect()] == ["c3", "c1"]
    with pytest.raises(ValueError):
        analytics.top_customers(customers, 101)


def test_one_customer(customers):
    assert analytics.one_customer(customers, "c2").lifetime_revenue == 5.0
    assert analytics.find_customer(customers, "nobody").count() == 0
    with pytest.raises(KeyError):
        analytics.one_customer(customers, "nobody")


def test_revenue_and_profit(daily, spark):
    per_day = {r.date_key: r.net_revenue for r in analytics.daily_net_revenue(daily).collect()}
    assert len(per_day) == 31 and per_day["2026-01-31"] == 62.0
    monthly = spark.createDataFrame(
        [("2026-01", "x", 0.1), ("2026-02", "x", 0.2), ("2026-01", "y", 5.0)],
        "year_month string, category string, gross_profit double",
    )
    assert [tuple(r) for r in analytics.profit_by_category(monthly).collect()] == [("y", 5.0), ("x", 0.3)]


def test_totals(spark):
    fact = spark.createDataFrame([(1.1, 0.4), (2.2, -0.1)], "net_revenue double, gross_profit double")
    found = {r.metric: r.value for r in analytics.totals({"fact_sales": fact, "dim_date": spark.range(3)}).collect()}
    assert found == {"net_revenue": 3.3, "gross_profit": 0.3, "rows_fact_sales": 2.0, "rows_dim_date": 3.0}
