import random
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pytest
from exports import GATE_PRODUCTS, GATE_STORES, SALES_ROWS
from pyspark.errors import PySparkException

from tillhouse.operators import marts, quality, star


@pytest.fixture
def staged(make):
    stores, products = make.stores(GATE_STORES), make.products(GATE_PRODUCTS)
    frame = quality.annotate(make.transactions(SALES_ROWS), stores, products, ["line"])
    return star.staged(quality.clean(frame))


@pytest.fixture
def fact(make, staged):
    return star.fact_sales(staged, make.products(GATE_PRODUCTS))


def test_dimensions(make, staged):
    stores = {r.store_id: r.store_age_years for r in star.dim_store(make.stores(GATE_STORES), date(2026, 1, 1)).collect()}
    assert stores == {"ST-0001": 11, "ST-0002": 6}
    assert {r.margin_pct for r in star.dim_product(make.products(GATE_PRODUCTS)).collect()} == {33.33}
    dates = {tuple(r) for r in star.dim_date(staged).collect()}
    assert dates == {("2026-01-01", 2026, 1, "Thursday", 0), ("2026-01-02", 2026, 1, "Friday", 0)}


def test_weekends(spark):
    days = spark.createDataFrame([(f"2026-01-0{d}",) for d in range(2, 7)], "transaction_date string")
    found = {r.date_key: (r.day_of_week, r.is_weekend) for r in star.dim_date(days).collect()}
    assert found == {
        "2026-01-02": ("Friday", 0),
        "2026-01-03": ("Saturday", 1),
        "2026-01-04": ("Sunday", 1),
        "2026-01-05": ("Monday", 0),
        "2026-01-06": ("Tuesday", 0),
    }


def test_default_store_age_is_of_today(make):
    assert star.dim_store(make.stores(GATE_STORES)).first().store_age_years == date.today().year - 2015


def test_margin_edges(make):
    products = make.products([("a", "c", 1.0, 0.0), ("b", "c", 3.0, 2.0), ("c", "c", 1.0, 3.0), ("d", "c", 7.0, 8.0)])
    assert {r.product_id: r.margin_pct for r in star.dim_product(products).collect()} == {
        "a": None, "b": -50.0, "c": 66.67, "d": 12.5,
    }


def test_fact_measures(fact):
    rows = {r.transaction_id: (r.gross_revenue, r.net_revenue, r.cost_of_goods, r.gross_profit) for r in fact.collect()}
    assert rows == {
        "TXN-1": (30.0, 27.0, 20.0, 7.0),
        "TXN-2": (150.0, 150.0, 100.0, 50.0),
        "TXN-3": (45.0, 42.75, 30.0, 12.75),
    }


def one_line(make, spark, cost, price, quantity, discount):
    lines = spark.createDataFrame(
        [("t", "2026-01-01", "s", "p", None, quantity, discount)],
        "transaction_id string, transaction_date string, store_id string, product_id string, customer_id string, "
        "quantity bigint, discount_pct double",
    )
    return star.fact_sales(lines, make.products([("p", "c", cost, price)])).first()


@pytest.mark.parametrize(
    ("price", "quantity", "gross"),
    [(0.125, 8, 1.0), (1.2345, 1000, 1234.5), (91.0, 1_000_000_000, 91e9), (0.005, 1, 0.01), (0.000001, 5000, 0.01)],
)
def test_prices_finer_than_a_cent(make, spark, price, quantity, gross):
    row = one_line(make, spark, price, price, quantity, 0.0)
    assert (row.gross_revenue, row.net_revenue, row.cost_of_goods, row.gross_profit) == (gross, gross, gross, 0.0)


def test_measures_equal_decimal_arithmetic(make, spark):
    rnd = random.Random(7)
    for _ in range(12):
        cost, price = (round(rnd.uniform(0, 50), rnd.randint(0, 6)) for _ in range(2))
        quantity, discount = rnd.randint(1, 10_000), round(rnd.uniform(0, 100), rnd.randint(0, 4))
        row = one_line(make, spark, cost, price, quantity, discount)
        gross, bought = quantity * Decimal(str(price)), quantity * Decimal(str(cost))
        net = gross * (1 - Decimal(str(discount)) / 100)
        exact = [float(x.quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in (gross, net, bought, net - bought)]
        assert [row.gross_revenue, row.net_revenue, row.cost_of_goods, row.gross_profit] == exact


def test_a_price_beyond_six_decimals_is_an_error(make, spark):
    with pytest.raises(PySparkException, match="more than 6 decimals in unit_price"):
        one_line(make, spark, 1.0, 1.23456789, 1, 0.0)


def test_margin_of_fine_prices(make):
    assert star.dim_product(make.products([("a", "c", 0.1, 0.125)])).first().margin_pct == 20.0


def test_profit_is_rounded_once(make, spark):
    row = one_line(make, spark, 0.33, 0.99, 1, 12.5)
    # 0.99 * 0.875 = 0.86625 -> 0.87; 0.86625 - 0.33 = 0.53625 -> 0.54
    assert (row.net_revenue, row.gross_profit) == (0.87, 0.54)


def test_fact_through_the_large_dimension_path(make, staged, fact, monkeypatch):
    monkeypatch.setattr(star, "fits_broadcast", lambda *_: False)
    for min_rows in (0, 10_000_000):
        split = star.fact_sales(staged, make.products(GATE_PRODUCTS), min_rows)
        assert sorted(split.collect()) == sorted(fact.collect())


def test_daily_mart(make, fact):
    mart = marts.daily_sales_by_store(fact, make.stores(GATE_STORES))
    assert sorted(tuple(r) for r in mart.collect()) == [
        ("2026-01-01", "ST-0001", "North", 1, 2, 30.0, 27.0, 7.0),
        ("2026-01-02", "ST-0001", "North", 1, 3, 45.0, 42.75, 12.75),
        ("2026-01-02", "ST-0002", "South", 1, 1, 150.0, 150.0, 50.0),
    ]


def test_monthly_mart_weighs_margins_by_sales(make, fact):
    mart = marts.monthly_sales_by_category(fact, star.dim_product(make.products(GATE_PRODUCTS)))
    assert sorted(tuple(r) for r in mart.collect()) == [
        ("2026-01", "Electronics", 1, 1, 150.0, 150.0, 50.0, 33.33),
        ("2026-01", "Grocery", 2, 5, 75.0, 69.75, 19.75, 33.33),
    ]
    mixed = star.dim_product(make.products([("PRD-00001", "c", 5.0, 10.0), ("PRD-00002", "c", 1.0, 10.0)]))
    row = marts.monthly_sales_by_category(fact, mixed).first()
    assert row.n_transactions == 3 and row.avg_margin_pct == 63.33  # (50 + 50 + 90) / 3


def test_customer_mart_leaves_out_guests(fact):
    mart = {r.customer_id: tuple(r)[1:] for r in marts.customer_summary(fact).collect()}
    assert mart == {
        "CUST-1": ("2026-01-01", "2026-01-01", 1, 27.0, 27.0),
        "CUST-2": ("2026-01-02", "2026-01-02", 1, 42.75, 42.75),
    }
