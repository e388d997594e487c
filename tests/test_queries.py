"""Every query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracles import duck, normal
from tillhouse.fixtures.views import QUERIES
from tillhouse.operators import quality, skew, star

FOLDER = "/root/testdata/sf0.001"
SQL = {name: text for name, text in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(entry.queries())


def as_text(rows):
    return [tuple(str(v)[:10] if hasattr(v, "year") else v for v in row) for row in rows]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    mine = normal(entry.queries()[name](spark, FOLDER).toPandas().astype(object))
    theirs = normal(con.sql(SQL[name]).df().astype(object))
    assert mine[0] == theirs[0]
    assert as_text(mine[1]) == as_text(theirs[1])


NEVER_SMALL = lambda *_: False
ONLY_UNKNOWN_KEYS = lambda side, *_: side.columns == ["_unknown"]


@pytest.mark.parametrize("small", [NEVER_SMALL, ONLY_UNKNOWN_KEYS], ids=["never", "unknown-keys"])
@pytest.mark.parametrize("name", ["dq_duplicates", "dq_annotated", "orphan_products", "mart_monthly_sales_by_category"])
def test_query_with_heavy_keys_and_large_dimensions(spark, con, name, small, monkeypatch):
    """Every repeated key counts as heavy and no dimension as small; the result is the same."""
    found = skew.heavy_keys
    monkeypatch.setattr(skew, "heavy_keys", lambda rows, key, min_rows: found(rows, key, 1))
    for module in (skew, quality, star):
        monkeypatch.setattr(module, "fits_broadcast", small)
    test_query(spark, con, name)


def test_counts_of_the_derived_rows(spark):
    row = entry.queries()["dq_report"](spark, FOLDER).first()
    assert (row.total_rows, row.clean_rows, row.null_customer_id_count) == (6000, 4322, 125)
    assert (row.duplicate_transaction_id, row.invalid_transaction_date, row.non_positive_quantity) == (1401, 67, 86)
    assert (row.unknown_store_id, row.unknown_product_id, row.discount_out_of_range) == (68, 67, 93)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:3] == ["date_key", "store_id", "region"]
    assert frame.count() == 3962
