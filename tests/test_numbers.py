from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillhouse.functions.numbers import amount, cents, half_up_div


def test_cents_and_back(spark):
    values = [0.0, 0.01, 1.15, 2.675, 1.005, -3.33, 900.1, 99999999.99]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", cents(F.col("v")).alias("c"), amount(cents(F.col("v"))).alias("a")).collect()
    for row in rows:
        assert abs(row.c - row.v * 100) <= 0.5 + 1e-6
        assert row.a == float(Decimal(row.c) / 100)


def test_zero_denominator_is_null(spark):
    assert spark.range(1).select(half_up_div(F.lit(5), F.lit(0)).alias("q")).first().q is None


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(-(10**15), 10**15), st.integers(-(10**9), 10**9).filter(bool)
        ),
        min_size=1,
        max_size=200,
    )
)
def test_half_up_division_is_exact(spark, pairs):
    ties = [(n % 10**6 * d + d // 2, d) for n, d in pairs]  # at or next to a half
    pairs = pairs + ties + [(5, 2), (-5, 2), (5, -2), (1, 3)]
    frame = spark.createDataFrame(pairs, "n bigint, d bigint")
    for row in frame.select("n", "d", half_up_div(F.col("n"), F.col("d")).alias("q")).collect():
        n, d = abs(row.n), abs(row.d)
        expected = (2 * n + d) // (2 * d) * (-1 if (row.n < 0) != (row.d < 0) else 1)
        assert row.q == expected
        if d < 10**6 and n < 10**9:
            exact = (Decimal(row.n) / Decimal(row.d)).quantize(Decimal(1), ROUND_HALF_UP)
            assert row.q == int(exact)
