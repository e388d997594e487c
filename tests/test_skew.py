"""The paths for heavy keys give the same rows as brute force."""

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillhouse.operators import quality, skew
from tillhouse.session import settings as session_settings

KEYS = st.one_of(st.none(), st.sampled_from(["hot", "#0", "#1", "a", "b", "c", "d"]))


def frame_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("min_rows", [0, 2, 5])
def test_heavy_keys(spark, min_rows):
    keys = ["hot"] * 10 + [None] * 6 + ["a"] * 3 + ["b"]
    rows = frame_of(spark, [(k,) for k in keys], "k string")
    found = skew.heavy_keys(rows, "k", min_rows)
    assert {r._heavy for r in found.collect()} == {k for k, n in Counter(keys).items() if n > min_rows}


def test_second_count_has_no_input_without_heavy_keys(spark):
    """Also where there are more rows than buckets: their number follows the rows."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    few, enough = 16, skew.buckets_for(20_000, 100)
    assert skew._suspects(rows, "k", 100, few).count() == 20_000
    assert skew._suspects(rows, "k", 100, enough).isEmpty()
    assert skew.buckets_for(3 * 10**12, 10**7) == skew.FILL * 300_000


def test_no_heavy_keys(spark):
    rows = frame_of(spark, [(str(i),) for i in range(50)], "k string")
    assert skew.heavy_keys(rows, "k", 5) is None
    assert skew.heavy_keys(rows, "k") is None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(KEYS, st.integers(0, 3)), min_size=1, max_size=60), st.sampled_from([0, 1, 3, 100]))
def test_exactly_one_first_row_per_key(spark, pairs, min_rows):
    """Also where rows tie in the order, whole copies included."""
    rows = frame_of(spark, pairs, "k string, o int")
    marked = skew.mark_repeats(rows, "k", ["o"], "again", min_rows).collect()
    assert Counter((r.k, r.o) for r in marked) == Counter(pairs)
    firsts = defaultdict(list)
    for r in marked:
        if not r.again:
            firsts[r.k].append(r.o)
    assert firsts == {k: [min(o for q, o in pairs if q == k)] for k in {k for k, _ in pairs}}


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(KEYS, st.integers(0, 9)), min_size=1, max_size=60),
    st.dictionaries(st.sampled_from(["hot", "#0", "#1", "a", "b", "x"]), st.integers(0, 99)),
    st.sampled_from(["left", "inner"]),
    st.sampled_from([0, 2, 100]),
)
def test_lookup(spark, pairs, entries, how, min_rows):
    rows = frame_of(spark, pairs, "k string, v int")
    dim = frame_of(spark, list(entries.items()), "k string, w int") if entries else spark.createDataFrame([], "k string, w int")
    split = skew.lookup(rows, dim, "k", how, small=False, min_rows=min_rows)
    expected = Counter((k, v, entries.get(k)) for k, v in pairs if how == "left" or k in entries)
    assert Counter((r.k, r.v, r.w) for r in split.select("k", "v", "w").collect()) == expected


@pytest.mark.parametrize("small", [(True,), (False, True), (False, False)])
def test_known_keys_in_all_three_ways(spark, small, monkeypatch):
    keys = ["hot"] * 9 + [None] * 4 + ["a", "b", "b", "x", "x", "x"]
    rows = frame_of(spark, list(enumerate(keys)), "i int, k string")
    dim = frame_of(spark, [("a",), ("hot",), ("hot",), ("z",), (None,)], "k string")
    for min_rows in (1, 100):
        answers = iter(small)
        monkeypatch.setattr(quality, "fits_broadcast", lambda *_: next(answers))
        marked = quality.mark_known(rows, dim, "k", "known", min_rows)
        assert sorted((r.i, r.known) for r in marked.collect()) == [(i, k in ("hot", "a")) for i, k in enumerate(keys)]
        assert next(answers, None) is None


def test_heavy_rows_are_spread(spark):
    rows = spark.range(4000, numPartitions=40).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    dim = rows.select("k").distinct().withColumn("w", F.length("k"))
    four_tasks = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    with session_settings(spark, four_tasks):
        joined = skew.lookup(rows, dim, "k", "left", small=False, min_rows=100)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2 * 4000 / 4


def test_small_side_is_broadcast_and_large_is_not(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("k"))
    dim = rows.withColumn("w", F.lit(1))
    assert skew.fits_broadcast(dim, 10) and not skew.fits_broadcast(dim, 9)
