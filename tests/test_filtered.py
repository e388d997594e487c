"""Ids too many for a broadcast are ruled out by a filter before a shuffle."""

import pytest

from tillhouse.operators import skew
from tillhouse.plans import delta


@pytest.mark.parametrize("words", [skew.FILTER_WORDS, 1])
def test_ids_beyond_a_broadcast_are_met_exactly(spark, monkeypatch, words):
    """However small the filter; the rows that it rules out are not shuffled."""
    monkeypatch.setattr(skew, "FILTER_WORDS", words)
    monkeypatch.setattr(delta, "fits_broadcast", lambda side: False)
    rows = spark.createDataFrame([(f"T{i}",) for i in range(500)] * 2 + [(None,)], "transaction_id string")
    ids = spark.createDataFrame([(f"T{i}",) for i in range(0, 600, 7)] + [(None,)], "transaction_id string")
    among = {f"T{i}" for i in range(0, 600, 7)} | {None}
    held = [r[0] for r in rows.collect()]
    for how, wanted in (("left_semi", True), ("left_anti", False)):
        found = [r[0] for r in delta._has(rows, ids, how).collect()]
        assert sorted(found, key=str) == sorted((x for x in held if (x in among) == wanted), key=str)
    out, maybe = skew.filtered(rows, ids, "transaction_id")
    assert out.count() + maybe.count() == len(held) and not {r[0] for r in out.collect()} & among
    if words > 1:
        assert out.count() > len(held) // 2
