"""A refresh and three loads of changes give what one refresh over everything gives."""

from datetime import date

import pytest
from exports import GATE_PRODUCTS, GATE_STORES

from tillhouse.operators.quality import Gate, NullGate, QualityGateError
from tillhouse.plans import delta
from tillhouse.plans.delta import run_delta
from tillhouse.plans.refresh import Exports, run_pipeline
from tillhouse.schemas import TABLES
from tillhouse.sources import versions
from tillhouse.sources.versions import stored_tables, version

AS_OF = date(2026, 1, 1)


def row(i, day, store=1, product=1, customer="C1", quantity=1, discount=0.0):
    return (i, day, f"ST-000{store}", f"PRD-0000{product}", customer, quantity, discount)


BASE = [
    row("T1", "2026-01-01"), row("T2", "2026-01-05", customer="C2"), row("T3", "2026-01-09", 2, 2, "C1", 3, 12.5),
    row("T4", "2026-02-01", customer=None), row("T5", "bad"), row(None, "2026-02-02"), row("T6", "2026-02-03", customer="C3"),
]
LOADS = [
    # A repeat of a clean id, of a quarantined one and of a null id; a new first day; repeats of its own.
    ([row("T1", "2026-01-02"), row("T5", "2026-01-02"), row(None, "2026-01-02"), row("T7", "2025-12-31", customer="C2"),
      row("T8", "2026-03-01", 2, 2, "C4", 2, 5.0), row("T8", "2026-03-02")], None),
    # The first and the last sale of a customer go, all of another, one that was never there; T5 may come again.
    ([row("T5", "2026-01-03", customer="C5"), row("T9", "2026-03-03", 2, 1, "C1")], ["T7", "T3", "T6", "T5", "none", None]),
    ([row("T10", "2026-03-04", 9, 1, "C1"), row("T6", "2026-02-04", 1, 2, "C1", 4, 7.5)], ["T8"]),
]


def contents(spark, root):
    return {n: sorted(map(tuple, f.collect()), key=str) for n, f in stored_tables(spark, root).items()}


@pytest.mark.parametrize("folders", [versions.MOST_FOLDERS, 1])
def test_base_and_three_loads_are_a_full_refresh(spark, make, tmp_path, monkeypatch, folders):
    """With one folder per table, appends write tables anew."""
    monkeypatch.setattr(versions, "MOST_FOLDERS", folders)
    stores, products = make.stores(GATE_STORES), make.products(GATE_PRODUCTS)
    root = f"{tmp_path}/deltas"
    run_pipeline(spark, Exports(stores, products, make.transactions(BASE), ["line"]), root, AS_OF)
    whole = list(BASE)
    for i, (rows, gone) in enumerate(LOADS):
        withdrawn = None if gone is None else spark.createDataFrame([(g,) for g in gone], "transaction_id string")
        summary = run_delta(spark, root, make.transactions(rows), ["line"], withdrawn)
        assert summary["dq_report"]["total_rows"] == len(rows) and version(spark, root).number == i + 2
        whole = [r for r in whole if gone is None or r[0] not in gone] + rows
        if folders == 1 and i < 2:
            continue
        full = f"{tmp_path}/full{i}"
        run_pipeline(spark, Exports(stores, products, make.transactions(whole), ["line"]), full, AS_OF)
        assert contents(spark, root) == contents(spark, full)
    tables = stored_tables(spark, root)
    assert tables["mart_customer_summary"].count() == 3 and set(tables) == set(TABLES)
    # A refresh leaves the kept sums behind; the next load sums them up anew.
    run_pipeline(spark, Exports(stores, products, make.transactions(whole), ["line"]), root, AS_OF)
    run_delta(spark, root, make.transactions([]), ["line"])
    assert contents(spark, root) == contents(spark, full)
    assert len(stored_tables(spark, root).folders["fact_sales"]) == min(2, folders)


def test_a_stopped_load_changes_nothing(spark, make, tmp_path, monkeypatch):
    root = str(tmp_path)
    exports = Exports(make.stores(GATE_STORES), make.products(GATE_PRODUCTS), make.transactions(BASE), ["line"])
    run_pipeline(spark, exports, root, AS_OF)
    before = version(spark, root)
    with pytest.raises(QualityGateError):
        run_delta(spark, root, make.transactions([row("T20", "bad")]), ["line"], gate=Gate(enabled=True))
    monkeypatch.setattr(delta.marts, "merge_customers", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_delta(spark, root, make.transactions([row("T20", "2026-01-01")]), ["line"])
    assert version(spark, root) == before


def test_null_gate(spark, make, tmp_path):
    """Off unless enabled; guests do not count; a rate at the limit passes."""
    rows = [row(f"T{i}", "2026-01-01", customer=None) for i in range(9)] + [("T9", "2026-01-01", None, "PRD-00001", "C", None, 0.0)]
    frame = make.transactions(rows)
    NullGate().check(frame)
    NullGate(0.1, enabled=True).check(frame)
    with pytest.raises(QualityGateError, match="quantity.*store_id"):
        NullGate(0.09, enabled=True).check(frame)
    assert {r["column_name"]: r["n_nulls"] for r in NullGate().rates(frame).filter("n_nulls > 0").collect()} == {"store_id": 1, "quantity": 1}
    assert not NullGate(0.0, enabled=True).rates(make.transactions([])).filter("stops").count()
    exports = Exports(make.stores(GATE_STORES), make.products(GATE_PRODUCTS), frame, ["line"])
    with pytest.raises(QualityGateError, match="are null"):
        run_pipeline(spark, exports, str(tmp_path), AS_OF, null_gate=NullGate(enabled=True))
    assert version(spark, str(tmp_path)) is None
