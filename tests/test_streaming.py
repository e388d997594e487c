"""Files that arrive one after the other give the tables of one refresh over all of them."""

from datetime import date
from pathlib import Path

import pytest
from exports import GATE_PRODUCTS, GATE_STORES

from tillhouse.plans import delta
from tillhouse.plans.refresh import Exports, run_pipeline
from tillhouse.schemas import TRANSACTIONS
from tillhouse.sources.versions import stored_tables, version
from tillhouse.streaming import loads

AS_OF = date(2026, 1, 1)
FILES = [
    ["T1,2026-01-01,ST-0001,PRD-00001,C1,2,10.0", "T2,2026-01-02,ST-0002,PRD-00002,,1,0.0", "T3,bad,ST-0001,PRD-00001,C1,1,0"],
    ["T1,2026-01-05,ST-0001,PRD-00001,C2,2.0,10.0", "T4,2026-02-02,ST-0001,PRD-00002,C2,3,5.0", "T4,2026-02-03,ST-0001,PRD-00002,C2,3,5.0"],
    ["T3,2026-01-03,ST-0001,PRD-00001,C3,1,0", "T5,2025-12-01,ST-0002,PRD-00001,C1,1,0"],
]


def put(folder, name, lines):
    """A file that appears as a whole."""
    part = Path(folder).parent / f"part-{name}"
    part.write_text("\n".join([",".join(TRANSACTIONS.names), *lines]) + "\n")
    part.rename(Path(folder) / name)


def contents(spark, root):
    return {n: sorted(map(tuple, f.collect()), key=str) for n, f in stored_tables(spark, root).items()}


@pytest.fixture
def warehouse(spark, make, tmp_path):
    """A warehouse with the dimensions and one sale."""
    first = make.transactions([("T0", "2026-01-01", "ST-0001", "PRD-00001", "C0", 1, 0.0)])
    exports = Exports(make.stores(GATE_STORES), make.products(GATE_PRODUCTS), first, ["line"])
    run_pipeline(spark, exports, str(tmp_path / "w"), AS_OF)
    (tmp_path / "in").mkdir()
    return str(tmp_path / "w")


def test_micro_batches_give_the_batch_result(spark, make, tmp_path, warehouse):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for i, lines in enumerate(FILES):
        put(folder, f"{i}.csv", lines)
        if i != 1:  # two files come before the second look: a batch each
            loads.follow(spark, warehouse, folder, checkpoint, files_per_batch=1).awaitTermination()
    assert version(spark, warehouse).number == 1 + len(FILES) and loads.last_batch(spark, warehouse, "transactions") == 2
    loads.follow(spark, warehouse, folder, checkpoint).awaitTermination()  # nothing new
    assert version(spark, warehouse).number == 1 + len(FILES)

    rows = [("T0", "2026-01-01", "ST-0001", "PRD-00001", "C0", 1, 0.0)]
    for line in (x for lines in FILES for x in lines):
        i, day, store, product, customer, quantity, discount = line.split(",")
        rows.append((i, day, store, product, customer or None, int(float(quantity)), float(discount)))
    exports = Exports(make.stores(GATE_STORES), make.products(GATE_PRODUCTS), make.transactions(rows), ["line"])
    run_pipeline(spark, exports, str(tmp_path / "full"), AS_OF)
    assert contents(spark, warehouse) == contents(spark, str(tmp_path / "full"))


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path, warehouse, monkeypatch):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    put(folder, "0.csv", FILES[0])
    load, state = loads.load_batch, {}

    def dying(*args):
        load(*args)
        if not state:
            state["died"] = True
            raise RuntimeError("after the publish, before the stream knows")

    monkeypatch.setattr(loads, "load_batch", dying)
    with pytest.raises(Exception, match="before the stream knows"):
        loads.follow(spark, warehouse, folder, checkpoint).awaitTermination()
    before = contents(spark, warehouse)
    loads.follow(spark, warehouse, folder, checkpoint).awaitTermination()
    assert contents(spark, warehouse) == before and version(spark, warehouse).number == 2

    put(folder, "1.csv", FILES[1])
    with monkeypatch.context() as patched:
        patched.setattr(delta.marts, "merge_daily", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            loads.follow(spark, warehouse, folder, checkpoint).awaitTermination()
    assert contents(spark, warehouse) == before  # nothing of the second batch
    loads.follow(spark, warehouse, folder, checkpoint).awaitTermination()
    assert version(spark, warehouse).number == 3 and loads.last_batch(spark, warehouse, "transactions") == 1
