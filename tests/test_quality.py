import pytest
from exports import GATE_PRODUCTS, GATE_ROWS, GATE_STORES
from pyspark.sql import functions as F

from tillhouse.operators import contracts, quality
from tillhouse.operators.contracts import ContractError
from tillhouse.operators.quality import RULES, SCHEDULED_GATE, Gate, QualityGateError, Rule

EXPECTED = [
    "",
    "",
    "duplicate_transaction_id",
    "invalid_transaction_date; non_positive_quantity",
    "unknown_store_id; discount_out_of_range",
    "non_positive_quantity; unknown_product_id",
]


def annotated(make, rows, **options):
    return quality.annotate(
        make.transactions(rows), make.stores(GATE_STORES), make.products(GATE_PRODUCTS), ["line"], **options
    )


def reasons(make, rows, **options):
    """Reasons in row order; the row number travels in the customer id."""
    rows = [(*r[:4], str(i), *r[5:]) for i, r in enumerate(rows)]
    found = annotated(make, rows, **options).collect()
    return [r.dq_reasons for r in sorted(found, key=lambda r: int(r.customer_id))]


def one(**change):
    names = ["transaction_id", "transaction_date", "store_id", "product_id", "customer_id", "quantity", "discount_pct"]
    return tuple((dict(zip(names, GATE_ROWS[0])) | change).values())


@pytest.mark.parametrize("min_rows", [10_000_000, 0, 1])
def test_reasons_of_the_literal_rows(make, min_rows):
    assert reasons(make, GATE_ROWS, min_rows=min_rows) == EXPECTED


def test_split_and_types(make):
    frame = annotated(make, GATE_ROWS)
    clean, bad = quality.clean(frame), quality.quarantined(frame)
    assert clean.count() == 2 and bad.count() == 4
    assert dict(clean.dtypes)["transaction_date"] == "date"
    assert "dq_reasons" not in clean.columns
    assert {r.transaction_date for r in bad.collect()} >= {"not-a-date"}
    assert all("customer" not in r.dq_reasons for r in bad.collect())


def test_report(make):
    row = quality.report(annotated(make, GATE_ROWS)).first().asDict()
    assert row == {
        "total_rows": 6,
        "clean_rows": 2,
        "quarantined_rows": 4,
        "quarantine_rate": 0.6667,
        "null_customer_id_count": 2,
        "duplicate_transaction_id": 1,
        "invalid_transaction_date": 1,
        "non_positive_quantity": 2,
        "unknown_store_id": 1,
        "unknown_product_id": 1,
        "discount_out_of_range": 1,
    }


def test_report_of_no_rows(make):
    row = quality.report(annotated(make, [])).first()
    assert row.total_rows == 0 and row.quarantine_rate == 0.0 and row.duplicate_transaction_id == 0


def test_reason_counts(make):
    frame = annotated(make, GATE_ROWS)
    counts = [(r.reason, r.n_rows) for r in quality.reason_counts(frame).collect()]
    assert counts[0] == ("non_positive_quantity", 2)
    assert len(counts) == 6 and sum(n for _, n in counts) == 7


@pytest.mark.parametrize(
    ("text", "ok"),
    [
        ("2026-01-05", True),
        ("2026-1-5", True),
        ("2024-02-29", True),
        ("2026/01/05", False),
        ("2026-01-05T10:00", False),
        ("20260105", False),
        (" 2026-01-05", False),
        ("2026-01", False),
        ("2026-02-30", False),
        ("2026-13-01", False),
        ("12026-01-01", False),
        ("", False),
        (None, False),
        ("not-a-date", False),
    ],
)
def test_date_forms(make, text, ok):
    expected = "" if ok else "invalid_transaction_date"
    assert reasons(make, [one(transaction_date=text)]) == [expected]


def test_unpadded_date_is_stored_padded(make):
    from tillhouse.operators import star

    frame = star.staged(quality.clean(annotated(make, [one(transaction_date="2026-1-5")])))
    assert frame.first().transaction_date == "2026-01-05"


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({"quantity": None}, ""),
        ({"discount_pct": None}, ""),
        ({"discount_pct": 0.0}, ""),
        ({"discount_pct": 100.0}, ""),
        ({"discount_pct": 100.01}, "discount_out_of_range"),
        ({"discount_pct": -0.01}, "discount_out_of_range"),
        ({"store_id": None}, "unknown_store_id"),
        ({"product_id": None}, "unknown_product_id"),
        ({"quantity": 0}, "non_positive_quantity"),
    ],
)
def test_edges(make, change, expected):
    assert reasons(make, [one(**change)]) == [expected]


@pytest.mark.parametrize("min_rows", [10_000_000, 0])
def test_copy_of_a_quarantined_first_row_is_a_repeat(make, min_rows):
    rows = [one(quantity=-1), one(), one(quantity=0)]
    assert reasons(make, rows, min_rows=min_rows) == [
        "non_positive_quantity",
        "duplicate_transaction_id",
        "duplicate_transaction_id; non_positive_quantity",
    ]


@pytest.mark.parametrize("min_rows", [10_000_000, 0])
def test_null_ids_are_copies_of_each_other(make, min_rows):
    rows = [one(transaction_id=None), one(), one(transaction_id=None)]
    assert reasons(make, rows, min_rows=min_rows) == ["", "", "duplicate_transaction_id"]


def test_repeated_dimension_keys_do_not_multiply_rows(make):
    frame = quality.annotate(
        make.transactions(GATE_ROWS), make.stores(GATE_STORES * 2), make.products(GATE_PRODUCTS * 3), ["line"]
    )
    assert frame.count() == len(GATE_ROWS)


def test_single_rules(make):
    raw, stores, products = make.transactions(GATE_ROWS), make.stores(GATE_STORES), make.products(GATE_PRODUCTS)

    def ids(frame):
        return sorted(r.transaction_id for r in frame.collect())

    assert ids(quality.repeats(raw, ["line"])) == ["TXN-2"]
    assert ids(raw.filter(quality.bad_date())) == ["TXN-3"]
    assert ids(raw.filter(quality.bad_quantity())) == ["TXN-3", "TXN-5"]
    assert ids(raw.filter(quality.bad_discount())) == ["TXN-4"]
    assert ids(quality.orphans(raw, stores, "store_id")) == ["TXN-4"]
    assert ids(quality.orphans(raw, products, "product_id")) == ["TXN-5"]


def test_a_further_rule(make):
    rules = [*RULES, Rule("large_quantity", lambda: F.col("quantity") > 2)]
    frame = annotated(make, GATE_ROWS, rules=rules)
    assert quality.report(frame, rules).first().large_quantity == 1
    assert frame.filter("dq_reasons like '%; large_quantity'").count() == 1


def test_gates(make):
    totals = quality.report(annotated(make, GATE_ROWS)).first()
    Gate().check(totals)  # off by default
    with pytest.raises(QualityGateError):
        Gate(0.01, enabled=True).check(totals)
    with pytest.raises(QualityGateError):
        SCHEDULED_GATE.check(totals)
    Gate(totals.quarantine_rate, enabled=True).check(totals)  # only above, not at
    assert not Gate().stops(1.0) and SCHEDULED_GATE.stops(0.11) and not SCHEDULED_GATE.stops(0.10)


def test_partition_check_sees_a_lost_row(make):
    raw = make.transactions(GATE_ROWS)
    frame = annotated(make, GATE_ROWS)
    whole = quality.partition_check(raw, quality.clean(frame), quality.quarantined(frame)).first()
    assert whole.asDict() == {"total_rows": 6, "clean_rows": 2, "quarantined_rows": 4, "holds": True}
    lost = quality.partition_check(raw, quality.clean(frame).limit(1), quality.quarantined(frame))
    assert not lost.first().holds
    with pytest.raises(ContractError, match="1 clean and 4"):
        contracts.require_partition(lost)


def test_broken_contracts_are_counted(make):
    row = dict(zip(("transaction_id", "transaction_date", "store_id", "product_id", "customer_id", "quantity", "discount_pct"), GATE_ROWS[0]))
    rows = make.transactions([tuple(row.values()), tuple((row | {"quantity": None}).values())])
    nulls = {r.column_name: r.n_nulls for r in contracts.null_counts({"stg_transactions": rows}).collect()}
    assert nulls["quantity"] == 1 and sum(nulls.values()) == 1
    assert contracts.repeated_keys({"stg_transactions": rows}).first().n_repeated == 1
    with pytest.raises(ContractError, match="1 nulls in stg_transactions.quantity"):
        contracts.require_not_null({"stg_transactions": rows})


def test_a_line_end_is_no_part_of_a_date(make):
    assert reasons(make, [one(transaction_date="2026-01-05\n")]) == ["invalid_transaction_date"]


def test_document(make):
    row = quality.report_document(quality.report(annotated(make, GATE_ROWS))).first()
    assert row.table == "transactions" and row.violation_counts.non_positive_quantity == 2
