"""Small exports with known outcomes."""

# Small exports with known outcomes.
GATE_STORES = [("ST-0001", "North", "standard", 2015), ("ST-0002", "South", "express", 2020)]
GATE_PRODUCTS = [("PRD-00001", "Grocery", 10.0, 15.0), ("PRD-00002", "Electronics", 100.0, 150.0)]
GATE_ROWS = [
    ("TXN-1", "2026-01-01", "ST-0001", "PRD-00001", "CUST-1", 2, 10.0),
    ("TXN-2", "2026-01-02", "ST-0001", "PRD-00002", None, 1, 5.0),
    ("TXN-2", "2026-01-02", "ST-0001", "PRD-00002", None, 1, 5.0),
    ("TXN-3", "not-a-date", "ST-0002", "PRD-00001", "CUST-3", -1, 0.0),
    ("TXN-4", "2026-01-04", "ST-9999", "PRD-00001", "CUST-4", 3, 200.0),
    ("TXN-5", "2026-01-05", "ST-0002", "PRD-99999", "CUST-5", 0, 5.0),
]
SALES_ROWS = [
    ("TXN-1", "2026-01-01", "ST-0001", "PRD-00001", "CUST-1", 2, 10.0),
    ("TXN-2", "2026-01-02", "ST-0002", "PRD-00002", None, 1, 0.0),
    ("TXN-3", "2026-01-02", "ST-0001", "PRD-00001", "CUST-2", 3, 5.0),
]
