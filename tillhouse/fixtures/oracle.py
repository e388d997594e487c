"""Independent SQL for every query, run by DuckDB on the same tables.

Money is computed in DECIMAL and whole cents, apart from the Spark code's integers.
"""

from __future__ import annotations

# The rule names.
_RULES = (
    "duplicate_transaction_id",
    "invalid_transaction_date",
    "non_positive_quantity",
    "unknown_store_id",
    "unknown_product_id",
    "discount_out_of_range",
)


def _padded(key: str, width: int) -> str:
    text = f"cast({key} as varchar)"
    return f"lpad({text}, cast(greatest({width}, length({text})) as integer), '0')"


def _rounded(numerator: str, denominator: str) -> str:
    """Integer quotient of hugeints, half away from zero, denominator positive."""
    size = f"((2 * abs({numerator}) + ({denominator})) // (2 * ({denominator})))"
    return f"(case when ({numerator}) < 0 then -{size} else {size} end)"


def _amount(cents: str) -> str:
    return f"cast({cents} as double) / 100.0"


_MARGIN = _rounded("(price - cost) * 10000", "price")

_CTES = f"""
WITH raw_stores AS (
  SELECT 'ST-' || {_padded('s_suppkey', 4)} AS store_id, r_name AS region,
         CASE s_suppkey % 3 WHEN 0 THEN 'flagship' WHEN 1 THEN 'standard' ELSE 'express' END AS store_format,
         cast(2005 + s_suppkey % 20 AS bigint) AS opened_year
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
raw_products AS (
  SELECT 'PRD-' || {_padded('p_partkey', 5)} AS product_id, p_type AS category,
         cast(round(price * cast(42 + p_partkey % 40 AS decimal(3,0)) * cast(0.01 AS decimal(3,2)), 4) AS decimal(12,4))
           AS unit_cost,
         price AS unit_price
  FROM (SELECT *, cast(cast(p_retailprice AS decimal(12,2)) + CASE WHEN p_partkey % 10 = 7 THEN 0.1234 ELSE 0.0000 END
                       AS decimal(12,4)) AS price FROM part)
),
raw_transactions AS (
  SELECT 'TXN-' || {_padded('l_orderkey', 8)} || '-' || cast(l_linenumber AS varchar) AS transaction_id,
         CASE WHEN l_orderkey % 97 = 0 THEN 'not-a-date' ELSE strftime(l_shipdate, '%Y-%m-%d') END
           AS transaction_date,
         CASE WHEN l_orderkey % 89 = 1 THEN 'ST-9999' ELSE 'ST-' || {_padded('l_suppkey', 4)} END AS store_id,
         CASE WHEN l_orderkey % 83 = 2 THEN 'PRD-99999' ELSE 'PRD-' || {_padded('l_partkey', 5)} END AS product_id,
         CASE WHEN l_orderkey % 50 = 3 THEN NULL ELSE 'CUST-' || {_padded('o_custkey', 6)} END AS customer_id,
         CASE WHEN l_orderkey % 79 = 4 THEN -(cast(l_quantity AS bigint) % 4) ELSE cast(l_quantity AS bigint) END
           AS quantity,
         CASE WHEN l_orderkey % 73 = 5 THEN 200.0 ELSE cast(cast(l_discount * 100 AS decimal(5,1)) AS double) END
           AS discount_pct,
         l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
flagged AS (
  SELECT r.*,
         row_number() OVER (PARTITION BY transaction_id ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) > 1 AS f1,
         try_strptime(transaction_date, '%Y-%m-%d') IS NULL AS f2,
         coalesce(quantity <= 0, false) AS f3,
         coalesce(store_id NOT IN (SELECT store_id FROM raw_stores), true) AS f4,
         coalesce(product_id NOT IN (SELECT product_id FROM raw_products), true) AS f5,
         coalesce(discount_pct < 0 OR discount_pct > 100, false) AS f6
  FROM raw_transactions r
),
annotated AS (
  SELECT transaction_id, transaction_date, store_id, product_id, customer_id, quantity, discount_pct,
         concat_ws('; ', {', '.join(f"CASE WHEN f{i} THEN '{name}' END" for i, name in enumerate(_RULES, 1))})
           AS dq_reasons,
         f1, f2, f3, f4, f5, f6
  FROM flagged
),
clean AS (SELECT * EXCLUDE (dq_reasons, f1, f2, f3, f4, f5, f6) FROM annotated WHERE dq_reasons = ''),
bad AS (SELECT * EXCLUDE (f1, f2, f3, f4, f5, f6) FROM annotated WHERE dq_reasons <> ''),
report AS (
  SELECT count(*) AS total, count(*) FILTER (dq_reasons = '') AS clean_n, count(*) FILTER (dq_reasons <> '') AS bad_n,
         count(*) FILTER (customer_id IS NULL) AS guests,
         {', '.join(f"count(*) FILTER (f{i}) AS n{i}" for i in range(1, 7))}
  FROM annotated
),
stores_dim AS (SELECT *, cast(2026 - opened_year AS bigint) AS store_age_years FROM raw_stores),
products_dim AS (
  SELECT product_id, category, unit_cost, unit_price, {_MARGIN} AS margin_hundredths
  FROM (SELECT *, cast(unit_price * 10000 AS hugeint) AS price, cast(unit_cost * 10000 AS hugeint) AS cost
        FROM raw_products)
),
dates_dim AS (
  SELECT DISTINCT transaction_date AS date_key, cast(year(cast(transaction_date AS date)) AS integer) AS year,
         cast(month(cast(transaction_date AS date)) AS integer) AS month,
         dayname(cast(transaction_date AS date)) AS day_of_week,
         cast(isodow(cast(transaction_date AS date)) >= 6 AS integer) AS is_weekend
  FROM clean
),
lines AS (
  SELECT c.*, category, margin_hundredths,
         cast(quantity AS decimal(12,0)) * unit_price AS gross_exact,
         cast(quantity AS decimal(9,0)) * unit_price * (1 - cast(discount_pct AS decimal(5,2)) * cast(0.01 AS decimal(3,2)))
           AS net_exact,
         cast(quantity AS decimal(12,0)) * unit_cost AS cost_exact
  FROM clean c JOIN products_dim USING (product_id)
),
fact AS (
  SELECT transaction_id, transaction_date AS date_key, store_id, product_id, customer_id, quantity, discount_pct,
         category, margin_hundredths, round(gross_exact, 2) AS gross, round(net_exact, 2) AS net,
         round(cost_exact, 2) AS cost, round(net_exact - cost_exact, 2) AS profit
  FROM lines
),
daily AS (
  SELECT date_key, store_id, region, count(*) AS n_transactions, cast(sum(quantity) AS bigint) AS total_quantity,
         cast(sum(gross) AS double) AS gross_revenue, cast(sum(net) AS double) AS net_revenue,
         cast(sum(profit) AS double) AS gross_profit
  FROM fact JOIN stores_dim USING (store_id) GROUP BY date_key, store_id, region
),
monthly AS (
  SELECT substr(date_key, 1, 7) AS year_month, category, count(*) AS n_transactions,
         cast(sum(quantity) AS bigint) AS total_quantity, cast(sum(gross) AS double) AS gross_revenue,
         cast(sum(net) AS double) AS net_revenue, cast(sum(profit) AS double) AS gross_profit,
         {_amount(_rounded('cast(sum(margin_hundredths) AS hugeint)', 'count(*)'))} AS avg_margin_pct
  FROM fact GROUP BY substr(date_key, 1, 7), category
),
customers AS (
  SELECT customer_id, min(date_key) AS first_purchase, max(date_key) AS last_purchase, count(*) AS n_transactions,
         cast(sum(net) AS double) AS lifetime_revenue,
         {_amount(_rounded('cast(sum(net) * 100 AS hugeint)', 'count(*)'))} AS avg_order_value
  FROM fact WHERE customer_id IS NOT NULL GROUP BY customer_id
),
store_table AS (SELECT * FROM raw_stores),
product_table AS (
  SELECT product_id, category, cast(unit_cost AS double) AS unit_cost, cast(unit_price AS double) AS unit_price
  FROM raw_products
),
product_dim_table AS (
  SELECT product_id, category, cast(unit_cost AS double) AS unit_cost, cast(unit_price AS double) AS unit_price,
         {_amount('margin_hundredths')} AS margin_pct
  FROM products_dim
),
fact_table AS (
  SELECT transaction_id, date_key, store_id, product_id, customer_id, quantity, discount_pct,
         cast(gross AS double) AS gross_revenue, cast(net AS double) AS net_revenue,
         cast(cost AS double) AS cost_of_goods, cast(profit AS double) AS gross_profit
  FROM fact
)
"""

_RAW = "transaction_id, transaction_date, store_id, product_id, customer_id, quantity, discount_pct"
_TXN_TABLES = {
    "stg_stores": "store_table",
    "stg_products": "product_table",
    "stg_transactions": "clean",
    "stg_quarantined_transactions": "bad",
    "dim_store": "stores_dim",
    "dim_product": "product_dim_table",
    "dim_date": "dates_dim",
    "fact_sales": "fact_table",
    "mart_daily_sales_by_store": "daily",
    "mart_monthly_sales_by_category": "monthly",
    "mart_customer_summary": "customers",
}


def _broken(rule: int) -> str:
    return f"SELECT {_RAW} FROM annotated WHERE f{rule}"


_REPORT = f"""
SELECT total AS total_rows, clean_n AS clean_rows, bad_n AS quarantined_rows,
       CASE WHEN total = 0 THEN 0.0 ELSE cast({_rounded('cast(bad_n AS hugeint) * 10000', 'total')} AS double) / 10000.0
         END AS quarantine_rate,
       guests AS null_customer_id_count, {', '.join(f"n{i} AS {name}" for i, name in enumerate(_RULES, 1))}
FROM report
"""


# Columns that may not be null, and primary keys, as the warehouse declares them.
_REQUIRED = {
    "stg_stores":
        "region store_format opened_year",
    "stg_products":
        "category unit_cost unit_price",
    "stg_transactions":
        "transaction_date store_id product_id quantity discount_pct",
    "stg_quarantined_transactions":
        "dq_reasons",
    "dim_store":
        "region store_format opened_year store_age_years",
    "dim_product":
        "category unit_cost unit_price margin_pct",
    "dim_date":
        "year month day_of_week is_weekend",
    "fact_sales":
        "date_key store_id product_id quantity discount_pct gross_revenue net_revenue "
        "cost_of_goods gross_profit",
    "mart_daily_sales_by_store":
        "date_key store_id region n_transactions total_quantity gross_revenue net_revenue "
        "gross_profit",
    "mart_monthly_sales_by_category":
        "year_month category n_transactions total_quantity gross_revenue net_revenue gross_profit "
        "avg_margin_pct",
    "mart_customer_summary":
        "first_purchase last_purchase n_transactions lifetime_revenue avg_order_value",
}
_KEYS = {
    "stg_stores": "store_id",
    "stg_products": "product_id",
    "stg_transactions": "transaction_id",
    "dim_store": "store_id",
    "dim_product": "product_id",
    "dim_date": "date_key",
    "fact_sales": "transaction_id",
    "mart_daily_sales_by_store": "date_key store_id",
    "mart_monthly_sales_by_category": "year_month category",
    "mart_customer_summary": "customer_id",
}


def _null_counts() -> str:
    parts = [
        f"SELECT '{name}' AS table_name, '{column}' AS column_name, count(*) FILTER ({column} IS NULL) AS n_nulls "
        f"FROM {_TXN_TABLES[name]}"
        for name, columns in _REQUIRED.items()
        for column in columns.split()
    ]
    return " UNION ALL ".join(parts)


def _null_counts_raw() -> str:
    """Quantities that are not positive count as null there."""
    counted = {"quantity": "coalesce(quantity <= 0, true)"}
    return " UNION ALL ".join(
        f"SELECT 'stg_transactions' AS table_name, '{column}' AS column_name, "
        f"count(*) FILTER ({counted.get(column, column + ' IS NULL')}) AS n_nulls FROM raw_transactions"
        for column in _REQUIRED["stg_transactions"].split()
    )


def _repeated(name: str, table: str) -> str:
    keys = _KEYS[name].split()
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (
        f"SELECT '{name}' AS table_name, count(*) AS n_repeated FROM (SELECT 1 FROM {table} WHERE {known} "
        f"GROUP BY {', '.join(keys)} HAVING count(*) > 1)"
    )


def _repeated_keys() -> str:
    return " UNION ALL ".join(_repeated(name, _TXN_TABLES[name]) for name in _KEYS)


def _totals() -> str:
    counts = " UNION ALL ".join(
        f"SELECT 'rows_{name}' AS metric, cast(count(*) AS double) AS value FROM {cte}" for name, cte in _TXN_TABLES.items()
    )
    return f"""
SELECT 'net_revenue' AS metric, cast(sum(net) AS double) AS value FROM fact
UNION ALL SELECT 'gross_profit', cast(sum(profit) AS double) FROM fact
UNION ALL {counts}"""


def _null_rates() -> str:
    """Nulls per raw column; a rate in ten thousandths is rounded half up."""
    columns = [c.strip() for c in _RAW.split(",")]
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_nulls,
((20000 * count(*) FILTER ({c} IS NULL) + count(*)) // (2 * count(*))) / 10000.0 AS null_rate,
((20000 * count(*) FILTER ({c} IS NULL) + count(*)) // (2 * count(*))) / 10000.0 > 0.01 AS stops FROM raw_transactions"""
        for c in columns
    )


def _gate(rate: str, enabled: str) -> str:
    return f"SELECT {rate} AS max_rate, quarantine_rate, {enabled} AND quarantine_rate > {rate} AS stops FROM ({_REPORT})"


def _first_copy(day: int) -> str:
    return f"""SELECT DISTINCT transaction_id, 'DAY-1' AS customer_id FROM raw_transactions
UNION ALL SELECT DISTINCT 'X-' || transaction_id, 'DAY-{day}' FROM raw_transactions
UNION ALL SELECT DISTINCT 'Y-' || transaction_id, 'DAY-{day}' FROM raw_transactions"""


def _rows(name: str, limit: int, table: str, most: int) -> str:
    n = f"(SELECT least({limit}, count(*)) FROM {table})" if 1 <= limit <= most else "NULL"
    return f"SELECT '{name}' AS query, cast({limit} AS bigint) AS wanted, cast({n} AS bigint) AS n_rows"


def statements(store_id: str, customer_id: str) -> dict[str, str]:
    """SQL per query name; the two ids are those the lookup queries ask for."""
    selects = {name: f"SELECT * FROM {cte}" for name, cte in _TXN_TABLES.items()}
    selects |= {
        "raw_stores_csv": "SELECT * FROM store_table",
        "raw_products_csv": "SELECT * FROM product_table",
        "raw_transactions_csv": f"SELECT {_RAW} FROM raw_transactions",
        "dq_duplicates": _broken(1),
        "dq_invalid_date": _broken(2),
        "dq_non_positive_quantity": _broken(3),
        "dq_unknown_store": _broken(4),
        "dq_unknown_product": _broken(5),
        "dq_discount_range": _broken(6),
        "orphan_stores": f"SELECT {_RAW} FROM raw_transactions t WHERE NOT EXISTS "
        "(SELECT 1 FROM raw_stores s WHERE s.store_id = t.store_id)",
        "orphan_products": f"SELECT {_RAW} FROM raw_transactions t WHERE NOT EXISTS "
        "(SELECT 1 FROM raw_products p WHERE p.product_id = t.product_id)",
        "dq_annotated": f"SELECT {_RAW}, dq_reasons FROM annotated",
        "dq_clean": "SELECT * REPLACE (cast(transaction_date AS date) AS transaction_date) FROM clean",
        "dq_quarantined": "SELECT * FROM bad",
        "dq_report": _REPORT,
        "dq_reason_counts": " UNION ALL ".join(
            f"SELECT '{name}' AS reason, n{i} AS n_rows FROM report WHERE n{i} > 0" for i, name in enumerate(_RULES, 1)
        ),
        "dq_partition_check": "SELECT total AS total_rows, clean_n AS clean_rows, bad_n AS quarantined_rows, "
        "clean_n + bad_n = total AS holds FROM report",
        "gate_default": _gate("cast(0.01 AS double)", "false"),
        "gate_scheduled": _gate("cast(0.10 AS double)", "true"),
        "contract_not_null": _null_counts(),
        "contract_unique_keys": _repeated_keys(),
        "warehouse_totals": _totals(),
        "q_daily_sales": "SELECT * FROM daily ORDER BY date_key DESC, store_id LIMIT 30",
        "q_daily_sales_store": f"SELECT * FROM daily WHERE store_id = '{store_id}' ORDER BY date_key DESC LIMIT 30",
        "q_monthly_by_category": "SELECT * FROM monthly ORDER BY year_month DESC, category LIMIT 100",
        "q_customer_lookup": f"SELECT * FROM customers WHERE customer_id = '{customer_id}'",
        "q_top_customers": "SELECT * FROM customers ORDER BY lifetime_revenue DESC, customer_id LIMIT 10",
        "q_sql_region_sales": "SELECT region, cast(sum(n_transactions) AS bigint) AS n_transactions FROM daily "
        "WHERE date_key >= '1998-01-01' GROUP BY region",
        "nb_daily_net_revenue": "SELECT date_key, cast(sum(net) AS double) AS net_revenue FROM fact GROUP BY date_key",
        "nb_profit_by_category": "SELECT category, cast(sum(profit) AS double) AS gross_profit FROM fact GROUP BY category",
        "refresh_daily_mart": "SELECT * FROM daily",
        "raw_transactions_csv_floats": "SELECT * REPLACE (CASE WHEN quantity > 0 THEN quantity END AS quantity) "
        f"FROM (SELECT {_RAW} FROM raw_transactions)",
        "dq_first_copy_more_in_first": _first_copy(1),
        "dq_first_copy_more_in_second": _first_copy(2),
        "contract_not_null_raw": _null_counts_raw(),
        "contract_unique_keys_raw": _repeated("stg_transactions", "raw_transactions"),
        "refresh_twice": _totals(),
        "delta_totals": _totals(),
        "delta_daily_mart": "SELECT * FROM daily",
        "delta_monthly_mart": "SELECT * FROM monthly",
        "delta_customer_mart": "SELECT * FROM customers",
        "gate_null_rate": _null_rates(),
        "report_json": f"SELECT 'transactions' AS \"table\", * FROM ({_REPORT})",
        "sql_model_files": "SELECT region, cast(sum(n_transactions) AS bigint) AS n_transactions FROM daily GROUP BY region",
        "limit_bounds": " UNION ALL ".join(
            _rows(name, limit, table, most)
            for name, table, most in (("daily", "daily", 1000), ("monthly", "monthly", 1000), ("top", "customers", 100))
            for limit in (0, 1, most, most + 1)
        ),
        "smoke_check": "SELECT 'fact_sales' AS table_name, count(*) > 0 AS passes FROM fact "
        "UNION ALL SELECT 'fact_sales after 2999', count(*) > 0 FROM fact WHERE date_key > '2999'",
    }
    selects |= {name.replace("q_", "stored_", 1): selects[name] for name in (
        "q_daily_sales", "q_daily_sales_store", "q_monthly_by_category", "q_customer_lookup", "q_top_customers")}
    # The same tables as if ids that end in 7 had never come; line numbers end the ids.
    lines = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    without = _CTES.replace(lines, f"{lines} WHERE l_linenumber % 10 <> 7")
    withdrawn = {
        "withdrawn_totals": _totals(),
        "withdrawn_monthly_mart": "SELECT * FROM monthly",
        "withdrawn_customer_mart": "SELECT * FROM customers",
    }
    return {name: _CTES + select for name, select in selects.items()} | {n: without + t for n, t in withdrawn.items()}
