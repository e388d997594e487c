"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of test tables, ``BENCH_CPUS`` the local cores. Each
query is built and run to its last row, without keeping the result. All run once to
warm the JVM up; the second round is the one reported. The stored marts are written in the
first round, so their reads are timed alone. ``refresh_daily_mart`` times the job from CSV
files; writing the files is apart, under ``fixture_csv``.
"""

from __future__ import annotations

import json
import os
import time

from tillhouse.fixtures.views import QUERIES, Views
from tillhouse.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "raw_transactions_csv",
    "dq_annotated",
    "dq_report",
    "dq_reason_counts",
    "orphan_products",
    "dim_date",
    "fact_sales",
    "mart_daily_sales_by_store",
    "mart_monthly_sales_by_category",
    "mart_customer_summary",
    "q_daily_sales",
    "q_top_customers",
    "nb_profit_by_category",
    "stored_customer_lookup",
    "stored_daily_sales_store",
]


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        run(name)
    seconds = {name: run(name) for name in HEADLINE}
    views = Views(spark, FOLDER)
    start = time.perf_counter()
    paths = views.csv_exports()
    fixture = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    views.refreshed(paths).write.format("noop").mode("overwrite").save()
    seconds["refresh_daily_mart"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "fixture_csv": fixture,
                "sf": float(os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
