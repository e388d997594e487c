"""Refresh a warehouse: ``spark-submit`` or ``python -m tillhouse`` with three CSV paths."""

from __future__ import annotations

import argparse
import json
from datetime import date

from tillhouse.operators.quality import Gate
from tillhouse.plans.refresh import Exports, run_pipeline
from tillhouse.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="tillhouse", description=__doc__)
    parser.add_argument("--stores", required=True, help="CSV file or folder")
    parser.add_argument("--products", required=True, help="CSV file or folder")
    parser.add_argument("--transactions", required=True, help="CSV file or folder")
    parser.add_argument("--warehouse", required=True, help="folder of the tables")
    parser.add_argument("--as-of", type=date.fromisoformat, help="day for store ages, default today in UTC")
    parser.add_argument("--max-rate", type=float, help="stop above this quarantine rate, e.g. 0.10")
    args = parser.parse_args()

    gate = Gate() if args.max_rate is None else Gate(args.max_rate, enabled=True)
    spark = build_session()
    exports = Exports.from_csv(spark, args.stores, args.products, args.transactions)
    print(json.dumps(run_pipeline(spark, exports, args.warehouse, args.as_of, gate), indent=2))
    spark.stop()


if __name__ == "__main__":
    main()
