"""A load of new transactions, and of withdrawn ones, into a warehouse that is there already.

The result is that of a full refresh over all raw rows so far, but only the new rows are
read, checked and priced, tables grow by folders, and the marts are merged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillhouse.operators import contracts, marts, quality, star
from tillhouse.operators.quality import RULES, Gate, Rule
from tillhouse.operators.skew import HEAVY_ROWS, filtered, fits_broadcast
from tillhouse.schemas import TABLES
from tillhouse.plans.refresh import report_dict
from tillhouse.session import COUNTED, EXACT, job_width, settings, stored_bytes
from tillhouse.sources.tables import CODEC, Ranged, materialize, scratch_folder, scratch_scope
from tillhouse.sources.versions import Run, StoredTables, new_version, prune

# A table beside the declared ones, kept for the merge of the monthly mart.
MARGINS = "state_monthly_margins"
_ID = "transaction_id"


def _has(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose id is (``left_semi``) or is not (``left_anti``) among ``ids``; a null id is one id.

    Ids too many for a broadcast are met by a shuffle on the id, but only by rows that
    :func:`filtered` cannot rule out; the others never leave their task.
    """
    ids = ids.select(F.col(_ID).alias("_id"))
    if fits_broadcast(ids):
        return rows.join(F.broadcast(ids), rows[_ID].eqNullSafe(ids["_id"]), how)
    out, maybe = filtered(rows, ids, _ID)
    met = maybe.join(ids, maybe[_ID].eqNullSafe(ids["_id"]), how)
    return met if how == "left_semi" else out.unionByName(met)


def _ids_of(tables: StoredTables, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that the warehouse has, clean or quarantined; only the id column is read."""
    held = [_has(tables[n].select(_ID), ids, "left_semi") for n in ("stg_transactions", "stg_quarantined_transactions")]
    return reduce(DataFrame.unionByName, held).distinct()


def run_delta(
    spark: SparkSession,
    root: str,
    transactions: DataFrame,
    order: Sequence[str],
    withdrawn: DataFrame | None = None,
    gate: Gate = Gate(),
    rules: Sequence[Rule] = RULES,
    min_rows: int = HEAVY_ROWS,
    keep_versions: int = 2,
    beside: Mapping[str, DataFrame] | None = None,
) -> dict[str, object]:
    """Load raw ``transactions`` that follow all earlier ones, and publish the next version.

    ``withdrawn`` (``transaction_id``) leave first, with all their rows, as if they had never
    come. Stores and products are those of the warehouse. An id that an earlier load had,
    clean or not, is a repeat, as in a full refresh. The gate is asked about the new rows
    alone. Readers see the version before until the new one is complete. ``beside``: further
    tables that are to be published with it.
    """
    with scratch_scope(spark), settings(spark, EXACT | COUNTED):
        summary = _delta(spark, root, transactions, order, withdrawn, gate, rules, min_rows, beside or {})
    prune(spark, root, keep_versions)
    return summary


def _delta(spark, root, transactions, order, withdrawn, gate, rules, min_rows, beside) -> dict[str, object]:
    with new_version(spark, root) as run:
        tables = run.tables
        with settings(spark, job_width(spark, 0)):
            raw = _scratch(transactions)
            gone = None if withdrawn is None else _scratch(withdrawn.select(_ID).distinct())
        with settings(spark, job_width(spark, stored_bytes(spark, tables.paths("stg_transactions")))):
            seen = _ids_of(tables, raw.select(_ID))
            if gone is not None:
                seen = _has(seen, gone, "left_anti")
            seen = _scratch(seen)
            rows = quality.annotate(
                raw, tables["stg_stores"], tables["stg_products"], order, rules, min_rows, seen=seen
            )
            rows = _scratch(rows)
            report = quality.report(rows, rules).first()
            gate.check(report)

            staged = _load(run, star.staged(quality.clean(rows)), "stg_transactions", gone)
            _load(run, quality.quarantined(rows), "stg_quarantined_transactions", gone)
            fact = _load(run, star.fact_sales(staged, tables["dim_product"], min_rows), "fact_sales", gone)
            taken = fact.limit(0)
            if gone is not None:
                taken = _scratch(_has(tables["fact_sales"], gone, "left_semi").select(fact.columns))

            change = marts.signed(fact, taken)
            margins = _margins(tables)
            layout = TABLES["mart_daily_sales_by_store"].layout if fits_broadcast(tables["dim_store"]) else ()
            daily = marts.merge_daily(tables["mart_daily_sales_by_store"], change, tables["dim_store"], layout)
            run.write(Ranged(daily) if layout else daily, "mart_daily_sales_by_store")
            monthly, margins = marts.merge_monthly(
                tables["mart_monthly_sales_by_category"], margins, change, tables["dim_product"]
            )
            run.write(monthly, "mart_monthly_sales_by_category")
            run.write(margins, MARGINS)
            run.write(marts.merge_customers(tables["mart_customer_summary"], change, run.tables["fact_sales"]), "mart_customer_summary")
            # Every clean row is a sale of some store on its day.
            days = run.tables["mart_daily_sales_by_store"].select(F.col("date_key").alias("transaction_date"))
            run.write(star.dim_date(days), "dim_date")
            for name, rows_beside in beside.items():
                run.write(rows_beside, name)
        contracts.require_rows({n: run.tables[n] for n in ("fact_sales", "mart_daily_sales_by_store")})
    return {"dq_report": report_dict(report, rules), "warehouse_path": root}


def _scratch(rows: DataFrame) -> DataFrame:
    return materialize(rows, scratch_folder(rows.sparkSession), codec=CODEC)


def _load(run: Run, new: DataFrame, name: str, gone: DataFrame | None) -> DataFrame:
    """Add new rows to a table, without those of the ids that are ``gone``; returns the new rows, read back.

    They are written once, as a folder of the table, unless the table is due to be written anew.
    """
    if gone is not None:
        run.write(_has(run.tables[name], gone, "left_anti"), name)
    if run.full(name):
        new = _scratch(new)
        run.append(new, name)
        return new
    run.append(new, name)
    return run.last(name)


def _margins(tables: StoredTables) -> DataFrame:
    """The kept sums; a full refresh has none, then they are summed from its fact once."""
    if MARGINS in tables.folders and not _older(tables):
        return tables[MARGINS]
    return marts.monthly_margins(tables["fact_sales"], tables["dim_product"])


def _older(tables: StoredTables) -> bool:
    """Whether the kept sums are of another version than the mart they belong to."""
    return _run_of(tables, MARGINS) != _run_of(tables, "mart_monthly_sales_by_category")


def _run_of(tables: StoredTables, name: str) -> str:
    return tables.folders[name][-1].split("/")[1]
