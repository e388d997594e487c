"""The refresh job: exports in, a full new warehouse out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tillhouse.operators import contracts, marts, quality, star
from tillhouse.operators.quality import RULES, Gate, NullGate, Rule
from tillhouse.operators.skew import HEAVY_ROWS, fits_broadcast, row_count
from tillhouse.schemas import TABLES
from tillhouse.session import COUNTED, EXACT, TWO_WRITERS, job_width, settings, stored_bytes
from tillhouse.sources import csv_files
from tillhouse.sources.tables import CODEC, Ranged, materialize, release, scratch_folder, scratch_scope, table_path
from tillhouse.sources.versions import Run, new_version, prune, stored_tables  # noqa: F401  read by callers


@dataclass(frozen=True)
class Exports:
    """The three raw inputs and the columns that give the transactions' file order."""

    stores: DataFrame
    products: DataFrame
    transactions: DataFrame
    order: Sequence[str]

    @classmethod
    def from_csv(cls, spark: SparkSession, stores: str, products: str, transactions: str) -> Exports:
        return cls(
            csv_files.read_stores(spark, stores),
            csv_files.read_products(spark, products),
            csv_files.read_transactions(spark, transactions),
            csv_files.FILE_ORDER,
        )


Model = Callable[[Mapping[str, DataFrame]], DataFrame | Ranged]

# Tables built from earlier ones, in build order. A further mart is one more entry here
# or one more file for ``run_sql_models``.
MODELS: dict[str, Model] = {
    "mart_customer_summary": lambda t: marts.customer_summary(t["fact_sales"]),
    "mart_daily_sales_by_store": lambda t: _daily(t["fact_sales"], t["dim_store"], t["dim_date"]),
    "mart_monthly_sales_by_category": lambda t: marts.monthly_sales_by_category(t["fact_sales"], t["dim_product"]),
}


def _daily(fact: DataFrame, stores: DataFrame, dates: DataFrame) -> DataFrame | Ranged:
    """The daily mart; where most of its rows are one sale, the sales are cut into its ranges and summed there."""
    sparse = row_count(fact) <= row_count(stores) * row_count(dates)
    if not sparse or not fits_broadcast(stores):
        return marts.daily_sales_by_store(fact, stores)
    layout = TABLES["mart_daily_sales_by_store"].layout
    return Ranged(marts.daily_sales_by_store(fact.repartitionByRange(*layout), stores))


def star_models(as_of: date | None, min_rows: int = HEAVY_ROWS) -> dict[str, Model]:
    """The dimensions and the fact, from the staging tables."""
    return {
        "dim_store": lambda t: star.dim_store(t["stg_stores"], as_of),
        "dim_product": lambda t: star.dim_product(t["stg_products"]),
        "dim_date": lambda t: star.dim_date(t["stg_transactions"]),
        "fact_sales": lambda t: star.fact_sales(t["stg_transactions"], t["dim_product"], min_rows=min_rows),
    }


def write_report(report_row: DataFrame, path: str, rules: Iterable[Rule] = RULES) -> None:
    """Publish the one-row quality report as JSON."""
    quality.report_document(report_row, rules).coalesce(1).write.mode("overwrite").json(path)


def run_models(run: Run, models: Mapping[str, Model]) -> dict[str, int]:
    """Build the tables of a version in order; every model reads those written before it."""
    return {name: run.write(model(run.tables), name) for name, model in models.items()}


def run_sql_models(spark: SparkSession, root: str, folder: str) -> list[str]:
    """Run the ``.sql`` files of a folder, each one SELECT over the warehouse tables and each other.

    The result is the table named like the file. A file runs after those whose tables it
    names, files that need each other are an error, and all results are published together.
    Returns the names in the order in which they ran.
    """
    texts = {file.stem: file.read_text(encoding="utf-8") for file in sorted(Path(folder).glob("*.sql"))}
    order = model_order(spark, texts)
    with new_version(spark, root) as run:
        for name in order:
            held = {n.lower(): n for n in run.tables.folders}
            read = {held[n]: run.tables[held[n]] for n in table_references(spark, texts[name]) if n in held}
            run.write(query(spark, read, texts[name]), name)
    return order


def table_references(spark: SparkSession, text: str) -> set[str]:
    """The tables that a statement reads, as its parsed plan names them.

    Names of its own WITH clauses are not among them.
    """
    found: set[str] = set()
    own: set[str] = set()

    def every(list_) -> list:
        return [list_.apply(i) for i in range(list_.size())]

    def visit(plan) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            found.add(plan.tableName().replace("`", "").lower())
        if kind == "UnresolvedWith":
            for relation in every(plan.cteRelations()):
                own.add(relation._1().lower())
                visit(relation._2())
        for expression in every(plan.expressions()):
            look_into(expression)
        for child in every(plan.children()):
            visit(child)

    def look_into(expression) -> None:
        if expression.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            visit(expression.plan())
        for child in every(expression.children()):
            look_into(child)

    visit(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    return found - own


def model_order(spark: SparkSession, texts: Mapping[str, str]) -> list[str]:
    """Names of SQL models such that each comes after those it reads; ties in order of name."""
    names = {name.lower(): name for name in texts}
    needs = {
        name: {names[t] for t in table_references(spark, text) if t in names and names[t] != name} for name, text in texts.items()
    }
    try:
        sorter = TopologicalSorter(needs)
        sorter.prepare()
    except CycleError as error:
        raise ModelCycleError(f"SQL models that read each other: {' -> '.join(error.args[1])}") from error
    order = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        order += ready
        sorter.done(*ready)
    return order


class ModelCycleError(ValueError):
    """SQL models that need each other."""


def query(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    text: str,
    args: Mapping[str, object] | Sequence[object] | None = None,
) -> DataFrame:
    """Run SQL with bound parameters over the tables, each named by its plain name.

    The names hold for this statement only; a view the session has under one of them is
    there again afterwards.
    """
    named = [name for name in tables if re.search(rf"\b{re.escape(name)}\b", text, re.IGNORECASE)]
    views = [v.name for v in spark.catalog.listTables() if v.isTemporary and v.name in named]
    own = {name: spark.table(name) for name in views}
    bound = dict(args) if isinstance(args, Mapping) else list(args or ())
    try:
        for name in named:
            tables[name].createOrReplaceTempView(name)
        return spark.sql(text, args=bound) if bound else spark.sql(text)
    finally:
        for name in named:
            spark.catalog.dropTempView(name)
        for name, view in own.items():
            view.createOrReplaceTempView(name)


@dataclass(frozen=True)
class Validated:
    """The outcome of the quality gate; all frames read the files under ``scratch``.

    ``report`` and ``partition`` are what was counted while the annotated rows were written.
    """

    raw: DataFrame
    stores: DataFrame
    products: DataFrame
    clean: DataFrame
    quarantined: DataFrame
    report: DataFrame
    partition: Row
    scratch: Sequence[str]


def validate(
    spark: SparkSession, exports: Exports, rules: Sequence[Rule] = RULES, min_rows: int = HEAVY_ROWS
) -> Validated:
    """Annotate the raw transactions once and split them.

    The exports land once as Parquet in the scratch folder, so that text is parsed once
    and file order is fixed. The annotated rows, the one result of the wide shuffle, are
    written there too, split by status, and counted on the way; no later step scans them
    for the report.
    """
    folders = [scratch_folder(spark) for _ in range(4)]
    stores = materialize(exports.stores, folders[0])
    products = materialize(exports.products, folders[1])
    with settings(spark, job_width(spark, 0)):
        raw = materialize(exports.transactions, folders[2], codec=CODEC)
    width = job_width(spark, stored_bytes(spark, folders[2]))
    counts = Observation()
    with settings(spark, width | TWO_WRITERS | EXACT):
        rows = quality.annotate(raw, stores, products, exports.order, rules, min_rows)
        rows = rows.withColumn("is_clean", F.col(quality.REASONS) == "")
        rows = materialize(rows.observe(counts, *quality.observed(rules)), folders[3], "is_clean", codec=CODEC)
    report = quality.report_of(spark, counts.get, rules)
    return Validated(
        raw,
        stores,
        products,
        quality.clean(rows.filter("is_clean").drop("is_clean")),
        rows.filter("not is_clean").drop("is_clean"),
        report,
        quality.observed_partition(report.first(), row_count(raw)),
        folders,
    )


def run_pipeline(
    spark: SparkSession,
    exports: Exports,
    root: str,
    as_of: date | None = None,
    gate: Gate = Gate(),
    report_path: str | None = None,
    rules: Sequence[Rule] = RULES,
    min_rows: int = HEAVY_ROWS,
    keep_versions: int = 2,
    null_gate: NullGate = NullGate(),
) -> dict[str, object]:
    """Validate, gate, load, build, check and publish a new version of every table.

    The report is published before the gate. Readers see the version before until every
    table is written and checked, then the new one, never some of each; a run that is
    stopped or dies changes nothing for them. Scratch tables are gone when the run ends,
    also by an error, and so are versions before the last ``keep_versions``.
    """
    with scratch_scope(spark), settings(spark, EXACT | COUNTED):
        summary = _refresh(spark, exports, root, as_of, gate, report_path, rules, min_rows, null_gate)
    prune(spark, root, keep_versions)
    return summary


def _refresh(
    spark: SparkSession,
    exports: Exports,
    root: str,
    as_of: date | None,
    gate: Gate,
    report_path: str | None,
    rules: Sequence[Rule],
    min_rows: int,
    null_gate: NullGate,
) -> dict[str, object]:
    checked = validate(spark, exports, rules, min_rows)
    totals = checked.report.first()
    write_report(checked.report, report_path or table_path(root, "dq_report"), rules)
    gate.check(totals)
    null_gate.check(checked.raw)
    contracts.require_partition(checked.partition)

    loaded = {
        "stg_stores": checked.stores,
        "stg_products": checked.products,
        "stg_transactions": star.staged(checked.clean),
        "stg_quarantined_transactions": checked.quarantined,
    }
    # Keys of the later tables are unique by construction: one row per id or group.
    contracts.require_unique_keys({n: loaded[n] for n in ("stg_stores", "stg_products")})
    with new_version(spark, root) as run:
        for name, rows in loaded.items():
            run.write(rows, name)
        release(spark, *checked.scratch)
        width = job_width(spark, stored_bytes(spark, run.tables.paths("stg_transactions")))
        with settings(spark, width):
            built = run_models(run, star_models(as_of, min_rows) | MODELS)
        contracts.require_counts({n: built[n] for n in ("fact_sales", "mart_daily_sales_by_store")})
    return {"dq_report": report_dict(totals, rules), "warehouse_path": root}


def report_dict(totals: Row, rules: Iterable[Rule] = RULES) -> dict[str, object]:
    """The one report row as a nested dictionary."""
    names = [rule.name for rule in rules]
    flat = {k: v for k, v in totals.asDict().items() if k not in names}
    return {"table": "transactions"} | flat | {"violation_counts": {n: totals[n] for n in names}}
