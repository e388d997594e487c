"""The data-quality gate: six rules, their reasons, the split and the report."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tillhouse.functions.numbers import half_up_div
from tillhouse.operators.skew import HEAVY_ROWS, fits_broadcast, lookup, mark_repeats, sized
from tillhouse.schemas import TRANSACTIONS
from tillhouse.sources.tables import materialize, release, scratch_folder

# The reasons column and the text between two reasons.
REASONS = "dq_reasons"
SEPARATOR = "; "

# Columns the marking step adds for the rules that need more than the row itself.
REPEATED, STORE_KNOWN, PRODUCT_KNOWN = "_repeated", "_store_known", "_product_known"


def parsed_date(text: Column) -> Column:
    """Calendar date of ``yyyy-M-d`` text; null for anything else.

    The pattern keeps out what the cast would also take (blanks, times, months alone);
    the cast is several times faster than a formatter.
    """
    return F.when(text.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), text.try_cast("date"))


def _or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def bad_date() -> Column:
    return parsed_date(F.col("transaction_date")).isNull()


def bad_quantity() -> Column:
    return _or_false(F.col("quantity") <= 0)


def bad_discount() -> Column:
    return _or_false((F.col("discount_pct") < 0) | (F.col("discount_pct") > 100))


@dataclass(frozen=True)
class Rule:
    """A named row condition; rows where it holds are quarantined under that name."""

    name: str
    broken: Callable[[], Column]


# The rule names, in the order in which reasons are listed.
RULES: tuple[Rule, ...] = (
    Rule("duplicate_transaction_id", lambda: F.col(REPEATED)),
    Rule("invalid_transaction_date", bad_date),
    Rule("non_positive_quantity", bad_quantity),
    Rule("unknown_store_id", lambda: ~F.col(STORE_KNOWN)),
    Rule("unknown_product_id", lambda: ~F.col(PRODUCT_KNOWN)),
    Rule("discount_out_of_range", bad_discount),
)


def _raw_columns(rows: DataFrame) -> list[str]:
    return [c for c in TRANSACTIONS.names if c in rows.columns]


def unknown_keys(keys_of: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``key`` that do not occur in ``dim`` (column ``_unknown``), null included.

    Each task sends a key once, however many rows have it.
    """
    used = keys_of.select(F.col(key).alias("_unknown")).distinct()
    return used.join(dim, used["_unknown"] == dim[key], "left_anti")


def mark_known(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    flag: str,
    min_rows: int = HEAVY_ROWS,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Add ``flag``: whether ``key`` occurs in ``dim``; a null key does not.

    The rows stay where they are if the dimension or, failing that, the list of unknown
    keys passes the size check for a broadcast. Only past both are they shuffled.
    """
    keys_of = rows if keys_of is None else keys_of
    small = fits_broadcast(dim)
    if not small:
        folder = scratch_folder(rows.sparkSession)
        unknown = materialize(unknown_keys(keys_of, dim, key), folder)
        if fits_broadcast(unknown):
            unknown = F.broadcast(unknown.withColumn(flag, F.lit(False)))
            marked = rows.join(unknown, F.col(key).eqNullSafe(F.col("_unknown")), "left").drop("_unknown")
            return marked.withColumn(flag, F.coalesce(F.col(flag), F.lit(True)))
        release(rows.sparkSession, folder)
    keys = dim.select(key).distinct().withColumn(flag, F.lit(True))
    marked = lookup(rows, keys, key, "left", small, min_rows, keys_of)
    return marked.withColumn(flag, _or_false(F.col(flag)))


def orphans(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    min_rows: int = HEAVY_ROWS,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Rows whose ``key`` does not occur in ``dim``, null keys included."""
    columns = _raw_columns(rows)
    if fits_broadcast(dim):
        return rows.join(F.broadcast(dim.select(key)), key, "left_anti").select(columns)
    return mark_known(rows, dim, key, "_known", min_rows, keys_of).filter("not _known").select(columns)


def repeats(
    rows: DataFrame, order: Sequence[str], min_rows: int = HEAVY_ROWS, keys_of: DataFrame | None = None
) -> DataFrame:
    """All rows of a transaction id but its first in file order."""
    marked = mark_repeats(rows, "transaction_id", order, REPEATED, min_rows, keys_of)
    return marked.filter(REPEATED).select(_raw_columns(rows))


def annotate(
    raw: DataFrame,
    stores: DataFrame,
    products: DataFrame,
    order: Sequence[str],
    rules: Iterable[Rule] = RULES,
    min_rows: int = HEAVY_ROWS,
    keys_of: DataFrame | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Raw rows plus ``dq_reasons``: the broken rules in rule order, empty when clean.

    ``seen`` has one row per ``transaction_id`` that an earlier load had; its copies are all
    repeats. ``order`` names the columns that give file order. A later copy of an id is a repeat
    even where the first copy breaks another rule, so the ids are numbered on all rows.
    ``keys_of`` may name a cheaper frame with the same transaction, store and product ids.
    """
    keys_of = raw if keys_of is None else keys_of
    marked = mark_repeats(raw, "transaction_id", order, REPEATED, min_rows, keys_of)
    if seen is not None:
        seen = sized(seen.select(F.col("transaction_id").alias("_seen"), F.lit(True).alias("_again")))
        marked = marked.join(seen, F.col("transaction_id").eqNullSafe(F.col("_seen")), "left")
        marked = marked.withColumn(REPEATED, F.col(REPEATED) | _or_false(F.col("_again"))).drop("_seen", "_again")
    marked = mark_known(marked, stores, "store_id", STORE_KNOWN, min_rows, keys_of)
    marked = mark_known(marked, products, "product_id", PRODUCT_KNOWN, min_rows, keys_of)
    reasons = F.concat_ws(SEPARATOR, *(F.when(rule.broken(), F.lit(rule.name)) for rule in rules))
    return marked.select(*_raw_columns(raw), reasons.alias(REASONS))


def clean(annotated: DataFrame) -> DataFrame:
    """Rows that break no rule, with the date as a date."""
    return (
        annotated.filter(F.col(REASONS) == "")
        .drop(REASONS)
        .withColumn("transaction_date", parsed_date(F.col("transaction_date")))
    )


def quarantined(annotated: DataFrame) -> DataFrame:
    """Rows that break a rule, columns as they came, with their reasons."""
    return annotated.filter(F.col(REASONS) != "")


def by_reasons(annotated: DataFrame) -> DataFrame:
    """Rows per distinct reason text: 2**6 groups at most, whatever the input size."""
    return annotated.groupBy(REASONS).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("customer_id").isNull()).alias("n_guests"),
    )


def report(annotated: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """One row of totals; the per-rule counts overlap where a row breaks several rules."""
    groups = by_reasons(annotated)

    def total(condition: Column, value: str = "n_rows") -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0)).cast("bigint")

    broken = F.split(REASONS, SEPARATOR)
    counted = groups.agg(
        total(F.lit(True)).alias("total_rows"),
        total(F.col(REASONS) == "").alias("clean_rows"),
        total(F.col(REASONS) != "").alias("quarantined_rows"),
        total(F.lit(True), "n_guests").alias("null_customer_id_count"),
        *(total(F.array_contains(broken, rule.name)).alias(rule.name) for rule in rules),
    )
    rate = half_up_div(F.col("quarantined_rows") * 10_000, F.col("total_rows")).cast("double") / F.lit(10_000.0)
    return counted.withColumn("quarantine_rate", F.coalesce(rate, F.lit(0.0)))


def observed(rules: Iterable[Rule] = RULES) -> list[Column]:
    """The counts of the report as metrics of a pass over annotated rows, one value each."""
    listed = F.concat(F.lit(SEPARATOR), REASONS, F.lit(SEPARATOR))
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(REASONS) == "").alias("clean_rows"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customer_id_count"),
        *(F.count_if(listed.contains(f"{SEPARATOR}{rule.name}{SEPARATOR}")).alias(rule.name) for rule in rules),
    ]


def report_of(spark: SparkSession, counts: Mapping[str, int], rules: Iterable[Rule] = RULES) -> DataFrame:
    """The report row, as :func:`report` makes it, from the metrics of :func:`observed`."""
    total, bad = counts["total_rows"], counts["total_rows"] - counts["clean_rows"]
    names = [rule.name for rule in rules]
    # Rounded half up to four decimals, in whole numbers.
    rate = (20_000 * bad + total) // (2 * total) / 10_000 if total else 0.0
    longs = {"total_rows": total, "clean_rows": counts["clean_rows"], "quarantined_rows": bad}
    longs |= {n: counts[n] for n in ("null_customer_id_count", *names)}
    schema = ", ".join([*(f"`{n}` bigint" for n in longs), "quarantine_rate double"])
    return spark.createDataFrame([(*longs.values(), rate)], schema)


def observed_partition(totals: Row, raw_rows: int) -> Row:
    """The row of :func:`partition_check` from a report that was counted in the write."""
    both = totals["clean_rows"] + totals["quarantined_rows"]
    return Row(
        total_rows=raw_rows, clean_rows=totals["clean_rows"], quarantined_rows=totals["quarantined_rows"], holds=both == raw_rows
    )


def report_document(report_row: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The report nested the way it is published, one JSON object."""
    return report_row.select(
        F.lit("transactions").alias("table"),
        "total_rows",
        "clean_rows",
        "quarantined_rows",
        "quarantine_rate",
        "null_customer_id_count",
        F.struct(*(F.col(rule.name) for rule in rules)).alias("violation_counts"),
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    """Quarantined rows per reason, most frequent first.

    Rows are counted per reason text before the texts are taken apart.
    """
    return (
        rows.filter(F.col(REASONS) != "")
        .groupBy(REASONS)
        .agg(F.count("*").alias("n_rows"))
        .select(F.explode(F.split(REASONS, SEPARATOR)).alias("reason"), "n_rows")
        .groupBy("reason")
        .agg(F.sum("n_rows").alias("n_rows"))
        .orderBy(F.desc("n_rows"), "reason")
    )


def partition_check(raw: DataFrame, clean_rows: DataFrame, quarantined_rows: DataFrame) -> DataFrame:
    """Whether clean and quarantined rows together are as many as the raw rows; each counted by itself."""
    names = ("total_rows", "clean_rows", "quarantined_rows")
    counts = [
        rows.agg(F.count("*").alias("n")).select(*((F.col("n") if n == name else F.lit(0)).alias(n) for n in names))
        for name, rows in zip(names, (raw, clean_rows, quarantined_rows))
    ]
    together = reduce(DataFrame.unionByName, counts).agg(*(F.sum(n).alias(n) for n in names))
    holds = F.col("clean_rows") + F.col("quarantined_rows") == F.col("total_rows")
    return together.withColumn("holds", holds)


# The highest quarantine rates of a run by hand and of a scheduled run.
MAX_RATE, SCHEDULED_MAX_RATE = 0.01, 0.10


@dataclass(frozen=True)
class Gate:
    """Stops a run whose quarantine rate is above ``max_rate``; off unless enabled."""

    max_rate: float = MAX_RATE
    enabled: bool = False

    def stops(self, rate: float) -> bool:
        return self.enabled and rate > self.max_rate

    def check(self, totals: Row) -> None:
        if self.stops(totals["quarantine_rate"]):
            raise QualityGateError(
                f"{totals['quarantine_rate']:.2%} of the rows are quarantined, more than {self.max_rate:.2%}"
            )


SCHEDULED_GATE = Gate(SCHEDULED_MAX_RATE, enabled=True)

# Fixed value: the highest share of nulls in one raw column.
MAX_NULL_RATE = 0.01


@dataclass(frozen=True)
class NullGate:
    """Stops a run in which a raw column has too many nulls; off unless enabled.

    The columns are those that a null makes useless; a guest has no customer id.
    """

    max_rate: float = MAX_NULL_RATE
    enabled: bool = False
    columns: tuple[str, ...] = tuple(c for c in TRANSACTIONS.names if c != "customer_id")

    def rates(self, rows: DataFrame) -> DataFrame:
        """Nulls per column, as (column_name, n_rows, n_nulls, null_rate, stops), in one pass.

        The rate is rounded half up to four decimals; no rows have no nulls.
        """
        counts = rows.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in self.columns))
        pairs = F.explode(F.create_map(*(x for c in self.columns for x in (F.lit(c), F.col(c)))))
        counts = counts.select("n_rows", pairs.alias("column_name", "n_nulls"))
        rate = half_up_div(F.col("n_nulls") * 10_000, F.col("n_rows")).cast("double") / F.lit(10_000.0)
        rate = F.coalesce(rate, F.lit(0.0))
        return counts.select("column_name", "n_rows", "n_nulls", rate.alias("null_rate"), (rate > self.max_rate).alias("stops"))

    def check(self, rows: DataFrame) -> None:
        if not self.enabled:
            return
        broken = self.rates(rows).filter("stops").orderBy("column_name").collect()  # one row per column at most
        if broken:
            raise QualityGateError("; ".join(f"{r.null_rate:.2%} of {r.column_name} are null, more than {self.max_rate:.2%}" for r in broken))


class QualityGateError(RuntimeError):
    """The quarantine rate of a run is above its gate."""
