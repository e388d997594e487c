"""Key and not-null contracts, since Spark tables do not enforce them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tillhouse.schemas import TABLES, Table


class ContractError(RuntimeError):
    """A table breaks its declared contract."""


def conform(rows: DataFrame, table: Table, strict: bool = True) -> DataFrame:
    """Rows in the table's column order and types; columns it does not know are left out.

    An optional column the rows lack is null. A null in a required column fails the job
    that reads the result, in the same pass, unless someone else counts them (not ``strict``).
    """
    columns = []
    for field in table.schema.fields:
        lacking = field.nullable and field.name not in rows.columns
        value = (F.lit(None) if lacking else F.col(field.name)).cast(field.dataType)
        if strict and not field.nullable:
            failure = F.raise_error(F.lit(f"null in required column {table.name}.{field.name}"))
            value = F.coalesce(value, failure.cast(field.dataType))
        columns.append(value.alias(field.name))
    return rows.select(columns)


def null_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Nulls per required column, as (table_name, column_name, n_nulls); one pass per table."""

    def of(name: str) -> DataFrame:
        required = TABLES[name].required
        counts = tables[name].agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required))
        pairs = F.explode(F.create_map(*(x for c in required for x in (F.lit(c), F.col(c)))))
        return counts.select(pairs.alias("column_name", "n_nulls")).withColumn("table_name", F.lit(name))

    return reduce(DataFrame.unionByName, [of(name) for name in tables])


def repeated_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Key values that occur more than once, as (table_name, n_repeated).

    Keys are counted before the shuffle. A key with a null is never a repeat.
    """

    def of(name: str) -> DataFrame:
        keys = list(TABLES[name].keys)
        groups = tables[name].dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
        return groups.agg(F.count_if(F.col("_n") > 1).alias("n_repeated")).withColumn("table_name", F.lit(name))

    return reduce(DataFrame.unionByName, [of(name) for name in tables if TABLES[name].keys])


def require_not_null(tables: Mapping[str, DataFrame]) -> None:
    broken = null_counts(tables).filter("n_nulls > 0").collect()  # one row per column
    if broken:
        raise ContractError("; ".join(f"{r.n_nulls} nulls in {r.table_name}.{r.column_name}" for r in broken))


def require_unique_keys(tables: Mapping[str, DataFrame]) -> None:
    broken = repeated_keys(tables).filter("n_repeated > 0").collect()  # one row per table
    if broken:
        raise ContractError("; ".join(f"{r.n_repeated} repeated keys in {r.table_name}" for r in broken))


def require_partition(check: DataFrame | Row) -> None:
    """``check``: the row of :func:`quality.partition_check` or :func:`quality.observed_partition`."""
    row = check.first() if isinstance(check, DataFrame) else check
    if not row.holds:
        raise ContractError(
            f"{row.clean_rows} clean and {row.quarantined_rows} quarantined rows of {row.total_rows}"
        )


def require_rows(tables: Mapping[str, DataFrame]) -> None:
    """Smoke check after a load: none of the tables is empty."""
    require_counts({name: 0 if frame.isEmpty() else 1 for name, frame in tables.items()})


def require_counts(rows: Mapping[str, int]) -> None:
    """The same from row counts, as they were taken in the write."""
    empty = [name for name, n in rows.items() if not n]
    if empty:
        raise ContractError(f"empty after the load: {', '.join(empty)}")
