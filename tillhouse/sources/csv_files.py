"""Raw exports as CSV with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tillhouse.schemas import PRODUCTS, STORES, TRANSACTIONS

# Texts that stand for a missing value in the exports.
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

LONGEST_NULL = max(map(len, NULL_TEXTS))

# Columns that give the order of the rows over all files of an export: path of the file,
# split, line within the split.
FILE_ORDER = ["_file", "_split", "_line"]


def _typed(text: Column, field: StructField) -> Column:
    """A field's text as its type. A whole number may be written as ``2.0``; other text fails."""
    if isinstance(field.dataType, StringType):
        return text
    value = F.trim(text)
    whole = isinstance(field.dataType, LongType)
    # Most whole numbers are written as such; only others take the long way.
    plain = value.try_cast("bigint") if whole else F.lit(None).cast(field.dataType)
    number = value.try_cast("decimal(38,10)" if whole else "double")
    wrong = number.isNull() | (number != F.floor(number)) if whole else number.isNull()
    kind = "a whole number" if whole else "a number"
    failure = F.raise_error(F.concat(F.lit(f"not {kind} in {field.name}: "), value)).cast(field.dataType)
    return F.coalesce(plain, F.when(value.isNotNull() & wrong, failure).otherwise(number.cast(field.dataType)))


def _typed_columns(schema: StructType) -> list[Column]:
    """The fields of a schema from text columns of their names."""
    columns = []
    for field in schema.fields:
        given = F.col(field.name)
        present = (F.octet_length(given) > LONGEST_NULL) | ~given.isin(NULL_TEXTS)
        columns.append(_typed(F.when(present, given), field).alias(field.name))
    return columns


def _read(spark: SparkSession, path: str, schema: StructType, ordered: bool = False) -> DataFrame:
    """Columns are found by their names in the header, in any order; others are left out."""
    rows = (
        spark.read.option("header", True)
        # All files must have the header of the first.
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    lacking = [name for name in schema.names if name not in rows.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)} in {path}")
    columns = _typed_columns(schema)
    if ordered:
        columns += [
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_line"),
        ]
    return rows.select(columns)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw transactions, all ids as text, with the ``FILE_ORDER`` columns."""
    return _read(spark, path, TRANSACTIONS, ordered=True)


def stream_transactions(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of raw transactions as they arrive, as text, for :func:`parsed_transactions`.

    Their columns are those of a transaction, in that order; a file with another header is
    an error. A file must appear under its name at once and never change.
    """
    text = StructType([StructField(name, StringType()) for name in TRANSACTIONS.names])
    rows = (
        spark.readStream.schema(text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
    )
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))


def parsed_transactions(rows: DataFrame) -> DataFrame:
    """A micro-batch of :func:`stream_transactions` as :func:`read_transactions` gives it."""
    return rows.select(*_typed_columns(TRANSACTIONS), "_file", "_split", F.monotonically_increasing_id().alias("_line"))


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, STORES)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PRODUCTS)


def write(rows: DataFrame, path: str) -> None:
    """Replace the export at ``path``; one file per partition, each with a header."""
    (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
