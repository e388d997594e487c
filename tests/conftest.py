from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillhouse.schemas import PRODUCTS, STORES, TRANSACTIONS  # noqa: E402
from tillhouse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    session = build_session(
        "tests",
        "local[8]",
        4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("spark-warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Frames of the raw exports from tuples; transactions get their line number."""

    class Make:
        @staticmethod
        def stores(rows):
            return spark.createDataFrame(rows, STORES)

        @staticmethod
        def products(rows):
            return spark.createDataFrame(rows, PRODUCTS)

        @staticmethod
        def transactions(rows):
            from pyspark.sql.types import LongType, StructField, StructType

            schema = StructType([*TRANSACTIONS.fields, StructField("line", LongType())])
            return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema)

    return Make
