"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Extra columns named like those the operators compute.
CLASHES = (
    "n_words", "kept", "key", "cuts", "ids", "size", "family", "shard", "path", "node", "low", "_id", "_host",
    "features", "words", "carried", "contaminated", "a b.c",
)


def passage(seed: int, n: int) -> str:
    """Words that no other seed has."""
    return " ".join(f"w{seed}x{i * 7919 % 1000}q{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    shared, long = passage(1, 60), passage(2, 30_000)
    return [
        (1, shared + " " + passage(3, 30), "en", "a", 1),
        (2, passage(4, 20) + "\n" + shared, "en", "a", 1),
        (3, passage(5, 80), "fr", "b", 1),
        (4, passage(5, 80), "fr", "b", 1),  # a copy
        (4, passage(5, 80), "fr", "b", 1),  # a repeated row
        (5, passage(5, 79) + " other", None, None, None),  # a near copy
        (6, "", "en", "a", 0),
        (7, None, "en", "a", None),
        (8, " \t\n\x0b ", "en", "b", 5),
        (9, "one two three", "en", "b", 3),
        (10, "one two three", "en", "b", 3),
        (None, passage(5, 80), "de", None, 9),
        (None, None, None, None, None),
        (11, long, "en", "a", 1),
        (12, long[: len(long) // 2], "en", "c", 1),
        (13, "spam spam " * 300, "en", "c", 1),
        (14, "Été 漢字 \U0001f600 naïve 'll don't\r\n\r\nx\x00y", "fr", "c", 1),
        (15, "same line here\n" * 40 + "Released under the MIT License.", "en", "c", 1),
        (16, "12 34 !!", "en", "c", 1),
        (16, passage(6, 70), "en", "c", 1),  # an id with two texts
        (17, passage(6, 70) + " more", "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, DOCS)
    for name in CLASHES:
        docs = docs.withColumn(name, docs["lang"])
    return docs


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
