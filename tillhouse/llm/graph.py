"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import stored


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """``u`` and the least of it and its neighbours; a hub is one row per task before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("_least")).select("u", F.least("u", "_least").alias("m"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``edges`` (``u``, ``v``).

    Alternates two steps until nothing changes: every node hands its larger neighbours to
    the least node it knows, then its smaller neighbours and itself. The rounds grow with
    the logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = stored(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least_neighbour(both), "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        large = stored(large)  # every u is above its v
        known = _least_neighbour(large)
        edges = stored(
            large.join(known, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(known.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
