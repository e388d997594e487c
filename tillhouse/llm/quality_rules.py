"""Quality rules whose soft verdicts are taken per host.

Method: every document is measured against document rules. Two of them reject a document
at once. The others are noisy on one document, so their failures are added up per host,
the rates are shrunk towards the corpus by a beta prior estimated from all hosts, and the
verdict on the host is joined back: a document goes if it fails a soft rule that its host
fails too, or if nearly everything on its host is rejected. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import ROW, small, stored, whole_row

# A word is a run of other characters than these six (fixed values).
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS_NOT = r"[^#*$%&|<>]+"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Thresholds; rates are whole numbers over whole numbers."""

    min_words: int = 10
    repeat_percent: int = 20
    symbols_percent: int = 10
    dup_lines_percent: int = 30
    min_word_length: int = 3
    max_word_length: int = 10
    # A host fails a soft rule above this shrunk rate, and is given up above the second.
    host_rate: float = 0.5
    blocked_rate: float = 0.9
    # The prior weighs at least so many documents: a few alone are no verdict on a host.
    least_strength: float = 10.0


SOFT = ("symbols", "dup_lines", "word_length")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the five counts and ``_n_lines``; every text is read to its end.

    Each array is a column of its own: lambda functions look its elements up by position.
    """
    rows = rows.withColumn("_text", F.coalesce(text, F.lit("")))
    trimmed = F.btrim(F.col("_text"), F.lit(SPACES))
    rows = rows.withColumns(
        {
            "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)),
            "_lines": F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
            "n_symbols": F.length(F.regexp_replace("_text", SYMBOLS_NOT, "")).cast("long"),
        }
    ).drop("_text")
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": F.when(
                F.size("_words") >= WINDOW,
                F.transform(
                    F.sequence(F.lit(0), F.size("_words") - WINDOW),
                    lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(WINDOW)]),
                ),
            ),
        }
    ).drop("_words", "_lines")
    # Most texts repeat no window; only the others are sorted.
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("at")))),
        ),
    ).drop("_grams")
    rows = rows.withColumn(
        "_twice",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda e, i: (F.get("_sorted", i - 1)["g"] == e["g"]) | (F.get("_sorted", i + 1)["g"] == e["g"]),
                ),
                lambda e: e["at"],
            )
        ),
    ).drop("_sorted")
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, at: F.struct(
            (acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n"), (at + WINDOW).alias("end")
        ),
        lambda acc: acc["n"].cast("long"),
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_twice")


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")
    )


def soft_failures(limits: Limits) -> dict[str, Column]:
    chars, words = F.col("word_chars"), F.col("n_words")
    return {
        "symbols": 100 * F.col("n_symbols") > limits.symbols_percent * words,
        "dup_lines": 100 * F.col("n_dup_lines") > limits.dup_lines_percent * F.col("_n_lines"),
        "word_length": (chars < limits.min_word_length * words) | (chars > limits.max_word_length * words),
    }


def host_verdicts(failures: DataFrame, limits: Limits) -> DataFrame:
    """One row per host with a failing verdict: ``_host``, one flag per soft rule, ``_blocked``.

    ``failures`` has ``_host`` and a flag per rule. Prior: mean rate m over all documents;
    between-host variance v is the weighted variance of host rates less its sampling part;
    strength s = m(1-m)/v - 1 within 10 and 1e6; shrunk rate = (failed + m*s) / (n + s).
    """
    rules = (*SOFT, "base_failed")
    hosts = stored(
        failures.filter(F.col("_host").isNotNull())
        .groupBy("_host")
        .agg(F.count("*").alias("_n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    )
    sums = hosts.agg(
        F.sum("_n").alias("total"),
        F.count("*").alias("hosts"),
        *[F.sum(r).alias(r) for r in rules],
        *[F.sum(F.col(r) * F.col(r) / F.col("_n")).alias(f"squares_{r}") for r in rules],
    ).first()
    rates = {r: F.lit(0.0) for r in rules}
    if sums["total"]:
        for r in rules:
            mean = sums[r] / sums["total"]
            spread = mean * (1 - mean)
            variance = sums[f"squares_{r}"] / sums["total"] - mean * mean - spread * sums["hosts"] / sums["total"]
            strength = min(1e6, max(limits.least_strength, spread / variance - 1)) if variance > 0 else 1e6
            rates[r] = (F.col(r) + mean * strength) / (F.col("_n") + strength)
    verdicts = hosts.select(
        "_host",
        *[(rates[r] > limits.host_rate).alias(f"_host_{r}") for r in SOFT],
        (rates["base_failed"] > limits.blocked_rate).alias("_blocked"),
    )
    failed = F.col("_blocked")
    for r in SOFT:
        failed = failed | F.col(f"_host_{r}")
    return stored(verdicts.filter(failed))


def _flagged(rows: DataFrame, limits: Limits) -> DataFrame:
    """``rows`` (``_host``, ``_given``) with the counts and a flag per rule."""
    rows = measured(rows, F.col("_given")).drop("_given")
    return rows.withColumns({"base_failed": base_failed(limits), **soft_failures(limits)})


def _rejected() -> Column:
    """Whether the joined verdict on the host rejects a document."""
    rejected = F.coalesce(F.col("_blocked"), F.lit(False))
    for r in SOFT:
        rejected = rejected | (F.col(r) & F.coalesce(F.col(f"_host_{r}"), F.lit(False)))
    return rejected


def judged(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs`` (``text`` and the host column): counts and verdict.

    Columns: ``doc_id``, the five counts, ``base_failed``, ``kept`` and a flag per soft rule.
    A null text has no words and fails. A null host takes no host verdict. Repeated rows are
    judged each; an empty table gives an empty result; other columns are ignored.
    """
    given = docs.select("doc_id", docs[f"`{host}`"].alias("_host"), docs["text"].alias("_given"))
    rows = stored(_flagged(given, limits))
    out = rows.join(small(host_verdicts(rows, limits)), "_host", "left").withColumn("kept", ~F.col("base_failed") & ~_rejected())
    return out.select("doc_id", *COUNTS, "base_failed", "kept", *SOFT)


def keep(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, see :func:`judged`, with their columns as they came.

    The rules are measured twice, for the hosts and for the documents: that is cheaper than
    to write or to shuffle every text between the two.
    """
    given = docs.select(docs[f"`{host}`"].alias("_host"), docs["text"].alias("_given"))
    verdicts = host_verdicts(_flagged(given, limits), limits)
    rows = docs.select(whole_row(docs), docs[f"`{host}`"].alias("_host"), docs["text"].alias("_given"))
    # A number of the row holds the filter back: below the projections it would repeat all of
    # their work for every mention of a count.
    rows = _flagged(rows, limits).withColumn("_at", F.monotonically_increasing_id())
    kept = rows.join(small(verdicts), "_host", "left").withColumn("_rejected", F.col("base_failed") | _rejected())
    return kept.filter(~F.col("_rejected") & (F.col("_at") >= 0)).select(f"{ROW}.*")
