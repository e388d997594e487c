"""Manifests, token alignment and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import llm_brute as brute
from tillhouse.llm import alignment, exact, merkle, queries

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
ALIGNED = ("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


def rows_of(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def texts_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


# 11 Merkle manifest ---------------------------------------------------------------------


@pytest.mark.parametrize("levels", [merkle.LEVELS, 1, 2])
def test_manifest(sample, odd, nothing, levels):
    """With blocks of three or nine leaves, block roots are appended on several levels."""
    for docs in (sample, odd):
        rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
        assert rows_of(merkle.verified(docs, levels), MERKLE) == sorted(brute.merkle(rows), key=repr)
    assert merkle.verified(nothing, levels).isEmpty() and merkle.manifest(nothing).columns[0] == "doc_id"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_witnesses_of_trees_of_any_size(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    block = merkle.Block(n, 5)
    for leaf in leaves:
        block.append(leaf)
    root = block.close(whole=True)
    assert root.hex() == brute._levels([x.hex() for x in leaves])[-1][0]
    for at, (leaf, witness) in enumerate(zip(leaves, block.witnesses().to_pylist())):
        assert merkle.folded(leaf, at, n, witness) == root
        if n > 1:
            assert merkle.folded(b"other".ljust(32), at, n, witness) != root


def test_a_changed_row_changes_the_root(spark, sample):
    root = merkle.manifest(sample).select("root").distinct().collect()
    assert len(root) == 1
    again = merkle.manifest(sample.orderBy(F.rand(1)).repartition(5)).select("root").first()
    assert again == root[0]  # whatever the order of the rows
    changed = sample.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    assert merkle.manifest(changed).select("root").first() != root[0]


def test_one_source_is_the_root(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(5)], "doc_id bigint, text string, source string")
    docs = docs.selectExpr("*", "'en' AS lang", "1 AS n_chars")
    rows = merkle.manifest(docs).select("subroot", "root", "source_witness").distinct().collect()
    assert len(rows) == 1 and rows[0]["subroot"] == rows[0]["root"] and not rows[0]["source_witness"]


# 12 Token alignment ---------------------------------------------------------------------


def test_galloping_finds_what_a_binary_search_finds():
    rnd = np.random.default_rng(2)
    for n, m in ((0, 5), (1, 1), (64, 64), (65, 1000), (1000, 70), (500, 100_000)):
        short, long = (np.sort(rnd.choice(200_000, size, replace=False)) for size in (n, m))
        assert alignment.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


PARTS = [
    "a", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00e9", "\u6f22", "\U0001f600", "'s", "12", "<0x41>", "\u2581",
    "<|endoftext|>", "</s>", "<unk>", "x y", " \n ", "\x1c", "\x85", "\u3000", "\ufb01", "e\u0301", "\x00", "\u200b", "\ufeff",
    "word", "Next", ".",
]


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 40])
def test_alignment_of_odd_texts(odd_rows, monkeypatch, chunk):
    """Texts in parts of 40 characters align like whole ones."""
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    texts += [r[1] for r in odd_rows]
    pair = alignment._pair(queries.BYTE_VOCABULARY, queries.PIECE_MODEL)
    numbers = pa.array(range(len(texts)), pa.int64())
    part = pa.RecordBatch.from_arrays([numbers, numbers, pa.array(texts, pa.string())], names=["row", "doc_id", "text"])
    got = alignment._rows(pair, (len(pair.bytes_a), len(pair.bytes_b)), part).to_pylist()
    want = brute.token_alignment(list(enumerate(texts)))
    assert [(r["doc_id"], *(r[c] for c in alignment.COUNTS), r["groups_sha256"]) for r in got] == [(*w[:5], w[7]) for w in want]
    assert 500 < sum(w[1] > 0 for w in want) < len(texts)  # some do not come back from one side
    for r in got:
        assert sum(x["n"] for x in r["links"]) == r["n_links"] == max(0, r["n_a"] + r["n_b"] - r["n_groups"])


@pytest.mark.parametrize("pairs", [alignment.SMALL_PAIRS, 500])
def test_alignment_of_tables(sample, odd, nothing, monkeypatch, pairs):
    """With few pairs to send out, the rare ones are shuffled."""
    monkeypatch.setattr(alignment, "SMALL_PAIRS", pairs)
    for docs in (sample, odd):
        got = rows_of(alignment.weighed(docs, queries.BYTE_VOCABULARY, queries.PIECE_MODEL), ALIGNED)
        assert got == sorted(brute.token_alignment(texts_of(docs)), key=repr)
    assert alignment.weighed(nothing, queries.BYTE_VOCABULARY, queries.PIECE_MODEL).isEmpty()


# 13 Exact dedup -------------------------------------------------------------------------


@pytest.mark.parametrize("fan,run_rows", [(exact.FAN, exact.RUN_ROWS), (2, 3), (3, 10)])
def test_exact(sample, odd, nothing, monkeypatch, fan, run_rows):
    """With runs of three rows there are many rounds."""
    merged = exact.merged
    monkeypatch.setattr(exact, "merged", lambda rows: merged(rows, fan, run_rows))
    for docs in (sample, odd):
        assert rows_of(exact.judged(docs), EXACT) == sorted(brute.exact(texts_of(docs)), key=repr)
    assert exact.judged(nothing).isEmpty() and exact.distinct(nothing).isEmpty()


def test_exact_with_hot_texts(spark, monkeypatch):
    """A text that a third of the rows have takes the broadcast path, others are shuffled."""
    monkeypatch.setattr(exact, "SMALL_ROWS", 2)
    monkeypatch.setattr(exact, "HOT_ROWS", 100)
    rows = [(i, "same \n text" if i % 3 == 0 else f"pair\t{i // 6}" if i % 3 == 1 else f"own {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert rows_of(exact.judged(docs), EXACT) == sorted(brute.exact(rows), key=repr)


def test_texts_of_one_digest_stay_apart(spark, monkeypatch):
    """As if SHA-256 were the same for all: bytes and the second hash still tell texts apart."""
    named = exact._named
    monkeypatch.setattr(exact, "_named", lambda text: named(text) | {"digest": F.lit("0" * 64)})
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "cc"), (5, None), (6, "")]
    got = exact.judged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}


def test_exact_distinct(odd, odd_rows):
    kept = exact.distinct(odd)
    assert kept.columns == odd.columns
    want = sorted((r[0], r[4]) for r in brute.exact([r[:2] for r in odd_rows]) if r[3] and r[0] is not None)
    got = [(r["doc_id"], brute.sha(" ".join(brute.re.split(r"[\x20\x09-\x0D]+", r["text"] or "")))) for r in kept.collect()]
    assert sorted(g for g in got if g[0] is not None) == want and len(got) == len(want)
