"""Each operator against brute force, on odd rows and on the smallest table."""

from __future__ import annotations

import random
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check_oracles
import llm_brute as brute
from tillhouse.llm import (
    bpe, decontaminate, graph, jaccard, language, licenses, notices, oracle, quality_rules, queries, sharding, substrings,
    toxicity, warc,
)
from tillhouse.llm.fm_index import FMIndex, WaveletMatrix
from tillhouse.llm.words import ALPHANUMERIC, BY_SPACE, same_words, words

FOLDER = "/root/testdata/sf0.001"


def passage(seed, n):
    """Words that no other seed has."""
    return " ".join(f"w{seed}x{i * 7919 % 1000}q{i}" for i in range(n))


PATTERN = public_tokenizers.PATTERN
LIMITS = quality_rules.Limits()


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def texts_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


# Shared parts ---------------------------------------------------------------------------


def test_words_of_bytes(odd_rows):
    texts = [(r[1] or "").encode() for r in odd_rows]
    ends = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for classes, plain in ((BY_SPACE, brute.words), (ALPHANUMERIC, brute.alphanumeric)):
        found = words(data, ends, classes)
        assert found.counts.tolist() == [len(plain(r[1])) for r in odd_rows]
        by_word = defaultdict(set)
        for i, w in enumerate(w for r in odd_rows for w in plain(r[1])):
            by_word[w].add(int(found.hash[i]))
        assert all(len(h) == 1 for h in by_word.values())
        assert len({next(iter(h)) for h in by_word.values()}) == len(by_word)


def colliding(n):
    """Two words that a hash which is a polynomial modulo 2 ** 64 takes for one: Thue-Morse and its complement."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 65536])
def test_words_that_once_collided(spark, n):
    one, other = colliding(n)
    data = np.frombuffer(f"{one} {other} {one}".encode(), np.uint8)
    found = words(data, np.array([0, len(data)]), BY_SPACE)
    assert found.hash[0] != found.hash[1] and found.hash[0] == found.hash[2]
    assert same_words(data, found)[0] != same_words(data, found)[1]
    found.hash[:] = 7  # even if all hashes were one
    numbers = same_words(data, found)
    assert numbers[0] == numbers[2] != numbers[1]

    begin = passage(1, 49)
    rows = [(1, f"{begin} {one}"), (2, f"{begin} {other}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(substrings.digests(docs), "doc_id", "n_removed") == [(1, 0), (2, 0)]
    short = [(1, f"{passage(2, 4)} {one}"), (2, f"{passage(2, 4)} {other}")]
    got = rows_of(jaccard.classes(spark.createDataFrame(short, "doc_id bigint, text string")), "doc_id", "copies", "n_links")
    assert got == [(1, 1, 0), (2, 1, 0)]
    items = spark.createDataFrame([(1, " ".join(rows[0][1].split()[-10:]))], "item_id bigint, text string")
    got = rows_of(decontaminate.judged(docs, items), "doc_id", "n_hit")
    assert got == [(1, 10), (2, 0)]


def test_wavelet_matrix_counts():
    symbols = np.random.default_rng(1).integers(0, 37, 500)
    matrix = WaveletMatrix(symbols, 37)
    for c in range(37):
        for at in (0, 1, 63, 64, 65, 250, 500):
            assert matrix.count(np.array([c]), np.array([at]))[0] == (symbols[:at] == c).sum()


@pytest.mark.parametrize("window", [1, 2, 3, 4, 7, 8])
def test_fm_index_finds_the_least_number_of_every_window(window):
    rnd = random.Random(window)
    texts = [[rnd.randint(1, 3) for _ in range(rnd.randint(1, 30))] for _ in range(40)]
    numbers = [rnd.randint(0, 99) for _ in texts]
    hashes = np.array([w for t in texts for w in t], np.uint64)
    first = np.cumsum([0, *map(len, texts)])
    found, at = FMIndex(hashes, first, np.array(numbers), window).least_numbers(hashes, first)
    for i, text in enumerate(texts):
        for j in range(len(text) - window + 1):
            least = min(
                n for t, n in zip(texts, numbers) for k in range(len(t) - window + 1) if t[k : k + window] == text[j : j + window]
            )
            assert found[at[i] + j] == least


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randint(100, 400), rnd.randint(100, 400)) for _ in range(200)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).isEmpty()


# 1 Licences -----------------------------------------------------------------------------


def test_licences(spark, sample, odd, nothing):
    assert licenses.licences(nothing).isEmpty()
    found = {r["doc_id"]: r for r in licenses.licences(odd).collect()}
    assert found[15]["family"] == "mit" and found[15]["line"] == 40
    assert sum(r["n_notices"] for r in found.values()) == 1 and len(found) == 18
    planted = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "proprietary",
    }
    found = {r["doc_id"]: r["families"] for r in licenses.licences(sample).collect()}
    for doc_id, text in texts_of(sample):
        assert found[doc_id] == (",".join(sorted(planted[x] for x in set(text.split("\n")) & set(planted))) or None)


# Notices and sentences that sound like one, with what may be said of them (fixed values).
PROBES = [
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", {"mpl-2.0"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", {"isc"}),
    ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.", {"apache-2.0"}),
    ("This is free and unencumbered software released into the public domain.", {"public-domain"}),
    ("SPDX-License-Identifier: MPL-2.0", {"mpl-2.0"}),
    ("SPDX-License-Identifier: CECILL-2.1", {"unknown"}),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"lgpl"}),
    ("He said all his rights were reserved for the king and the public license office.", {"unknown", None}),
    ("Licensed under the Foo Bar License, version 7.", {"unknown"}),
    ("The cat sat on the mat.", {None}),
    ("", {None}),
    (None, {None}),
]


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def scanned(scanner, docs):
    """Notices per text."""
    names = docs.select("doc_id", *licenses._text_name(F.col("text")))
    out = defaultdict(list)
    for r in scanner.scan(docs).join(names, [*licenses.TEXT]).collect():
        out[r["doc_id"]].append((r["line"], r["family"]))
    return out


def test_probes(spark, scanner):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PROBES)], "doc_id bigint, text string")
    found = scanned(scanner, docs)
    for i, (text, may) in enumerate(PROBES):
        assert {f for _, f in found[i]} <= may and (found[i] or None in may), (text, found[i])
    # Inside a long line of ordinary words, and in the middle of a paragraph.
    words = " ".join(f"word{i}" for i in range(500))
    rows = [(1, f"{words} Released under the MIT License. {words}"), (2, f"{words}\n{words} All rights reserved.\n{words}")]
    found = scanned(scanner, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found == {1: [(0, "mit")], 2: [(1, "proprietary")]}


def test_many_notices_of_one_text(spark, scanner):
    """The work grows with the notices, not with their pairs."""
    n = 20_000
    text = "\n".join(["Released under the MIT License.", "and other words", "Licensed under CC BY 4.0."] * n)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.time()
    counts = {r["family"]: r["count"] for r in scanner.scan(docs).groupBy("family").count().collect()}
    assert counts == {"mit": n, "cc-by": n} and time.time() - start < 60


def test_scores_are_those_of_the_model(spark, scanner, sample):
    """Families, probabilities and similarities of all paragraphs, worked out one by one."""
    paragraphs = scanner.vocabulary.paragraphs(sample.filter("text is not null"))
    judged = {tuple(r[c] for c in licenses.UNIT): r for r in scanner.judged(paragraphs).collect()}
    rows = paragraphs.collect()
    assert len(rows) > len(judged) > 0
    for row in rows:
        p = scanner.probabilities(row["features"])
        best = max(range(1, len(p)), key=p.__getitem__)
        found = judged.get(tuple(row[c] for c in licenses.UNIT))
        assert (found is not None) == (1 - p[0] >= scanner.notice)
        if found:
            similarity = scanner.similarity(licenses.FAMILIES[best], row["features"])
            known = p[best] >= scanner.sure and similarity >= licenses.CONFIRMED
            assert found["family"] == (licenses.FAMILIES[best] if known else "unknown")
            assert abs(found["probability"] - p[best]) < 1e-9 and abs(found["similarity"] - similarity) < 1e-9


def test_held_out_notices(scanner):
    """Most other wordings come out as their family, none as another; no untaught one as known."""

    def family(text):
        features = scanner.vocabulary.numbers(text)
        p = scanner.probabilities(features)
        best = max(range(1, len(p)), key=p.__getitem__)
        if 1 - p[0] < scanner.notice:
            return None
        sure = p[best] >= scanner.sure and scanner.similarity(licenses.FAMILIES[best], features) >= licenses.CONFIRMED
        return licenses.FAMILIES[best] if sure else "unknown"

    found = [(f, family(t)) for f, texts in notices.HELD_OUT.items() for t in texts]
    assert all(got in (f, "unknown") for f, got in found) and sum(got == f for f, got in found) >= len(found) / 2
    assert {family(t) for t in notices.UNTAUGHT} == {"unknown"}
    assert all(family(t) == f for f, texts in notices.TEMPLATES.items() for t in texts)
    assert len(notices.TEMPLATES) >= 15


def test_licences_learn_from_all_texts(spark):
    """Every distinct text counts, however many there are: for single words, and for the thresholds."""
    rows = [(i, f"ordinary line {i}\nlicense of the house {i}" if i % 2 else f"plain {i}") for i in range(4000)] + [(0, "plain 0")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert licenses.line_counts(docs, ["license", "plain", "house", "warranty"]) == (6000, [2000, 2000, 2000, 0])
    seen = []
    fit = licenses.LogisticRegression.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(licenses.LogisticRegression, "fit", lambda self, table: seen.append(table) or fit(self, table))
        scanner, paragraphs = licenses.trained(docs)
    taught = seen[0].filter("label = 0").agg(F.sum("weight")).first()[0]
    held = paragraphs.filter(F.pmod(F.xxhash64(*licenses.UNIT, F.lit(1)), F.lit(5)) == 0).count()
    assert ("license",) not in scanner.vocabulary.grams and ("warranty",) in scanner.vocabulary.grams
    assert taught == 6000 - held


def test_licence_threshold_is_that_of_sorted_risks(spark):
    """Counting in bins finds what sorting all of them finds."""
    rnd = random.Random(9)
    risks = [(rnd.choice([0.5, 0.7, 0.9, 1 - 1e-15, rnd.random()]), float(rnd.randint(1, 5))) for _ in range(500)]
    table = spark.createDataFrame(risks, "risk double, n double")
    for allowed in (0.0, 3.0, 100.0, 600.0, 1e9):
        passed, expected = 0.0, None
        for risk, n in sorted((r for r in risks if r[0] >= 0.5), reverse=True):
            passed += n
            if passed > allowed:
                expected = risk
                break
        assert licenses._highest(table, allowed, 0.5) == expected


def test_notices_wrapped_over_lines(spark, scanner):
    """Each longer template wrapped, in a comment between ordinary lines, is one notice of its family."""
    wrapped = [(f, textwrap.wrap(t, 72)) for f, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 72]
    rows = [(i, "\n".join(["# some ordinary words", *(f"# {x}" for x in lines), "# and more of them"])) for i, (_, lines) in enumerate(wrapped)]
    found = scanned(scanner, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [found[i] for i in range(len(wrapped))] == [[(1, f)] for f, _ in wrapped]


# 2 Jaccard join -------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [1000, 3])
def test_jaccard_classes(sample, odd, bucket):
    """With buckets of three nodes, splitting and comparing in blocks take place."""
    for docs in (sample, odd):
        got = rows_of(jaccard.classes(docs, bucket=bucket), "doc_id", "n_links", "class_id")
        assert got == sorted(brute.similar(texts_of(docs)), key=repr)


def test_jaccard_dense_group(spark):
    """A group of near copies larger than a bucket, and a common passage: no link is lost."""
    rnd, base = random.Random(5), [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rnd.randint(0, 4)):
            text[rnd.randrange(200)] = f"x{rnd.random()}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join([*base[:8], *(f"y{i}z{j}" for j in range(100))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rows_of(jaccard.classes(docs, bucket=10), "doc_id", "n_links", "class_id")
    assert got == sorted(brute.similar(rows), key=repr)


def near_copies(n, edits, seed=5):
    """Copies of 200 words, each with up to ``edits`` words changed."""
    rnd, base, rows = random.Random(seed), [f"b{i}" for i in range(200)], []
    for i in range(n):
        text = list(base)
        for _ in range(rnd.randint(0, edits)):
            text[rnd.randrange(200)] = f"x{rnd.random()}"
        rows.append((i, " ".join(text)))
    return rows


def test_jaccard_large_group_of_near_copies_is_dealt_once(spark, monkeypatch):
    """What is sent to be compared grows with the group, not with its square; all links are counted."""
    sent, deal = [], jaccard._block_places
    monkeypatch.setattr(jaccard, "_block_places", lambda rows, bucket: sent.append(deal(rows, bucket)) or sent[-1])
    counts = []
    for n in (100, 400):
        rows = near_copies(n, 2) + [(1000 + i, " ".join(f"c{j}" for j in range(50))) for i in range(3)]
        got = rows_of(jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket=30), "doc_id", "n_links", "class_id")
        assert got == sorted(brute.similar(rows), key=repr)
        counts.append(sent[-1].count())
    assert counts[1] <= 8 * counts[0]  # by squares it would be sixteen times


def dealt(spark, monkeypatch, rows, bucket):
    """Paths and rows that are compared in blocks; classes and links are those of brute force."""
    sent, deal = [], jaccard._block_places
    with monkeypatch.context() as m:
        m.setattr(jaccard, "_block_places", lambda rows, bucket: sent.append(deal(rows, bucket)) or sent[-1])
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert rows_of(jaccard.classes(docs, bucket=bucket), "doc_id", "n_links", "class_id") == sorted(brute.similar(rows), key=repr)
    return sum(x.select("path").distinct().count() for x in sent), sum(x.count() for x in sent)


def test_jaccard_common_line_of_unlike_texts_is_split(spark, monkeypatch):
    """Texts that have a line or a passage in common, and little else, are not compared in blocks."""
    line, rnd = passage(90, 12), random.Random(8)
    rows = [(i, f"{line}\n{passage(100 + i, rnd.choice((20, 40, 100)))}") for i in range(300)]
    rows += [(1000 + i, f"{text}{' more' * (i % 2)}") for i, (_, text) in enumerate(rows[:40])]
    rows += [(2000 + i, f"{passage(91, 60)} {passage(600 + i, 40)}") for i in range(100)]
    assert dealt(spark, monkeypatch, rows, 30)[1] <= len(rows)


def test_jaccard_loose_near_copies_meet_in_one_bucket(spark, monkeypatch):
    """A group that no clique holds is compared in blocks once, not in each bucket that it fills."""
    paths, _ = dealt(spark, monkeypatch, near_copies(120, 9), 30)
    assert paths <= 2


def test_jaccard_split_outside_of_the_common_part():
    """Of two similar sets both are split, with as many tokens to share as they count on, or both stay."""
    rnd = np.random.default_rng(6)
    split, stay = jaccard.common_shares(0.8)
    seen = Counter()
    for _ in range(4000):
        tokens = rnd.permutation(1 << 12)[:400].astype(np.uint64)
        n = int(rnd.integers(5, 200))
        first, second = rnd.integers(0, n // 5 + 1), rnd.integers(0, n // 5 + 1)
        a, b = np.sort(tokens[: n - first]), np.sort(np.concatenate([tokens[: n - second - first], tokens[n - first : n]]))
        both = len(np.intersect1d(a, b))
        if 1.8 * both < 0.8 * (len(a) + len(b)):
            continue
        common = np.sort(np.concatenate([rnd.permutation(a)[: rnd.integers(0, len(a) + 1)], tokens[300:]]))
        (out_a, limit_a, share_a), (out_b, limit_b, share_b) = (jaccard.outside(x, common, 0.8) for x in (a, b))
        divided, staying = share_a < split and share_b < split, share_a >= stay and share_b >= stay
        assert divided or staying
        seen[divided, staying] += 1
        if divided:
            assert len(np.intersect1d(out_a, out_b)) * float(min(limit_a, limit_b)) >= (1 - 1e-9) * 2.0**64 * min(1, len(out_a))
    assert len(seen) == 3


def test_jaccard_sketches_lose_no_pair():
    """Bits that differ are no more than tokens that do, also between sketches of two lengths."""
    rnd = np.random.default_rng(4)
    for n, more in ((1, 0), (60, 10), (64, 1), (500, 100), (1000, 250)):
        token = rnd.integers(0, 1 << 48, n + more, dtype=np.uint64)
        small, large = np.sort(token[:n]), np.sort(token)
        both = np.concatenate([small, large])
        packed = jaccard.sketches(both, np.array([0, n, 2 * n + more]))
        apart = jaccard.Sketches(packed, 0.8).apart(np.array([0, 0]), np.array([0, 1]))
        assert apart[0] == 0 and apart[1] <= more
    sets = [np.sort(rnd.integers(0, 1 << 48, 300, dtype=np.uint64)) for _ in range(2)]
    packed = jaccard.sketches(np.concatenate(sets), np.array([0, 300, 600]))
    assert jaccard.Sketches(packed, 0.8).apart(np.array([0]), np.array([1]))[0] * 9 > 600  # unlike sets go no further


def test_jaccard_recall_of_paths_split_twice():
    """Pairs just at the threshold, one set inside the other, that must share a path on three levels."""
    rnd, pairs = np.random.default_rng(3), 2000
    seeds = jaccard.mixed(np.arange(1, jaccard.runs_for(jaccard.RECALL, jaccard.SPLITS) + 1, dtype=np.uint64))
    large, small = jaccard.limits_of(np.array([100, 80]), jaccard.THRESHOLD)
    found = 0
    for _ in range(pairs):
        tokens = rnd.integers(0, 1 << 48, 100, dtype=np.uint64)
        shared = set(seeds.tolist())
        for _ in range(1 + jaccard.SPLITS):
            shared = {
                int(x)
                for path in shared
                for x in np.intersect1d(
                    jaccard.chosen(tokens, large, np.uint64(path))[1], jaccard.chosen(tokens[:80], small, np.uint64(path))[1]
                )
            }
        found += bool(shared)
    assert found >= 0.996 * pairs  # 0.998 but for chance


def test_jaccard_distinct(odd, odd_rows, nothing):
    kept = jaccard.distinct(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({i: 1 for i in (1, 2, 3, 6, 7, 8, 9, 11, 12, 13, 14, 15)} | {None: 2, 16: 2})
    assert jaccard.distinct(nothing).isEmpty() and jaccard.classes(nothing).isEmpty()


# 3 Substring dedup ----------------------------------------------------------------------


@pytest.mark.parametrize("hot", [5000, 1])
def test_substrings(sample, odd, hot, monkeypatch):
    """With a least hash counting as hot from two segments on, the other path is taken."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SEGMENT", 7 if hot == 1 else 512)
    for docs in (sample, odd):
        plain = [
            (d, len(w), len(gone), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
            for d, w, gone in brute.without_passages(texts_of(docs))
        ]
        got = rows_of(substrings.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(plain, key=repr)


def test_a_common_gram_is_spread(spark, monkeypatch):
    """Every least hash counts as too large for a shard: windows are indexed one by one."""
    monkeypatch.setattr(substrings, "HEAVY_BYTES", 0)
    header = " ".join(f"h{i}" for i in range(8))
    rows = [(i, f"{passage(100 + i // 3, 60)} {header} {passage(500 + i // 2, 60)}") for i in range(60)]
    plain = [(d, len(w), len(gone)) for d, w, gone in brute.without_passages(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(substrings.removed(docs), "doc_id", "n_words", "n_removed") == sorted(plain, key=repr)


def test_substrings_of_no_rows(nothing):
    assert substrings.digests(nothing).isEmpty()


# 4 BPE ----------------------------------------------------------------------------------


def test_bpe_is_that_of_the_library(monkeypatch):
    """With tiny leaves every join is exercised, over borders of any kind."""
    encode = brute.tokenizer()
    codec = bpe.Codec(bpe.read_ranks(brute.RANKS), PATTERN)
    parts = ["a", "b", " ", "  ", "'", "'s", "'l", "l", "\n", "\r\n", "é", "漢", "1", "²", "Ⅷ", "!", "　", "\x1c", "\x85", "the", "​", "\U0001f600", "ª"]
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rnd.choice("abcdeéthinons") for _ in range(rnd.randint(30, 600))) for _ in range(200)]
    texts += ["a" * 5000, " " * 3000, "é" * 999, "ab" * 2500 + " x"]
    texts += [f"a{chr(c)}b {chr(c)}1" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for leaf_chars, leaf_bytes in ((3, 2), (bpe.LEAF_CHARS, bpe.LEAF_BYTES)):
        monkeypatch.setattr(bpe, "LEAF_CHARS", leaf_chars)
        monkeypatch.setattr(bpe, "LEAF_BYTES", leaf_bytes)
        codec.remembered.clear()
        for text in texts:
            ids = codec.encode(text)
            assert ids.tolist() == encode(text), repr(text[:80])
            assert codec.decode(ids) == text.encode()


def test_bpe_decodes_by_halves(monkeypatch):
    codec = bpe.Codec(bpe.read_ranks(brute.RANKS), PATTERN)
    monkeypatch.setattr(bpe, "LEAF_TOKENS", 3)
    ids = codec.encode("one two three four five six seven eight")
    assert codec.decode(ids) == b"one two three four five six seven eight"
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]))


def test_bpe_of_tables(sample, odd, nothing):
    encode = brute.tokenizer()
    for docs in (sample, odd):
        got = rows_of(bpe.digests(docs, brute.RANKS, PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        assert got == sorted(brute.encoded(texts_of(docs), encode), key=repr)
    assert bpe.digests(nothing, brute.RANKS, PATTERN).isEmpty()


# 5 Decontamination ----------------------------------------------------------------------


def test_decontamination(spark, sample, odd, odd_rows, nothing):
    items = [
        (1, " ".join(odd_rows[0][1].split()[20:45])), (2, "one, TWO"), (2, "one, TWO"), (3, None), (4, "!!"), (None, "12 34"),
        (10, " ".join(odd_rows[2][1].split()[:10])), (9, "été"), (11, "no such words here at all in any of these documents"),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n_words", F.lit("x"))
    for docs in (odd, sample):
        got = rows_of(decontaminate.judged(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == sorted(brute.contaminated(texts_of(docs), items), key=repr)
    none = benchmark.limit(0)
    assert not decontaminate.judged(odd, none).filter("contaminated").count()
    assert decontaminate.judged(nothing, benchmark).isEmpty()
    clean = decontaminate.clean(odd, benchmark)
    assert clean.columns == odd.columns
    assert clean.count() == sum(not r[-1] for r in brute.contaminated([r[:2] for r in odd_rows], items))


def test_hits_are_extended_on_words(spark, monkeypatch):
    """A shared fingerprint is no hit: only what agrees around it decides, however many items have it."""
    gram = "one two three four five"
    items = [(i, f"{passage(700 + i, 5)} {gram} {passage(800 + i, 5)}") for i in range(40)] + [(50, f"seven {gram} eight")]
    rows = [(i, f"{passage(900, 20)} {passage(700 + i, 5)} {gram} {passage(800 + i + i % 2, 5)} end") for i in range(40)]
    rows += [(100, f"x {gram} y"), (101, f"{passage(703, 5)} {gram} {passage(804, 5)}"), (102, f"six seven {gram} eight nine")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.contaminated(rows, items), key=repr)
    for contexts in (1000, 0):
        monkeypatch.setattr(decontaminate, "CONTEXTS", contexts)
        assert rows_of(decontaminate.judged(docs, benchmark), *columns) == want
    # Without the extension, texts that share no more than a fingerprint would be hit.
    monkeypatch.setattr(decontaminate, "CONTEXTS", 1000)
    monkeypatch.setattr(decontaminate, "extended", lambda hits: hits.withColumns({"low": hits["start"], "high": hits["start"] + 5}))
    assert rows_of(decontaminate.judged(docs, benchmark), *columns) != want


# 6 WARC ---------------------------------------------------------------------------------


def test_warc(spark, nothing):
    html = "<p>" + "x" * 200
    pages = [
        (5, "http://a/5", html), (3, "http://a/3 \r\nX: y", html), (3, "http://a/3", html), (9, None, html), (None, "u", html),
        (1, "http://b", "short"), (2, "http://b", "short"), (4, "http://c", ""), (6, "http://c", None),
        (7, "http://d", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né" * 9), (8, "http://e", "z" * 3_000_000),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    monolithic = warc.write_monolithic(warc.with_originals(frame), archive_bytes=1000)
    normalised = warc.normalise(monolithic).cache()
    back = warc.read_records(normalised, warc.sidecar(normalised)).collect()
    want = []
    for page_id, _, text in pages:
        data = (text or "").encode()
        first = min(p for p, _, t in pages if t == text and p is not None) if len(data) >= 100 else None
        revisit = first is not None and (page_id is None or page_id > first)
        want.append((page_id, len(data), brute.sha(data), "revisit" if revisit else "response", first if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r["page_id"]: bytes(r["payload"]) for r in back if r["record_type"] == "response" and r["page_id"]} == {
        p: (t or "").encode() for p, _, t in pages if p in (1, 2, 3, 4, 6, 7, 8)
    }
    index = warc.sidecar(normalised).collect()
    data = {r["archive"]: bytes(r["data"]) for r in normalised.collect()}
    assert len(index) == len(pages) and len(data) > 1
    for row in index:  # every record is a member of its own
        member = data[row["archive"]][row["offset"] : row["offset"] + row["length"]]
        stream = zlib.decompressobj(31)
        assert stream.decompress(member).startswith(b"WARC/1.1\r\n") and stream.eof and not stream.unused_data
    again = warc.normalise(normalised.select("archive", "data"))  # members in a row are taken as well
    assert warc.sidecar(again).count() == len(pages)
    normalised.unpersist()


def test_a_cut_archive_is_an_error():
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = whole.compress(warc.record("n", 1, "u", b"x" * 500, "d", None)) + whole.flush()
    assert len(list(warc.split_records(warc.inflated(pa.py_buffer(data))))) == 1
    for cut in (10, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflated(pa.py_buffer(data[:cut]))))
    assert not list(warc.split_records(warc.inflated(pa.py_buffer(b""))))


def test_archives_as_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>one"), (2, "u", "<p>two")], "page_id bigint, url string, html string")
    archives, index = warc.archive(pages.coalesce(1))
    assert archives.columns == ["archive", "data"] and index.columns == ["archive", "record", "offset", "length"]
    one = warc.read_records(archives, index.filter("record = 1")).collect()  # only what the index is asked for
    assert [(r["page_id"], bytes(r["payload"])) for r in one] == [(2, b"<p>two")]
    (row,) = warc.save_files(archives, index, str(tmp_path)).collect()
    lines = open(row["path"].replace(".warc.gz", ".idx")).read().splitlines()
    assert lines == [f"{r['offset']} {r['length']}" for r in index.orderBy("record").collect()]
    assert warc.archive(pages.limit(0))[1].isEmpty()


# 7 Quality rules ------------------------------------------------------------------------


def test_quality_counts(odd, odd_rows, nothing):
    got = rows_of(quality_rules.judged(odd), "doc_id", *quality_rules.COUNTS, "base_failed")
    want = []
    for doc_id, text, *_ in odd_rows:
        counts, failed, _ = brute.quality(text, LIMITS)
        want.append((doc_id, *counts, failed))
    assert got == sorted(want, key=repr)
    assert quality_rules.judged(nothing).isEmpty() and quality_rules.keep(nothing).isEmpty()
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id", "text") == sorted(
        [(r[0], r[1]) for r in odd_rows if not brute.quality(r[1], LIMITS)[1]], key=repr
    )


def test_hosts_decide_soft_rules(spark):
    """A host with many symbol texts loses those, one with few keeps them; clean texts stay."""
    plain = " ".join(f"word{i}" for i in range(40))
    marked = plain + " # # # # # # #"
    rows = [(i, marked if i % 10 else plain, "noisy") for i in range(100)]
    rows += [(1000 + i, plain if i % 10 else marked, "fine") for i in range(100)]
    rows += [(2000 + i, "too short", "empty") for i in range(99)] + [(2099, plain, "empty")]
    rows += [(3000, marked, None), (3001, marked, "single")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.judged(docs).filter("kept").collect()}
    assert kept == {i for i in range(0, 100, 10)} | {1000 + i for i in range(100)} | {3000, 3001}


# 8 Toxicity -----------------------------------------------------------------------------


def test_toxicity(spark, odd, nothing):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    chain = toxicity.train(docs, labels.filter(~held))
    seen = toxicity.predict(docs, chain).join(labels.filter(held).withColumnRenamed("toxic", "truth"), "doc_id")
    counts = {(r["toxic"], r["truth"]): r["count"] for r in seen.groupBy("toxic", "truth").count().collect()}
    # Four in ten of the labelled toxic documents have nothing that others do not have.
    assert counts[True, 1] >= 0.55 * (counts[True, 1] + counts.get((False, 1), 0))
    assert counts.get((True, 0), 0) <= 0.003 * counts[False, 0]
    abused = docs.filter(F.lower("text").rlike(r"\b(idiot|moron|scum|worthless|pathetic)\b")).select("doc_id")
    found = toxicity.predict(docs, chain).join(abused, "doc_id").groupBy("toxic").count().collect()
    found = {r["toxic"]: r["count"] for r in found}
    assert found[True] >= 0.97 * sum(found.values())
    assert toxicity.predict(odd, chain).count() == odd.count()
    assert not toxicity.predict(odd, chain).filter("toxic").count()
    assert toxicity.toxicity(nothing, labels.limit(0)).isEmpty()


def test_a_chain_without_both_classes_is_constant(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {(r["p_low_quality"], r["p_toxic"]) for r in toxicity.toxicity(odd, labels).collect()}
    assert got == {(0.0, 0.0)}


# 9 Sharding -----------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [16, 3])
def test_shards(sample, odd, nothing, shards):
    for docs in (sample, odd):
        rows = sorted(
            ((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, d) for d, t in texts_of(docs))
        )
        total, before, want, slots = sum(r[3] for r in rows), 0, [], Counter()
        for _, _, crc, size, doc_id in rows:
            shard = (2 * before + size) * shards // (2 * total)
            want.append((doc_id, size, crc, "bytes", shard, slots[shard], None))
            before += size
            slots[shard] += 1
        columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
        for range_rows in (1_000_000, 7):
            assert rows_of(sharding.shard_by_bytes(docs, shards, range_rows), *columns) == sorted(want, key=repr)
    assert sharding.shard_by_bytes(nothing).isEmpty()


# 10 Language ----------------------------------------------------------------------------


def test_language(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in seen:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in seen if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    got = rows_of(language.identify(odd), "doc_id", "lang_pred")
    assert len(got) == odd.count()
    assert {d for d, p in got if p == "und"} == {None, 6, 7, 8, 16} and Counter(got)[None, "und"] == 1
    assert language.identify(nothing).isEmpty()
    assert {r["lang_pred"] for r in language.predict(odd, {}).collect()} == {"und"}
    assert {r["score"] for r in language.predict(odd.filter("doc_id = 1"), {"en": b"some words"}).collect()} == {1.0}


def test_languages_of_many_copies(spark):
    """The sample follows the different texts of a language, not its rows."""
    copied = [f"kopio {i} tekstistä" for i in range(5)]
    copies = spark.range(20_000).select("id", F.element_at(F.array(*map(F.lit, copied)), (F.col("id") % 5 + 1).cast("int")), F.lit("fi"))
    others = spark.range(1000).select("id", F.concat(F.lit("word "), "id"), F.lit("en"))
    found = language.learn(copies.union(others).toDF("doc_id", "text", "lang"))
    assert set(found["fi"].decode().split("\n")) == set(copied)
    assert len(set(found["en"].decode().split("\n"))) == language.SAMPLE_TEXTS


# Queries --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, name):
    con = check_oracles.duck(FOLDER)
    mine = check_oracles.normal(queries.QUERIES[name](spark, FOLDER).toPandas().astype(object))
    assert mine == check_oracles.normal(con.sql(oracle.SQL[name]).df().astype(object))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_large_sides_are_shuffled(spark, odd, odd_rows, monkeypatch):
    """What passes no size check is joined by a shuffle, with the same rows."""
    for module in (substrings, jaccard, decontaminate, quality_rules, warc, licenses):
        for name in ("small", "small_lists"):
            monkeypatch.setattr(module, name, lambda side, *_: side, raising=False)
    rows = texts_of(odd)
    got = rows_of(jaccard.classes(odd), "doc_id", "n_links", "class_id")
    assert got == sorted(brute.similar(rows), key=repr)
    got = rows_of(substrings.digests(odd), "doc_id", "n_words", "n_removed")
    assert got == sorted(((d, len(w), len(gone)) for d, w, gone in brute.without_passages(rows)), key=repr)
    items = [(1, " ".join(odd_rows[0][1].split()[20:45]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = rows_of(decontaminate.judged(odd, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contaminated(rows, items), key=repr)
    assert jaccard.distinct(odd).count() == 16
    assert quality_rules.keep(odd).count() == sum(not brute.quality(t, LIMITS)[1] for _, t in rows)
