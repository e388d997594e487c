"""The pipeline against brute force, and its stages on odd and empty tables."""

from __future__ import annotations

import public_tokenizers
import tiktoken  # noqa: F401  the library whose ids are expected

import llm_brute as brute
import check_oracles
import corpus_pipeline
from tillhouse.llm import oracle

FOLDER = "/root/testdata/sf0.001"


def read_again(spark, frame, path):
    frame.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_run_equals_brute_force(spark, sample):
    con = check_oracles.duck(FOLDER)
    kept = {r[0] for r in con.sql(f"WITH {oracle.QUALITY} SELECT doc_id FROM judged WHERE kept").fetchall()}
    rows = [(r["doc_id"], r["text"]) for r in sample.collect() if r["doc_id"] in kept]
    rows = [r for r, (doc_id, _, least) in zip(rows, brute.similar(rows)) if doc_id == least]
    texts = dict(rows)
    rows = []
    for doc_id, words, gone in brute.without_passages(list(texts.items())):
        if len(gone) < len(words):
            rest = " ".join(w for i, w in enumerate(words) if i not in gone)
            rows.append((doc_id, rest if gone else texts[doc_id]))
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, found in zip(rows, brute.contaminated(rows, items)) if not found[-1]]
    assert 0 < len(rows) < len(texts) < len(kept) < sample.count()
    encode = brute.tokenizer()
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(
        brute.encoded(rows, encode)
    )
    assert {r["doc_id"]: r["ids"] for r in got} == {d: encode(t) for d, t in rows}


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = read_again(spark, stage(spark, docs, FOLDER), tmp_path / name)
        if i < 4:
            assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
        assert 0 < docs.count() <= before.count()
    assert {r["doc_id"] for r in docs.collect()} >= {1, 2, 3, 11, 16, None}


def test_passages_change_only_what_repeats(spark, odd, tmp_path):
    before = {(r["doc_id"], r["text"]) for r in odd.collect()}
    _, stage = corpus_pipeline.STAGES[2]
    after = read_again(spark, stage(spark, odd, FOLDER), tmp_path / "out").collect()
    changed = {r["doc_id"]: r for r in after if (r["doc_id"], r["text"]) not in before}
    assert set(changed) == {2, 5, 17}
    assert changed[5]["text"] == "other" and changed[17]["text"] == "more"
    assert changed[2]["n_chars"] == len(changed[2]["text"]) and "w1x" not in changed[2]["text"]
    # Copies of whole documents are gone, as is a text that another begins with.
    assert {r["doc_id"] for r in odd.collect()} - {r["doc_id"] for r in after} == {4, 12}


def test_stages_on_no_rows(spark, nothing, tmp_path):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = read_again(spark, stage(spark, docs, FOLDER), tmp_path / name)
        assert docs.isEmpty()


def test_stages_are_those_agreed():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken").endswith(".tiktoken")
