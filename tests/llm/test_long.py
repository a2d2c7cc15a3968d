"""One text of 50 MB among short ones, through every operator."""

import random

import numpy as np
import pytest

from quotemill.llm import decontam, exact_dedup, langid, licenses, lm_bloom, mixing, ngram_join, shards, token_records, unit_dedup

from . import fixtures as fx

WORDS = 7_000_000


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    pool = np.array([f"word{k:x}" for k in range(20_000)])
    words = pool[rng.integers(0, len(pool), WORDS)]
    words[17::40] = np.char.add(words[17::40], ".")
    long = " ".join(words.tolist())
    assert len(long) > 50_000_000
    small = random.Random(2)
    rows = [(i, fx.prose(small, 60), "en", "a") for i in range(20)]
    tail = " ".join(words[-200:-100].tolist())
    rows += [(100, long, "en", "b"), (101, f"before {tail} after", "en", "a"), (102, "all rights reserved", "en", "a")]
    path = str(tmp_path_factory.mktemp("long") / "docs")
    fx.frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path), long, tail


def test_language(docs):
    got = {r.doc_id: r for r in langid.predict_language(docs[0]).collect()}
    assert len(got) == 23 and got[100].lang_pred == "en" and langid.keep_placed(docs[0]).count() >= 22


def test_scores(docs):
    got = {r.doc_id: r for r in lm_bloom.lm_scores(docs[0]).collect()}
    assert got[100].n_tokens == WORDS + 1 and got[100].n_known == WORDS + 1 and got[100].score < 0


def test_shards(docs):
    got = {r.doc_id: r for r in shards.extendible_shards(docs[0], limit_bytes=1 << 20).select("doc_id", "shard", "shard_bytes").collect()}
    assert got[100].shard_bytes == len(docs[1]) + 32 and sum(r.shard == got[100].shard for r in got.values()) == 1


def test_repeats(docs):
    got = [r for r in unit_dedup.repeated_spans(docs[0], min_words=50).collect() if r.doc_id == 101]
    assert len(got) == 1 and got[0].keep_doc_id == 100 and got[0].n_words >= 90


def test_join(docs):
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs[0]).collect()}
    assert got[100].component_id == 100 and got[100].n_shingles > 0.99 * WORDS


def test_leaks(spark, docs):
    items = spark.createDataFrame([(1, docs[2]), (2, "nothing of this is there at all " * 3)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs[0], items).collect()} == {(100, 1), (101, 1)}


def test_records(spark, docs, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    got = {r.doc_id: r for r in token_records.token_records(docs[0], tokenizers.path("word_bpe_49k.json"), out=f"file://{tmp_path}").collect()}
    assert len(got) == 23 and got[100].n_tokens > WORDS


def test_exact(docs):
    got = {r.doc_id: r for r in exact_dedup.grace_dedup(docs[0].unionByName(docs[0].where("doc_id = 100"))).collect()}
    assert got[100].group_size == 2 and got[101].group_size == 1


def test_mix(docs):
    got = {r.doc_id: r for r in mixing.mix_sources(docs[0], columns=["doc_id"]).collect()}
    assert got[100].n_tokens == WORDS


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs[0]).collect()}
    assert got[100].n_words == WORDS and got[102].n_base == 1
