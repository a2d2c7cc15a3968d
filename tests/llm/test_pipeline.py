"""The corpus pipeline."""

import random

import pytest

from . import fixtures as fx
from .test_pairs import _leaky

pipeline = pytest.importorskip("corpus_pipeline")


def _written(spark, tmp_path, rows, bench, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline(spark, tmp_path):
    docs, bench, leaks = _leaky(6)
    rng = random.Random(9)
    base = [(1000 + i, fx.prose(rng, 60)) for i in range(10)]
    near = [(2000 + i, t.replace(" ", "  ") + " end") for i, (_, t) in enumerate(base[:5])]
    odd = [(3000, None), (3001, "1 2 3"), (3002, "")]
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t or "")) for i, t in docs + base + near + odd]
    out = pipeline.run(spark, _written(spark, tmp_path, rows, bench)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {3000, 3001, 3002}
    comp = fx.components([(i, t) for i, t, *_ in rows if i < 3000], 5, 80)
    heads = {i for i, c in comp.items() if i == c}
    assert ids <= heads and len(heads - ids - {i for i, _ in leaks}) <= 1
    assert len(ids & {i for i, _ in leaks}) <= 0.1 * len(leaks)
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "shard", "shard_depth", "shard_bytes"}


def test_null_ids_and_repeated_rows(spark, tmp_path):
    """Rows are judged by id and text, whatever else they hold; labels are absent, so all texts with letters are placed."""
    rng = random.Random(4)
    items = [(i, fx.prose(rng, 25, [f"b{i}x{k}" for k in range(25)])) for i in range(4)]
    text = {k: fx.prose(rng, 60, [f"{k}{j}" for j in range(80)]) for k in "abcdefg"}
    rows = [
        (1, text["a"]), (1, text["a"]), (None, text["a"]),  # repeated, and a copy without an id
        (None, text["b"]), (None, text["b"]),  # repeated without an id
        (2, text["c"] + " " + items[0][1]), (None, text["d"] + " " + items[1][1]), (None, text["d"] + " " + items[1][1]),  # leaks
        (3, text["e"]), (3, text["f"] + " " + items[2][1]),  # one id, two texts, one of them a leak
        (4, text["g"]), (5, text["g"]), (6, None), (7, "12 3"), (None, None), (None, ""),
    ]
    columns = "doc_id long, text string, lang string, source string, copies int, n_tokens string, shard string, score double, first string, key long"
    sf = _written(spark, tmp_path, [(*r, None, "s" if i % 2 else None, 7, "n", "x", 0.5, "f", i) for i, r in enumerate(rows)], items, columns)
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, sf), name)
        seen[name] = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
        if name != "shard":
            assert docs.columns == [c.split()[0] for c in columns.split(", ")] and {(r.copies, r.n_tokens, r.first) for r in docs.collect()} == {(7, "n", "f")}
    assert seen["language_id"] == sorted((i or 0, t) for i, t in rows if any(c.isalpha() for c in t or ""))
    assert [x for x in seen["ngram_jaccard"]] == sorted([(1, text["a"]), (0, text["b"]), (2, rows[5][1]), (0, rows[6][1]), (3, text["e"]), (3, rows[9][1]), (4, text["g"])])
    assert seen["decontaminate"] == sorted([(1, text["a"]), (0, text["b"]), (3, text["e"]), (4, text["g"])])
    assert set(seen["mix"]) == set(seen["decontaminate"]) and seen["shard"] == seen["mix"]


def test_nothing(spark, tmp_path):
    sf = _written(spark, tmp_path, [], [])
    out = pipeline.run(spark, sf)
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "text", "lang"]
