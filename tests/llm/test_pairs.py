"""Operators on links between documents."""

import random

import numpy as np
import pytest

from quotemill.llm import common, decontam, graph, ngram_join, textkit

from . import fixtures as fx


@pytest.mark.parametrize("task_edges", [None, 0])
def test_components(spark, task_edges):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long"), task_edges).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "u long, v long"), task_edges).count() == 0


def test_bloom_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = common.SegmentedBloom(1 << 16, 8, 3)
    for b in range(8):
        f.place(b, f.segment_bytes(keys[keys >> np.uint64(61) == b], b))
    assert f.contains(keys).all() and f.contains(keys + np.uint64(12345)).mean() < 0.1


def test_key_blocks_round_trip():
    import pyarrow as pa

    toks = np.random.default_rng(2).integers(0, 1 << 63, 3000, dtype=np.uint64)
    toks = np.concatenate([toks, toks[:500]])
    got = []
    for rb in ngram_join.TokenKeys(4)(iter([pa.RecordBatch.from_arrays([pa.array([toks.tobytes()], pa.binary())], ["tokens"])])):
        b = rb.column(0)[0].as_py()
        k, c = ngram_join.unpack_keys(rb.column(1)[0].as_py(), b, 2)
        got += list(zip(k.tolist(), c.tolist(), strict=True))
    k, c = np.unique(toks >> np.uint64(24), return_counts=True)
    assert got == list(zip(k.tolist(), c.tolist(), strict=True))


def test_frequent_tokens_that_a_filter_has_room_for():
    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(4)
    toks = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    many = np.repeat(toks, rng.integers(1, 200, len(toks)))
    blob = next(ngram_join.TokenKeys(1)(iter([pa.RecordBatch.from_arrays([pa.array([many.tobytes()], pa.binary())], ["tokens"])]))).column(1)[0].as_py()
    _, counts = np.unique(many, return_counts=True)
    for bits, held in ((1 << 16, (counts > 16).sum()), (1 << 12, (1 << 12) // ngram_join.OFTEN_ENTRY)):
        out = ngram_join.TokenClasses(1, 1 << 18, bits, 16)(pd.DataFrame({"bucket": [0], "keys": [blob]}))
        often = ngram_join.filters(1, 1 << 18, bits)[1]
        often.place(0, out["often"].iloc[0])
        hit = often.contains(toks >> np.uint64(24) << np.uint64(24))
        assert 0.9 * held <= hit.sum() <= 1.2 * held + 40 and hit[np.argsort(counts)[-int(0.8 * held) :]].all()


@pytest.mark.parametrize("often,per_row,n,percent", [(16, 16, 4, 85), (2, 0, 4, 85), (1, 0, 5, 80)])
def test_join(spark, monkeypatch, often, per_row, n, percent):
    """With ``per_row`` 0 every group that the stars leave apart goes through blocks."""
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", per_row)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4 if often == 1 else 1000)
    monkeypatch.setattr(graph, "TASK_EDGES", 0 if often == 2 else 1000)
    rows = fx.families() + [r[:2] for r in fx.edge_rows() if r[0] not in (0, 1, 2, 3, 4, 5, 6, 7, 9, 10)]
    rows += [(1000 + (r[0] or 0), r[1]) for r in fx.edge_rows() if r[0] is not None]
    got = ngram_join.ngram_join(fx.frame(spark, rows), words_per_gram=n, percent=percent, rare_bits=1 << 16, often_bits=1 << 12, often=often).collect()
    want = fx.components(rows, n, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {**want, None: None}
    assert sorted(r.n_shingles for r in got) == sorted(len(fx.shingles(t, n)) for _, t in rows)


def test_join_of_nothing(spark):
    assert ngram_join.ngram_join(fx.frame(spark, [])).count() == 0
    one = ngram_join.ngram_join(fx.frame(spark, [(3, None), (4, ""), (5, "a")])).collect()
    assert sorted(map(tuple, one)) == [(3, 0, 3), (4, 0, 4), (5, 1, 5)]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 12))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.lcs(a, b) == t[-1, -1]


def _leaky(seed=4):
    rng = random.Random(seed)
    bench = [(i, fx.prose(rng, rng.randrange(15, 60), [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ra", "ne", "tis", "lom")])) for i in range(20)]
    bench += [(90, None), (91, ""), (92, fx.prose(rng, 200))]
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ra", "ne", "tis", "lom")]
    docs, leaks = [], set()
    for i in range(150):
        text = fx.prose(rng, rng.randrange(20, 400), words)
        if i % 3 == 0:
            item = rng.choice(bench[:20])
            w = item[1].split()
            if i % 2:
                w = [x for k, x in enumerate(w) if k % 9 != 4]  # a word in nine left out
            at = rng.randrange(len(text.split()))
            t = text.split()
            text = " ".join(t[:at] + [x.upper() if i % 4 == 0 else x for x in w] + t[at:])
            leaks.add((i, item[0]))
        docs.append((i, text))
    docs.append((700, bench[22][1]))
    leaks.add((700, 92))
    return docs, bench, leaks


def test_leaks(spark):
    docs, bench, leaks = _leaky()
    rows = [*docs, *docs[:9], (None, "nothing here"), (800, None), (801, "")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontam.find_leaks(fx.frame(spark, rows), items).collect()]
    got = set(found)
    assert len(found) == len(got)  # repeated rows are one document
    assert len(leaks & got) >= 0.9 * len(leaks) and len(got - leaks) <= 1, (leaks - got, got - leaks)
    assert decontam.find_leaks(fx.frame(spark, []), items).count() == 0
    assert decontam.find_leaks(fx.frame(spark, rows), items.limit(0)).count() == 0


def _judged(docs, bench):
    """(document, item) by the verdict on every stretch of every document, without candidates."""
    import pandas as pd
    import pyarrow as pa

    hashes = lambda t: np.concatenate([np.zeros(0, np.uint64), *[w.hashes for w in textkit.words(pa.array([t or ""]))]])
    found = set()
    cut = decontam.pieces(pd.DataFrame(bench, columns=["item_id", "text"]))
    for doc, text in docs:
        h = hashes(text)
        for item, _, piece in cut:
            for start in range(0, len(h), decontam.STEP):
                size = len(piece)
                reach = (size + 2 * decontam.STEP - 2) // decontam.STEP * decontam.STEP
                cover, answer = decontam.judge(piece, h[max(0, start - size) : start + reach + size])
                if cover >= decontam.COVER or (cover >= decontam.PARAPHRASE and answer):
                    found.add((doc, item))
                    break
    return found


def test_leaks_among_other_benchmark_words(spark):
    """No leak that the verdict accepts is lost before it, edited ones among words of other items included."""
    rng = random.Random(8)
    pool = [f"q{k}" for k in range(400)]
    bench = [(i, fx.prose(rng, rng.choice([12, 20, 33, 50]), pool)) for i in range(40)]
    docs = []
    for i in range(160):
        words = bench[i % 40][1].split()
        for k in rng.sample(range(len(words) - len(words) // 4 - 1), int((i // 40) * 0.1 * len(words))):
            words[k] = rng.choice(pool)
        docs.append((i, f"{fx.prose(rng, rng.randrange(20, 60), pool)} {' '.join(words)} {fx.prose(rng, rng.randrange(20, 60), pool)}"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(fx.frame(spark, docs), items).collect()}
    want = _judged(docs, bench)
    assert len(want) >= 150 and not want - got, (len(want), len(want - got))


def test_lookup():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 20, 200, dtype=np.uint64) << np.uint64(40), np.array([5, 5 + (1 << 60), 5 + (1 << 61)], np.uint64)]))
    absent = np.setdiff1d(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), keys + np.uint64(1)]), keys)
    find = decontam.Lookup(keys)
    assert (find(keys) == np.arange(len(keys))).all() and (find(absent) == -1).all() and len(find.levels) > 1
    alike = decontam.Lookup(np.arange(3, dtype=np.uint64) << np.uint64(63))  # what no table tells apart is compared
    assert decontam.Lookup(np.zeros(0, np.uint64))(keys).max() == -1 and len(alike.keys) == 3


def test_slices_and_trees_change_nothing(spark, monkeypatch):
    docs, bench, _ = _leaky(5)
    items = spark.createDataFrame(bench, "item_id long, text string")
    find = lambda: sorted((r.doc_id, r.item_id, round(r.cover, 6), r.answer) for r in decontam.find_leaks(fx.frame(spark, docs).repartition(7), items).collect())
    want = find()
    for name, value in (("SLICE_CELLS", 8), ("SLICE_PASSAGES", 3), ("SLICE_HITS", 2), ("FAN_IN", 2)):
        monkeypatch.setattr(decontam, name, value)
    assert find() == want and len(want) > 40


def test_answer_check():
    piece = np.arange(20)
    assert decontam.judge(piece, np.concatenate([piece[:8], piece[14:]])) == (14 / 20, True)
    assert decontam.judge(piece, piece[:13])[1] is False
