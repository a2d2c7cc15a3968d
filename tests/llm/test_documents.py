"""Operators on single documents and groups of equal ones."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from quotemill.llm import exact_dedup, langid, licenses, lm_bloom, mixing, shards, textkit, token_records

from . import fixtures as fx

VOCABULARY = "word_bpe_49k.json"


def test_words_of_a_batch():
    import pyarrow as pa

    texts = ["A b\x0bC", None, "", " zz  Zz ", "é É x"]
    got = [len(x) for w in textkit.words(pa.array(texts), limit=4) for x in np.split(w.hashes, w.bounds[1:-1])]
    assert got == [len(fx.split(t)) for t in texts]
    w = next(textkit.words(pa.array(["Ab ab AB é É"])))
    assert w.hashes[0] == w.hashes[1] == w.hashes[2] != w.hashes[3] != w.hashes[4] and textkit.hash_word(b"aB") == w.hashes[0]


@pytest.mark.parametrize("limit", [64 << 20, 100])
def test_exact(spark, limit):
    rows = fx.edge_rows()
    got = exact_dedup.grace_dedup(fx.frame(spark, rows), table_bytes=limit, partitions=2).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(fx.SPACE, " ", t or ""), []).append(i)
    want = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            want.append((i, keep, len(ids), i == keep and first, hashlib.sha256(body.encode()).hexdigest()))
            first = first and i != keep
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert exact_dedup.grace_dedup(fx.frame(spark, [])).count() == 0


def test_open_addressing_compares_contents():
    t = exact_dedup.ContentTable(1 << 20, size=4)
    for i in range(50):
        body = b"%d" % i
        e, at = t.find(5, body)
        assert e == -1 and t.add(5, body, at) == i
    assert [t.find(5, b"%d" % i)[0] for i in range(50)] == list(range(50))


def test_records(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(VOCABULARY)
    rows = fx.edge_rows() + [(11, "<|endoftext|> it's 3.14 don't ÀÉ naïve ́x y"), (12, "x" * 5000)]
    got = token_records.token_records(fx.frame(spark, rows), path, out=f"file://{tmp_path}/o", files=3).collect()
    tok, start, want = Tokenizer.from_file(path), 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert [tuple(r[:4]) for r in sorted(got, key=key)] == want
    part = sorted((tmp_path / "o/records").glob("part-*"))[-1].read_bytes()
    assert all(token_records.unpack(p)[1][-1] == 2 for _, _, p in token_records.frames(part))
    for at in (3, 20, len(part) - 3):
        with pytest.raises(ValueError):
            list(token_records.frames(part[:at] + bytes([part[at] ^ 1]) + part[at + 1 :]))
    with pytest.raises(ValueError):
        list(token_records.frames(part[:-1]))
    assert token_records.token_records(fx.frame(spark, []), path).count() == 0


def test_masked_checksum():
    raw = struct.pack("<Q", 5)
    c = zlib.crc32(raw)
    assert token_records.masked_crc(raw) == (((c >> 15) | (c << 17)) + 0xA282EAD8) % (1 << 32)
    big = np.array([70_000, 2], np.uint32)
    assert token_records.unpack(token_records.pack(None, big))[0] is None and (token_records.unpack(token_records.pack(7, big))[1] == big).all()


@pytest.mark.parametrize("limit", [1 << 30, 700, 120])
def test_shards(spark, limit):
    rng = random.Random(2)
    rows = [(i, fx.prose(rng, rng.randrange(0, 30))) for i in range(120)] + [(None, "null id"), (500, None)] + [(900, "one key " * 9)] * 30
    out = shards.extendible_shards(fx.frame(spark, rows), limit_bytes=limit).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in out) == sorted((i or -1, t or "") for i, t in rows)
    held = {}
    for r in out:
        held.setdefault((r.shard, r.shard_bytes), []).append(len((r.text or "").encode()) + 32)
        assert len(r.shard) == r.shard_depth
    assert all(sum(v) == n and (n <= limit or len(v) == 1) for (_, n), v in held.items())
    names = sorted(s for s, _ in held)
    assert len(set(names)) == len(names) and not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    # only buckets over the limit were split: a shard and its sibling together do not fit
    total = lambda p: sum(n for s, n in held if s.startswith(p))
    assert all(total(s[:-1]) > limit for s, _ in held if s)
    assert shards.extendible_shards(fx.frame(spark, [])).count() == 0
    plan = shards.extendible_shards(fx.frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _languages(n, seed):
    rng = random.Random(seed)
    stems = {"aa": ["kar", "tol", "min", "sah"], "bb": ["ßen", "über", "ich", "sch"], "cc": ["ción", "ado", "ñe", "que"]}
    rows = []
    for i in range(n):
        lang = sorted(stems)[i % 3]
        words = [a + b for a in stems[lang] for b in stems[lang]]
        rows.append((i, fx.prose(rng, rng.choice([1, 3, 20, 80]), words), lang))
    return rows


def test_language(spark):
    rows = _languages(400, 1) + [(1000, None, "aa"), (1001, "12 — !", "aa"), (None, "karkar tolmin", None), (1003, "", None)]
    got = {r.doc_id: r for r in langid.predict_language(fx.frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    held = [(got[i].lang_pred == lang) for i, _, lang in rows[:400] if got[i].held_out]
    assert len(held) > 50 and np.mean(held) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1003)] == ["und"] * 3 and got[1000].score == 0 and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = rows + rows[:3] + [(None, "", None), (None, "karkar tolmin sahsah minkar", None)]
    alike = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict_language(fx.frame(spark, odd)).collect() if r.doc_id in {x[0] for x in rows[:3]}]
    assert len(alike) == 6 and len(set(alike)) == 3
    kept = langid.keep_placed(fx.frame(spark, odd))
    assert kept.columns == fx.frame(spark, odd).columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert {1000, 1001, 1003}.isdisjoint(i for i, _ in left) and len(left) >= 0.99 * (len(odd) - 4)
    assert langid.keep_placed(fx.frame(spark, odd), placed=2.0).count() == 0
    one = [(i, "Ein Satz aus Worten", "de") for i in range(9)] + [(20, "文字文字", None), (21, "Worten", None)]
    assert {r.doc_id for r in langid.keep_placed(fx.frame(spark, one)).collect()} == {*range(9), 21}
    assert sum(i in {r[0] for r in rows[:3]} for i, _ in left) == 6 and (None, "karkar tolmin sahsah minkar") in left
    # without any label that could be learned, all texts with a letter stay
    bare = [(i, t, None) for i, t, *_ in odd]
    assert langid.keep_placed(fx.frame(spark, bare)).count() == sum(any(c.isalpha() for c in t or "") for _, t, _ in bare)
    assert langid.keep_placed(fx.frame(spark, [])).count() == 0
    nothing = langid.predict_language(fx.frame(spark, [(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert langid.predict_language(fx.frame(spark, [])).count() == 0


def _folded(text):
    import re

    return re.sub(rb"[^a-z\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def _gram_set(text):
    x = _folded(text)
    return {x[i : i + n] for n in langid.LENGTHS for i in range(len(x) - n + 1)}


def test_kernel_equals_brute_force(monkeypatch):
    texts = [t for _, t, _ in _languages(30, 3)] + ["A b", "é!"]
    m = langid.fit(texts, ["a", "b", "c"] * 10 + ["a", "c"], landmarks=200)
    cut = langid._flat([t.encode() for t in texts])
    k = m.kernel(*cut)
    sets = [_gram_set(t) for t in texts]
    order = [i for y in "abc" for i in np.flatnonzero(np.array(["a", "b", "c"] * 10 + ["a", "c"]) == y)]
    want = np.array([[len(x & sets[z]) / np.sqrt(len(x) * len(sets[z])) for z in order] for x in sets])
    # landmarks come in random order within a label; n-grams share slots now and then
    assert np.allclose(np.sort(k, 1), np.sort(want, 1), atol=0.03) and k.min() >= 0 and k.max() <= 1.0001
    monkeypatch.setattr(langid, "SLICE", 7)
    assert np.allclose(m.kernel(*cut), k) and all(len(langid.gram_set(np.frombuffer(t.encode(), np.uint8))) >= 0.98 * len(s) for t, s in zip(texts, sets, strict=True))
    dense = np.arange(langid.SLOTS, dtype=np.int32)[::2]
    assert (langid._unpacked(langid._packed(dense)) == dense).all() and len(langid._packed(dense)) == langid.SET_BYTES
    assert (langid._unpacked(langid._packed(dense[:9])) == dense[:9]).all()


def test_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 3)
    with pytest.raises(ValueError):
        langid.predict_language(fx.frame(spark, [(i, "some text", f"l{i}") for i in range(40)]))
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 6)
    base = fx.frame(spark, [(i, f"text {i}", "en" if i % 2 else "de") for i in range(400)] + [(7, "text 7", "en")] * 200).withColumn("held_out", langid.F.lit(False))
    got = langid.training_sample(base, 400)
    assert sum(part == 0 for _, part, _ in got) == 6 and {y for y, _, _ in got} == {"en", "de"}


def _lm_reference(rows):
    import math
    from collections import Counter

    toks = [(i, [*fx.split(t), None]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, v in toks if not held(i) for w in v)
    n, v = sum(c.values()), len(c)
    return n, [(i, held(i), len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in toks]


@pytest.mark.parametrize("top", [1 << 18, 3])
def test_lm(spark, top):
    rng = random.Random(5)
    rows = [r[:2] for r in fx.edge_rows()] + [(20 + i, fx.prose(rng, 50) + f" odd{i}") for i in range(60)]
    got = lm_bloom.lm_scores(fx.frame(spark, rows), top_words=top).collect()
    n, want = _lm_reference(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == n and abs(g[5] - w[4]) < 1e-9 * max(1, abs(w[4])) and g[6] < 0
    assert lm_bloom.lm_scores(fx.frame(spark, [])).count() == 0
    alone = lm_bloom.lm_scores(fx.frame(spark, [(i, "" if i % 2 else None) for i in range(40)])).collect()
    assert all(r.score <= 0 and r.n_tokens == r.n_known == 1 for r in alone)


def test_filter_holds_levels():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) >> np.uint64(24) << np.uint64(24))
    counts = rng.integers(1, 3000, len(keys))
    import pandas as pd

    buckets, bits = 4, 1 << 20
    bloom = lm_bloom.SegmentedBloom(bits, buckets, lm_bloom.HASHES)
    for b in range(buckets):
        own = (keys >> np.uint64(62)) == b
        if own.any():
            pdf = pd.DataFrame({"kind": [0], "bucket": [b], "keys": [keys[own].tobytes()], "counts": [counts[own].astype(np.uint32).tobytes()]})
            bloom.place(b, lm_bloom.Segment(buckets, bits)(pdf)["segment"].iloc[0])
    found = lm_bloom.lookup(bloom, keys)
    level = np.where(found > 1, np.round(np.log2(np.maximum(found, 1) / 1.4)) + 1, found)
    assert (level >= lm_bloom.levels(counts)).all() and (level == lm_bloom.levels(counts)).mean() > 0.97
    assert (lm_bloom.lookup(bloom, keys + np.uint64(1 << 30)) == 0).mean() > 0.95


def _lm_exact_scores(rows):
    """Scores from exact counts, quantised as the filter does."""
    import math
    from collections import Counter

    toks = {i: [*t.split(), None] for i, t in rows}
    c = Counter()
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(tuple(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1))
    total, kinds = (f([x for g, x in c.items() if len(g) == 1]) for f in (sum, len))

    def q(*g):
        level = c[g].bit_length()
        return 1.4 * 2.0 ** (level - 1) if level > 1 else level

    out = {}
    for i, t in toks.items():
        score = 0
        for k in range(len(t)):
            p = (q(t[k]) + 0.1) / (total + 0.1 * (kinds + 1))
            for n in range(2, min(3, k + 1) + 1):
                found = q(*t[k - n + 1 : k + 1])
                p = (found + lm_bloom.STRENGTH[n] * p) / (max(q(*t[k - n + 1 : k]), found) + lm_bloom.STRENGTH[n])
            score += math.log10(p)
        out[i] = score / len(t)
    return out


def test_lm_scores_of_a_filled_filter(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(3000)]
    body = [fx.prose(rng, 200, vocabulary) for _ in range(700)]
    rows = list(enumerate(body * 2))
    got = {r.doc_id: r.score / r.n_tokens for r in lm_bloom.lm_scores(fx.frame(spark, rows)).collect()}
    want = _lm_exact_scores(rows)  # texts held out whose copy is not have pairs and triples seen once
    off = {held: np.mean([abs(got[i] - want[i]) for i in want if (zlib.crc32(str(i).encode()) % 10 == 0) == held]) for held in (True, False)}
    assert max(off.values()) < 0.05, off


def test_segment_follows_its_entries():
    import pandas as pd

    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 62, 300_000, dtype=np.uint64))
    counts = rng.integers(1, 40, len(keys))
    absent = rng.integers(0, 1 << 62, 100_000, dtype=np.uint64)
    pdf = pd.DataFrame({"chunk": [7, 8], "kind": [0, 3], "bucket": 0, "keys": [keys.tobytes(), absent.tobytes()], "counts": [counts.astype(np.uint32).tobytes(), b""]})
    out = lm_bloom.Segment(4)(pdf)
    own, other = (np.frombuffer(x, np.uint8) for x in out["levels"][1:])
    assert out["chunk"].tolist() == [-1, 7, 8] and own.max() == lm_bloom.levels(counts).max()
    assert (own == lm_bloom.levels(counts)).mean() > 0.97 and (other == 0).mean() > 0.97
    full = lm_bloom.SegmentedBloom(64, 1, lm_bloom.HASHES, np.full(8, 255, np.uint8))
    assert lm_bloom.probe(full, keys, 5).max() == 5


def test_a_large_bucket_takes_little_memory():
    """A bucket is worked off in pieces: beside its keys and rows, memory does not follow its size, and nothing of it is left out."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    blobs, counts, chunks = [], [], []
    for chunk in range(24):
        keys = np.unique(rng.integers(0, 1 << 62, 150_000, dtype=np.uint64) | np.uint64(1) << np.uint64(62))
        own = rng.integers(1, 40, len(keys))
        for kind in (0, 1, 3, 4):
            part = keys if kind % 3 == 0 else np.unique(keys >> np.uint64(24))
            if kind % 3:
                steps = np.diff(part, prepend=np.uint64(1 << 38))
                assert steps.max() < 1 << 32
                head, many = [len(part), 0, len(part)], [np.arange(len(part)), own[: len(part)]]
                blobs.append(b"".join(np.asarray(x).astype(np.uint32).tobytes() for x in (head, steps, *many)))
                counts.append(b"")
            else:
                blobs.append(part.tobytes())
                counts.append(own.astype(np.uint32).tobytes() if kind == 0 else b"")
            chunks.append((chunk, kind))
    pdf = pd.DataFrame({"chunk": [c for c, _ in chunks], "kind": [k for _, k in chunks], "bucket": 1, "keys": blobs, "counts": counts})
    tracemalloc.start()
    out = lm_bloom.Segment(4)(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = np.concatenate([np.frombuffer(x, np.uint64) for x, (_, k) in zip(blobs, chunks, strict=True) if k == 0])
    told = np.concatenate([np.frombuffer(x, np.uint32) for x in counts])
    order = np.argsort(words)
    assert (np.frombuffer(out["hashes"][0], np.uint64) == words[order]).all() and (np.frombuffer(out["counts"][0], np.int64) == told[order]).all()
    assert out["n"][0] == told.sum() and out["v"][0] == len(words)
    for (_, kind), blob, found in zip(chunks, pdf["counts"], out["levels"][1:], strict=True):
        if kind == 0:
            assert (np.frombuffer(found, np.uint8) >= lm_bloom.levels(np.frombuffer(blob, np.uint32))).all()
    n = sum(len(x) for x in out["levels"])
    assert n > 14_000_000 and peak < 40 * n


def _entropy(w):
    w = w[w > 0]
    return -(w * np.log(w)).sum()


def test_mixing_plan():
    t = np.array([9000, 500, 400, 0])
    of = lambda budget=10_000, limit=None, **k: mixing.plan(mixing.Shares.of(t), repeat_limit=limit, budget=budget, **({"entropy_gap": None} | k))
    w = lambda m: m.weight(t, 9000)
    m = of(entropy_share=0.9)
    assert abs(_entropy(w(m)) - 0.9 * np.log(3)) < 1e-9 and w(m)[3] == 0 and abs(w(m).sum() - 1) < 1e-12 and m.met and 0 < m.exponent < 1
    natural = _entropy(t / t.sum())
    m = of(entropy_gap=0.5)
    assert abs(_entropy(w(m)) - (natural + np.log(3)) / 2) < 1e-9 and 0 < m.exponent < 1
    m = of(entropy_share=0.1)
    assert abs(_entropy(w(m)) - 0.1 * np.log(3)) < 1e-9 and m.exponent > 1 and m.met
    m = of(entropy_share=0.99, limit=2.0)
    assert (w(m)[:3] * 10_000 <= 2 * t[:3] * 1.0001).all() and (w(m)[:3] * 10_000 / t[:3]).max() > 1.999 and not m.met
    m = of(entropy_share=0.1, limit=1.05)
    assert (w(m)[:3] * 10_000 / t[:3]).max() <= 1.0501 and m.exponent > 1 and not m.met
    m = of(None, 4.0, entropy_share=0.9)
    budget = np.floor(w(m) * m.total * (1 + 1e-9))
    assert (budget >= t).all() and (budget[:3] <= 4.001 * t[:3]).all()
    assert of(100_000, 2.0, entropy_share=0.9).exponent == 1.0  # ten passes over everything: no weights keep the limit
    alike = mixing.plan(mixing.Shares.of(np.array([5, 5, 5])), None, 0.5, None, 10)
    assert alike.exponent == 1.0 and not alike.met
    assert mixing.plan(mixing.Shares.of(np.array([0, 0])), 0.5, None, 1.0, 10).met
    with pytest.raises(ValueError):
        of(entropy_share=1.5)


def test_mixing_of_many_sources_is_the_same(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, fx.prose(rng, rng.randrange(1, 9)), "en", f"s{rng.randrange(1, 30) ** 2 // 30}") for i in range(300)]
    want = {r.doc_id: (r.copies, round(r.source_weight, 9)) for r in mixing.mix_sources(fx.frame(spark, rows), columns=["doc_id"]).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert {r.doc_id: (r.copies, round(r.source_weight, 9)) for r in mixing.mix_sources(fx.frame(spark, rows)).collect()} == want
    assert len({c for c, _ in want.values()}) > 1


@pytest.mark.parametrize("share", [1.0, 0.4, None])
def test_mixing(spark, share):
    rng = random.Random(3)
    rows = [(i, fx.prose(rng, rng.randrange(0, 40)), "en", rng.choice("aaaaaaab") + "" if i % 11 else rng.choice("cd")) for i in range(300)] + [(900, None, None, None), (None, "some words", None, "a"), (5, "again here", None, "a")]
    out = mixing.mix_sources(fx.frame(spark, rows), budget_share=share, block_tokens=100).collect()
    assert len(out) == len(rows) and all(r.n_tokens == len(fx.split(r.text)) for r in out)
    read, most = {}, {}
    for r in out:
        k = r.source or ""
        read[k] = read.get(k, 0) + r.copies * r.n_tokens
        most[k] = max(most.get(k, 0), r.n_tokens)
        if r.source_tokens:
            assert r.source_budget // r.source_tokens <= r.copies <= r.source_budget // r.source_tokens + 1
    for r in out:
        k = r.source or ""
        assert read[k] <= r.source_budget and (r.source_budget - read[k] < 2 * max(most[k], 1) or not r.source_tokens)
    if share is None:
        assert all(r.copies >= 1 for r in out)
    elif share == 1.0:
        assert len({r.copies for r in out if r.n_tokens}) > 1 and all(r.target_met for r in out)
    # of a part of a pass: whole blocks in their order, and of the last one rows in theirs
    for src in {r.source for r in out if r.source_tokens}:
        own = sorted((r.mix_block_key, r.mix_row_key, r.copies) for r in out if r.source == src)
        assert [c for *_, c in own] == sorted((c for *_, c in own), reverse=True)
    again = mixing.mix_sources(fx.frame(spark, rows[::-1]), budget_share=share, block_tokens=100).collect()
    assert sorted((r.doc_id or -1, r.copies) for r in again) == sorted((r.doc_id or -1, r.copies) for r in out)
    x = mixing.mix_sources(fx.frame(spark, rows), budget_share=share, block_tokens=100)
    assert mixing.realise(x, ["doc_id"]).count() == sum(r.copies for r in out)
    assert mixing.mix_sources(fx.frame(spark, [])).count() == 0


def test_licenses(spark):
    rows = fx.edge_rows() + [
        (20, "Licensed under CC BY-NC 4.0. CC BY"), (21, "GNU General Public License, and general  public\nlicense. All rights\treserved"), (22, "cc, by; all rights not reserved ccby"),
        (23, "Released under the MIT License."), (24, "the Apache License, Version 2.0"), (25, "apache license version 3 0"), (26, "écc by cc by"), (27, "license public general rights all reserved by cc"),
        (28, "SPDX-License-Identifier: MIT"), (29, "SPDX-License-Identifier: Apache-2.0"),
    ]
    got = {}
    for r in licenses.scan_licenses(fx.frame(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.lower(t))
        places = [(k, p.label) for p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.words())] == p.words()]
        r = got[i]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), (i, r)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[20].labels == "cc-by,cc-by-nc" and got[23].labels == "mit" and got[24].labels == "apache-2.0" and got[24].score == 1
    assert got[25].labels == "" and got[27].labels == "" and got[0].score == 0 and got[28].labels == "mit" and got[29].labels == "apache-2.0"
    assert licenses.scan_licenses(fx.frame(spark, [])).count() == 0
    plan = licenses.scan_licenses(fx.frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_bodies(spark):
    """Bodies among other words, with words changed, left out and put in: found as long as their key phrases stand."""
    rng = random.Random(2)
    filler = [f"fill{k}" for k in range(60)]
    bodies = [t for t in licenses.MORE if t.keys and len(t.words()) >= 12]
    rows, want = [], {}
    for i, t in enumerate(bodies):
        w = re.sub(r"[^\w]+", " ", t.text).split()
        rows.append((3 * i, " ".join(rng.choices(filler, k=9) + w + rng.choices(filler, k=5))))
        want[3 * i] = t.label
        key = t.phrases()[0]
        at = next(k for k in range(len(w)) if [x.lower() for x in w[k : k + len(key)]] == key)
        broken = w[:at] + ["other"] + w[at + 1 :]  # a key phrase that is not whole
        rows.append((3 * i + 1, " ".join(broken)))
        moved = w[: at] + ["put", "in"] + w[at:]
        rows.append((3 * i + 2, " ".join(moved)))
    got = {r.doc_id: r for r in licenses.scan_licenses(fx.frame(spark, rows), templates=tuple(bodies)).collect()}
    assert len(bodies) >= 12
    for i, label in want.items():
        assert label in got[i].labels.split(",") and got[i].score >= 0.999, (label, got[i])
        assert label not in got[i + 1].labels.split(","), (label, got[i + 1])
        assert label in got[i + 2].labels.split(","), (label, got[i + 2])


def test_licenses_of_any_number_of_templates(spark):
    """The same as the SQL says, and a plan that does not grow."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    pool = [f"{a}{b}" for a in "bcdfg" for b in ("ra", "ne", "tis", "lom", "um", "ves")]
    own = tuple(licenses.Template(f"l{i}", fx.prose(rng, rng.randrange(2, 14), pool)) for i in range(90))
    own += tuple(licenses.Template(f"m{i}", " ".join(w), (" ".join(w[3:6]), " ".join(w[9:11]))) for i in range(40) for w in [fx.prose(rng, 20, pool).split()])
    rows = fx.edge_rows()[:4]
    for i in range(120):
        w = own[i % len(own)].words()
        w = [rng.choice(pool) if rng.random() < 0.1 else x for x in w if rng.random() > 0.05]
        rows.append((100 + i, f"{fx.prose(rng, rng.randrange(9), pool)} {' '.join(w)}. {fx.prose(rng, rng.randrange(9), pool)}"))
    templates = licenses.BASE + own
    docs = fx.frame(spark, rows)
    found = licenses.scan_licenses(docs, templates=templates)
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = db.execute(licenses.oracle(templates)).fetchall()
    clean = lambda rs: sorted(tuple("" if v is None else str(v) for v in r) for r in rs)
    assert clean(map(tuple, found.collect())) == clean(want)
    assert len({r[6] for r in want}) > 30
    nodes = lambda df: df._jdf.queryExecution().analyzed().toString().count("lambdafunction")
    assert len(templates) > 100 and nodes(found) == nodes(licenses.scan_licenses(docs, templates=licenses.BASE))
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, templates=(licenses.Template("x", "one"),))
