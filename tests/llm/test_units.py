import random
import re

from quotemill.llm import unit_dedup

from . import fixtures as fx

LEAST = 30


def brute(rows, least):
    """Spans by loops: (id, start, end, words, id that keeps)."""
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        found, at = [], 0
        for line in (text or "").split("\n"):
            unit = []
            for m in re.finditer(r"[^\x20\x09-\x0D]+", line):
                unit.append((m[0], at + m.start(), at + m.end()))
                if m[0][-1] in ".!?":
                    found.append(unit)
                    unit = []
            if unit:
                found.append(unit)
            at += len(line) + 1
        run = []
        for unit in [*found, None]:
            key = unit and tuple(fx.lower(x) for x, _, _ in unit)
            if unit and key in seen:
                run.append((unit, seen[key]))
                continue
            if sum(len(u) for u, _ in run) >= least:
                out.append((doc, run[0][0][0][1], run[-1][0][-1][2], sum(len(u) for u, _ in run), run[0][1]))
            run = []
            if unit:
                seen[key] = doc
    return out


def sentences(rng, n):
    return " ".join(fx.prose(rng, rng.randrange(3, 9)).capitalize() + rng.choice(".!?") for _ in range(n))


def test_spans(spark):
    rng = random.Random(2)
    passages = [sentences(rng, 12) for _ in range(3)] + ["é ß " * 20 + "ü.", "\n".join(sentences(rng, 2) for _ in range(6))]
    rows = []
    for i in range(80):
        text = sentences(rng, rng.randrange(1, 20))
        if i % 2:
            text = text + rng.choice([" ", "\n", "\n\n\t"]) + rng.choice(passages).replace(" ", rng.choice([" ", "  "])) + " " + sentences(rng, 3)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "Short line."), (104, "Short line."), (None, passages[0]), (105, "x " * 100_000)]
    got = unit_dedup.repeated_spans(fx.frame(spark, rows), min_words=LEAST).collect()
    want = brute(rows, LEAST)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.start, r.end, r.n_words, r.keep_doc_id) for r in got], key=key) == sorted(want, key=key) and len(want) > 20
    clean = {r.doc_id: r for r in unit_dedup.remove_repeats(fx.frame(spark, rows), min_words=LEAST).collect()}
    assert len(clean) == len(rows)
    for doc, text in rows:
        cuts = [(r.start, r.end) for r in clean[doc].removed or []]
        assert cuts == sorted((s, e) for d, s, e, *_ in want if d == doc)
        for s, e in reversed(cuts):
            text = text[:s] + text[e:]
        assert clean[doc].text == text


def test_every_repeat(spark):
    """By default a repeat of any length goes."""
    rng = random.Random(3)
    rows = [(i, "\n".join([sentences(rng, 3), rng.choice(["All of this is shared here.", "Short.", "x"]), sentences(rng, 2)])) for i in range(30)] + [(50, "Short.\nShort.\nnew words here"), (None, None)]
    got = [(r.doc_id, r.start, r.end, r.n_words, r.keep_doc_id) for r in unit_dedup.repeated_spans(fx.frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows, 1)) and len(got) > 25 and min(r[3] for r in got) == 1
    clean = {r.doc_id: r.text for r in unit_dedup.remove_repeats(fx.frame(spark, rows)).collect()}
    assert clean[50] == "\nnew words here" and clean[None] is None


def test_repeated_rows_and_nothing(spark):
    text = "one two three four five six. " * 8
    rows = [(1, text + "a."), (1, text + "a."), (2, text + "b.")]
    got = unit_dedup.repeated_spans(fx.frame(spark, rows), min_words=1).collect()
    assert sum(r.n_units for r in got) == 7 + 9 + 8 and {r.keep_doc_id for r in got} == {1}
    assert unit_dedup.repeated_spans(fx.frame(spark, [])).count() == 0
    assert unit_dedup.remove_repeats(fx.frame(spark, [])).count() == 0


def test_passages_within_sentences(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    free = lambda n: fx.prose(rng, n, words)
    rows, want = [], {}
    for i in range(0, 120, 2):
        n = rng.randrange(50, 90)
        passage = free(n)
        passage = passage.replace(" ", "  ", 3) if i % 3 else passage[:150] + ". " + passage[150:]
        head, tail = (f"{free(rng.randrange(0, 40))} h{i + k} " for k in range(2)), (f" t{i + k} {free(rng.randrange(0, 40))}" for k in range(2))
        (h, t), (h2, t2) = zip(head, tail, strict=True)
        rows += [(i, h + passage + t), (i + 1, h2 + passage.upper() + t2)]
        want[i + 1] = (len(h2), len(h2) + len(passage), len(fx.split(passage)), i)
    rows += [(200 + k, f"{free(30)} a{k} {rows[0][1].split(' ', 1)[1][:60]} b{k}") for k in range(3)]  # too short
    got = {r.doc_id: (r.start, r.end, r.n_words, r.keep_doc_id) for r in unit_dedup.repeated_spans(fx.frame(spark, rows), min_words=LEAST).collect()}
    assert got == want


def test_repeated_rows_keep_what_the_first_does(spark):
    rng = random.Random(5)
    plain, other = sentences(rng, 8), sentences(rng, 9)
    inner = sentences(rng, 7)
    rows = [(1, plain), (1, plain), (2, inner + " Between. " + inner), (2, inner + " Between. " + inner), (None, other), (None, other), (3, plain)]
    clean = [(r.doc_id, r.text) for r in unit_dedup.remove_repeats(fx.frame(spark, rows), min_words=LEAST).collect()]
    assert len(fx.split(plain)) >= 30 and len(fx.split(inner)) >= 30
    assert sorted(clean, key=str) == sorted([(1, plain)] * 2 + [(2, inner + " Between. ")] * 2 + [(None, other)] * 2 + [(3, "")], key=str)
