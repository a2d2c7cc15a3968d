"""Small tables with what operators have to cope with, and brute-force versions."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, n long, word string, copies int, row long, component string, h string"
SPACE = r"[\x20\x09-\x0D]+"


def frame(spark, rows):
    """(doc_id, text[, lang[, source]]) with extra columns whose names operators use themselves."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1]), 1.0, "x", 7, "w", 3, 5, "c", "h") for r in full], SCHEMA)


def edge_rows():
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (0, "The cat sat on the mat today", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "b"), (4, "123 !!", "de", "b"), (5, long, "en", "a"),
        (6, "the  CAT sat\ton the mat today", "en", "a"), (7, "The cat sat on the mat today", "en", "c"), (7, "The cat sat on the mat today", "en", "c"), (None, "The cat sat on the mat today", "en", None),
        (9, "The cat\x0bsat on the mat today", "fr", "b"), (10, "é É ß — 文字", "fr", "b"),
    ]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return [w for w in re.split(SPACE, lower(text)) if w]


def shingles(text, n):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def prose(rng, n, words=None):
    words = words or [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "te", "so") for b in ("rin", "sel", "tok", "van", "dus", "pel", "gar", "mon")]
    return " ".join(rng.choice(words) for _ in range(n))


def families(seed=1):
    """Unrelated texts, a hub with copies that each differ in their own words, a chain, and a passage that many share."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(40)]
    hub = prose(rng, 120).split()
    for i in range(100, 130):
        w = hub[:]
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows.append((200, " ".join(hub)))
    step = prose(rng, 100).split()
    for i in range(300, 308):
        step = step[2:] + [f"y{i}a", f"y{i}b"]
        rows.append((i, " ".join(step)))
    shared = prose(rng, 30)
    rows += [(400 + i, prose(rng, 40) + " " + shared + " " + prose(rng, 40)) for i in range(25)]
    rows += [(500 + i, rows[3][1]) for i in range(5)]
    rng.shuffle(rows)
    return rows
