"""Licence scan by a positional index of rare words, with DataFrame functions alone.

A template is a run of words with mandatory key phrases.  Its postings are its rarest words by document frequency over all
texts, with their offsets; the rarest of these are its anchors.  A text's anchor words, that is its licence words of highest IDF,
are looked up: each place of one gives a start of each template that has it.  A start stands if ``AGREE`` of the template's postings are at
their relative positions, and the template is found there if all its key phrases stand near, whole.

The index is one literal, parsed from JSON once a query, so the plan is the same for any number of templates.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTINGS, AGREE = 4, 2


@dataclass(frozen=True)
class Template:
    """``keys`` empty: the words themselves are the key phrase."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    def words(self) -> list[str]:
        return words_of(self.text)

    def phrases(self) -> list[list[str]]:
        return [words_of(k) for k in self.keys or (self.text,)]

    def anchors(self) -> int:
        return max(1, min(3, len(self.words()) // 4))

    def slack(self) -> int:
        """Words that key phrases may be off their template, for what was put in or left out before them; short ones stand exactly."""
        n = len(self.words())
        return n // 4 + 4 if self.keys and n >= 8 else 0


# Phrases, key phrases, labels.  No word has a k, which a letter beyond ASCII is folded to.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
MORE = (
    Template("mit", "mit license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("apache-2.0", "apache license 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("epl", "eclipse public license"),
    Template("public-domain", "public domain"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("mit", "spdx license identifier mit"),
    Template("apache-2.0", "spdx license identifier apache 2 0"),
    Template("bsd", "spdx license identifier bsd"),
    Template("gpl", "spdx license identifier gpl"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"),
    ),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software",),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ("you may not use this file except in compliance with the license",),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("under the terms of the gnu lesser general public license",),
    ),
    Template(
        "agpl",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ("under the terms of the gnu affero general public license",),
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ("source code form is subject to the terms of the mozilla public license",),
    ),
    Template(
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution",
        ("made available under the terms of the eclipse public license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    Template(
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ("to any person or organization obtaining a copy of the software and accompanying documentation",),
    ),
    Template("cc0", "has waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    Template("cc-by", "is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    Template("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
)
TEMPLATES = BASE + MORE
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX = "struct<anchors:array<struct<word:string,t:int,off:int>>,words:array<string>,templates:array<struct<label:string,base:boolean,n:int,slack:int,total:double,words:array<string>,idf:array<double>,posts:array<struct<word:string,off:int>>,keys:array<array<string>>>>>"


def words_of(text: str) -> list[str]:
    folded = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return [w for w in re.split(SEPARATORS, folded) if w]


def word_array(text: Column) -> Column:
    """Words of lower-cased text.

    ``lower`` also folds letters beyond ASCII; those stay word characters, and no template has the one ASCII letter (k) that
    comes out of folding one, so words and matches are those of folding A-Z alone.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def idf(n: int, df: int) -> float:
    return round(math.log((n + 1) / (df + 1)) + 1, 9)


def _literal(value: object, schema: str) -> Column:
    """A value as one foldable expression, however large it is."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def rarity(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts and, for the templates' words, of texts with each; at most a row a word of the templates reaches the driver."""
    own = _literal(vocabulary, "array<string>")
    some = words.select(F.explode(F.array_append(F.array_intersect("w", own), F.lit("")).alias("word")))  # "" counts the texts
    counts = {r["word"]: r["count"] for r in some.toDF("word").groupBy("word").count().collect()}
    return counts.get("", 0), {x: counts.get(x, 0) for x in vocabulary}


def positional_index(templates: tuple[Template, ...], value: dict[str, float]) -> dict:
    """Anchors over all templates, and of each template its words, their IDF, postings and key phrases."""
    anchors, rows = [], []
    for t, x in enumerate(templates):
        w = x.words()
        ranked = sorted(range(len(w)), key=lambda i: (-value[w[i]], w[i], i))  # noqa: B023
        anchors += [{"word": w[i], "t": t, "off": i} for i in ranked[: x.anchors()]]
        posts = [{"word": w[i], "off": i} for i in ranked[:POSTINGS]]
        rows.append({"label": x.label, "base": x.base, "n": len(w), "slack": x.slack(), "total": sum(value[v] for v in w), "words": w, "idf": [value[v] for v in w], "posts": posts, "keys": x.phrases()})
    return {"anchors": anchors, "words": sorted({a["word"] for a in anchors}), "templates": rows}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are their least and largest start (null
    without any).  ``base_labels`` and ``labels`` are distinct, sorted and comma-joined, "" for none.  ``score`` is the largest
    IDF-weighted share of a template's words found at their places, over all starts that ``AGREE`` of its postings agree on, found
    or not; 0 without one.  Equally rare words rank by themselves, then by place.  A null text has no words.  Repeated rows are
    scanned each.  A text of any length is one array of words; one without an anchor word is looked through once.  Other columns
    are not looked at.  An empty table gives no rows.  Templates have two words at least.
    """
    short = [t.text for t in templates if len(t.words()) < AGREE or "k" in "".join(t.words())]
    if short:
        raise ValueError(f"templates need {AGREE} words, none with a k: {short}")
    vocabulary = sorted({w for t in templates for w in t.words()})
    n, df = rarity(docs.select(word_array(F.col(text_col)).alias("w")), vocabulary)
    table = positional_index(templates, {x: idf(n, df[x]) for x in vocabulary})
    index = _literal(table, INDEX)
    at = lambda t: F.get(index["templates"], t)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_array(F.col(text_col)).alias("w"))
    rows = rows.withColumn("h", F.array_intersect("w", _literal(table["words"], "array<string>")))
    w = F.col("w")
    size = F.size(w)
    run = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    anchored = F.filter(index["anchors"], lambda a: F.array_contains("h", a["word"]))
    places = lambda a: F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get(w, i) == a["word"])
    starts = F.flatten(F.transform(anchored, lambda a: F.transform(places(a), lambda i: F.struct(a["t"].alias("t"), (i - a["off"]).alias("s")))))
    stands = lambda c: F.size(F.filter(at(c["t"])["posts"], lambda p: F.coalesce(F.get(w, c["s"] + p["off"]) == p["word"], F.lit(False)))) >= AGREE

    def found(c: Column) -> Column:
        x = at(c["t"])
        near = lambda k: run(F.greatest(F.lit(0), c["s"] - x["slack"]), F.least(size, c["s"] + x["n"] + x["slack"]) - F.size(k))
        whole = F.forall(x["keys"], lambda k: F.exists(near(k), lambda j: F.slice(w, j + 1, F.size(k)) == k))
        have = F.aggregate(run(F.lit(0), x["n"] - 1), F.lit(0.0), lambda acc, k: acc + F.when(F.get(w, c["s"] + k) == F.get(x["words"], k), F.get(x["idf"], k)).otherwise(0.0))
        return F.struct(c["s"].cast("long").alias("start"), x["label"].alias("label"), x["base"].alias("base"), whole.alias("whole"), F.round(have / x["total"], 6).alias("share"))

    none = F.array().cast("array<struct<start:bigint,label:string,base:boolean,whole:boolean,share:double>>")
    places_found = F.when(F.size("h") > 0, F.transform(F.filter(F.array_distinct(starts), stands), found)).otherwise(none)
    rows = rows.select("doc_id", size.cast("long").alias("n_words"), places_found.alias("p"))
    whole = rows.withColumn("f", F.expr("filter(p, x -> x.whole)")).withColumn("b", F.expr("filter(f, x -> x.base)"))
    return whole.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.expr("array_min(transform(b, x -> x.start))").alias("first_word"),
        F.expr("array_max(transform(b, x -> x.start))").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(b, x -> x.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(f, x -> x.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(p, x -> x.share)), 0D)").alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same in DuckDB's SQL."""
    lists = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(f"({t}, '{x.label}', {str(x.base).lower()}, {len(x.words())}, {x.slack()}, {x.anchors()}, {k}, '{w}')" for t, x in enumerate(templates) for k, w in enumerate(x.words()))
    keys = ", ".join(f"({t}, {i}, '{k[0]}', {lists(k)})" for t, x in enumerate(templates) for i, k in enumerate(x.phrases()))
    return rf"""
WITH tw(t, label, base, n, slack, a, off, word) AS (VALUES {rows}),
keys(t, k, word, words) AS (VALUES {keys}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
x AS (SELECT r, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
df AS (SELECT v.word, count(DISTINCT x.r) AS df FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN x ON x.word = v.word GROUP BY 1),
v AS (SELECT word, round(ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) + 1, 9) AS idf FROM df),
tv AS (SELECT tw.*, v.idf, row_number() OVER (PARTITION BY t ORDER BY v.idf DESC, tw.word, off) AS rk, sum(v.idf) OVER (PARTITION BY t) AS total FROM tw JOIN v ON v.word = tw.word),
c AS (SELECT DISTINCT x.r, t, pos - off AS s FROM x JOIN tv ON x.word = tv.word AND rk <= a),
g AS (SELECT c.r, c.t, c.s FROM c JOIN tv ON tv.t = c.t AND rk <= {POSTINGS} JOIN x ON x.r = c.r AND x.pos = c.s + tv.off AND x.word = tv.word GROUP BY ALL HAVING count(*) >= {AGREE}),
sh AS (SELECT g.r, g.t, g.s, any_value(label) AS label, any_value(base) AS base, any_value(n) AS n, any_value(slack) AS slack, round(sum(idf) / any_value(total), 6) AS share
  FROM g JOIN tv ON tv.t = g.t JOIN x ON x.r = g.r AND x.pos = g.s + tv.off AND x.word = tv.word GROUP BY g.r, g.t, g.s),
kp AS (SELECT x.r, keys.t, k, pos AS j, len(words) AS l FROM x JOIN keys ON x.word = keys.word JOIN d ON d.r = x.r WHERE ws[pos + 1:pos + len(words)] = words),
kn AS (SELECT t, count(*) AS many FROM keys GROUP BY t),
f AS (SELECT sh.r, sh.t, sh.s FROM sh JOIN kp ON kp.r = sh.r AND kp.t = sh.t AND j >= s - slack AND j <= s + n + slack - l JOIN kn ON kn.t = sh.t GROUP BY sh.r, sh.t, sh.s, many HAVING count(DISTINCT k) = many),
m AS (SELECT sh.*, f.r IS NOT NULL AS whole FROM sh LEFT JOIN f ON f.r = sh.r AND f.t = sh.t AND f.s = sh.s),
o AS (SELECT r, count(*) FILTER (base AND whole) AS n_base, min(s) FILTER (base AND whole) AS first_word, max(s) FILTER (base AND whole) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS labels, max(share) AS score FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN o USING (r)"""
