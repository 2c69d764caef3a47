"""License scan: sparse TF-IDF cosine of notices and licence files to templates, then inheritance from the nearest
directory above. DataFrame functions only."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_join, written

# Templates of notices and headers by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX License Identifier MIT"),
    ("MIT", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License Version 2.0"),
    ("Apache-2.0", "SPDX License Identifier Apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License Version 2.0 you may not use this file except in compliance with the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License version 2"),
    ("GPL-2.0", "SPDX License Identifier GPL 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "SPDX License Identifier GPL 3.0"),
    ("GPL-3.0", "This program is free software you can redistribute it under the terms of the GNU General Public License version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3 Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms with or without modification are permitted provided that the license conditions are met"),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 licence"),
    ("Unlicense", "This is free and unencumbered software released into the public domain no licence needed"),
    # Headers in their full wording, and the titles of licence files.
    ("MIT", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so subject to the following conditions"),
    ("Apache-2.0", "Apache License Version 2.0 January 2004 http www.apache.org licenses"),
    *(
        (f"{short}-{v}.0", f"This program is free software you can redistribute it and or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation either version {v} of the License or at your option any later version")
        for short, name, v in (("GPL", "General", 2), ("GPL", "General", 3), ("LGPL", "Lesser General", 3), ("AGPL", "Affero General", 3))
    ),
    ("GPL-2.0", "GNU General Public License Version 2 June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v. 2.0 If a copy of the MPL was not distributed with this file You can obtain one at http mozilla.org MPL 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((f"CC-BY{short}-4.0", f"Creative Commons Attribution{name} 4.0 International Public License") for short, name in (("", ""), ("-NC", " NonCommercial"), ("-SA", " ShareAlike"))),
)
#: Whole licence texts by SPDX identifier, for files named as licence files.
TEXTS = Path(__file__).parent / "license_texts"
#: Words that say that a line is a notice at all; they weigh more than their frequency among notices.
KEYWORDS = ("license", "licensed", "licence", "spdx", "permission", "redistribution", "domain")
#: A notice is a line, or consecutive lines read as one, with this cosine to a template.
THRESHOLD = 0.72
#: A whole text must be so near to a licence text.
FULL_THRESHOLD = 0.85
#: Numbers of consecutive lines that are read as one.
SIZES = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 26, 32)
#: What a line of a comment begins and ends with, as far as it is made of letters; other marks are no terms anyway.
MARKS = r"(?i)^\s*(?:dnl|rem)(?![\p{L}\p{N}])"
SPLIT = "[^a-z0-9.]+|\\.(?![0-9])"


def terms(text: str) -> list[str]:
    return [t for t in re.split(SPLIT, text.lower()) if t]


@cache
def weights(full: bool = False) -> tuple[str, str, float]:
    """As JSON: the templates (``full``: the whole licence texts) as unit-length sparse vectors (each weight times idf
    once more, for dot products with term counts), and the idf of each term; the idf of unknown terms."""
    of = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))] if full else TEMPLATES
    counts = [Counter(terms(t)) for _, t in of]
    n = len(counts)
    idf = {t: 1 + math.log((1 + n) / (1 + sum(t in c for c in counts))) for t in sorted(set().union(*counts))}
    if not full:
        idf |= dict.fromkeys(KEYWORDS, 4.0)
    vectors = []
    for (name, _), c in zip(of, counts, strict=True):
        length = math.sqrt(sum((m * idf[t]) ** 2 for t, m in c.items()))
        vectors.append({"license": name, "parts": [{"t": t, "w": m * idf[t] ** 2 / length} for t, m in sorted(c.items())]})
    return json.dumps(vectors), json.dumps(idf), 1 + math.log(1 + n)


@cache
def _by_term(full: bool) -> tuple[str, str, float, int]:
    """The same weights by term, as JSON: of each term, its weight in each template and, last, its idf; the
    identifiers; the idf of unknown terms; the number of templates."""
    vectors, idf, unknown = weights(full)
    templates, rows = json.loads(vectors), {t: [] for t in json.loads(idf)}
    for v in templates:
        held = {x["t"]: x["w"] for x in v["parts"]}
        for t, r in rows.items():
            r.append(held.get(t, 0.0))
    for t, x in json.loads(idf).items():
        rows[t].append(x)
    return json.dumps(rows), json.dumps([v["license"] for v in templates]), unknown, len(templates)


@cache
def shares() -> tuple[dict, int]:
    """Of each term, its part of each template's squared length (nothing: 0); the number of templates.

    By Cauchy and Schwarz, a text's cosine to a template is at most the root of the sum of the parts that the terms
    they share hold."""
    vectors, idf, _ = weights()
    templates, held = json.loads(vectors), json.loads(idf)
    out: dict = {}
    for i, v in enumerate(templates):
        squares = {x["t"]: (x["w"] / held[x["t"]]) ** 2 for x in v["parts"]}
        for t, q in squares.items():
            out.setdefault(t, [0.0] * len(templates))[i] = q
    return out, len(templates)


@cache
def anchors(threshold: float = THRESHOLD) -> tuple[str, ...]:
    """Terms of which every text that reaches ``threshold`` holds at least one: of each template the longest (long
    words are rare in other texts), until the others hold less than the squared threshold of its squared length."""
    parts, n = shares()
    found: set = set()
    for i in range(n):
        mine = {t: x[i] for t, x in parts.items() if x[i]}
        left = sum(q for t, q in mine.items() if t not in found)
        for t in sorted(set(mine) - found, key=lambda t: (-len(t), t)):
            if left < threshold**2 - 1e-6:
                break
            found.add(t)
            left -= mine[t]
    return tuple(sorted(found))


def has_anchor(words: Column, threshold: float = THRESHOLD) -> Column:
    return F.arrays_overlap(words, F.from_json(F.lit(json.dumps(anchors(threshold))), "array<string>"))


def can_match(words: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a text with these terms, or a part of it, can reach ``threshold``; see :func:`shares`."""
    parts, n = shares()
    table = F.from_json(F.lit(json.dumps(parts)), "map<string, array<double>>")
    known = F.array_intersect(words, F.from_json(F.lit(json.dumps(sorted(parts))), "array<string>"))
    total = F.aggregate(known, F.array_repeat(F.lit(0.0), n), lambda s, t: F.zip_with(s, F.element_at(table, t), lambda a, b: a + b))
    return F.exists(total, lambda x: x >= threshold**2 - 1e-6)


def words_in(line: Column) -> Column:
    """The terms of a line."""
    return F.filter(F.split(F.lower(line), SPLIT), lambda t: t != "")


def best_match(words: Column, full: bool = False) -> Column:
    """(s, license) of the best template of an array of terms, s its cosine's negative; ties to the smaller identifier.
    Each different term is looked up once, with its weight in every template."""
    rows, names, unknown, n = _by_term(full)
    table = F.from_json(F.lit(rows), "map<string, array<double>>")
    licenses = F.from_json(F.lit(names), "array<string>")
    nothing = F.array(*[F.lit(0.0)] * (n + 1))
    other = F.concat(F.array_repeat(F.lit(0.0), n), F.array(F.lit(unknown)))

    def add(total: Column, x: Column) -> Column:
        # The last place of the total sums squares of the words' own weights.
        return F.zip_with(total, F.transform(x["w"], lambda w, i: F.when(i == n, F.pow(w * x["n"], F.lit(2.0))).otherwise(w * x["n"])), lambda a, b: a + b)

    # Equal terms are neighbours when sorted, so that a term's number is the distance to the next different one.
    def counted(sorted_words: Column) -> Column:
        size = F.size(sorted_words)
        last = F.filter(F.transform(sorted_words, lambda t, i: F.when((i + 1 == size) | (F.get(sorted_words, i + 1) != t), i + 1)), lambda i: i.isNotNull())
        return _let(last, lambda ends: F.transform(ends, lambda e, k: F.struct((e - F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))).alias("n"), F.coalesce(F.try_element_at(table, F.get(sorted_words, e - 1)), other).alias("w"))))

    def pick(total: Column) -> Column:
        length = F.sqrt(F.get(total, F.lit(n)))
        return F.array_min(F.transform(licenses, lambda name, i: F.struct((-F.round(F.get(total, i) / length, 9)).alias("s"), name.alias("license"))))

    return _let(_let(_let(F.array_sort(words), counted), lambda c: F.aggregate(c, nothing, add)), pick)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def best_template(line: Column) -> Column:
    """(s, license) of the best template of a text, s its cosine's negative; ties to the smaller identifier."""
    return best_match(words_in(line))


def notices(text: Column, threshold: float = THRESHOLD) -> Column:
    """The lines of a text that match a template, and so do consecutive lines read as one: (at, n, score, license),
    ``n`` lines from the one numbered ``at``, from 1.

    A line without letters and digits, as of comment marks alone, ends a run. Read as one are a run, and within it SIZES
    lines, as long as there is not twice what the longest template holds. Scored are only those of runs that
    :func:`can_match`, with one of :func:`anchors`; no others reach the threshold."""
    longest = 2 * max(len(terms(t)) for _, t in TEMPLATES)
    shift = 1 << 31
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, MARKS, ""))
    nothing = F.array().cast("array<bigint>")

    def found(z: Column) -> Column:
        held, size = z["lines"], F.size(z["lines"])
        gaps = F.concat(F.array(F.lit(0)), F.filter(F.transform(held, lambda x, i: F.when(~x["line"].rlike(r"[\p{L}\p{N}]"), i + 1)), lambda i: i.isNotNull()), F.array(size + 1))

        def runs_of(g: Column) -> Column:
            every = F.transform(g, lambda a, k: F.struct((a + 1).alias("first"), F.coalesce(F.get(g, k + 1), a + 1).alias("end")))
            return F.filter(every, lambda r: (r["end"] > r["first"]) & can_match(words_of(r["first"], r["end"] - r["first"]), threshold))

        def words_of(at: Column, n: Column) -> Column:
            return F.flatten(F.transform(F.slice(held, at, n), lambda x: x["words"]))

        def windows(r: Column) -> Column:
            """Keys of the run and of the windows around its lines with an anchor."""
            first, end = r["first"], r["end"]
            hits = F.filter(F.transform(F.slice(held, first, end - first), lambda x, i: F.when(has_anchor(x["words"], threshold), first + i)), lambda a: a.isNotNull())

            def around(a: Column) -> Column:
                starts = lambda n: F.when(F.least(a, end - n) >= F.greatest(a - n + 1, first), F.sequence(F.greatest(a - n + 1, first), F.least(a, end - n))).otherwise(F.array().cast("array<int>"))
                return F.flatten(F.transform(F.array(*map(F.lit, SIZES)), lambda n: F.transform(starts(n), lambda s: s.cast("long") * shift + n)))

            return F.concat(nothing, F.flatten(F.transform(hits, around)), F.array(first.cast("long") * shift + (end - first)))

        def scored(key: Column) -> Column:
            at, n = (key / shift).cast("int"), (key % shift).cast("int")
            return F.struct(at.alias("at"), n.alias("n"), words_of(at, n).alias("words"))

        # A window is too long if it is still so without its first line: a long line before a notice is no reason.
        fits = lambda key: (key % shift == 1) | (F.aggregate(F.slice(held, (key / shift).cast("int") + 1, (key % shift).cast("int") - 1), F.lit(0), lambda t, x: t + F.size(x["words"])) <= longest)
        keys = F.array_distinct(F.flatten(F.transform(_let(gaps, runs_of), windows)))
        each = F.transform(F.filter(keys, fits), lambda k: _let(scored(k), lambda w: F.struct(w["at"].alias("at"), w["n"].alias("n"), best_match(w["words"]).alias("b"))))
        hits = F.filter(each, lambda s: s["b"]["s"] <= -threshold)
        return F.transform(hits, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), (-s["b"]["s"]).alias("score"), s["b"]["license"].alias("license")))

    return _let(F.struct(F.transform(lines, lambda x: F.struct(x.alias("line"), words_in(x).alias("words"))).alias("lines")), found)


def scan(files: DataFrame, share: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``files`` (path, text, any others) with: own (licence of its best notice), score, declares (whether it is a
    licence file: named LICENSE or COPYING, or notices are at least ``share`` of its words; of a file so named, the
    whole text is compared with licence texts as well), license (own, or else
    that of the nearest directory above with a licence file), found_in (that directory; null for own).

    A directory's licence is the one most of its licence files declare, ties to the smaller identifier. Null text:
    no notice. Null path: nothing to inherit, and nothing declared. Repeated rows: each gets its result. Empty
    table: no rows. Columns of ``files`` with the names above are replaced. ``keep`` names the columns of ``files`` that
    are returned (all, if none are named).

    Texts are scored once: the columns to return are written with what was found.

    Directories are summed up by task before they meet; each distinct directory looks at those above it by joins on
    paths, and the files join their directory's result, which is broadcast if small and else joined with hot
    directories split."""
    names = ("own", "score", "declares", "license", "found_in")
    rows = files.drop(*names, "__dir", "__notices", "__whole")
    words = F.split(F.lower("text"), SPLIT)
    rows = rows.withColumn("__notices", F.when(has_anchor(words) & can_match(words), notices(F.col("text"))).otherwise(F.lit(None)))
    named = F.coalesce(F.lower(F.col("path")).rlike(r"(?:\A|/)(?:licen[cs]e|copying|notice)[^/]*\z"), F.lit(False))
    whole = F.filter(F.array(best_match(words_in(F.col("text")), full=True)), lambda b: b["s"] <= -FULL_THRESHOLD)
    rows = rows.withColumn("__whole", F.when(named & F.col("text").isNotNull(), whole))
    found = F.transform("__notices", lambda x: F.struct((-x["score"]).alias("s"), x["license"].alias("license")))
    none = F.array().cast("array<struct<s double, license string>>")
    rows = rows.withColumn("__best", F.array_min(F.concat(F.coalesce(found, none), F.coalesce(F.col("__whole"), none))))
    n_words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    covered = F.array_distinct(F.flatten(F.transform("__notices", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    part = _let(F.split("text", "\n"), lambda ls: F.aggregate(covered, F.lit(0), lambda s, i: s + n_words(F.element_at(ls, i))))
    declares = F.when(F.col("__best").isNull() | F.col("path").isNull(), F.lit(False)).otherwise(named | F.coalesce(part >= share * n_words(F.col("text")), F.lit(False)))
    rows = rows.withColumn("own", F.col("__best.license")).withColumn("score", -F.col("__best.s")).withColumn("declares", declares)
    rows = rows.withColumn("__dir", F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)).drop("__notices", "__best", "__whole")
    if keep is not None:
        rows = rows.select(*(k for k in keep if k not in names), *names[:3], "__dir")
    rows = written(rows, "license-rows")

    stated = rows.where("declares").groupBy("__dir", "own").agg(F.count("*").alias("n"))
    pick = F.row_number().over(Window.partitionBy("__dir").orderBy(F.col("n").desc(), "own"))  # a row a licence
    stated = written(stated.withColumn("r", pick).where("r = 1").select(F.col("__dir").alias("above"), F.col("own").alias("license")), "license-dirs")
    dirs = written(rows.where("__dir IS NOT NULL").select("__dir").distinct(), "dirs")
    steps = F.split("__dir", "/")
    above = dirs.select("__dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("above"))
    above = above.unionByName(dirs.select("__dir", F.lit("").alias("above")).where("__dir <> ''"))
    nearest = sized_join(above, stated, "above").groupBy("__dir").agg(F.max_by(F.struct("above", "license"), F.length("above")).alias("__near"))
    out = sized_join(rows, written(nearest, "license-near"), "__dir", "left")
    out = out.withColumn("license", F.coalesce("own", "__near.license")).withColumn("found_in", F.when(F.col("own").isNull(), F.col("__near.above")))
    return out.drop("__dir", "__near")
