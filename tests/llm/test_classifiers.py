"""Toxicity, URL filter and licence scan."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.llm import licenses, queries, toxicity, urls

SF = "/root/testdata/sf0.01"


def slow_features(u: str) -> dict:
    """Triples of symbols in order within a span of five, each weighted by DECAY to the symbols skipped."""
    out: dict = {}
    for i in range(len(u)):
        for k in range(2, 5):
            for j in range(1, k):
                if i + k < len(u):
                    t = (u[i], u[i + j], u[i + k])
                    out[t] = out.get(t, 0) + toxicity.DECAY ** (k - 2)
    return out


def slow_kernel(a: str, b: str) -> float:
    """Sum over common triples, divided by the norms of units of these lengths whose triples all differ."""
    x, y = slow_features(a), slow_features(b)
    norm = lambda n: max(1e-9, sum(toxicity.DECAY ** (2 * (k - 2)) for i in range(n) for k in range(2, 5) for j in range(1, k) if i + k < n)) ** 0.5
    return sum(v * y.get(t, 0) for t, v in x.items()) / (norm(len(a)) * norm(len(b)))


def unit(text: str) -> np.ndarray:
    return toxicity.symbols(text)


def spelled(text: str) -> str:
    """Symbols as characters, so that the plain kernel can use them."""
    return "".join(chr(0x4000 + c) for c in unit(text).tolist())


def test_kernel_equals_the_plain_one():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcxyz", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 4))) for _ in range(30)]
    got = toxicity.gram(list(map(unit, texts)), list(map(unit, texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert got[i, j] == pytest.approx(slow_kernel(spelled(a), spelled(b)), abs=1e-9)


@pytest.mark.parametrize("alphabet", ["абвгдежзиклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصض", "的一是不了人我在有他这中大来上"])
def test_kernel_tells_letters_of_any_script(alphabet):
    rng = random.Random(2)
    words = ["".join(rng.choices(alphabet, k=rng.randint(2, 12))) for _ in range(20)]
    got = toxicity.gram(list(map(unit, words)), list(map(unit, words)))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(slow_kernel(spelled(a), spelled(b)), abs=0.1)  # a few triples may share a place


def test_margins_equal_the_plain_sum_over_landmarks():
    """A text's window margins are the machine's weights over its landmarks times the plain kernel, plus the bias."""
    rng = np.random.default_rng(6)
    marks = ["pathetic loser", "stupid", "moron and trash", "walk of the river"]
    beta = rng.normal(size=len(marks))
    table = np.zeros(toxicity.WIDTH**3)
    row, code, weight = toxicity.triples(list(map(unit, marks)))
    np.add.at(table, code, beta[row] * weight)
    model = toxicity.Model(table, 0.25)
    for text in ("you stupid moron, walk", "a b", "", "x" * 95 + " losers", "Идиот stu.pid ñu", " ".join(["the river"] * 40)):
        y = unit(text)
        at = toxicity.cuts(y)
        for m, found in zip(toxicity.SPANS, model.windows(y, at), strict=True):
            want = []
            for a, b in zip(at, at[m:], strict=False):
                u = "".join(chr(0x4000 + c) for c in y[a : b + 1].tolist())
                want.append(0.25 + sum(w * slow_kernel(u, spelled(x)) for w, x in zip(beta, marks, strict=True)))
            assert found == pytest.approx(want, abs=1e-6)


def test_margins_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.WIDTH**3), 0.1)
    text = " ".join("".join(rng.choice(list("abcdé…x1"), rng.integers(1, 90 if k % 7 == 0 else 9))) for k in range(300))
    y = unit(text)
    want = model.windows(y, toxicity.cuts(y))
    for chunk in (1, 50, 333):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        for a, b in zip(model.windows(y, toxicity.cuts(y)), want, strict=True):
            assert a == pytest.approx(b)
    assert model.features(["", "\n"])[:, :-1].tolist() == [[0.1] * (toxicity.TOP + len(toxicity.SPANS) - 1)] * 2


def test_gapped_insults_of_any_script():
    """Learned from short stretches of labelled texts; found with letters, dots or blanks put in, never in clean ones."""
    rng = random.Random(3)
    insults = ["идиот", "придурок", "мерзавец", "moron", "worthless", "ηλίθιος"]
    plain = ["река", "письмо", "деревня", "учитель", "river", "letter", "teacher", "village", "ποταμός", "δάσκαλος", "morning", "worth", "идея", "придумать"]
    line = lambda: " ".join(rng.choices(plain, k=2))
    bad = [unit(rng.choice([f"{w} {line()}", f"{line()} {w}", w])) for w in insults for _ in range(12)]
    good = [unit(rng.choice([line(), rng.choice(plain), f"{line()} {line()}"])) for _ in range(200)]
    model = toxicity.fit_machine(good, bad)
    clean = max(model.margin(f"{line()} {line()}") for _ in range(50))
    for text in ("идиот", "и.д.и.о.т", "и д и о т", "придууурок", "при дурок", "mоr on moron", "w0rthless", "wor th less", "мерз-авец", "ηλιθιος"):
        assert model.margin(f"{line()} {text} {line()}") > clean, text
    assert clean < 0


def test_symbols():
    assert unit("  !Cät5,\n") .tolist() == [30, 3, 1, 20, 19, 30]
    assert unit("a i d i o t bb").tolist() == unit("aidiot bb").tolist()
    assert unit("").tolist() == unit(" \n…").tolist() == [30, 30][:1]


def test_held_out_quality(spark):
    """On held-out rows, far better than always answering clean (which finds nothing)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    some = docs.join(labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("doc_id", "toxic"), "doc_id").repartition(8)
    got = toxicity.score(some, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
    hit, toxic, said = (sum(f(r) for r in got) for f in (lambda r: r["toxic"] and r["predicted"], lambda r: r["toxic"], lambda r: r["predicted"]))
    assert hit >= 0.85 * toxic > 50
    assert hit >= 0.85 * said
    pos, neg = (np.array([r["score"] for r in got if r["toxic"] == y]) for y in (1, 0))
    assert (pos[:, None] > neg[None]).mean() > 0.93


def test_toxicity_edges(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = [(None, "some words", 1, 1.0), (5, None, 1, 1.0), (5, "", 1, 1.0), (6, "x" * 100_000, 1, 1.0), (7, "🙂 …", 1, 1.0), (5, "", 1, 1.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(rows)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert toxicity.score(odd.where("false"), model).collect() == []
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


def test_score_ignores_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = docs.limit(50)
    a = sorted(r["score"] for r in toxicity.score(rows, model).collect())
    b = sorted(r["score"] for r in toxicity.score(rows.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("lang", F.lit("zz")), model).collect())
    assert a == pytest.approx(b)  # sums of other batches may differ in the last place


def slow_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def slow_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


URLS = [None, "", "no scheme", "http://", "https://A.B.NET/x", "http://net/", "http://net", "http://net?x=/", "https://www.example.net/en/a?b#c", "https://example.net/EN/a", "https://badexample.com/de/x", "https://m.example.com/de/x", "https://x.org/fr/", "https://x.org/fr", "a://b://c/d", "http://ÄB.org/fr/é\n/x", "ftp://h#f/p", "http://h?q/p", "http://HOST/p?q"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = slow_host_path(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        rule = slow_rule(host, path)
        assert got[i]["rule"] == (rule and rule[0]), u
        assert got[i]["verdict"] == (rule[1] if rule else ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert urls.judge(pages.where("false")).collect() == []


def test_url_model_on_urls_it_did_not_learn(spark):
    """Each labelled url judged without its fold: far better than to allow all, and few ordinary urls are blocked."""
    rows = urls.labelled()
    assert len({slow_host_path(u)[0] for u, _ in rows}) == len(rows)
    precision, recall, accuracy = urls.cross_validate(spark, folds=3)
    print(f"url model, cross-validated: precision {precision:.3f}, recall {recall:.3f}, accuracy {accuracy:.3f}")
    assert precision >= 0.85 and recall >= 0.5
    assert accuracy >= sum(y == 0 for _, y in rows) / len(rows) + 0.15


FILES = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0"),
    ("a/b/c/x.txt", "some prose without a notice"),
    ("a/b/LICENSE", "Released under the MIT License."),
    ("a/d/x.txt", "prose\nSPDX-License-Identifier: GPL-3.0\nmore prose, a lot of it, so that this is no licence file of its own here"),
    ("z/x.txt", "nothing here"),
    ("top.txt", None),
    (None, "Released under the MIT License."),
    ("a/e/deep/er/x", ""),
    ("a/e/deep/er/x", ""),
    ("q/x.txt", "license plate numbers were read by the driver of the car"),
]


def test_licence_scan_and_inheritance(spark):
    files = spark.createDataFrame([(i, p, t, 1, "x") for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string, own int, n string")
    got = {r["doc_id"]: r for r in licenses.scan(files).collect()}
    assert len(got) == len(FILES)
    assert [got[i]["license"] for i in range(10)] == ["Apache-2.0", "MIT", "MIT", "GPL-3.0", None, None, "MIT", "Apache-2.0", "Apache-2.0", None]
    assert [got[i]["found_in"] for i in (1, 7, 8, 0)] == ["a/b", "a", "a", None]
    assert [got[i]["declares"] for i in (0, 2, 3, 6)] == [True, True, False, False]
    assert licenses.scan(files.where("false")).collect() == []


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {v} of the License, or
# (at your option) any later version."""
WRAPPED = [
    ("src/a.py", "import os\n\n" + GPL_HEADER.format(v=3) + "\n\nprint(os)", "GPL-3.0"),
    ("src/b.py", GPL_HEADER.format(v=2) + "\n#\n# more about it", "GPL-2.0"),
    ("src/c.c", "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n */", "BSD-3-Clause"),
    ("src/d.txt", "some prose that goes before\nThis work is licensed under the GNU General Public\nLicense, version 3.\nand other prose after", "GPL-3.0"),
    ("src/e.txt", "the license\nof the driver\nwas read by the police and then\nhe drove on", None),
]


def test_wrapped_notices(spark):
    files = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(WRAPPED)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own"] for r in licenses.scan(files).collect()}
    assert [got[i] for i in range(len(WRAPPED))] == [w for _, _, w in WRAPPED]


def test_whole_licence_texts_declare(spark):
    """Each text as it is, and its body without title and last fifth, where the headers are, wrapped anew."""
    import textwrap

    rows = []
    for f in sorted(licenses.TEXTS.glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        words = text.split()
        body = "\n".join(textwrap.wrap(" ".join(words[10 : len(words) * 4 // 5]), 60))
        rows += [(f"{k}/{f.stem}/{name}", t, f.stem) for k, (name, t) in enumerate([("LICENSE", text), ("COPYING", body)])]
        rows += [(f"{k}/{f.stem}/deep/x.txt", "nothing here", f.stem) for k in range(2)]
    rows.append(("p/LICENSE", "the house and the garden of the old man in the town, and the river that runs to the sea " * 20, None))
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string, want string")).collect()
    assert [(r["path"], r["license"]) for r in got if r["license"] != r["want"]] == []
    assert all(r["declares"] for r in got if r["want"] and not r["path"].endswith("x.txt"))


def test_scan_equals_sql_without_pruning(spark, tmp_path):
    """The SQL scores every window of every run: neither gate of the scan loses one."""
    import duckdb

    rng = random.Random(5)
    pieces = [t.split() for _, t in licenses.TEMPLATES]
    prose = "the river ran to the sea and all of it was so good that you can do as you like in any town".split()
    texts = [t for _, t, _ in WRAPPED] + [t for _, t in FILES]
    for _ in range(120):
        lines = []
        for _ in range(rng.randint(1, 8)):
            p = rng.choice(pieces)
            lines.append(rng.choice(["", "# ", "dnl ", " * "]) + " ".join(rng.choice([p[rng.randrange(len(p)) :], p[: rng.randint(1, 12)], rng.choices(prose, k=rng.randint(0, 9))])))
        texts.append("\n".join(lines))
    texts.append((licenses.TEXTS / "MIT.txt").read_text(encoding="utf-8"))
    texts.append(" ".join(prose) * 20_000)
    rows = [(i, t, rng.choice(["a", "a/b", "c", None]), rng.choice(["en", None])) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = ("doc_id", "path", "own", "score", "declares", "license", "found_in")
    want = sorted(con.execute(f"SELECT {', '.join(key)} FROM ({queries.license_sql()})").fetchall())
    got = sorted(tuple(r[k] for k in key) for r in queries.op7_licenses(spark, str(tmp_path)).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)
    assert sum(g[2] is not None for g in got) > 50


def test_anchors_are_needed():
    """What is left of a template without the anchors stays under the threshold."""
    parts, n = licenses.shares()
    rare = set(licenses.anchors())
    for i in range(n):
        assert sum(x[i] for x in parts.values()) == pytest.approx(1)
        assert math.sqrt(sum(x[i] for t, x in parts.items() if t not in rare)) < licenses.THRESHOLD


def test_every_template_finds_itself(spark):
    rows = [(i, None, t, name) for i, (name, t) in enumerate(licenses.TEMPLATES)]
    got = licenses.scan(spark.createDataFrame(rows, "i int, path string, text string, want string")).collect()
    assert [(r["i"], r["own"]) for r in got if r["own"] != r["want"]] == []
    assert all(r["score"] == pytest.approx(1) for r in got)


def test_cosine_equals_numpy(spark):
    from collections import Counter
    import json

    vectors, idf, unknown = licenses.weights()
    idf = json.loads(idf)
    line = "This file is licensed under the MIT License 2.0 MIT"
    c = Counter(licenses.terms(line))
    mine = {t: n * idf.get(t, unknown) for t, n in c.items()}
    best = 0.0
    for _, text in licenses.TEMPLATES:
        other = {t: n * idf[t] for t, n in Counter(licenses.terms(text)).items()}
        dot = sum(v * other.get(t, 0) for t, v in mine.items())
        best = max(best, dot / np.sqrt(sum(v * v for v in mine.values()) * sum(v * v for v in other.values())))
    got = spark.range(1).select(licenses.best_template(F.lit(line)).alias("b")).first()["b"]
    assert -got["s"] == pytest.approx(best, abs=1e-8)


@pytest.mark.parametrize("query", [queries.op7_licenses, queries.op9_urls])
def test_native_plans_hold_no_python(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_grams_equal_slices_and_long_urls_cost_their_length(spark):
    rows = [("ab\U0001f600c.de", "/x\ny"), ("", ""), ("h", "/" + "a1-" * 300_000)]
    df = spark.createDataFrame(rows, "host string, path string")
    got = df.select("host", "path", urls.grams(F.col("host"), F.col("path")).alias("g")).collect()
    for r in got[:2]:
        want = [m + t[i : i + n] for m, t in (("h", f"^{r.host}$"), ("p", f"^{r.path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)]
        assert r.g == want
    assert len(got[2].g) == 1 + 3 * (900_001 + 3) - 12
