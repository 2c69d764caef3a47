"""Quality counts against a plain restatement, and the promise of the cutoffs."""

from __future__ import annotations

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelane.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, n_words int, kept string"


def slow(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows: dict = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab#*é \n\t\x0b\x0c\r\x1c\x85 日", max_size=80))
def test_counts(text):
    assert quality.measure(text)[:5] == slow(text)


def test_counts_of_long_repeats():
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join(rng.choices(["x", "y", "z", "w w w", "\nline"], k=rng.randint(0, 400)))
        assert quality.measure(text)[:5] == slow(text)


def test_binomial_tail_is_the_sum():
    for n, k, p in ((10, 3, 0.2), (200, 0, 0.02), (50, 50, 0.4), (400, 2, 0.005)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoff_needs_proof():
    n = len(quality.CUTOFFS)
    assert quality.choose_cutoff([0] * n, 10, [5] * n, 0.02, 0.05) is None  # ten documents prove nothing
    assert quality.choose_cutoff([0] * n, 5000, list(range(n)), 0.02, 0.05) == quality.CUTOFFS[-1]
    # Testing stops at the first cutoff without proof, even if a later one looked fine.
    assert quality.choose_cutoff([0, 0, 400, *[0] * (n - 3)], 5000, [1, 2, *[900] * (n - 2)], 0.02, 0.05) == quality.CUTOFFS[1]


def document(rng, good: bool) -> str:
    words = [rng.choice("abcdefghij") * rng.randint(2, 7) for _ in range(60)]
    if not good:
        words = [w + "#" * (2 * len(w)) for w in words]
    return " ".join(words)


def test_judge_rejects_junk_and_keeps_good(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        good = rng.random() < 0.7
        rows.append((i, document(rng, good), "xy"[i % 2], 1, "k"))
        labels.append((i, int(good)))
    rows += [(9000, None, "x", 1, "k"), (9001, "", None, 1, "k"), (9002, "few words", "x", 1, "k"), (9003, "one two three four five six " * 9, "x", 1, "k"), (None, document(rng, True), "x", 1, "k"), (0, rows[0][1], "x", 1, "k")]
    docs = spark.createDataFrame(rows, DOCS)
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    good = dict(labels)
    inner = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 3000]
    assert all(r["kept"] for r in inner if good[r["doc_id"]])
    assert not any(r["kept"] for r in inner if not good[r["doc_id"]])
    base = {r["doc_id"]: r["base_failed"] for r in got if (r["doc_id"] or 0) >= 9000}
    assert base == {9000: True, 9001: True, 9002: True, 9003: True}
    by_text = {}
    for k, t, *_ in rows:
        by_text.setdefault(k, slow(t or ""))
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == by_text[r["doc_id"]]


def test_risk_holds_on_fresh_documents(spark):
    """Over several draws, the false rejections on documents outside the holdout stay below the risk."""
    rng = random.Random(3)
    over = 0
    for draw in range(3):
        rows, labels = [], []
        for i in range(4000):
            good = rng.random() < 0.8
            n = 60
            marks = sum(rng.random() < (0.03 if good else 0.25) for _ in range(n))
            rows.append((i, " ".join([f"{rng.choice('abcdefgh')}{k}{draw}" for k in range(n)] + ["#"] * marks), "x", 1, "k"))
            labels.append((i, int(good)))
        held = [x for x in labels if x[0] % 2]
        got = quality.judge(spark.createDataFrame(rows, DOCS), spark.createDataFrame(held, "doc_id long, quality int")).collect()
        mark = dict(labels)
        fresh = [r["kept"] for r in got if r["doc_id"] % 2 == 0 and mark[r["doc_id"]]]
        over += fresh.count(False) > 0.02 * len(fresh)
        assert not all(r["kept"] for r in got)
    assert over == 0


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, document(random.Random(4), False), None, 1, "k")], DOCS)
    assert [r["kept"] for r in quality.judge(docs, none).collect()] == [True]
    assert quality.judge(docs.where("false"), none).collect() == []


def test_cutoffs_and_verdicts_equal_sql(spark):
    """Counts, the proven cutoffs and the verdicts of every document, against DuckDB."""
    import duckdb

    from wavelane.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.op6_quality(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op6_quality']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_five_hundred_good_rows_prove_a_cutoff(spark):
    """A stratum of 300 good rows rejects its junk; one of 100 proves nothing and keeps all that the base rules keep."""
    fine, junk = "plain words of a text that says one thing after another", "#### $$$$ words ## && of ** junk ||| <<>> and ### more $$ of it"
    rows = [(i, junk if i % 10 == 0 else f"{fine} {i}", "a" if i < 330 else "b") for i in range(440)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(440)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert got == {i: i >= 330 or i % 10 != 0 for i in range(440)}
