"""Ranked lexical search against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelane.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def plainly(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(d, words(t)) for d, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        asked, scores = words(text), []
        for d, w in held:
            m = 100 - 25 + (25 * len(w) * n_docs) // n_terms
            score = 0
            for x in asked:
                df = sum(x in v for _, v in held)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 12 * m))
            scores.append((score, d))
        ranked = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(ranked)]
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAzZ09 -_\n\x00\x7f@[`{/:é日İ ", max_size=40))
def test_terms(text):
    assert [w.decode() for w in lexical.terms(text.encode())] == words(text)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_intervals_settle_on_the_best(data):
    """Against sums over whole lists: all that are at least as good as the kth, with exact scores."""
    n, k, least = data.draw(st.integers(1, 60)), data.draw(st.integers(1, 8)), data.draw(st.sampled_from([0, 0, 5, 12]))
    lists, total = [], np.zeros(n, np.int64)
    for _ in range(data.draw(st.integers(0, 6))):
        doc = np.array(data.draw(st.lists(st.integers(0, n - 1), unique=True, max_size=n)), np.int64)
        impact = np.sort(np.array([data.draw(st.integers(1, 6)) for _ in doc], np.int64))[::-1]
        total[doc] += impact
        lists.append((doc, impact))
    kth = max(least, sorted(total.tolist(), reverse=True)[min(k, n) - 1] if n >= k else 0)
    want = {(d, int(total[d])) for d in range(n) if total[d] > 0 and total[d] >= kth}
    for read in (1, 3, 64):
        old, lexical.READ = lexical.READ, read
        try:
            rows, scores = lexical.nra(lists, n, k, least)
        finally:
            lexical.READ = old
        assert set(zip(rows.tolist(), scores.tolist(), strict=True)) == want


def test_reads_end_before_the_lists_do():
    """One document far ahead in every list: the long lists of small impacts aren't read to their ends."""
    n = 100_000
    doc = np.arange(n)
    lists = [(doc, np.concatenate([[1000], np.full(n - 1, 3)])), (doc, np.concatenate([[900], np.full(n - 1, 2)]))]

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counting.read += at.stop - at.start
            return super().__getitem__(at)

    rows, scores = lexical.nra([(d, i.view(Counting)) for d, i in lists], n, 1)
    assert (rows.tolist(), scores.tolist()) == ([0], [1900])
    assert Counting.read < 1_000


def corpus(rng, n: int) -> list[tuple]:
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "日本", "The"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(rng.choice([i, i, i, None, 7]), " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 40])))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 60, "block_docs": 16, "block_entries": 50}])
def test_search_equals_plain_scoring(spark, sizes, monkeypatch):
    rng = random.Random(4)
    docs = [*corpus(rng, 120), (500, None), (501, ""), (502, "w1 " * 50_000), (503, "w3, W3; w3"), (504, "w3, W3; w3")]
    items = [*((i, " ".join(rng.choices(["w1", "w3", "w9", "w20", "the", "missing", "été", "Été"], k=rng.randint(1, 9)))) for i in range(12)), (3, "w2 w2 w2"), (None, "w5"), (90, None), (91, " .,"), (92, "nowhere")]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, rank int")
    got = lexical.search(d, q, k=7, **sizes).collect()
    plain = plainly(docs, items, 7)
    # Of repeated ids that tie, either row may come first; they look alike.
    assert sorted((tuple(r) for r in got), key=repr) == plain
    assert lexical.search(d.limit(0), q).count() == 0
    assert lexical.search(d, q.limit(0)).count() == 0


def test_many_lists_are_searched_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    n, t = 50, 12
    per_doc = np.full(n, t)
    lists = lexical.Lists(rng.integers(20, 60, n), per_doc, np.tile(np.arange(t), n), rng.integers(1, 5, n * t), rng.integers(1, 3000, t), 80, 3000)
    q = lexical.Query(0, 1, np.arange(t), rng.integers(1, 3, t))
    rows, scores = lexical.best(lists, q, 5, 0)
    monkeypatch.setattr(lexical, "MET", 7 * t)
    more, theirs = lexical.best(lists, q, 5, 0)
    assert {*zip(rows.tolist(), scores.tolist(), strict=True)} <= {*zip(more.tolist(), theirs.tolist(), strict=True)}
    top = lambda r, s: sorted(zip((-s).tolist(), r.tolist(), strict=True))[:5]
    assert top(rows, scores) == top(more, theirs)


def test_long_documents_do_not_overflow():
    big = np.array([2**40, 5])
    made = lexical.Lists(big, np.array([1, 1]), np.array([0, 0]), np.array([3, 1]), np.array([7]), 2**30, 2**41)
    m = [75 + 25 * int(x) * 2**30 // 2**41 for x in big]
    want = {i: 7 * (10**9 * tf // (1000 * tf + 12 * m[i])) for i, tf in ((0, 3), (1, 1))}
    assert dict(zip(made.doc.tolist(), made.impact.tolist(), strict=True)) == {i: s for i, s in want.items() if s}
