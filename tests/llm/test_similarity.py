"""The similarity join against brute force on small fixtures."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.llm import similarity
from wavelane.llm.components import components

DOCS = "doc_id long, text string, node int, copies string, family int"


def grams(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 10 * len(a & b) >= 10 * threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    for i, (k, _) in enumerate(rows):  # texts without words: one class for each id
        for j in range(i):
            if not sets[i] and not sets[j] and k is not None and k == rows[j][0]:
                up[root(i)] = root(j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return [[rows[i][0] for i in g] for g in groups.values()], links, [root(i) for i in range(len(rows))]


def same_result(rows, got):
    """The documents' links, and the same classes under ids of which no two are equal and which are the smallest doc_id
    of their class wherever no other class has that."""
    groups, links, root = brute(rows)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((k, n) for k, _, n in got), key=key) == sorted(((k, n) for (k, _), n in zip(rows, links, strict=True)), key=key)
    classes: dict = {}
    for k, c, _ in got:
        if c is not None:
            classes.setdefault(c, []).append(k)
    named = [g for g in groups if any(k is not None for k in g)]
    order = lambda gs: sorted((sorted(g, key=lambda k: (k is None, k or 0)) for g in gs), key=lambda g: [(k is None, k or 0) for k in g])
    worded = {root[i] for i, (k, t) in enumerate(rows) if grams(t)}
    nameless = [[k for k, _ in (rows[i] for i in range(len(rows)) if root[i] == r)] for r in worded]
    nameless = [g for g in nameless if all(k is None for k in g)]
    assert order(classes.values()) == order([*named, *nameless])
    lows = [min(k for k in g if k is not None) for g in named]
    for c, g in classes.items():
        low = min((k for k in g if k is not None), default=None)
        assert c < 0 or c == low
        assert c == low or low is None or lows.count(low) > 1


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 12, 60, 200]))
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w) + rng.choice(["", " ", "\n", " tail"]))
    rng.shuffle(rows)
    return [(10 * i, t) for i, t in enumerate(rows)]


def run(spark, rows, **conf):
    df = spark.createDataFrame([(k, t, 1, "c", 2) for k, t in rows], DOCS)
    return [(r["doc_id"], r["class_id"], r["n_links"]) for r in similarity.join(df, **conf).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(3, None), (3, ""), (5, ""), (7, " \n\t"), (11, "one two"), (12, "one  two"), (13, "one"), (10, rows[0][1]), (0, rows[0][1]), (0, "another text of a repeated id here")]
    rows += [(-4, "first of two unrelated texts under one id"), (-4, "and the second one of them is this"), (None, None), (None, "")]
    same_result(rows, run(spark, rows))


def hot_rows():
    """Groups far over small block sizes: exact copies, near copies, and rows without ids."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(40)]
    return rows + [(None, " ".join(base)), *[(None, "all alone without an id and long enough")] * 2, *[(None, f"no id and a text of its own {i}") for i in range(30)]]


def test_small_blocks_lose_nothing(spark):
    rows = hot_rows()
    same_result(rows, run(spark, rows, bucket_rows=16, family_rows=8))
    same_result(rows, run(spark, rows, block_shingles=500))


def test_one_of_each(spark):
    """One row a class stays with its columns, whatever its id; unrelated texts under one id both stay."""
    rows = [*corpus(4), *hot_rows(), (5, "unrelated text number one under five"), (5, "and here quite another text for five"), (0, "a third text that has the id zero"), (7, ""), (7, None), (None, ""), (None, None)]
    rows += [rows[3], rows[3], (2_000_000, rows[3][1])]
    docs = spark.createDataFrame([(k, t, 1, "c", 2) for k, t in rows], DOCS)
    got = similarity.one_of_each(docs)
    assert got.columns == docs.columns
    groups, _, root = brute(rows)
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    stays: dict = {}
    for i, (k, t) in enumerate(rows):
        if k is None and not grams(t):
            stays[-1 - i] = [(k, t)]
        else:
            stays.setdefault(root[i], []).append((k, t))
    assert len(left) == len(stays)
    low = lambda g: min(((k is None, k or 0) for k, _ in g))
    for g in stays.values():
        assert any(x in left and (x[0] is None, x[0] or 0) == low(g) for x in g)


def test_no_documents(spark):
    assert run(spark, []) == []


def test_posterior_table_drops_only_the_unlikely():
    """A pair at the threshold passes every step with about the promised chance."""
    need = similarity.fewest_matches(0.8, 1e-6)
    rng = np.random.default_rng(4)
    p = 0.8 + 0.2 / 256
    hits = rng.random((200_000, similarity.HASHES)) < p
    kept = np.ones(len(hits), bool)
    for n, m in need:
        kept &= hits[:, :n].sum(1) >= m
    assert 1 - kept.mean() < 1e-3
    far = rng.random((2000, similarity.HASHES)) < 0.2
    gone = np.zeros(len(far), bool)
    for n, m in need:
        gone |= far[:, :n].sum(1) < m
    assert gone.mean() > 0.95


def test_exact_verification_by_blocks():
    rng = random.Random(5)
    texts = [t for _, t in corpus(6, 40)]
    rng.shuffle(texts)
    sets = [similarity.shingles(t) for t in texts]
    plain = [grams(t) for t in texts]
    want = {(i, j) for i, a in enumerate(plain) for j, b in enumerate(plain) if 10 * len(a & b) >= 8 * len(a | b)}

    def pairs(wanted=None):
        return {p for i, j in similarity.similar(sets, sets, 0.8, wanted, width=7) for p in zip(i.tolist(), j.tolist(), strict=True)}

    assert pairs() == want
    # Of the pairs asked for only, few or many in a block, the same ones are found.
    few = lambda x, y: (np.arange(min(2, len(sets) - max(x, y))),) * 2
    assert pairs(few) == {(i, j) for i, j in want if i % 7 == j % 7 < 2}


def test_rows_connected_are_those_that_surviving_pairs_connect():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (5, similarity.HASHES))
    sig = np.repeat(base, 30, 0)
    noise = rng.random(sig.shape) < 0.12
    sig = np.where(noise, rng.integers(0, 256, sig.shape), sig).astype(np.uint8)
    sig = sig[rng.permutation(len(sig))]
    need = similarity.fewest_matches(0.8, 1e-6)
    every = np.arange(len(sig))
    want = similarity.Forest(len(sig))
    want.link(*similarity.surviving(sig, sig, need))
    for left, right in ((every, every), (every[:70], every[70:])):
        got = similarity.connect(sig, left, right, need, width=16)
        if left is right:
            assert np.array_equal(got.roots(every), want.roots(every))
        else:
            i, j = similarity.surviving(sig[left], sig[right], need)
            assert np.array_equal(got.roots(left[i]), got.roots(right[j]))


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, b) for b in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
