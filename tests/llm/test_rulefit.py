"""Rule ensemble: statistics, trees, penalty and compiled rules against plain restatements, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelane.llm import queries, rulefit
from wavelane.llm.rulefit import Bound


def plainly(text: str) -> list[float]:
    words = text.encode().split()
    if not words:
        return [0.0] * len(rulefit.STATISTICS)
    n, body = len(words), b"".join(words)
    share = lambda signs: sum(b in signs for b in body) / len(body)
    windows: dict = {}
    for i in range(n - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    return [
        n, len(body) / n, max(map(len, words)), share(b"#*$%&|<>@^~=+_\\/{}[]"), share(b"!?"), share(b"."), share(b",;:"), share(b"0123456789"), share(bytes(range(65, 91))), share(bytes(range(192, 256))),
        -sum(c / len(body) * math.log2(c / len(body)) for c in Counter(body).values()), len(set(words)) / n, max(Counter(words).values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(covered) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
    ]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB1#!.,é \n\t\x0b\x00日", max_size=80))
def test_statistics(text):
    assert rulefit.measure(text.encode()) == pytest.approx(plainly(text))


def sample(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(rulefit.STATISTICS))).round(3)
    return x, ((x[:, 3] < 0.4) & (x[:, 11] > 0.3) | (x[:, 0] > 0.9)).astype(float)


def test_bounds_in_one_direction_merge():
    a = rulefit.conjunction((Bound("words", True, 2.0),), Bound("words", True, 5.0))
    assert a == (Bound("words", True, 5.0),)
    assert rulefit.conjunction(a, Bound("words", True, 1.0)) == a
    assert rulefit.conjunction(a, Bound("words", False, 9.0)) == tuple(sorted((Bound("words", False, 9.0), *a)))


def test_paths_lead_to_the_trees_values():
    x, y = sample(400)
    cuts = rulefit.cut_points(x)
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    rows = np.arange(0, 400, 2)
    paths, value = rulefit.grow(binned, cuts, rows, y, 3, 5)
    assert paths
    for r in range(400):
        deepest = [p for p in paths if rulefit.holds(p, x[r : r + 1])[0]]
        leaf = min(deepest, key=lambda p: rulefit.holds(p, x[rows]).sum())
        assert value[r] == pytest.approx(y[rows][rulefit.holds(leaf, x[rows])].mean())
    # The first split is the best of all, by trying every one.
    error = lambda m: ((y[rows][m] - y[rows][m].mean()) ** 2).sum() + ((y[rows][~m] - y[rows][~m].mean()) ** 2).sum()
    every = [error(x[rows, f] > c) for f, cs in enumerate(cuts) for c in cs if 5 <= (x[rows, f] > c).sum() <= 195]
    assert error(rulefit.holds(paths[0], x[rows])) == pytest.approx(min(every))


def test_lasso_meets_the_conditions_of_a_minimum():
    x, y = sample(300, 2)
    x = (x > 0.5).astype(float)
    for penalty in (0.003, 0.02, 0.08):
        w = rulefit.lasso(x, y, penalty, steps=5_000)
        gradient = x.T @ (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y) / len(y)
        assert abs((1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y).mean()) < 1e-4
        assert (np.abs(gradient) <= penalty + 1e-4).all()
        on = w[:-1] != 0
        assert gradient[on] == pytest.approx(-penalty * np.sign(w[:-1][on]), abs=1e-4)
    assert not rulefit.lasso(x, y, 1.0)[:-1].any()


def test_ensemble_is_sparse_and_finds_the_rule():
    x, y = sample(2_000)
    m = rulefit.fit(x, y)
    more, theirs = sample(2_000, 9)
    assert ((m.score(more) >= 0.5) == (theirs == 1)).mean() > 0.97
    assert 0 < len(m.rules) < len(rulefit.propose(x, y)) / 2


def test_compiled_rules(spark):
    x, y = sample(800)
    m = rulefit.fit(x, y)
    cuts = [b for r, _ in m.rules for b in r]
    for k, b in enumerate(cuts[:50]):  # values right at the cuts
        x[k, rulefit.STATISTICS.index(b.statistic)] = b.cut
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["doc_id", *rulefit.STATISTICS])
    got = {r.doc_id: r.s for r in df.select("doc_id", m.column().alias("s")).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(m.score(x).tolist())


def test_edge_rows(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 99)) for _ in range(60)) + "."
    junk = lambda: " ".join(rng.choice(["x###", "y&&&", "z***"]) for _ in range(60))
    rows = [(i, junk() if i % 4 == 0 else prose()) for i in range(200)]
    edge = [(None, prose()), (900, None), (901, ""), (902, " \n"), (903, "word " * 200_000), (1, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(k, t, "en", 0.5, 7) for k, t in rows + edge], "doc_id long, text string, lang string, score double, words int")
    marks = spark.createDataFrame([*((i, int(i % 4 > 0), 0) for i in range(200)), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = rulefit.score(docs, marks).collect()
    assert len(got) == len(rows) + len(edge)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1
    # Labels of held-out rows change nothing.
    flipped = marks.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(map(repr, rulefit.score(docs, flipped).collect())) == sorted(map(repr, got))
    assert rulefit.score(docs.limit(0), marks).count() == 0
    assert {r.score for r in rulefit.score(docs, marks.where("quality = 1")).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(marks[r.doc_id], r.score, r.predicted) for r in queries.op11_rules(spark, sf).collect() if r.held_out and r.doc_id in marks]
    good, bad = [s for q, s, _ in got if q == 1], [s for q, s, _ in got if q == 0]
    assert len(good) > 500 and len(bad) > 80
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    assert sum(p for q, _, p in got if q == 0) <= 0.05 * len(bad) and sum(1 - p for q, _, p in got if q == 1) <= 0.01 * len(good)
