"""The list of hypotheses against a plain beam, and damage found by fingerprints against a plain comparison."""

from __future__ import annotations

import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelane.operators import beam, compare

VOCAB = ["<blank>", "<unk>", "<sos>", "<eos>", "a", "b", "c"]


def plain_beam(steps: list[list[float]], k: int) -> list[tuple[float, tuple[int, ...]]]:
    """Keeps ``k`` hypotheses a step, with the tie rule: at the first difference, the better place among the step's scores."""
    kept = [(0.0, (), ())]
    for scores in steps:
        order = sorted(range(len(scores)), key=lambda v: (-scores[v], v))
        kept = sorted(((s + scores[v], places + (place,), tokens + (v,)) for s, places, tokens in kept for place, v in enumerate(order)), key=lambda h: (-h[0], h[1]))[:k]
    return [(s, tokens) for s, _, tokens in kept]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=4), min_size=1, max_size=5), st.integers(1, 7))
def test_merging_keeps_the_best(losses, k):
    ways = [[(float(-x), ((t, i, i),) if i else ()) for i, x in enumerate(sorted([0, *step]))] for t, step in enumerate(losses)]
    every = sorted(((sum(w[0] for w in c), sum((w[1] for w in c), ())) for c in product(*ways)), key=beam._key)[:k]
    left = [(0.0, ())]
    for w in ways:
        left = beam.merge(left, w, k)
    half = len(ways) // 2
    parts = []
    for own in (ways[:half], ways[half:]):
        kept = [(0.0, ())]
        for w in own:
            kept = beam.merge(kept, w, k)
        parts.append(kept)
    assert left == every == beam.merge(*parts, k)


@pytest.mark.parametrize("k", [1, 5])
def test_hypotheses_equal_a_plain_beam(spark, k, monkeypatch):
    rng = random.Random(3)
    # Whole numbers: many ties, and sums without rounding. A clip of one step has fewer hypotheses than asked for.
    clips = {c: [[float(rng.randint(0, 6)) for _ in range(8 if c else 3)] for _ in range(n)] for c, n in enumerate((1, 2, 9, 40))}
    rows = [(c, 10 * t, s) for c, steps in clips.items() for t, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "clip long, t long, logits array<double>").repartition(3)
    vocab = spark.createDataFrame(list(enumerate(VOCAB)), "token_id int, token string")
    want = {}
    for c, steps in clips.items():
        for i, (s, tokens) in enumerate(plain_beam(steps, k)):
            words = [VOCAB[v] for v in tokens if 3 < v < len(VOCAB)]
            want[c, i + 1] = (s, "".join(words), len(words))
    assert len(want) == k * 4 - max(0, k - 3)
    for stretch in (20, 1024):
        monkeypatch.setattr(beam, "STRETCH", stretch)
        assert {(r["clip"], r["rank"]): (r["score"], r["text"], r["n_tokens"]) for r in beam.hypotheses(df, vocab, k).collect()} == want


def test_hypotheses_of_odd_scores(spark):
    nan, low = float("nan"), float("-inf")
    df = spark.createDataFrame([(1, 0, [nan, 1.0, nan]), (1, 1, [2.0, low, 1.0])], "clip long, t long, logits array<double>")
    vocab = spark.createDataFrame(list(enumerate(["-", "x", "y"])), "token_id int, token string")
    got = beam.hypotheses(df, vocab, 9, blank_id=0).orderBy("rank").collect()
    assert [(r["score"], r["text"]) for r in got] == [(3.0, "x"), (2.0, "xy")]
    assert beam.hypotheses(df.limit(0), vocab, 3).count() == 0


def test_damage_is_found_and_named(spark):
    rng = random.Random(5)
    sent = [(c, i, rng.randint(-99, 99)) for c in range(5) for i in range(200)]
    got = {(c, i): x for c, i, x in sent}
    got[1, 150] += 1
    got[1, 70] -= 3
    del got[2, 199]
    for i in range(200):
        del got[3, i]
    # Two samples that change places leave sums of samples as they were.
    got[4, 10], got[4, 11] = 7, 8
    sent = [(c, i, {(4, 10): 8, (4, 11): 7}.get((c, i), x)) for c, i, x in sent]
    schema = "clip long, pos long, sample long"
    a = spark.createDataFrame([*sent, (9, 0, None)], schema).repartition(4)
    b = spark.createDataFrame([*((c, i, x) for (c, i), x in got.items()), (7, 3, 5), (9, 0, None), (0, 0, next(x for c, i, x in sent if (c, i) == (0, 0)))], schema).orderBy(F.rand(1))
    for size in (8, 4096):
        rows = {r["clip"]: tuple(r)[1:] for r in compare.compare(a, b, size).collect()}
        x = {(c, i): v for c, i, v in sent}
        assert rows == {0: (201, 1, 0, x[0, 0], x[0, 0]), 1: (200, 2, 70, x[1, 70], x[1, 70] - 3), 2: (199, 1, 199, x[2, 199], None), 3: (0, 200, 0, x[3, 0], None), 4: (200, 2, 10, 8, 7), 7: (1, 1, 3, None, 5), 9: (1, 0, None, None, None)}
    assert {r["lost"] for r in compare.compare(a, a, 16).collect()} == {0}
