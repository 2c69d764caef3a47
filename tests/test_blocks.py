"""Blocks of a clip: layouts, halos, scans, and that nothing hangs on where blocks begin."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from wavelane.operators import blocks, hysteresis, scan, signal, vad
from wavelane.profile import Profile

P = Profile(frame=10, hop=4, n_fft=16, n_mels=3, vad_frame=4, calib_frames=3, start_frames=2, end_frames=3, factor=1.2, block=1)


def long(spark, clips: dict):
    return spark.createDataFrame([(c, i, float(x)) for c, xs in clips.items() for i, x in enumerate(xs)], "clip long, pos long, sample double")


def clips(seed: int, lengths) -> dict:
    rng = random.Random(seed)
    out = {}
    for c, n in enumerate(lengths):
        level, xs = 1.0, []
        for _ in range(n):
            level = level if rng.random() < 0.9 else rng.choice([0.4, 1.0, 6.0])
            xs.append(round(level * rng.uniform(0.9, 1.1), 3))
        out[c] = xs
    return out


def test_layouts_agree(spark):
    held = clips(1, (1, 7, 8, 9, 40))
    rng = random.Random(2)
    pieces = []
    for c, xs in held.items():
        at = 0
        while at < len(xs):
            n = rng.randint(1, 11)
            pieces.append((c, at, xs[at : at + n]))
            at += n
    want = {(c, i, tuple(xs[i * 8 : i * 8 + 8])) for c, xs in held.items() for i in range(-(-len(xs) // 8))}
    whole = spark.createDataFrame([*((c, xs) for c, xs in held.items()), (99, [])], "clip long, pcm array<double>")
    for df in (long(spark, held), spark.createDataFrame(pieces, "clip long, at long, pcm array<double>"), whole):
        got = blocks.as_blocks(df, 8)
        assert {(r["clip"], r["block"], tuple(r["pcm"])) for r in got.collect()} == want
        assert {tuple(r) for r in blocks.as_samples(blocks.as_blocks(got, 8), 8).collect()} == {(c, i, x) for c, xs in held.items() for i, x in enumerate(xs)}


@pytest.mark.parametrize("gone", [0, 3, 9])
def test_gaps_are_errors(spark, gone):
    df = long(spark, {1: range(20)}).where(f"pos <> {gone}")
    with pytest.raises(SparkRuntimeException, match="gap"):
        blocks.as_blocks(df, 8).collect()
    with pytest.raises(SparkRuntimeException, match="gap|not full"):
        blocks.with_halo(blocks.as_blocks(df.union(long(spark, {1: [5.0]})).where("pos <> 7"), 8), 1, 2, 8).collect()


def test_halo(spark):
    df = blocks.as_blocks(long(spark, {1: range(20), 2: range(8)}), 8)
    got = {(r["clip"], r["block"]): (r["before"], r["after"]) for r in blocks.with_halo(df, 2, 5, 8).collect()}
    assert got == {(1, 0): (None, [8, 9, 10, 11, 12]), (1, 1): ([6, 7], [16, 17, 18, 19]), (1, 2): ([14, 15], None), (2, 0): (None, None)}
    assert {tuple(r["before"] or ()) for r in blocks.with_halo(df.withColumn("more", F.lit(1)), 1, 0, 8).collect()} == {(), (7,), (15,)}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.lists(st.integers(0, 40), max_size=5), st.integers(0, 4), st.integers(0, 4))
def test_summaries_compose(flags, cuts, start, end):
    """However a row of flags is cut: summaries compose to that of the whole, in any bracketing, and states carry over."""
    p = replace(P, start_frames=start, end_frames=end)
    x, compose = np.array(flags, bool), hysteresis.composer(p)
    at = [0, *sorted(min(c, len(x)) for c in cuts), len(x)]
    parts = [x[a:b] for a, b in zip(at, at[1:], strict=False)]
    own = [hysteresis.summary(part, p) for part in parts]
    left = hysteresis.EMPTY
    for s in own:
        left = compose(left, s)
    right = hysteresis.EMPTY
    for s in reversed(own):
        right = compose(s, right)
    assert left == right == hysteresis.summary(x, p)
    state, latch, runs = hysteresis.OFF, [], []
    for part, s in zip(parts, own, strict=True):
        latch += hysteresis.latched(part, p, state).tolist()
        runs += hysteresis.run_lengths(part, state).tolist()
        state = hysteresis.after(s, p, state)
    assert latch == hysteresis.latched(x, p).tolist() and runs == hysteresis.run_lengths(x).tolist()
    now = 0
    for i, (flag, run) in enumerate(zip(flags, runs, strict=True)):  # a plain latch
        now = 1 if flag and run >= max(1, start) else 0 if not flag and run >= max(1, end) else now
        assert latch[i] == now
    found = []
    state = hysteresis.OFF
    whole = hysteresis.edges(x, 0, p, state)
    for part, s, a in zip(parts, own, at, strict=False):
        found.append(hysteresis.edges(part, a, p, state))
        state = hysteresis.after(s, p, state)
    assert sum(found, []) == whole
    left = hysteresis.NOTHING
    for f in found:
        left = hysteresis.compose_closed(left, hysteresis.closed(f))
    assert left == hysteresis.closed(whole)


def test_scans_in_small_groups(spark):
    rows = [(c, b, f"{c}{b} ") for c in range(3) for b in range(17 if c else 1)]
    df = spark.createDataFrame(rows, "clip long, block long, s string").repartition(4)
    compose = lambda a, b: (a[0] + b[0],)
    for fan in (2, 5, 100):
        assert {r["clip"]: r["s"] for r in scan.fold(df, compose, fan).collect()} == {c: "".join(s for k, _, s in rows if k == c) for c in range(3)}
        got = {(r["clip"], r["block"]): r["s"] for r in scan.exclusive(df, compose, ("",), fan).collect()}
        assert got == {(c, b): "".join(s for k, j, s in rows if k == c and j < b) for c, b, _ in rows}


def test_moments_merge():
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1e-3, 500)
    parts = np.split(x, [0, 1, 7, 300])
    total = (0, 0.0, 0.0)
    for part in parts:
        total = signal.merged(total, signal.moments(part))
    assert total[0] == 500 and total[1] == pytest.approx(x.mean(), rel=1e-15) and total[2] == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-6)
    assert signal.merged((0, 0.0, 0.0), (0, 0.0, 0.0)) == (0, 0.0, 0.0)


def test_results_do_not_hang_on_blocks(spark):
    held = clips(3, (0, 3, 9, 12, 64, 500, 501))
    df = long(spark, held).repartition(5)
    seen = []
    for block in (1, 20, 64, 65_536):
        p = replace(P, block=block)
        found = vad.segments(df, p)
        joined = blocks.block_size(p)
        seen.append((
            sorted(map(tuple, found.collect())),
            sorted(map(tuple, vad.runs(vad.flagged(vad.energies(df, p), p), p).collect())),
            sorted(map(tuple, blocks.as_samples(blocks.as_blocks(vad.segment_concat(df, found, p), joined), joined).collect())),
            sorted((r["clip"], r["frame_idx"], *(round(v, 9) for v in r["fbank"])) for r in signal.fbank(df, p).collect()),
        ))
    assert all(map(len, seen[0]))
    assert all(s == seen[0] for s in seen[1:])


def test_no_clip_meets_in_one_task(spark):
    """Plans have no window, and what is grouped by clip alone are totals of groups of blocks."""
    df = long(spark, clips(4, (300,)))
    for out in (vad.segments(df, P), signal.fbank(df, P)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan


def test_one_long_clip(spark):
    """Two million frames of one clip: segments as a plain latch has them, and no task with a large share of the blocks."""
    n = 2_000_000
    rng = np.random.default_rng(5)
    flags = np.repeat(rng.random(n // 20) < 0.5, 20)
    p = Profile(vad_frame=1, hop=1, frame=1, calib_frames=1, start_frames=5, end_frames=30, factor=1.5, block=8192)
    made = spark.range(0, n // 8000, 1, 16).select(F.lit(1).alias("clip"), (F.col("id") * 8000).alias("at"))

    def fill(batches):
        import pyarrow as pa

        for b in batches:
            rows = [np.where(flags[a : a + 8000], 5.0, 1.0) for a in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["clip", "at", "pcm"])

    flags[0] = False
    latch = hysteresis.latched(np.append(False, flags[1:]), p)
    got = vad.segments(made.mapInArrow(fill, "clip int, at long, pcm array<double>"), p).collect()
    change = np.flatnonzero(np.diff(np.append(0, latch)))
    starts, ends = change[0::2] + 1 - 5, np.append(change[1::2] + 1 - 30, n)[: len(change[0::2])]
    want = [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert len(want) > 1_000
    assert sorted((r["seg_id"], r["start_sample"], r["end_sample"]) for r in got) == want
    lengths = np.array([b - a for _, a, b in want])
    assert [r["before"] for r in sorted(got, key=lambda r: r["seg_id"])] == (np.cumsum(lengths) - lengths).tolist()
