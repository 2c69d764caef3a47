"""Streamed voice activity and recognition against the batch operators."""

from __future__ import annotations

import random
import time
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelane import queries as speech
from wavelane.operators import hysteresis, vad
from wavelane.plans.recognize import LinearScorer, recognize
from wavelane.profile import Profile
from wavelane.shared import shared_path
from wavelane.streaming import online
from wavelane.streaming.recognize_stream import detector_states, drained, recognize_stream
from wavelane.streaming.vad_stream import vad_stream

P = Profile(vad_frame=4, calib_frames=5, start_frames=2, end_frames=3, factor=1.0)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    clips = {c: [rng.choice([0.5, 1.0, 4.0])] * 1 for c in range(6)}
    for c in clips:
        level = 1.0
        clips[c] = []
        for _ in range(rng.randint(30, 120)):
            level = level if rng.random() < 0.85 else rng.choice([0.3, 1.0, 5.0])
            clips[c].append(level)
    rows = [(c, i, x) for c, xs in clips.items() for i, x in enumerate(xs)]
    batch = vad.segments(spark.createDataFrame(rows, "clip long, pos long, sample double"), P)
    want = {tuple(r) for r in batch.select("clip", "seg_id", "start_sample", "end_sample").collect()}
    assert want

    # Chunks of uneven length, one file a trigger; the last one of each clip carries the end mark.
    schema = "clip long, pos long, sample double, is_end boolean"
    source, edges = tmp_path / "in", [0, 7, 30, 31, 75, 10_000]
    for a, b in zip(edges, edges[1:], strict=False):
        part = [(c, i, clips[c][i], i == len(clips[c]) - 1) for c in clips for i in range(a, min(b, len(clips[c])))]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = vad_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), P)
    query = stream.writeStream.format("memory").queryName("vad_segments_streamed").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert {tuple(r) for r in spark.table("vad_segments_streamed").collect()} == want


WEIGHTS = np.random.default_rng(4).normal(size=(5, 9)) * ([0.5] * 4 + [1.0] * 5)
VOCAB = ["<blank>", "<unk>", "<sos>", "<eos>", *(f"t{i}" for i in range(4, 8))]  # token 8 is unknown
Q = Profile(frame=12, hop=5, n_fft=16, n_mels=5, vad_frame=4, calib_frames=4, start_frames=2, end_frames=3, factor=1.2, block=40)


def noise(seed: int, n: int) -> list[float]:
    rng, level, out = random.Random(seed), 1.0, []
    for _ in range(n):
        level = level if rng.random() < 0.93 else rng.choice([0.4, 1.0, 6.0])
        out.append(level * rng.uniform(-3000, 3000))
    return out


def joined_speech(xs: list[float], p: Profile) -> list[float]:
    """By the batch functions on one block."""
    e = (np.array(xs[: len(xs) // p.vad_frame * p.vad_frame]).reshape(-1, p.vad_frame) ** 2).mean(1)
    floor = e[: p.calib_frames].mean() if len(e) >= p.calib_frames else np.inf
    flags = (np.arange(len(e)) >= p.calib_frames) & (e > p.vad_factor * floor)
    out, start = [], None
    for begins, at in [*hysteresis.edges(flags, 0, p, hysteresis.OFF), (False, len(xs))]:
        if begins:
            start = at
        elif start is not None:
            out += xs[start:at] if at > start else []
            start = None
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 200), st.lists(st.integers(0, 200), max_size=12), st.integers(0, 3), st.integers(0, 4))
def test_detector_and_framer_take_any_chunks(seed, n, cuts, start, end):
    p, xs = replace(Q, start_frames=start, end_frames=end), noise(seed, n)
    at = [0, *sorted(min(c, n) for c in cuts), n]
    state, framer, speech, rows = online.QUIET, online.FRESH, [], []
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        state, part = online.detect(state, np.array(xs[a:b]), k + 2 == len(at), p)
        assert len(state[1]) <= (max(start + 1, end) + 1) * p.vad_frame
        framer, found = online.frame(framer, part, p)
        speech += part.tolist()
        rows += found.tolist()
    assert speech == joined_speech(xs, p)
    _, whole = online.frame(online.FRESH, np.array(speech), p)
    assert np.array(rows).reshape(-1, p.n_mels) == pytest.approx(whole)


def chunks(rng, clip: int, xs: list[float], seq: int = 0) -> list[tuple]:
    out, at = [], 0
    while at < len(xs) or not out:
        n = rng.choice([0, 1, 3, 17, 60])
        out.append((clip, seq + len(out), xs[at : at + n], at + n >= len(xs), False, seq + len(out)))
        at += n
    return out


def batch_text(spark, clips: dict, scorer) -> dict:
    df = spark.createDataFrame([(c, xs) for c, xs in clips.items()], "clip long, pcm array<double>")
    vocab = spark.createDataFrame(list(enumerate(VOCAB)), "token_id int, token string")
    return {r["clip"]: (r["text"], r["n_tokens"]) for r in recognize(df, scorer, vocab, Q).collect()}


def run(spark, tmp_path, triggers: list[list[tuple]], timeout=None, watermark=None):
    schema = "clip long, seq long, pcm array<double>, is_end boolean, reset boolean, sec long"
    source = tmp_path / "in"
    for rows in triggers:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_000_000)).drop("sec").coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    stream = spark.readStream.schema("clip long, seq long, pcm array<double>, is_end boolean, reset boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    stream = stream.withWatermark("ts", watermark) if watermark else stream
    out = drained(recognize_stream(stream, LinearScorer(WEIGHTS).of, VOCAB, Q, timeout), str(tmp_path / "out"), str(tmp_path / "state"))
    return sorted(map(tuple, out.collect()))


def test_streamed_text_equals_batch(spark, tmp_path):
    """Uneven chunks over several triggers, delivered again now and then, out of order within one; and a reset."""
    rng = random.Random(6)
    clips = {c: noise(c, n) for c, n in enumerate((300, 420, 10, 0, 260))}
    triggers: list[list[tuple]] = [[], [], []]
    for c, xs in clips.items():
        own = chunks(rng, c, xs)
        if c == 4:  # noise before a reset counts for nothing
            own = [(4, k, noise(99 + k, 50), False, False, k) for k in range(3)] + [(4, 3, None, False, True, 3)] + chunks(rng, 4, xs, 4)
        a, b = sorted(rng.choices(range(1, len(own) + 1), k=2))
        for t, part in zip(triggers, (own[:a], own[a:b], own[b:]), strict=True):
            t += part
        if a < b:
            triggers[1].append(own[a - 1][:3] + (False, *own[a - 1][4:]))  # once more
    for t in triggers:
        rng.shuffle(t)
    got = run(spark, tmp_path, triggers)
    want = batch_text(spark, clips, LinearScorer(WEIGHTS))
    final = {c: (text, n) for c, _, text, n, end in got if end}
    assert final == want and any(text for text, _ in want.values())
    assert any(text and not end for _, _, text, _, end in got)  # provisional text on the way
    assert len([r for r in got if r[4]]) == len(clips)
    assert detector_states(spark, str(tmp_path / "state"), Q).count() == 0  # nothing is kept of clips that ended


def test_a_trigger_costs_one_row_and_one_state_a_clip(spark, tmp_path):
    """However many chunks a clip has: texts of every chunk would grow with their square."""
    xs = {c: noise(c, 240) for c in (1, 2)}
    rows = [(c, k, xs[c][3 * k : 3 * k + 3], k == 79, False, k) for c in xs for k in range(80)]
    got = run(spark, tmp_path, [[r for r in rows if r[1] // 30 == t] for t in range(3)])
    assert [(r[0], r[1], r[4]) for r in got] == [(c, k, k == 79) for c in xs for k in (29, 59, 79)]
    assert {r[0]: r[2:4] for r in got if r[4]} == batch_text(spark, xs, LinearScorer(WEIGHTS))
    assert any(r[2] for r in got)


def test_files_of_a_stream_are_bounded_and_in_order(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(speech, "CHUNKS", 2)
    paths = []
    monkeypatch.setattr(speech, "shared_path", lambda spark, label: paths.append(shared_path(spark, label)) or paths[-1])
    got = sorted(map(tuple, speech._recognize_stream(spark, sf).collect()))
    want = speech.recognize(speech.audio_pieces(spark, sf), LinearScorer(speech.WEIGHTS), F.broadcast(speech.vocab(spark)), speech.GATED)
    assert got == sorted(map(tuple, want.collect()))
    sizes = spark.read.parquet(paths[0]).groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] == 2


def test_missing_end_mark_and_states(spark, tmp_path):
    """A clip that stops arriving ends by event time, with the text of what there was; another one goes on."""
    xs, rng = noise(1, 300), random.Random(1)
    first = [(1, k, c[2], False, False, k) for k, c in enumerate(chunks(rng, 1, xs))]
    other = [(2, k, noise(2, 40), False, False, 5 + 100 * k) for k in range(3)]
    got = run(spark, tmp_path, [first + other[:1], other[1:2], other[2:]], "30 seconds", "1 second")
    assert [(r[0], r[2:4], r[4]) for r in got if r[4]][:1] == [(1, batch_text(spark, {1: xs}, LinearScorer(WEIGHTS))[1], True)]
    # By the batches: both clips, then one; a snapshot of an earlier trigger is there too.
    state = str(tmp_path / "state")
    assert {r["clip"] for r in detector_states(spark, state, Q, batch=0).collect()} == {1, 2}
    assert {r["clip"] for r in detector_states(spark, state, Q).collect()} <= {2}
    (r,) = detector_states(spark, state, Q, batch=0).where("clip = 1").collect()
    e = (np.array(xs).reshape(-1, Q.vad_frame) ** 2).mean(1)
    flags = (np.arange(len(e)) >= Q.calib_frames) & (e > Q.vad_factor * e[: Q.calib_frames].mean())
    latch, runs = hysteresis.latched(flags, Q), hysteresis.run_lengths(flags)
    assert r["position"] == len(xs) and (r["state"] == "silence") == (latch[-1] == 0)
    assert r["consecutive_speech"] == (runs[-1] if not latch[-1] and flags[-1] else 0)
    assert r["consecutive_silence"] == (runs[-1] if latch[-1] and not flags[-1] else 0)
