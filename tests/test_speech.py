"""Speech operators against hand-made cases and plain restatements."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.functions import metrics
from wavelane.operators import blocks, decode, signal, vad
from wavelane.plans.recognize import LinearScorer, recognize
from wavelane.profile import Profile
from wavelane.sources.vocab import parse_vocab, read_vocab
from wavelane.sources.wav import decode_wav, encode_wav, read_wav, write_wav


def samples(spark, clips: dict) -> object:
    rows = [(c, i, float(x)) for c, xs in clips.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "clip long, pos long, sample double")


def test_pre_emphasis(spark):
    got = signal.pre_emphasis(samples(spark, {1: [0, 32767, 0]})).orderBy("pos").collect()
    x = 32767 / 32768
    assert [r["y"] for r in got] == pytest.approx([0, x, -0.97 * x])
    assert signal.pre_emphasis(samples(spark, {})).collect() == []


def test_blocks_of_a_clip_join_without_a_seam(spark):
    """Lag and frames over block edges, and clips that end at one."""
    rng = np.random.default_rng(2)
    clips = {n: rng.integers(-3000, 3000, n) for n in (1, 2, 63, 64, 65, 128, 333)}
    df = samples(spark, clips)
    want = {(c, i): x[i] / 32768 - (0.97 * x[i - 1] / 32768 if i else 0) for c, x in clips.items() for i in range(len(x))}
    for block in (1, 2, 64):
        got = {(r["clip"], r["pos"]): r["y"] for r in signal.pre_emphasis(df, block=block).collect()}
        assert got == pytest.approx(want)
    p = Profile(frame=10, hop=4, vad_frame=4)
    w = np.array(signal.hamming(p))
    frame = lambda c, f: [want[c, 4 * f + i] * w[i] for i in range(10)]
    every = {(c, f): frame(c, f) for c, x in clips.items() for f in range((len(x) - 10) // 4 + 1 if len(x) >= 10 else 0)}
    for block in (1, 16, 28, 64):
        got = {(r["clip"], r["frame_idx"]): r["frame"] for r in signal.frame_arrays(df, replace(p, block=block)).collect()}
        assert set(got) == set(every)
        assert all(got[k] == pytest.approx(every[k]) for k in every)


def test_frame_counts(spark):
    lengths = [1, 239, 240, 241, 399, 400, 559, 560]
    got = signal.frame_count(samples(spark, {n: [0] * n for n in lengths}))
    assert {r["clip"]: r["n_frames"] for r in got.collect()} == dict(zip(lengths, [0, 0, 0, 0, 0, 1, 1, 2], strict=True))
    none = signal.frames(samples(spark, {7: [1] * 399}))
    assert none.count() == 0


def test_frames_are_windowed_slices(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3000, 3000, 900)
    y = x / 32768
    y = np.append(y[0], y[1:] - 0.97 * y[:-1])
    got = signal.frame_arrays(samples(spark, {1: x})).orderBy("frame_idx").collect()
    assert len(got) == (900 - 400) // 160 + 1
    for r in got:
        f = r["frame_idx"]
        assert r["frame"] == pytest.approx((y[160 * f : 160 * f + 400] * np.array(signal.hamming())).tolist())


def test_silent_frame_has_the_floor_in_every_mel(spark):
    (r,) = signal.mel_log(samples(spark, {1: [0] * 400})).collect()
    assert r["fbank"] == pytest.approx([math.log(1e-10)] * 80)


def test_mel_filter_two_is_empty():
    w = signal.mel_weights()
    assert not [x for x in w if x[0] == 2]
    assert len(w) == 425
    assert signal.mel_to_hz(signal.hz_to_mel(1234.5)) == pytest.approx(1234.5)


def test_dft_is_the_basis_sum(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3000, 3000, 400)
    (r,) = signal.dft_magnitude(samples(spark, {1: x})).collect()
    (f,) = signal.frame_arrays(samples(spark, {1: x})).collect()
    n = np.arange(400)
    for k in (0, 1, 77, 256):
        assert r["mag"][k] == pytest.approx(abs((np.array(f["frame"]) * np.exp(-2j * np.pi * k * n / 512)).sum()) / 512, abs=1e-12)


def test_cmvn_is_global(spark):
    rng = np.random.default_rng(3)
    got = signal.fbank(samples(spark, {1: rng.integers(-9000, 9000, 2000), 2: rng.integers(-90, 90, 1000)})).collect()
    for clip in (1, 2):
        v = np.array([r["fbank"] for r in got if r["clip"] == clip])
        assert v.mean() == pytest.approx(0, abs=1e-9)
        assert v.std() == pytest.approx(1, abs=1e-6)


def logits(spark, ids, width=4, clip=1):
    rows = [(clip, t, [1.0 if k == i else 0.0 for k in range(width)]) for t, i in enumerate(ids)]
    return spark.createDataFrame(rows, "clip int, t long, logits array<float>")


@pytest.fixture(scope="module")
def vocab(spark):
    return parse_vocab(spark.createDataFrame([("<blank>\na\nb\n<unk>\n",)], "value string"))


def test_greedy_collapses_and_beam_does_not(spark, vocab):
    x = logits(spark, [1, 1, 0, 1, 2, 2, 3])
    assert decode.decode(x, vocab).first()["text"] == "aab"
    assert decode.decode(x, vocab, beam_size=4).first()["text"] == "aaabb"


def test_clip_of_blanks_has_empty_text(spark, vocab):
    (r,) = decode.decode(logits(spark, [0, 0]), vocab).collect()
    assert (r["text"], r["n_tokens"]) == ("", 0)


@pytest.mark.parametrize(
    ("row", "greedy", "beam"),
    [([2.0, 5.0, 5.0], 1, 1), ([5.0, 1.0, 1.0], 2, 0), ([0.0, float("nan"), 1.0], 2, 2), ([float("nan"), 9.0, 1.0], 2, 1)],
)
def test_argmax_ties_nan_and_start_value(spark, row, greedy, beam):
    x = spark.createDataFrame([(1, 0, row)], "clip int, t long, logits array<float>")
    assert decode.argmax_tokens(x, blank_id=2).first()["token_id"] == greedy
    assert decode.argmax_tokens(x, blank_id=2, greedy=False).first()["token_id"] == beam


def test_beam_search_is_best_token_per_step(spark):
    """A plain beam search over sums of scores gives what the reduction says."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        t, v, width, blank = rng.integers(1, 7), rng.integers(2, 6), rng.integers(2, 7), 0
        x = rng.normal(size=(t, v))
        beams = [((), 0.0)]
        for row in x:
            grown = [(b + (() if i == blank else (i,)), s + row[i]) for b, s in beams for i in range(v)]
            beams = sorted(grown, key=lambda b: -b[1])[:width]
        assert list(beams[0][0]) == [i for i in x.argmax(1) if i != blank]


def test_token_topk(spark):
    x = spark.createDataFrame([(1, 0, [0.5, 2.0, 2.0, float("nan")])], "clip int, t long, logits array<float>")
    assert [(r["rank"], r["token_id"]) for r in decode.token_topk(x, 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 0)]


def machine(speech: list[bool], p: Profile, total: int) -> list[tuple[int, int]]:
    """The state machine, step by step: counters reset whenever the flag turns."""
    out, on, run_on, run_off, start = [], False, 0, 0, 0
    for f, flag in enumerate(speech):
        run_on, run_off = (run_on + 1, 0) if flag else (0, run_off + 1)
        if not on and flag and run_on >= p.start_frames:
            on, start = True, (f + 1 - p.start_frames) * p.vad_frame
        elif on and not flag and run_off >= p.end_frames:
            out.append((start, (f + 1 - p.end_frames) * p.vad_frame))
            on = False
    if on:
        out.append((start, total))
    return [s for s in out if s[1] > s[0]]


def test_segments_follow_the_state_machine(spark):
    rng = random.Random(5)
    clips, wanted = {}, {}
    p = Profile(vad_frame=2, calib_frames=3, start_frames=2, end_frames=3, factor=1.5)
    for c in range(60):
        flags, flag = [], rng.random() < 0.5
        for _ in range(rng.randint(1, 30)):
            flag = flag if rng.random() < 0.7 else not flag
            flags.append(flag)
        tail = rng.randint(0, 1)
        xs = [1.0] * 6 + [v for f in flags for v in [(5.0 if f else 0.5)] * 2] + [9.0] * tail
        clips[c] = xs
        wanted[c] = machine([False] * 3 + flags, p, len(xs))
    got: dict = {c: [] for c in clips}
    for r in vad.segments(samples(spark, clips), p).orderBy("clip", "seg_id").collect():
        got[r["clip"]].append((r["start_sample"], r["end_sample"]))
    assert got == wanted


def test_default_profile_segments(spark):
    quiet, loud = [1.0] * 320, [100.0] * 320
    ending = quiet * 50 + loud * 10 + quiet * 30
    open_end = quiet * 50 + loud * 6 + [100.0] * 100
    got = vad.segments(samples(spark, {1: ending, 2: open_end, 3: quiet * 54, 4: quiet * 50 + loud * 4 + quiet * 40}))
    assert {(r["clip"], r["start_sample"], r["end_sample"]) for r in got.collect()} == {(1, 16000, 19200), (2, 16000, 56 * 320 + 100)}


def test_session_calibration_reuses_the_first_frames(spark):
    p = Profile(vad_frame=1, calib_frames=2, start_frames=1, end_frames=1, factor=1.0)
    x = samples(spark, {1: [1, 1, 3], 2: [3, 0, 3]})
    got = {(r["clip"], r["frame_idx"]): r["speech"] for r in vad.flags(x, p, scope="session").collect()}
    assert got == {(1, 0): False, (1, 1): False, (1, 2): True, (2, 0): True, (2, 1): False, (2, 2): True}


def test_segment_concat_renumbers(spark):
    x = samples(spark, {1: range(10_000)})
    found = spark.createDataFrame([(1, 0, 5, 8), (1, 1, 4000, 4100)], "clip long, seg_id int, start_sample long, end_sample long")
    size = blocks.block_size(Profile())
    got = blocks.as_samples(blocks.as_blocks(vad.segment_concat(x, found), size), size).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(103))
    assert [r["sample"] for r in got] == [5, 6, 7, *range(4000, 4100)]
    counts = vad.segment_counts(x, found.where("clip < 0")).collect()
    assert [(r["clip"], r["n_segments"]) for r in counts] == [(1, 0)]


def test_modes():
    assert [Profile(mode=m).vad_factor for m in range(4)] == [4, 2, 4, 8]


def test_status_labels(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 7, 11, 99)], "c int").select(metrics.error_label(F.col("c")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["Success", "Invalid audio data", "Engine not initialized", "Unknown error"]
    zero = spark.range(1).select(metrics.real_time_factor(F.lit(5.0), F.lit(0.0)).alias("x"))
    assert zero.first()["x"] == 0.0


def test_vocabulary_lines(spark, tmp_path):
    f = tmp_path / "tokens.txt"
    f.write_bytes(b"a\r\nb\n\nc\n")
    assert [(r["token_id"], r["token"]) for r in read_vocab(spark, str(f)).orderBy("token_id").collect()] == [(0, "a"), (1, "b"), (2, ""), (3, "c")]


def test_wav_round_trip(spark, tmp_path):
    clips = spark.createDataFrame([("a", 16000, [1, -32768, 32767]), ("b", 8000, [])], "name string, sample_rate int, pcm array<smallint>")
    write_wav(clips, str(tmp_path / "out"))
    got = {r["path"].rsplit("/", 1)[1]: (r["sample_rate"], list(r["pcm"])) for r in read_wav(spark, str(tmp_path / "out/*.wav")).collect()}
    assert got == {"a.wav": (16000, [1, -32768, 32767]), "b.wav": (8000, [])}


def test_wav_bad_file_and_equal_names(spark, tmp_path):
    clips = spark.createDataFrame([("a", 8000, [1, 2]), ("b", 8000, [])], "name string, sample_rate int, pcm array<smallint>")
    write_wav(clips, str(tmp_path / "w"))
    (tmp_path / "w/c.wav").write_bytes(b"no sound")
    (tmp_path / "w/d.wav").write_bytes(encode_wav(np.array([1]))[:30])
    got = {r["path"][-5:]: (r["sample_rate"], r["pcm"], r["error"]) for r in read_wav(spark, str(tmp_path / "w")).collect()}
    assert got["a.wav"] == (8000, [1, 2], None) and got["b.wav"] == (8000, [], None)
    assert all(got[n][:2] == (None, None) and got[n][2] for n in ("c.wav", "d.wav"))
    assert sorted(f.name for f in (tmp_path / "w").iterdir() if not f.name.startswith(".")) == ["a.wav", "b.wav", "c.wav", "d.wav"]
    with pytest.raises(Exception, match="same name"):
        write_wav(clips.unionByName(clips), str(tmp_path / "v"))
    assert not list((tmp_path / "v").glob("*.wav"))


def test_wav_chunks_and_refusals():
    plain = encode_wav(np.array([5, 6], "<i2"))
    odd = plain[:12] + b"LIST\x04\x00\x00\x00abcd" + plain[12:] + encode_wav(np.array([7], "<i2"))[36:]
    assert decode_wav(odd)[1].tolist() == [7]  # unknown chunks are skipped, the last data chunk counts
    with pytest.raises(ValueError, match="RIFF"):
        decode_wav(b"JUNK" + plain[4:])
    with pytest.raises(ValueError, match="mono"):
        decode_wav(plain[:22] + b"\x02" + plain[23:])


def test_recognize_without_speech_is_empty(spark, vocab):
    scorer = LinearScorer(np.ones((80, 4)))
    got = recognize(samples(spark, {1: [1.0] * 4000}), scorer, vocab).collect()
    assert [(r["clip"], r["text"], r["n_tokens"]) for r in got] == [(1, "", 0)]


def test_recognize_gates_on_speech(spark, vocab):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-10, 10, 320 * 50), rng.integers(-9000, 9000, 320 * 12)])
    both = {1: x, 2: rng.integers(-10, 10, 320 * 60)}
    w = rng.normal(size=(80, 4))
    w[:, [0, 3]] = 0
    w[:, 2] = -w[:, 1]  # so one of the two real tokens beats the blank in every frame
    got = {r["clip"]: r["text"] for r in recognize(samples(spark, both), LinearScorer(w), vocab).collect()}
    assert set(got) == {1, 2}
    assert got[2] == ""
    assert got[1]
