"""The whole way from samples to text, with a pluggable scorer, in blocks of a clip from end to end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import decode, signal, vad
from ..operators.blocks import as_blocks, block_size, with_halo
from ..profile import Profile
from ..shared import written


class Scorer(Protocol):
    """Scores for rows of features, one row a frame. ``context`` frames on either side of a frame may count for it: so
    many come with a block (zeros beyond a clip's ends), and what is scored for them is cut off again."""

    context: int

    def of(self, rows: np.ndarray) -> np.ndarray: ...


class LinearScorer:
    """Scores are a fixed linear map of each frame's features; stands in for a trained model."""

    context = 0

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Rounded so that the decision doesn't hang on the order of summation."""
        return np.round(rows @ self.weights, 6)


class FilterScorer:
    """A fixed filter over time, then a linear map."""

    def __init__(self, taps: list[float], weights: np.ndarray):
        self.taps, self.weights, self.context = taps, weights, len(taps) // 2

    def of(self, rows: np.ndarray) -> np.ndarray:
        padded = np.pad(rows, ((self.context, self.context), (0, 0)))
        smooth = sum(h * padded[k : k + len(rows)] for k, h in enumerate(self.taps))
        return np.round(smooth @ self.weights, 6)


#: Models by name, once a Python worker.
_LOADED: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


class LoadedScorer:
    """A model that ``load`` gives in the worker, at the first block that it scores there; ``name`` tells models apart."""

    def __init__(self, name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], context: int = 0):
        self.name, self.load, self.context = name, load, context

    def of(self, rows: np.ndarray) -> np.ndarray:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name](rows)


def _scored(features: DataFrame, scorer: Scorer, p: Profile, out: str, kind: str, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(clip, block, n, ``out``, infer_ms, decode_ms): ``make`` of the scores of each block of features, as a flat array."""
    rows, width = features.where("n > 0").select("clip", "block", "n", "fbank"), p.n_mels
    if scorer.context:
        rows = with_halo(rows, scorer.context, scorer.context, block_size(p) // p.hop, "fbank", width)
    context, kinds = scorer.context, {"double": pa.float64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda x: x.values.to_numpy().reshape(-1, width) if x.is_valid else np.zeros((0, width))
        for b in batches:
            for k in range(len(b)):
                began = time.perf_counter()
                own = of(b.column("fbank")[k])
                x = own
                if context:
                    before, after = of(b.column("before")[k]), of(b.column("after")[k])
                    x = np.concatenate([np.zeros((context - len(before), width)), before, own, after, np.zeros((context - len(after), width))])
                scores = scorer.of(x)[context : context + len(own)]
                scored = time.perf_counter()
                made = make(scores)
                times = [pa.array([1000 * t]) for t in (scored - began, time.perf_counter() - scored)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in ("clip", "block")), pa.array([len(own)], pa.int64()), pa.array([made.ravel()], pa.list_(kinds[kind])), *times], ["clip", "block", "n", out, "infer_ms", "decode_ms"])

    clip = dict(rows.dtypes)["clip"]
    return rows.mapInArrow(run, f"clip {clip}, block long, n long, {out} array<{kind}>, infer_ms double, decode_ms double")


def score_blocks(features: DataFrame, scorer: Scorer, p: Profile = Profile()) -> DataFrame:
    """(clip, block, n, logits, infer_ms, decode_ms): scores of :func:`signal.fbank_blocks`, flat."""
    return _scored(features, scorer, p, "logits", "double", lambda x: x)


def token_blocks(features: DataFrame, scorer: Scorer, p: Profile = Profile()) -> DataFrame:
    """(clip, block, n, tokens, infer_ms, decode_ms): the best token of each frame; scores don't leave the task."""
    greedy, blank = p.beam_size <= 1, p.blank_id
    return _scored(features, scorer, p, "tokens", "int", lambda x: decode.best_tokens(x, blank, greedy))


def kept_tokens(tokens: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(clip, t, token_id) without blanks and, in greedy decoding, repeats. The step before a block's first comes with it."""
    size = block_size(p) // p.hop
    rows = with_halo(tokens.select("clip", "block", "tokens"), 1, 0, size, "tokens")
    before = lambda i: F.when(i > 0, F.get("tokens", i - 1)).otherwise(F.coalesce(F.get("before", F.lit(0)), F.lit(p.blank_id)))
    repeat = (lambda x, i: x == before(i)) if p.beam_size <= 1 else (lambda x, i: F.lit(False))
    each = F.transform("tokens", lambda x, i: F.when((x != p.blank_id) & ~repeat(x, i), F.struct((F.col("block") * size + i).cast("long").alias("t"), x.alias("token_id"))))
    return rows.select("clip", F.inline(F.array_compact(each)))


METRICS = ("audio_ms", "vad_ms", "preprocess_ms", "infer_ms", "decode_ms", "total_ms", "rtf")


def recognize_timed(samples: DataFrame, scorer: Scorer, vocab: DataFrame, p: Profile = Profile(), gate: bool = True) -> DataFrame:
    """(clip, text, n_tokens) and METRICS for every clip of ``samples``; clips without speech or frames have the empty text.

    With ``gate`` only speech goes on to features and scores, its segments joined first. Times are measured where the
    work is done, around each block of a clip, and summed by clip: energies; frames, spectra and features; scores; best
    tokens. What Spark does between (exchanges, joins) is no clip's own and is not counted. total_ms is the sum of the
    four, rtf total_ms over the clip's length (0 without length)."""
    size = block_size(p)
    measured = vad.energies(samples, p)
    clips = measured.groupBy("clip").agg(metrics.duration_ms(F.sum("n"), p.rate).alias("audio_ms"), F.sum("ms").alias("vad_ms"))
    speech = as_blocks(samples, size)
    if gate:
        speech = vad.segment_concat(samples, vad.segments_of(vad.flagged(measured, p), p), p)
    features = signal.fbank_blocks(speech, p)
    tokens = written(token_blocks(features, scorer, p), "tokens")
    text = decode.to_text(decode.vocab_lookup(kept_tokens(tokens, p), vocab), clips.select("clip"))
    spent = tokens.groupBy("clip").agg(F.sum("infer_ms").alias("infer_ms"), F.sum("decode_ms").alias("decode_ms"))
    framed = features.groupBy("clip").agg(F.sum("ms").alias("preprocess_ms"))
    out = clips.join(framed, "clip", "left").join(spent, "clip", "left").na.fill(0.0, ["preprocess_ms", "infer_ms", "decode_ms"]).join(text, "clip")
    total = F.col("vad_ms") + F.col("preprocess_ms") + F.col("infer_ms") + F.col("decode_ms")
    out = out.withColumn("total_ms", total).withColumn("rtf", metrics.real_time_factor(F.col("total_ms"), F.col("audio_ms")))
    return out.select("clip", "text", "n_tokens", *METRICS)


def recognize(samples: DataFrame, scorer: Scorer, vocab: DataFrame, p: Profile = Profile(), gate: bool = True) -> DataFrame:
    """(clip, text, n_tokens); see :func:`recognize_timed`. With ``gate`` a whole clip without samples is one without
    speech, as in the stream: it has the empty text, but no measures and so no row there."""
    out = recognize_timed(samples, scorer, vocab, p, gate).select("clip", "text", "n_tokens")
    if gate and "pcm" in samples.columns and not {"at", "block"} & set(samples.columns):
        silent = samples.where(F.coalesce(F.size("pcm"), F.lit(0)) <= 0)
        out = out.unionByName(silent.select("clip", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_tokens")))
    return out


def stage_times(samples: DataFrame, scorer: Scorer, vocab: DataFrame, p: Profile = Profile()) -> DataFrame:
    """One row of METRICS over all clips: sums, and the rate of these."""
    sums = recognize_timed(samples, scorer, vocab, p).agg(*(F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in METRICS[:-1]))
    return sums.withColumn("rtf", metrics.real_time_factor(F.col("total_ms"), F.col("audio_ms")))
