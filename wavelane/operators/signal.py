"""Signals of clips to frames, spectra and features; any layout of samples that :func:`blocks.as_blocks` reads."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..profile import Profile
from ..shared import written
from .blocks import as_blocks, block_size, with_halo
from .scan import fold


def pcm_scale(samples: DataFrame) -> DataFrame:
    """x = sample / 32768."""
    return samples.select("clip", "pos", (F.col("sample") / F.lit(32768.0)).alias("x"))


#: Samples in a block: a clip is spread over tasks by blocks, however long it is.
BLOCK = 65_536


def pre_emphasis(samples: DataFrame, alpha: float = 0.97, block: int = BLOCK) -> DataFrame:
    """y = x - alpha * previous x; the first sample stays. An empty clip gives nothing.

    The window is a block of a clip; a block's last sample goes to the next block as well, for the lag there."""
    own = F.floor(F.col("pos") / block)
    rows = pcm_scale(samples).withColumn("own", own).withColumn("block", F.explode(F.when((F.col("pos") + 1) % block == 0, F.array(own, own + 1)).otherwise(F.array(own))))
    before = F.coalesce(F.lag("x", 1).over(Window.partitionBy("clip", "block").orderBy("pos")), F.lit(0.0))
    return rows.withColumn("y", F.col("x") - F.lit(alpha) * before).where("own = block").select("clip", "pos", "y")


def n_frames(length: Column, p: Profile) -> Column:
    """Full frames in a clip; none if it is shorter than one."""
    return F.when(length < p.frame, F.lit(0)).otherwise(F.floor((length - p.frame) / p.hop) + 1).cast("long")


def frame_count(samples: DataFrame, p: Profile = Profile()) -> DataFrame:
    sizes = samples.groupBy("clip").agg(F.count("*").alias("n_samples"))
    return sizes.select("clip", "n_samples", n_frames(F.col("n_samples"), p).alias("n_frames"))


def hamming(p: Profile = Profile()) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (p.frame - 1)) for i in range(p.frame)]


def hamming_table(spark: SparkSession, p: Profile = Profile()) -> DataFrame:
    i = F.col("id")
    return spark.range(p.frame).select(i.cast("int").alias("i"), (0.54 - 0.46 * F.cos(F.lit(2 * math.pi) * i / (p.frame - 1))).alias("w"))


def _framed(samples: DataFrame, p: Profile, alpha: float, out: str, make: Callable[[np.ndarray], np.ndarray], per_frame: bool = True) -> DataFrame:
    """Of each block of a clip, ``make`` of its windowed frames (one a row, after pre-emphasis): as column ``out``, a row a
    frame (clip, frame_idx, ``out``), or a row a block (clip, block, n, ``out`` as one flat array, ms).

    Blocks come with the samples after them that the last frames need and one sample before for the lag, so no task
    holds more of a clip. A frame counts if its last sample exists."""
    size = block_size(p)
    held = with_halo(as_blocks(samples, size), 1, p.frame - p.hop, size) if p.frame > p.hop else with_halo(as_blocks(samples, size), 1, 0, size)
    window, per_block = np.array(hamming(p)), size // p.hop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                began = time.perf_counter()
                pcm, before, after = (np.zeros(0) if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64) / 32768.0 for x in (b.column(c)[k] for c in ("pcm", "before", "after")))
                x = np.concatenate([pcm, after])
                y = x - alpha * np.concatenate([before if len(before) else [0.0], x[:-1]])
                n = min(per_block, (len(x) - p.frame) // p.hop + 1) if len(x) >= p.frame else 0
                found = make(np.lib.stride_tricks.sliding_window_view(y, p.frame)[: (n - 1) * p.hop + 1 : p.hop] * window) if n else np.zeros((0, 1))
                clip, block = b.column("clip").slice(k, 1), b.column("block")[k].as_py()
                if per_frame:
                    for i in range(0, n, 256):
                        part = found[i : i + 256]
                        rows = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(np.ascontiguousarray(part).ravel())
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays([clip] * len(part)), pa.array(block * per_block + i + np.arange(len(part))), pa.ListArray.from_arrays(*rows)], ["clip", "frame_idx", out])
                else:
                    yield pa.RecordBatch.from_arrays([clip, pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([found.ravel()], pa.list_(pa.float64())), pa.array([1000 * (time.perf_counter() - began)])], ["clip", "block", "n", out, "ms"])

    kind = dict(held.dtypes)["clip"]
    return held.mapInArrow(run, f"clip {kind}, frame_idx long, {out} array<double>" if per_frame else f"clip {kind}, block long, n long, {out} array<double>, ms double")


def frame_arrays(samples: DataFrame, p: Profile = Profile(), alpha: float = 0.97) -> DataFrame:
    """(clip, frame_idx, frame): the windowed samples of each full frame of a clip after pre-emphasis, as one array."""
    return _framed(samples, p, alpha, "frame", lambda x: x)


def frames(samples: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(clip, frame_idx, i, v): the samples of :func:`frame_arrays` one by one."""
    return frame_arrays(samples, p).select("clip", "frame_idx", F.posexplode("frame").alias("i", "v"))


def spectra(x: np.ndarray, p: Profile = Profile()) -> np.ndarray:
    """Magnitude / n_fft of the real transform of each zero-padded row."""
    return np.abs(np.fft.rfft(x, p.n_fft)) / p.n_fft


def dft_magnitude(samples: DataFrame, p: Profile = Profile(), alpha: float = 0.97) -> DataFrame:
    """(clip, frame_idx, mag): :func:`spectra` of each frame."""
    return _framed(samples, p, alpha, "mag", lambda x: spectra(x, p))


def hz_to_mel(hz: float) -> float:
    return 2595 * math.log10(1 + hz / 700)


def mel_to_hz(mel: float) -> float:
    return 700 * (10 ** (mel / 2595) - 1)


def mel_weights(p: Profile = Profile()) -> list[tuple[int, int, float]]:
    """(mel, bin, w), non-zero weights of triangles between equally spaced mel points from 0 to half the rate."""
    top = hz_to_mel(p.rate / 2)
    edges = [min(p.n_fft // 2, math.floor((p.n_fft + 1) * mel_to_hz(top * i / (p.n_mels + 1)) / p.rate)) for i in range(p.n_mels + 2)]
    out = []
    for m, (a, b, c) in enumerate(zip(edges, edges[1:], edges[2:], strict=False)):
        out += [(m, k, (k - a) / (b - a)) for k in range(a + 1, b)]
        out += [(m, k, (c - k) / (c - b)) for k in range(b, c)]
    return out


def mel_filterbank(spark: SparkSession, p: Profile = Profile()) -> DataFrame:
    return spark.createDataFrame(mel_weights(p), "mel int, bin int, w double")


def log_mels(x: np.ndarray, p: Profile = Profile()) -> np.ndarray:
    """ln(max(sum, 1e-10)) of each filter over the rows' spectra; one without weights gives ln(1e-10)."""
    return np.log(np.maximum(spectra(x, p) @ _bank(p).T, 1e-10))


@cache
def _bank(p: Profile) -> np.ndarray:
    bank = np.zeros((p.n_mels, p.n_fft // 2 + 1))
    for m, k, w in mel_weights(p):
        bank[m, k] = w
    return bank


def mel_log(samples: DataFrame, p: Profile = Profile(), alpha: float = 0.97) -> DataFrame:
    """(clip, frame_idx, fbank): :func:`log_mels` of each frame."""
    return _framed(samples, p, alpha, "fbank", lambda x: log_mels(x, p))


def merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and sum of squared deviations of two samples together, from those of either."""
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n


def moments(x: np.ndarray) -> tuple[int, float, float]:
    if not x.size:
        return 0, 0.0, 0.0
    mean = float(x.mean())
    return x.size, mean, float(((x - mean) ** 2).sum())


def fbank_blocks(samples: DataFrame, p: Profile = Profile(), alpha: float = 0.97) -> DataFrame:
    """(clip, block, n, fbank, ms): log-mel features of a block's frames in one flat array, standardised by one mean and
    population deviation per clip.

    Spectra are computed once and written. Each block has count, mean and squared deviations of its own; these merge
    pairwise in order of block to the clip's, so frames of a clip never meet."""
    rows = _framed(samples, p, alpha, "fbank", lambda x: log_mels(x, p), per_frame=False)
    kind = dict(rows.dtypes)["clip"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own = [moments(x.values.to_numpy()) for x in b.column("fbank")]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(zip(*own, strict=True), (pa.int64(), pa.float64(), pa.float64()), strict=True))], [*b.schema.names, "items", "mean", "m2"])

    rows = written(rows.mapInArrow(measure, f"clip {kind}, block long, n long, fbank array<double>, ms double, items long, mean double, m2 double"), "fbank")
    clips = fold(rows.select("clip", "block", "items", "mean", "m2"), merged)
    clips = clips.select("clip", F.col("mean").alias("center"), (F.sqrt(F.col("m2") / F.greatest(F.lit(1), F.col("items"))) + 1e-8).alias("spread"))
    return rows.join(clips, "clip").select("clip", "block", "n", F.transform("fbank", lambda v: (v - F.col("center")) / F.col("spread")).alias("fbank"), "ms")


def fbank(samples: DataFrame, p: Profile = Profile(), alpha: float = 0.97) -> DataFrame:
    """(clip, frame_idx, fbank): :func:`fbank_blocks`, a row a frame."""
    rows = fbank_blocks(samples, p, alpha).where("n > 0")
    each = rows.select("clip", "block", "fbank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return each.select("clip", (F.col("block") * (block_size(p) // p.hop) + F.col("i")).alias("frame_idx"), F.slice("fbank", (F.col("i") * p.n_mels).cast("int") + 1, p.n_mels).alias("fbank"))
