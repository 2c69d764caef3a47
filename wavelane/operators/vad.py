"""Voice activity by frame energy over a noise floor, with hysteresis.

Energies are arrays, one a block of a clip. The latch crosses block borders by a scan over block summaries (see
:mod:`hysteresis`), so neither frames nor segments of a clip meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..profile import Profile
from ..shared import written
from . import hysteresis as h
from .blocks import as_blocks, block_size
from .scan import exclusive

SEGMENTS = "seg_id int, start_sample long, end_sample long, before long"


def energies(samples: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(clip, block, n, energy): samples in a block, and the mean square of each of its full frames, as one array.

    Worked out once and written; it is 1 / ``vad_frame`` of the samples. The tail that fills no frame has no energy.
    ``ms`` is what the work on a block took."""
    blocks = as_blocks(samples, block_size(p))

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for b in batches:
            out = []
            for pcm in b.column(2):
                began = time.perf_counter()
                x = pcm.values.to_numpy(zero_copy_only=False).astype(np.float64)
                full = len(x) // p.vad_frame
                out.append((len(x), (x[: full * p.vad_frame].reshape(full, p.vad_frame) ** 2).mean(1), 1000 * (time.perf_counter() - began)))
            if out:
                n, e, ms = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(e, pa.list_(pa.float64())), pa.array(ms)], ["clip", "block", "n", "energy", "ms"])

    kind = dict(blocks.dtypes)["clip"]
    return written(blocks.mapInArrow(square, f"clip {kind}, block long, n long, energy array<double>, ms double"), "energies")


def _per_block(p: Profile) -> int:
    return block_size(p) // p.vad_frame


def _frames(rows: DataFrame, p: Profile, *arrays: str) -> DataFrame:
    """(clip, frame_idx, one column an array)."""
    each = rows.select("clip", "block", F.posexplode(F.arrays_zip(*arrays)).alias("i", "x"))
    return each.select("clip", (F.col("block") * _per_block(p) + F.col("i")).cast("long").alias("frame_idx"), *(f"x.{a}" for a in arrays))


def energy(samples: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Mean square of each full tumbling frame; the tail that fills no frame is dropped."""
    return _frames(energies(samples, p), p, "energy")


def _clips(measured: DataFrame, p: Profile) -> DataFrame:
    """(clip, floor, frames, total, last): mean energy of a clip's first frames, null with fewer than calibration needs;
    its full frames and samples, and its last block. Sums of a row a block, partial in each task."""
    head = F.greatest(F.lit(0), F.lit(p.calib_frames) - F.col("block") * _per_block(p)).cast("int")
    first = F.slice("energy", 1, head)
    sums = measured.groupBy("clip").agg(
        F.sum(F.aggregate(first, F.lit(0.0), lambda a, e: a + e)).alias("f"), F.sum(F.size(first)).alias("calibrated"),
        F.sum(F.size("energy")).alias("frames"), F.sum("n").alias("total"), F.max("block").alias("last"),
    )
    floor = F.when((F.col("calibrated") >= p.calib_frames) & (F.col("calibrated") > 0), F.col("f") / F.col("calibrated"))
    return sums.select("clip", floor.alias("floor"), "frames", "total", "last")


def noise_floor(samples: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Mean energy of a clip's first frames; null with fewer frames than calibration needs."""
    return _clips(energies(samples, p), p).where("frames > 0").select("clip", F.col("floor").alias("noise_floor"))


def flagged(measured: DataFrame, p: Profile = Profile(), scope: str = "clip") -> DataFrame:
    """:func:`energies` with ``speech`` (an array of flags) and the clip's ``total`` and ``last``. Calibration frames are never speech.

    ``scope`` "clip": each clip calibrates by itself. "session": the first frames over all clips in order of clip
    calibrate once, for all (what one long-lived detector does); so many blocks at most are looked at for that."""
    clips = _clips(measured, p)
    rows = measured.join(clips.drop("frames"), "clip")
    floor, calib = F.col("floor"), lambda i: F.col("block") * _per_block(p) + i < p.calib_frames
    if scope == "session":
        head = _frames(measured.where(F.size("energy") > 0).orderBy("clip", "block").limit(p.calib_frames), p, "energy").orderBy("clip", "frame_idx").limit(p.calib_frames)
        one = head.agg(F.avg("energy").alias("f"), F.count("*").alias("n")).select(F.when(F.col("n") >= p.calib_frames, F.col("f")).alias("session"), F.lit(1).alias("one"))
        used = head.groupBy("clip").agg(F.max("frame_idx").alias("used"))
        # As many rows as calibration has frames at most.
        rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").join(F.broadcast(used), "clip", "left")
        floor, calib = F.col("session"), lambda i: F.coalesce(F.col("block") * _per_block(p) + i <= F.col("used"), F.lit(False))
    speech = F.transform("energy", lambda e, i: ~calib(i) & F.coalesce(e > F.lit(float(p.vad_factor)) * floor, F.lit(False)))
    return rows.select("clip", "block", "n", "energy", speech.alias("speech"), "total", "last")


def flags(samples: DataFrame, p: Profile = Profile(), scope: str = "clip") -> DataFrame:
    """(clip, frame_idx, energy, speech); see :func:`flagged`."""
    return _frames(flagged(energies(samples, p), p, scope), p, "energy", "speech")


def _entered(rows: DataFrame, p: Profile) -> DataFrame:
    """``rows`` (clip, block, speech, ...) with ``state``: latch, last flag and its run before the block."""
    kind = dict(rows.dtypes)["clip"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [h.summary(_bools(x), p) for x in b.column(2)]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True))], ["clip", "block", "n", "first", "lead", "last", "trail", "event"])

    summaries = rows.select("clip", "block", "speech").mapInArrow(summarise, f"clip {kind}, block long, {h.SUMMARY}")
    names = [c.split()[0] for c in h.SUMMARY.split(", ")]
    before = exclusive(summaries, h.composer(p), h.EMPTY).select("clip", "block", F.struct(*names).alias("state"))
    return rows.join(before, ["clip", "block"])


def _bools(x: pa.Scalar) -> np.ndarray:
    return np.array(x.values.to_numpy(zero_copy_only=False), bool)


def _state(x: pa.Scalar, p: Profile) -> tuple[int, int, int]:
    return h.after(tuple(x.as_py().values()), p)


def runs(found: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(clip, frame_idx, speech, run) of :func:`flagged` blocks: the number of equal flags up to and with each frame."""
    rows = _entered(found.select("clip", "block", "speech"), p)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                out = [h.run_lengths(_bools(x), _state(s, p)) for x, s in zip(b.column(2), b.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["clip", "block", "speech", "run"])

    kind = dict(rows.dtypes)["clip"]
    return _frames(rows.mapInArrow(count, f"clip {kind}, block long, speech array<boolean>, run array<long>"), p, "speech", "run")


def segments(samples: DataFrame, p: Profile = Profile(), scope: str = "clip") -> DataFrame:
    """(clip, seg_id, start_sample, end_sample): half-open; both ends dated back to the start of their run. A segment
    still open at the end stops at the clip's last sample, the dropped tail included. ``before``: samples in the
    clip's segments before it."""
    return segments_of(flagged(energies(samples, p), p, scope), p)


def segments_of(found: DataFrame, p: Profile = Profile()) -> DataFrame:
    """:func:`segments` of :func:`flagged` blocks. A first scan gives each block its state, a second one the segment that
    is open before it and how many are closed; then a block numbers and gives those it closes."""
    rows = _entered(found.select("clip", "block", "speech", "total", "last"), p)
    kind = dict(rows.dtypes)["clip"]
    of = lambda b, k: h.edges(_bools(b.column("speech")[k]), b.column("block")[k].as_py() * _per_block(p), p, _state(b.column("state")[k], p))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [of(b, k) for k in range(len(b))]
            if got:
                edges = [[{"begins": x, "at": at} for x, at in e] for e in got]
                what = list(zip(*map(h.closed, got), strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("clip", "block", "total", "last")), pa.array(edges, pa.list_(pa.struct([("begins", pa.bool_()), ("at", pa.int64())]))), *(pa.array(c, t) for c, t in zip(what, kinds, strict=True))], ["clip", "block", "total", "last", "found", "open", "closed", "samples", "head", "edges"])

    edges = rows.mapInArrow(find, f"clip {kind}, block long, total long, last long, found array<struct<begins: boolean, at: long>>, {h.CLOSED}")
    names = [c.split()[0] for c in h.CLOSED.split(", ")]
    before = exclusive(edges.select("clip", "block", *names), h.compose_closed, h.NOTHING).select("clip", "block", F.col("open").alias("begun"), "closed", "samples")
    busy = edges.drop(*names).join(before, ["clip", "block"]).where((F.size("found") > 0) | (F.col("block") == F.col("last")) & (F.col("begun") >= 0))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                start, seg, samples = r["begun"], r["closed"], r["samples"]
                ends = [(e["begins"], e["at"]) for e in r["found"]] + [(False, r["total"])] * (r["block"] == r["last"])
                for begins, at in ends:
                    if begins:
                        start = at
                    elif start >= 0:
                        if at > start:
                            out.append((r["clip"], seg, start, at, samples))
                            seg, samples = seg + 1, samples + at - start
                        start = -1
            if out:
                kinds = (b.schema.field("clip").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["clip", "seg_id", "start_sample", "end_sample", "before"])

    return busy.mapInArrow(close, f"clip {kind}, {SEGMENTS}")


def _pieces(samples: DataFrame, found: DataFrame, p: Profile) -> DataFrame:
    """(clip, seg_id, at, to, pcm): of each block the parts that lie in segments, with their place in the clip and in the
    joined segments. A segment meets the blocks that it touches; arrays are cut, samples aren't moved one by one.

    ``found`` from elsewhere may lack ``before``; then it is a running sum over a clip's segments."""
    size = block_size(p)
    if "before" not in found.columns:
        earlier = Window.partitionBy("clip").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("before", F.coalesce(F.sum(F.col("end_sample") - F.col("start_sample")).over(earlier), F.lit(0)))
    touched = found.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_sample") / size), F.floor((F.col("end_sample") - 1) / size))))
    rows = as_blocks(samples, size).join(touched, ["clip", "block"])
    at = F.greatest(F.col("start_sample"), F.col("block") * size)
    stop = F.least(F.col("end_sample"), F.col("block") * size + F.size("pcm"))
    rows = rows.withColumn("at", at).where(stop > at)
    return rows.select("clip", "seg_id", "at", (F.col("before") + F.col("at") - F.col("start_sample")).alias("to"), F.slice("pcm", (F.col("at") - F.col("block") * size).cast("int") + 1, (stop - F.col("at")).cast("int")).alias("pcm"))


def segment_slice(samples: DataFrame, found: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(clip, seg_id, pos, sample): the samples that lie in a segment."""
    rows = _pieces(samples, found, p).select("clip", "seg_id", "at", F.posexplode("pcm").alias("i", "sample"))
    return rows.select("clip", "seg_id", (F.col("at") + F.col("i")).cast("long").alias("pos"), "sample")


def segment_concat(samples: DataFrame, found: DataFrame, p: Profile = Profile()) -> DataFrame:
    """The segments of a clip one after the other, numbered anew, as pieces: (clip, at, pcm)."""
    return _pieces(samples, found, p).select("clip", F.col("to").cast("long").alias("at"), "pcm")


def segment_counts(samples: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy("clip").agg(F.count("*").alias("n_segments"))
    return samples.select("clip").distinct().join(counts, "clip", "left").select("clip", F.coalesce("n_segments", F.lit(0)).alias("n_segments"))
