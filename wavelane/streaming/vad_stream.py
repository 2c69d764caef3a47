"""Voice activity over a stream of samples; an extension, the batch operator is its measure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..profile import Profile

STATE = "tail array<double>, frames long, calib double, speech int, run long, open long, seen long, segs int"
OUT = "clip long, seg_id int, start_sample long, end_sample long"


def vad_stream(samples: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Rows (clip, pos, sample, is_end), a clip's batches in order of pos, to closed segments.

    State per clip: the part of a frame that is left, the calibration sum, the run, the latch and the open segment's
    start. A row with ``is_end`` (its sample may be null) flushes a segment that is open. Append mode."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, frames, calib, speech, run, opened, seen, segs = state.get if state.exists else ([], 0, 0.0, 0, 0, -1, 0, 0)
        rows = pd.concat(list(parts)).sort_values("pos")
        x = np.concatenate([np.array(tail, float), rows["sample"].dropna().to_numpy(float)])
        seen += int(rows["sample"].notna().sum())
        n = len(x) // p.vad_frame
        out = []
        for e in (x[: n * p.vad_frame].reshape(n, p.vad_frame) ** 2).mean(1):
            if frames < p.calib_frames:
                calib += e
                flag = 0
            else:
                flag = int(e > p.vad_factor * calib / p.calib_frames)
            run = run + 1 if flag == speech and frames else 1
            speech = flag
            frames += 1
            if flag and opened < 0 and run >= max(1, p.start_frames):
                opened = (frames - p.start_frames) * p.vad_frame
            elif not flag and opened >= 0 and run >= max(1, p.end_frames):
                out.append((key[0], segs, opened, (frames - p.end_frames) * p.vad_frame))
                opened, segs = -1, segs + 1
        if rows["is_end"].any() and opened >= 0:
            out.append((key[0], segs, opened, seen))
            opened, segs = -1, segs + 1
        state.update((x[n * p.vad_frame :].tolist(), frames, float(calib), speech, run, opened, seen, segs))
        yield pd.DataFrame([r for r in out if r[3] > r[2]], columns=["clip", "seg_id", "start_sample", "end_sample"])

    return samples.groupBy("clip").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
