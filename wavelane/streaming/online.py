"""What a stream knows of one clip, as plain functions over numpy arrays: detector, framer and decoder."""

from __future__ import annotations

import numpy as np

from ..operators.decode import SPECIAL, best_tokens
from ..operators.hysteresis import thresholds
from ..operators.signal import hamming, log_mels
from ..profile import Profile

#: The detector: what is left of a frame; the frames that a segment may yet claim; frames so far and the sum of the
#: calibration energies; the last flag and its run; the latch, and whether the last frame set it.
DETECTOR = "tail array<double>, held array<double>, frames long, calibration double, flag int, run long, latch int, started boolean"
QUIET = ([], [], 0, 0.0, 0, 0, 0, False)


def detect(state: tuple, samples: np.ndarray, ends: bool, p: Profile) -> tuple[tuple, np.ndarray]:
    """The state after ``samples``, and the samples that by now are known to lie in a segment, in order.

    Before a segment the last ``start_frames`` frames are held, for its start is dated back to them; in one, a run of
    silent frames is held until speech goes on or the run is long enough to end the segment where it began."""
    tail, held, frames, calibration, flag, run, latch, started = state
    off, on = thresholds(p)
    x = np.concatenate([np.asarray(tail, float), samples])
    n = len(x) // p.vad_frame
    out, kept = [], [np.asarray(held, float)] if len(held) else []
    size = sum(map(len, kept))
    full = x[: n * p.vad_frame].reshape(n, p.vad_frame)
    for frame, energy in zip(full, (full**2).mean(1).tolist(), strict=True):
        now = 0
        if frames < p.calib_frames:
            calibration += energy
        else:
            now = int(energy > p.vad_factor * calibration / p.calib_frames) if p.calib_frames else 0
        run = run + 1 if frames and now == flag else 1
        flag, frames, started = now, frames + 1, False
        kept.append(frame)
        size += len(frame)
        if latch and flag:
            out += kept
            kept, size = [], 0
        elif latch and run >= off:
            whole = np.concatenate(kept)
            out.append(whole[: max(0, len(whole) - p.end_frames * p.vad_frame)])
            latch, kept, size = 0, [], 0
        elif not latch and flag and run >= on:
            whole = np.concatenate(kept)
            out.append(whole[len(whole) - p.start_frames * p.vad_frame :])
            latch, started, kept, size = 1, True, [], 0
        elif not latch and size > (p.start_frames + 1) * p.vad_frame:
            kept = [np.concatenate(kept)[-p.start_frames * p.vad_frame :] if p.start_frames else np.zeros(0)]
            size = len(kept[0])
    rest = x[n * p.vad_frame :]
    if ends and latch:
        out += [*kept, rest]
        latch, kept = 0, []
    held = np.concatenate(kept) if kept else np.zeros(0)
    return (rest.tolist(), held.tolist(), frames, calibration, flag, run, latch, started), np.concatenate(out) if out else np.zeros(0)


#: The framer: scaled samples from the start of the next frame on, and the one before them.
FRAMER = "rest array<double>, before double"
FRESH = ([], 0.0)


def frame(state: tuple, speech: np.ndarray, p: Profile, alpha: float = 0.97) -> tuple[tuple, np.ndarray]:
    """The state after more ``speech``, and the log-mel features of the frames that are full by now."""
    rest, before = state
    x = np.concatenate([np.asarray(rest, float), speech / 32768.0])
    if len(x) < p.frame:
        return (x.tolist(), before), np.zeros((0, p.n_mels))
    y = x - alpha * np.append(before, x[:-1])
    n = (len(x) - p.frame) // p.hop + 1
    rows = np.lib.stride_tricks.sliding_window_view(y, p.frame)[: (n - 1) * p.hop + 1 : p.hop] * np.array(hamming(p))
    return (x[n * p.hop :].tolist(), float(x[n * p.hop - 1])), log_mels(rows, p)


#: The decoder: the token of the last step, and the text so far.
DECODER = "last int, text string, n_tokens long"


def decode(state: tuple, scores: np.ndarray, vocab: list[str], p: Profile) -> tuple:
    """Greedy decoding goes on: best token of each step, repeats and blanks dropped, special and unknown ones skipped."""
    last, text, n = state
    words = []
    for token in best_tokens(scores, p.blank_id).tolist():
        if token not in (p.blank_id, last) and token < len(vocab) and vocab[token] not in SPECIAL:
            words.append(vocab[token])
        last = token
    return last, text + "".join(words), n + len(words)
