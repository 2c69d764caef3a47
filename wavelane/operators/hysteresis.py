"""A latch with run lengths as block summaries that compose: what a block of flags does to any state before it.

The latch is set by a run of ``start`` true flags and reset by one of ``end`` false flags. Of a block it matters how
long its first run is (it may go on one from before), what the last event after that run is, and how its last run ends.
"""

from __future__ import annotations

import numpy as np

from ..profile import Profile

#: n flags; the first flag and its run; the last flag and its run; the last event after the first run (1 set, 0 reset, -1 none).
SUMMARY = "n long, first int, lead long, last int, trail long, event int"
EMPTY = (0, 0, 0, 0, 0, -1)
#: Latch, last flag and how long it has lasted; before a clip begins.
OFF = (0, 0, 0)


def thresholds(p: Profile) -> tuple[int, int]:
    """Length of a run of false flags that resets, of true ones that sets."""
    return max(1, p.end_frames), max(1, p.start_frames)


def run_lengths(flags: np.ndarray, state: tuple[int, int, int] = OFF) -> np.ndarray:
    """For each flag, how many equal ones end with it, those before the block included."""
    at = np.arange(len(flags))
    begins = np.append(True, flags[1:] != flags[:-1]) if len(flags) else np.zeros(0, bool)
    out = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
    if len(flags) and state[2] and state[1] == int(flags[0]):
        inner = np.flatnonzero(begins[1:])
        out[: inner[0] + 1 if len(inner) else len(out)] += state[2]
    return out


def events(flags: np.ndarray, runs: np.ndarray, p: Profile) -> np.ndarray:
    off, on = thresholds(p)
    return np.where(flags & (runs >= on), 1, np.where(~flags & (runs >= off), 0, -1))


def latched(flags: np.ndarray, p: Profile, state: tuple[int, int, int] = OFF) -> np.ndarray:
    """The latch after each flag."""
    event = events(flags, run_lengths(flags, state), p)
    at = np.maximum.accumulate(np.where(event >= 0, np.arange(len(flags)), -1)) if len(flags) else np.zeros(0, int)
    return np.where(at >= 0, event[np.maximum(at, 0)], state[0])


def summary(flags: np.ndarray, p: Profile) -> tuple:
    n = len(flags)
    if not n:
        return EMPTY
    runs = run_lengths(flags)
    change = np.flatnonzero(flags[1:] != flags[:-1])
    lead = int(change[0]) + 1 if len(change) else n
    found = events(flags, runs, p)[lead:]
    found = found[found >= 0]
    return n, int(flags[0]), lead, int(flags[-1]), int(runs[-1]), int(found[-1]) if len(found) else -1


def composer(p: Profile):
    least = thresholds(p)

    def compose(a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, first, lead, last, trail, event = a
        m, head, lead_b, tail, trail_b, event_b = b
        joined = trail if last == head else 0  # how much of a run reaches into b
        if lead == n and first == head:
            lead, event = n + lead_b, event_b  # b's first run goes on the first run
        elif event_b >= 0:
            event = event_b
        elif joined + lead_b >= least[head]:
            event = head
        return n + m, first, lead, tail, joined + m if lead_b == m else trail_b, event

    return compose


def after(summary: tuple, p: Profile, state: tuple[int, int, int] = OFF) -> tuple[int, int, int]:
    """The state after what is summarised."""
    n, first, lead, last, trail, event = summary
    if not n:
        return state
    latch, flag, run = state
    entering = run if flag == first else 0
    if entering + lead >= thresholds(p)[first]:
        latch = first
    return (event if event >= 0 else latch), last, entering + n if lead == n else trail


#: What a block's edges do to segments: the start of the one it leaves open (-1: none), those it opens and closes and
#: their samples, the end of one that began before it (-1: none), and whether it has edges.
CLOSED = "open long, closed long, samples long, head long, edges boolean"
NOTHING = (-1, 0, 0, -1, False)


def edges(flags: np.ndarray, first_frame: int, p: Profile, state: tuple[int, int, int]) -> list[tuple[bool, int]]:
    """(whether a segment begins, where) in order; both ends dated back to the start of their run."""
    latch = latched(flags, p, state)
    before = np.append(state[0], latch[:-1])[: len(latch)]
    at = np.flatnonzero(latch != before)
    back = np.where(latch[at] == 1, p.start_frames, p.end_frames)
    return list(zip((latch[at] == 1).tolist(), ((first_frame + at + 1 - back) * p.vad_frame).tolist(), strict=True))


def closed(found: list[tuple[bool, int]]) -> tuple:
    open_, n, samples, head = -1, 0, 0, -1
    for k, (begins, at) in enumerate(found):
        if begins:
            open_ = at
        elif k == 0:
            head = at
        else:
            n, samples, open_ = n + (at > open_), samples + max(0, at - open_), -1
    return open_, n, samples, head, bool(found)


def compose_closed(a: tuple, b: tuple) -> tuple:
    if not b[4]:
        return a
    open_, n, samples, head = a[0], a[1] + b[1], a[2] + b[2], a[3]
    if b[3] >= 0:
        if a[4]:
            n, samples = n + (b[3] > open_), samples + max(0, b[3] - open_)
        else:
            head = b[3]
    return b[0], n, samples, head, True
