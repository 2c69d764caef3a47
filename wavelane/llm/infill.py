"""Fill-in-middle transformation by block rotations in place.

A text is cut at two places between its units (runs of Latin letters, and every other character by itself). The
sentinels go into one bytearray at the cuts; then neighbouring blocks change places by three reversals, in place. The
way back is the same rotation undone, after which the sentinels are taken out; it needs the output and its form only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that a reversal moves at a time.
SCRATCH = 1 << 16
#: Characters that are scanned at a time for cuts.
SCAN = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_INNER = (np.arange(256) & 0xC0) == 0x80  # bytes that continue a code point


def unit_starts(text: bytes) -> np.ndarray:
    """Where the units of a UTF-8 text begin, in bytes."""
    found, before = [], False  # whether a letter stands before the part
    for i in range(0, len(text), SCAN):
        x = np.frombuffer(text, np.uint8, min(SCAN, len(text) - i), i)
        letter = _LETTER[x]
        goes_on = letter & np.concatenate([[before], letter[:-1]])
        found.append(np.flatnonzero(~(goes_on | _INNER[x])) + i)
        before = bool(letter[-1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def code_points(text: bytes, start: int, stop: int) -> int:
    return sum(int((~_INNER[np.frombuffer(text, np.uint8, min(SCAN, stop - i), i)]).sum()) for i in range(start, stop, SCAN))


def reverse(buffer: bytearray, i: int, j: int) -> None:
    """Reverses ``buffer[i:j]`` in place, from both ends inwards, with SCRATCH bytes of scratch space."""
    view = np.frombuffer(buffer, np.uint8)
    while j - i > 1:
        n = min(SCRATCH, (j - i) // 2)
        left = view[i : i + n].copy()
        view[i : i + n] = view[j - n : j][::-1]
        view[j - n : j] = left[::-1]
        i, j = i + n, j - n


def rotate(buffer: bytearray, i: int, m: int, j: int) -> None:
    """``buffer[i:m]`` and ``buffer[m:j]`` change places: each reversed by itself, then both together."""
    reverse(buffer, i, m)
    reverse(buffer, m, j)
    reverse(buffer, i, j)


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The output for a text cut at bytes ``first`` and ``second``.

    With its sentinels the text reads prefix, middle, suffix. For ``psm`` the last two blocks change places, for
    ``spm`` the last one with the two before it."""
    out = bytearray(text)
    if form == PLAIN:
        return out
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the end, so that places hold
        out[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == PSM else 0, suffix, len(out))
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The text that :func:`arrange` was given. Texts with a sentinel in them are plain, so each sentinel is there once."""
    text = bytearray(output)
    if form == PLAIN:
        return text
    n = len(text)
    if form == PSM:
        at = text.index(SUFFIX)
        moved = n - text.index(MIDDLE)  # the middle's block, which stands last
        rotate(text, at, n - moved, n)
    else:
        rotate(text, 0, text.index(PREFIX), n)
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = text.index(sentinel)
        del text[at : at + len(sentinel)]
    return text


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits that hang on seed and id alone, so that reruns and lost tasks agree."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, check: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars and middle_chars (code points; null if plain),
    and ``output`` (the transformed text as UTF-8 bytes); with ``check`` also ``restored``, made from output and form alone.

    A map over the rows without a shuffle; each text is handled by itself, whatever its length. Both cuts are uniform
    over the n + 1 places between units. Plain: empty texts, texts that hold a sentinel's name, and all but ``percent``
    of the others; of these ``spm_percent`` have the suffix first. Null text: empty. Null doc_id: drawn as an empty id,
    and stays null. Repeated rows: each transformed, alike. Empty table: no rows. Other columns are ignored."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary" + (", restored binary" if check else "")
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary()), ("restored", pa.binary())][: 6 + check])

    def one(doc_id: int | None, text: bytes) -> tuple:
        h1, h2, h3, h4 = draws(doc_id, seed)
        starts = unit_starts(text)
        n = len(starts)
        if not n or h3 % 100 >= percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            form, first, second, sizes = PLAIN, 0, 0, (None, None)
        else:
            form = SPM if h4 % 100 < spm_percent else PSM
            first, second = (int(starts[k]) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            sizes = code_points(text, 0, first), code_points(text, first, second)
        output = arrange(text, first, second, form)
        out = doc_id, n, form, *sizes, bytes(output)
        return (*out, bytes(restore(output, form))) if check else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = batch.column(0).to_pylist(), [], 0
            for k, doc_id in enumerate(ids):
                rows.append(one(doc_id, batch.column(1)[k].as_py() or b""))
                held += len(rows[-1][5])
                if held > 32 * SCAN or k + 1 == len(ids):  # outputs are as large as texts: batches bounded by bytes
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows, held = [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
