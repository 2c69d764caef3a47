"""Packing of documents into token sequences: first-fit decreasing over a tournament tree of bin capacities,
run independently in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Ties in size keep their order.

    A node of the tree holds the largest free capacity below it, so the first bin that fits an item is found by
    one descent, and bins that were not opened yet are simply the leaves that are still full."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False, keep: int = 500_000) -> DataFrame:
    """Cuts each document's ids (its text's, then ``end_id``) into pieces of ``capacity`` and a rest.

    Null text: empty, so one piece with the end id. Null doc_id: stays null. Repeated rows: pieces of their own;
    ``nth`` numbers rows of equal doc_id and ids (``doc_crc32`` of all of them) within a task. ``with_ids`` adds the ids themselves as column ``ids`` (unsigned 32-bit, little-endian).
    ``keep``: how many words' ids a worker keeps, for time against memory."""
    schema = PIECES + ", doc_crc32 long, nth long" + (", ids binary" if with_ids else "")
    arrow = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.int64()) for c in schema.split(", ")])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, met = encoder(tokenizer, keep).encode, Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in batches_of(batch.column(1)):
                rows = []
                for key, found in zip(ids[at : at + len(texts)], encode(texts), strict=True):
                    found += end
                    n, whole = len(found) // 4, zlib.crc32(found)
                    nth = met[key, whole]
                    met[key, whole] += 1
                    for start in range(0, n, capacity):
                        part = found[4 * start : 4 * (start + capacity)]
                        rows.append((key, start, len(part) // 4, whole if n <= capacity else zlib.crc32(part), n, whole, nth, part)[: 7 + with_ids])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_docs: int = 2048, seed: int = 7, with_ids: bool = False, keep: int = 500_000) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there; a sequence has no gaps.

    Documents are dealt at random (by a seeded hash of doc_id, ids and a number for rows that repeat each other, so that
    a lost task gives the same rows again and such rows don't meet) into groups of about ``group_docs``; each group
    packs all its documents' pieces by itself, whatever the number of groups. A group is bounded by its random share and
    holds a few numbers a piece. Padding is the unused end of a sequence. Empty tables give no rows; other columns are
    ignored."""
    groups = max(1, -(-docs.count() // group_docs))
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_crc32", "doc_tokens", "nth"), F.lit(groups))
    pieces = token_pieces(docs, tokenizer, capacity, end_id, with_ids, keep).withColumn("group", key).drop("doc_crc32", "nth")

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(g["length"].to_numpy(), capacity)
        g["sequence_id"], g["offset"] = (g["group"].to_numpy(np.int64) << 32) + bins, offsets
        return g.drop(columns="group").astype({"doc_id": "Int64"})

    return pieces.groupBy("group").applyInPandas(place, PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")
