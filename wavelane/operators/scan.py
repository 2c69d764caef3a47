"""Folds and prefix scans over the blocks of a clip by an associative operation on summaries.

Summaries meet in groups of FAN neighbours, the groups' totals by clip: two small exchanges of a row a block. No task
needs more of a clip at a time than FAN blocks, or one total for each FAN blocks. Groups are runs of a sorted partition,
so that very many short clips cost no more than their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FAN = 2048
#: Rows of a batch that goes out.
ROWS = 1024

Compose = Callable[[tuple, tuple], tuple]


def by_key(rows: DataFrame, keys: list[str], order: list[str], schema: str | StructType, run: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``run`` of the rows of each key, in ``order``, gives rows of ``schema``. Rows come as tuples in order of their columns."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow, at = to_arrow_schema(schema), [rows.columns.index(k) for k in keys]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []
        batch = lambda own: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own, strict=True), arrow, strict=True)], schema=arrow)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = [row[i] for i in at]
                if key != last and held:
                    out += run(held)
                    held = []
                    if len(out) >= ROWS:
                        yield batch(out)
                        out = []
                last = key
                held.append(row)
        if held:
            out += run(held)
        if out:
            yield batch(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(apply, schema)


def _grouped(summaries: DataFrame, fan: int) -> tuple[DataFrame, int]:
    names = [c for c in summaries.columns if c not in ("clip", "block")]
    return summaries.select("clip", F.floor(F.col("block") / fan).alias("group"), "block", *names), 3


def fold(summaries: DataFrame, compose: Compose, fan: int = FAN) -> DataFrame:
    """One row a clip: its summaries (clip, block, then columns of their own) composed in order of block. Without block."""
    grouped, own = _grouped(summaries, fan)
    total = lambda rows: [(*rows[0][:own], *reduce(compose, (r[own:] for r in rows)))]
    parts = by_key(grouped, ["clip", "group"], ["block"], grouped.schema, total)
    return by_key(parts, ["clip"], ["group"], grouped.schema, total).drop("block", "group")


def exclusive(summaries: DataFrame, compose: Compose, identity: tuple, fan: int = FAN) -> DataFrame:
    """For each block, what all blocks of its clip before it compose to: clip, block, then the summary's columns.

    ``identity`` composes with any summary to that summary. Block numbers are not null."""
    grouped, own = _grouped(summaries, fan)
    total = lambda rows: [(*rows[0][:own], *reduce(compose, (r[own:] for r in rows)))]

    def prefixes(rows: list[tuple], now: tuple = identity) -> list[tuple]:
        out = []
        for r in rows:
            out.append((*r[:own], *now))
            now = compose(now, r[own:])
        return out

    parts = by_key(grouped, ["clip", "group"], ["block"], grouped.schema, total)
    starts = by_key(parts, ["clip"], ["group"], grouped.schema, prefixes)
    # A group's start comes as one more row, in front, for its block is null.
    with_start = grouped.unionByName(starts.withColumn("block", F.lit(None).cast("long")))
    out = by_key(with_start, ["clip", "group"], ["block"], grouped.schema, lambda rows: prefixes(rows[1:], rows[0][own:]))
    return out.drop("group")
