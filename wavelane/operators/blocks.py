"""Signals as blocks of a clip: clip, block, pcm (an array of up to ``size`` samples; all but the last are full).

A clip of any length is spread over tasks by its blocks, and what moves between tasks is arrays, not single samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profile import Profile


def block_size(p: Profile) -> int:
    """Samples in a block: whole voice-activity frames, whole hops, and no fewer than a spectral frame reaches over."""
    unit = math.lcm(p.vad_frame, p.hop)
    return unit * max(p.block // unit, -(-p.frame // unit))


def as_blocks(samples: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` samples from any layout: single samples (clip, pos, sample), pieces (clip, at, pcm: an array
    that starts at position ``at``), whole clips (clip, pcm) or such blocks themselves.

    Positions of a clip run from 0 without gaps; a block with a gap in it or before it is an error. Whole clips are cut
    where they are; the other layouts cost one exchange. Other columns are dropped. A clip with no samples has no block."""
    names = set(samples.columns)
    if {"block", "pcm"} <= names:
        return samples.select("clip", "block", "pcm")
    if "pcm" not in names:
        samples = samples.select("clip", F.col("pos").alias("at"), F.col("sample").alias("pcm"))
        return _filled(samples.groupBy("clip", F.floor(F.col("at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "pcm"))).alias("s")), F.col("s.pcm"), size)
    whole = "at" not in names
    rows = samples.select("clip", F.lit(0).cast("long").alias("at") if whole else F.col("at").cast("long").alias("at"), "pcm").where(F.size("pcm") > 0)
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.size("pcm") - 1) / size)
    rows = rows.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("block") * size - F.col("at"))
    rows = rows.select("clip", "block", F.greatest(F.col("at"), F.col("block") * size).alias("at"), cut("pcm", begin, (F.col("block") + 1) * size - F.greatest(F.col("at"), F.col("block") * size)).alias("pcm"))
    if whole:
        return rows.select("clip", "block", "pcm")
    return _filled(rows.groupBy("clip", "block").agg(F.array_sort(F.collect_list(F.struct("at", "pcm"))).alias("s")), F.flatten("s.pcm"), size)


def cut(array: str, begin: Column, length: Column) -> Column:
    """``length`` items of an array from place ``begin`` (from 0) on, or what there is of them."""
    return F.slice(array, begin.cast("int") + 1, F.greatest(F.lit(0), length).cast("int"))


def _filled(rows: DataFrame, pcm: Column, size: int) -> DataFrame:
    gap = F.col("s")[0]["at"] != F.col("block") * size
    rows = rows.withColumn("pcm", pcm)
    last = F.element_at("s", -1)["at"]
    width = F.lit(1) if rows.schema["s"].dataType.elementType["pcm"].dataType.typeName() != "array" else F.size(F.element_at("s", -1)["pcm"])
    gap = gap | (F.size("pcm") != last + width - F.col("block") * size)
    return rows.select("clip", "block", F.when(gap, F.raise_error(F.format_string("clip %s, block %d: positions have a gap or occur twice", F.col("clip").cast("string"), F.col("block")))).otherwise(F.col("pcm")).alias("pcm"))


def as_samples(blocks: DataFrame, size: int) -> DataFrame:
    """(clip, pos, sample)."""
    rows = blocks.select("clip", "block", F.posexplode("pcm").alias("i", "sample"))
    return rows.select("clip", (F.col("block") * size + F.col("i")).cast("long").alias("pos"), "sample")


def with_halo(blocks: DataFrame, before: int, after: int, size: int, column: str = "pcm", width: int = 1) -> DataFrame:
    """Adds ``before`` and ``after``: arrays of up to so many items of the block before and the one after (null at the
    ends of a clip). An item is ``width`` values of ``column``. Blocks of ``size`` items hold at least as many as a halo.

    Blocks meet with their neighbours' edges in one exchange of arrays. A block that others follow must be full."""
    if max(before, after) > size:
        raise ValueError("a halo is larger than a block")
    ends = [F.struct(F.lit(0).alias("role"), F.col("block").alias("to"), F.col(column).alias("v"))]
    if before:
        from_end = F.greatest(F.lit(0), F.size(column) - before * width)
        ends.append(F.struct(F.lit(1).alias("role"), (F.col("block") + 1).alias("to"), cut(column, from_end, F.lit(before * width)).alias("v")))
    if after:
        ends.append(F.struct(F.lit(2).alias("role"), (F.col("block") - 1).alias("to"), cut(column, F.lit(0), F.lit(after * width)).alias("v")))
    rest = [c for c in blocks.columns if c not in ("clip", "block", column)]
    kept = F.struct(*rest) if rest else F.lit(None)
    rows = blocks.select("clip", F.explode(F.array(*ends)).alias("e"), kept.alias("kept")).where("e.to >= 0")
    of = lambda role, v: F.first(F.when(F.col("e.role") == role, v), ignorenulls=True)
    rows = rows.groupBy("clip", F.col("e.to").alias("block")).agg(of(0, F.col("e.v")).alias(column), of(1, F.col("e.v")).alias("before"), of(2, F.col("e.v")).alias("after"), of(0, F.col("kept")).alias("kept"))
    rows = rows.where(F.col(column).isNotNull())
    short = F.col("after").isNotNull() & (F.size(column) < size * width) if after else F.lit(False)
    checked = F.when(short, F.raise_error(F.format_string("clip %s: block %d is not full and not the last", F.col("clip").cast("string"), F.col("block")))).otherwise(F.col(column))
    return rows.select("clip", "block", checked.alias(column), *(f"kept.{c}" for c in rest), "before", "after")
