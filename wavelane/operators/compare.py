"""Two copies of the same signals held against each other by fingerprints of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(samples: DataFrame, size: int) -> DataFrame:
    """(clip, block, n, high, low): of each block of positions, how many samples it has and the sums of the two halves of
    their hashes with their places. Rows may come in any order, and each task sums its own before the exchange."""
    h = F.xxhash64("pos", F.col("sample"))
    rows = samples.select("clip", F.floor(F.col("pos") / size).alias("block"), F.shiftright(h, 32).alias("h"), h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("l"))
    return rows.groupBy("clip", "block").agg(F.count("*").alias("n"), F.sum("h").alias("high"), F.sum("l").alias("low"))


def compare(sent: DataFrame, received: DataFrame, size: int = 4096) -> DataFrame:
    """One row a clip of either side (clip, pos, sample; the same types): clip, n_samples (received), lost (positions whose
    sample differs or is on one side only, a repeated one included), first_pos of them, and what was sent and received there.

    Fingerprints settle the blocks that agree; only the samples of the others are looked at one by one. Blocks that
    differ but have equal sums pass unseen with a chance of about 2 to the -64. Null samples equal each other."""
    a, b = (fingerprints(x, size).select("clip", "block", F.struct("n", "high", "low").alias(name)) for x, name in ((sent, "a"), (received, "b")))
    both = a.join(b, ["clip", "block"], "full")
    clips = both.groupBy("clip").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("n_samples"))
    damaged = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("clip", "block")

    def within(x: DataFrame, name: str) -> DataFrame:
        rows = x.withColumn("block", F.floor(F.col("pos") / size)).join(damaged, ["clip", "block"], "left_semi")
        return rows.groupBy("clip", "pos").agg(F.array_sort(F.collect_list(F.struct("sample"))).alias(name))

    odd = within(sent, "x").join(within(received, "y"), ["clip", "pos"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    one = lambda name: F.get(F.col(name)["sample"], F.lit(0))
    found = odd.groupBy("clip").agg(F.count("*").alias("lost"), F.min(F.struct("pos", one("x").alias("sent"), one("y").alias("received"))).alias("first"))
    out = clips.join(found, "clip", "left")
    return out.select("clip", "n_samples", F.coalesce("lost", F.lit(0)).alias("lost"), F.col("first.pos").alias("first_pos"), "first.sent", "first.received")
