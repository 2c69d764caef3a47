"""Mixing of sources to target weights by Pareto order sampling.

Every document of a source is taken a whole number of times for certain. What the target still needs then is a sample
of further copies with unequal probabilities, in proportion to a document's size: those whose probability would exceed 1
are certain too, and the others go through Pareto sampling of fixed size, in strata of documents of like size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, sized_join, written

#: Steps of the histogram over the sampling rank; only the documents of one step per stratum are ordered exactly.
STEPS = 16_384


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Per source: source_size and target.

    Sources by code point (null last) take the weights in turn and share ``share`` of all sizes by weight. A target
    stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above:
    with sources in order of most * size / weight, those before the first whose fair part fits are full."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    rows = by_source.withColumn("w", w).withColumn("full_at", cap / F.col("w"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    part = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("part", part).withColumn("part", F.when(F.col("part") <= F.col("full_at"), F.col("part")))
    level = F.min_by("part", F.struct(F.col("part").isNull(), "full_at", F.col("source").isNull(), "source")).over(whole)
    return rows.select("source", "source_size", F.when(level.isNull(), cap).otherwise(F.least(cap, level * F.col("w"))).alias("target"))


def _unit(*parts) -> F.Column:
    """A number between 0 and 1, neither of them, from the first 52 bits of an MD5 sum of ``parts``."""
    text = F.concat_ws("|", *parts)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def further_copies(sizes: DataFrame) -> DataFrame:
    """``sizes`` (key, size, n, needs: a row for each source and size of its documents over 0) with ``chance``, that of
    a further copy: min(1, size / cut), so that the words expected of all of them are ``needs``.

    With the sizes in falling order, those from the largest on are certain until the rest fits: the first size whose
    chance, with all larger ones certain, is at most 1. A source has at most as many rows here as it has sizes."""
    down = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("needs") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(down), F.lit(0))
    squares = F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).over(rest)
    rows = sizes.withColumn("rate", left / squares)
    rows = rows.withColumn("rate", F.when((F.col("rate") >= 0) & (F.col("rate") * F.col("size") <= 1), F.col("rate")))
    first = F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("size"))).over(Window.partitionBy("key"))
    return rows.withColumn("chance", F.when(F.col("size") * first < 1, F.col("size") * first).otherwise(F.lit(1.0))).drop("rate")


def stratum(size) -> F.Column:
    """A number for sizes that differ by at most a quarter: four strata for each doubling. In whole numbers."""
    doublings = F.length(F.bin(size)) - 1
    return (doublings * 4 + F.floor(size * 4 / F.pow(F.lit(2.0), doublings)) - 4).cast("int")


def sample_sizes(sizes: DataFrame, seed: int) -> DataFrame:
    """(key, class, take) of ``sizes`` (key, size, n, chance): how many documents each stratum gives.

    The chances are summed up along a source's strata from a random start between 0 and 1, and a stratum gives as many
    as whole numbers are passed in it: its expected number, rounded up or down, and so does the source as a whole."""
    each = sizes.where("chance < 1").groupBy("key", stratum(F.col("size")).alias("class")).agg(F.sum(F.col("chance") * F.col("n")).alias("due"))
    to = F.sum("due").over(Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)) + _unit(F.lit(str(seed)), F.lit("start"), "key")
    each = each.withColumn("to", F.floor(to))
    before = F.coalesce(F.lag("to").over(Window.partitionBy("key").orderBy("class")), F.lit(0))
    return each.select("key", "class", (F.col("to") - before).alias("take"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``: 0, 1, ... among rows with an equal ``repeat``, in whatever order, for they are alike.

    Such rows are numbered within the part of the table they lie in and then through the parts, so that no task needs
    all the rows that repeat each other."""
    again = written(rows.groupBy("repeat").agg(F.count("*").alias("n")).where("n > 1").select("repeat"), "mix-repeats")
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    own = sized_join(rows, again, "repeat", "left_semi")
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("repeat", "part").orderBy("size")) - 1)
    through = Window.partitionBy("repeat").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("repeat", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(through), F.lit(0)))
    own = sized_join(own, written(parts.drop("n"), "mix-parts"), ["repeat", "part"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before")
    return sized_join(rows, again, "repeat", "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(own)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, chance, copies, taken (= copies * size).

    A source with target / size = c + rest takes every document c times; those copies are certain. ``chance`` is that
    of one more, in proportion to the document's size (see :func:`further_copies`); at 1 it is certain as well. The
    others are dealt into strata of like size, each with a fixed number of further copies (:func:`sample_sizes`), and
    within a stratum the lowest ranks of Pareto sampling are taken: the odds of a random number divided by the odds of
    the chance. The words taken are off the target by about one document whose further copy isn't certain, besides how
    sizes differ within a stratum.

    Random numbers are MD5 sums of seed, doc_id, source, text and, for rows equal in those, a running number; so reruns
    agree. Ranks are compared through a histogram per stratum (a map-side sum); only the documents of the one step in
    which the sample's size falls are ordered, so no stratum is ever sorted in one task.

    Null source: a source of its own, last. Null text or no words: size 0, never takes words. Repeated rows: each
    counts and is drawn by itself. Empty table: no rows. ``keep`` names columns of ``docs`` that the result carries."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest"), (F.xxhash64(*keep) if keep else F.lit(0).cast("long")).alias("tie"), *keep)
    rows = rows.withColumn("key", key).withColumn("repeat", F.xxhash64("doc_id", "key", "digest", "tie")).withColumn("part", F.spark_partition_id())
    rows = written(rows, "mix-sizes")
    goal = targets(rows.select("source", "size"), weights, share, most).withColumn("key", key).drop("source")
    goal = goal.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)))
    goal = written(goal.withColumn("needs", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))), "mix-targets")
    sizes = sized_join(rows.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), goal.select("key", "needs"), "key")
    sizes = written(further_copies(sizes).select("key", "size", "n", "chance"), "mix-chances")
    takes = written(sample_sizes(sizes, seed), "mix-takes")

    rows = sized_join(_numbered(rows.drop("source")).drop("part", "repeat"), goal.drop("needs"), "key")
    rows = sized_join(rows, sizes.drop("n"), ["key", "size"], "left").withColumn("chance", F.coalesce("chance", F.lit(0.0)))
    drawn = (F.col("chance") > 0) & (F.col("chance") < 1)
    u = _unit(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "key", "digest", F.col("nth").cast("string"))
    rows = rows.withColumn("class", F.when(drawn, stratum(F.col("size"))))
    rows = rows.withColumn("rank", F.when(drawn, u / (1 - u) / (F.col("chance") / (1 - F.col("chance")))))
    rows = rows.withColumn("step", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS), F.lit(STEPS - 1)))

    counts = rows.where("step IS NOT NULL").groupBy("key", "class", "step").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "class").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = sized_join(counts.withColumn("before", before), takes, ["key", "class"])
    edge = counts.where("before < take AND before + n >= take").select("key", "class", F.col("step").alias("edge"), (F.col("take") - F.col("before")).alias("open"))
    rows = sized_join(rows, written(edge, "mix-edges"), ["key", "class"], "left")
    at_edge = F.row_number().over(Window.partitionBy("key", "class").orderBy("rank", "doc_id", "digest", "tie", "nth"))
    sure = rows.where("step IS NULL OR edge IS NULL OR step <> edge").withColumn("more", F.when((F.col("chance") == 1) | (F.col("step") < F.col("edge")), 1).otherwise(0))
    near = rows.where("step = edge").withColumn("more", (at_edge <= F.col("open")).cast("int"))
    copies = F.col("certain") + F.col("more")
    out = sure.unionByName(near)
    return out.select("doc_id", "size", "source_size", "target", "chance", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *keep)
