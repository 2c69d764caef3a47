"""Decoding of scores per time step: clip, t, logits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPECIAL = ("<blank>", "<unk>", "<sos>", "<eos>")


def argmax_tokens(logits: DataFrame, blank_id: int = 0, greedy: bool = True) -> DataFrame:
    """(clip, t, token_id): the lowest index of the largest score; NaN never wins.

    Greedy decoding starts from the blank at index 0's score: index 0 (or NaN there) reads as the blank."""
    clean = F.transform("logits", lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x.cast("double")))
    rows = logits.withColumn("clean", clean)
    best = (F.array_position("clean", F.array_max("clean")) - 1).cast("int")
    if greedy:
        stuck = F.isnan(F.get("logits", F.lit(0)))
        best = F.when(stuck | (best == 0), F.lit(blank_id)).otherwise(best)
    return rows.select("clip", "t", best.alias("token_id"))


def best_tokens(scores: np.ndarray, blank_id: int = 0, greedy: bool = True) -> np.ndarray:
    """:func:`argmax_tokens` of an array, a row a step."""
    best = np.where(np.isnan(scores), -np.inf, scores).argmax(1)
    if greedy:
        best[np.isnan(scores[:, 0]) | (best == 0)] = blank_id
    return best.astype(np.int32)


def ctc_collapse(tokens: DataFrame, blank_id: int = 0) -> DataFrame:
    """Drops blanks and repeats of the step before; blanks count as a step before, so a-blank-a gives a twice."""
    before = F.coalesce(F.lag("token_id").over(Window.partitionBy("clip").orderBy("t")), F.lit(blank_id))
    return tokens.withColumn("before", before).where((F.col("token_id") != blank_id) & (F.col("token_id") != F.col("before"))).drop("before")


def vocab_lookup(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(clip, t, token): unknown ids and special tokens are dropped. A vocabulary has one row a token id."""
    return tokens.join(vocab, "token_id").where(~F.col("token").isin(*SPECIAL)).select("clip", "t", "token")


def to_text(words: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, text, n_tokens): tokens in order of time, without separators; a clip without tokens has the empty text."""
    rows = words.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "token"))).alias("w"))
    rows = rows.select("clip", F.array_join(F.col("w.token"), "").alias("text"), F.size("w").cast("long").alias("n_tokens"))
    return clips.join(rows, "clip", "left").select("clip", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def decode(logits: DataFrame, vocab: DataFrame, blank_id: int = 0, beam_size: int = 1) -> DataFrame:
    """Greedy decoding; with a beam over 1 repeats stay.

    Scores add up and steps don't depend on each other, so the best hypothesis of any beam is each step's best
    token without blanks; no beam needs to be kept."""
    tokens = argmax_tokens(logits, blank_id, beam_size <= 1)
    kept = ctc_collapse(tokens, blank_id) if beam_size <= 1 else tokens.where(F.col("token_id") != blank_id)
    return to_text(vocab_lookup(kept, vocab), logits.select("clip").distinct())


def token_topk(logits: DataFrame, k: int = 3) -> DataFrame:
    """(clip, t, rank, token_id) of the k best scores of each step, ties to the lower id."""
    each = F.transform("logits", lambda x, i: F.struct((-F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x.cast("double"))).alias("s"), i.alias("token_id")))
    top = F.slice(F.array_sort(each), 1, k)
    return logits.select("clip", "t", F.posexplode(top).alias("rank", "x")).select("clip", "t", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.token_id").cast("int").alias("token_id"))
