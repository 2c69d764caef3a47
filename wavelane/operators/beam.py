"""The list of hypotheses of a beam: the k best ways to take one token a step, by the sum of their scores.

Steps don't depend on each other, so a hypothesis is each step's best token but for a few changes, and the k best of two
stretches of a clip come from the k best of either. Stretches are folded by that; no beam is carried along a clip.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import vocab_lookup
from .scan import by_key, fold

#: Steps that meet in one task first.
STRETCH = 1024

Hypothesis = tuple[float, tuple[tuple[int, int, int], ...]]  # what it loses against the best, and its changes (t, rank, token)


def _key(h: Hypothesis) -> tuple:
    """Ties go to the hypothesis that keeps the best token longer, then to the change of smaller rank."""
    return -h[0], tuple((-t, rank) for t, rank, _ in h[1])


def merge(a: list[Hypothesis], b: list[Hypothesis], k: int) -> list[Hypothesis]:
    """The k best pairs of two sorted lists, sorted; only pairs next to ones already taken are looked at."""
    if not a or not b:
        return (a or b)[:k]
    joined = lambda i, j: (a[i][0] + b[j][0], a[i][1] + b[j][1])
    heap, seen, out = [(_key(joined(0, 0)), 0, 0)], {(0, 0)}, []
    while heap and len(out) < k:
        _, i, j = heappop(heap)
        out.append(joined(i, j))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heappush(heap, (_key(joined(x, y)), x, y))
    return out


def hypotheses(logits: DataFrame, vocab: DataFrame, k: int, blank_id: int = 0) -> DataFrame:
    """(clip, rank from 1, score, text, n_tokens): the ``k`` best hypotheses of each clip (all, if there are fewer), best first.

    A hypothesis is a token for each step; its score is the plain sum of the steps' scores, its text leaves out blanks,
    special and unknown tokens and keeps repeats, so two may have the same text. NaN counts as minus infinity, and such
    tokens are in no hypothesis but a step's best. Ties: at the first step where two differ, the token with the better
    place among the step's scores (equal ones by id). Steps of a clip are told apart by ``t``."""
    score = lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x.cast("double"))
    each = F.transform("logits", lambda x, i: F.struct((-score(x)).alias("s"), i.alias("token")))
    top = logits.select("clip", F.col("t").cast("long").alias("t"), F.slice(F.array_sort(each), 1, k).alias("top")).withColumn("block", F.floor(F.col("t") / STRETCH))
    kind = dict(top.dtypes)["clip"]
    pack = lambda hs: [{"loss": loss, "changes": [dict(zip(("t", "rank", "token"), c, strict=True)) for c in changes]} for loss, changes in hs]
    unpack = lambda hs: [(h["loss"], tuple((c["t"], c["rank"], c["token"]) for c in h["changes"])) for h in hs]

    def stretch(rows: list[tuple]) -> list[tuple]:
        base, kept = 0.0, [(0.0, ())]
        for _, t, ranked, _ in rows:
            scores = [-x["s"] for x in ranked]
            base += scores[0] if scores else 0.0
            ways = [(s - scores[0], ((t, i, ranked[i]["token"]),) if i else ()) for i, s in enumerate(scores) if not i or s > float("-inf")]
            kept = merge(kept, ways, k)
        return [(rows[0][0], rows[0][3], base, pack(kept))]

    stretches = by_key(top, ["clip", "block"], ["t"], f"clip {kind}, block long, base double, found array<struct<loss: double, changes: array<struct<t: long, rank: int, token: int>>>>", stretch)
    best = fold(stretches, lambda a, b: (a[0] + b[0], pack(merge(unpack(a[1]), unpack(b[1]), k))))
    listed = best.select("clip", "base", F.posexplode("found").alias("i", "h")).select("clip", (F.col("i") + 1).cast("int").alias("rank"), (F.col("base") + F.col("h.loss")).alias("score"), "h.changes")
    # Each hypothesis goes over the steps' best tokens with its few changes beside.
    changed = listed.select("clip", "rank", F.inline("changes").alias("t", "place", "changed")).select("clip", "rank", "t", "changed")
    steps = top.select("clip", "t", F.col("top")[0]["token"].cast("int").alias("token_id")).join(listed.select("clip", "rank"), "clip").join(changed, ["clip", "rank", "t"], "left")
    tokens = steps.select(F.struct("clip", "rank").alias("clip"), "t", F.coalesce("changed", "token_id").alias("token_id")).where(F.col("token_id") != blank_id)
    words = vocab_lookup(tokens, vocab).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "token"))).alias("w"))
    text = words.select("clip.clip", "clip.rank", F.array_join(F.col("w.token"), "").alias("text"), F.size("w").cast("long").alias("n_tokens"))
    return listed.drop("changes").join(text, ["clip", "rank"], "left").na.fill({"text": "", "n_tokens": 0})
