"""Quality classifier: a sparse ensemble of conjunctive rules over statistics of a text.

Small trees, each grown on a random half of a bounded labelled sample against what the trees before left unexplained,
propose rules: every node's path is a conjunction of bounds on statistics. A logistic regression with an L1 penalty
keeps few of them. The rules and their weights compile into one Spark column expression, so scoring needs no Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality import repeated_words

#: What the rules are about, in this order; shares are of words, of bytes in words, or of lines with a word.
STATISTICS = ("words", "word_bytes", "longest", "symbols", "marks", "stops", "commas", "digits", "upper", "beyond_ascii", "entropy", "distinct", "commonest", "adjacent", "repeats", "dup_lines", "line_words")

_OF = {
    "symbols": b"#*$%&|<>@^~=+_\\/{}[]", "marks": b"!?", "stops": b".", "commas": b",;:", "digits": b"0123456789",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "beyond_ascii": bytes(range(192, 256)),
}
_PLACES = {name: np.frombuffer(b, np.uint8) for name, b in _OF.items()}


def measure(text: bytes) -> tuple[float, ...]:
    """STATISTICS of a UTF-8 text; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    held[[9, 10, 11, 12, 13, 32]] = 0
    size = int(held.sum())
    share = held[held > 0] / size
    per_byte = {name: held[at].sum() / size for name, at in _PLACES.items()}
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        float(n), size / n, float(max(map(len, words))), *(float(per_byte[k]) for k in ("symbols", "marks", "stops", "commas", "digits", "upper", "beyond_ascii")),
        float(-(share * np.log2(share)).sum()), len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, repeated_words(words) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of every whole text, rounded to nine digits after the point; null text: empty. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measure(t.as_py() or b"") for t in batch.column(1)]).reshape(len(batch), len(STATISTICS)).round(9)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True, order=True)
class Bound:
    statistic: str
    above: bool  # over the cut, or up to it
    cut: float


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[tuple[Bound, ...], float], ...]  # conjunctions and their weights
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of STATISTICS, in numpy; what :meth:`column` says in Spark."""
        z = self.shift + sum((w * holds(rule, x) for rule, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as an expression over columns named as STATISTICS."""
        z = F.lit(self.shift)
        for rule, w in self.rules:
            every = F.lit(True)
            for b in rule:
                every = every & (F.col(b.statistic) > F.lit(b.cut) if b.above else F.col(b.statistic) <= F.lit(b.cut))
            z = z + F.when(every, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: tuple[Bound, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for b in rule:
        v = x[:, STATISTICS.index(b.statistic)]
        out &= v > b.cut if b.above else v <= b.cut
    return out


def conjunction(path: tuple[Bound, ...], more: Bound) -> tuple[Bound, ...]:
    """``path`` and one more bound; of two in the same direction on a statistic the tighter one stays."""
    kept = {(b.statistic, b.above): b for b in path}
    old = kept.get((more.statistic, more.above))
    if old is None or (more.cut > old.cut) == more.above:
        kept[more.statistic, more.above] = more
    return tuple(sorted(kept.values()))


def cut_points(x: np.ndarray, most: int = 40) -> list[np.ndarray]:
    """For each statistic, values halfway between neighbouring distinct quantiles."""
    out = []
    for v in x.T:
        q = np.unique(np.quantile(v, np.linspace(0, 1, most + 1)))
        out.append(np.unique(((q[1:] + q[:-1]) / 2).round(6)))
    return out


def grow(binned: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, target: np.ndarray, depth: int, least: int) -> tuple[list[tuple[Bound, ...]], np.ndarray]:
    """A regression tree on ``rows``: the paths of all its nodes but the root, and its value for every row of ``binned``.

    ``binned`` holds how many cuts each value is above. A split is the one that lowers the squared error most, ties to
    the first statistic and cut, with ``least`` rows on either side."""
    paths, value = [], np.zeros(len(binned))

    def split(own: np.ndarray, everyone: np.ndarray, path: tuple[Bound, ...], left: int) -> None:
        value[everyone] = target[own].mean()
        found = (1e-9, None, None)
        for f, c in enumerate(cuts) if left else ():
            if len(c):
                n = np.bincount(binned[own, f], minlength=len(c) + 1).cumsum()[:-1]
                s = np.bincount(binned[own, f], target[own], len(c) + 1).cumsum()
                total, s = s[-1], s[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s**2 / n + (total - s) ** 2 / (len(own) - n) - total**2 / len(own)
                gain[(n < least) | (len(own) - n < least)] = 0
                k = int(gain.argmax())
                if gain[k] > found[0]:
                    found = (float(gain[k]), f, k)
        if found[1] is None:
            return
        _, f, k = found
        for above in (False, True):
            longer = conjunction(path, Bound(STATISTICS[f], above, float(cuts[f][k])))
            paths.append(longer)
            split(own[(binned[own, f] > k) == above], everyone[(binned[everyone, f] > k) == above], longer, left - 1)

    split(rows, np.arange(len(binned)), (), depth)
    return paths, value


def propose(x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.2, seed: int = 5) -> list[tuple[Bound, ...]]:
    """Distinct rules from trees of two or three levels, boosted on the logistic loss; of rules that hold for the same
    rows of the sample, the shortest."""
    rng = np.random.default_rng(seed)
    cuts = cut_points(x)
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    z = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    least = max(5, len(y) // 200)
    by_rows: dict[bytes, tuple[Bound, ...]] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        paths, value = grow(binned, cuts, rows, y - p, int(rng.integers(2, 4)), least)
        z = z + rate * value * 4  # the logistic curve's slope is a quarter at most
        for path in paths:
            key = np.packbits(holds(path, x)).tobytes()
            if key not in by_rows or (len(path), path) < (len(by_rows[key]), by_rows[key]):
                by_rows[key] = path
    return sorted(r for r in by_rows.values() if least <= holds(r, x).sum() <= len(x) - least)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 400) -> np.ndarray:
    """Weights, then the shift, that minimise the mean logistic loss plus ``penalty`` times the weights' absolute sum;
    accelerated proximal steps, the shift without penalty."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    v = np.full(z.shape[1], 1.0)
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.26 * np.linalg.norm(z @ v) ** 2 / len(z))
    w = np.zeros(z.shape[1]) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -50, 50)))
        new = ahead - step * (z.T @ (p - y)) / len(z)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        if (ahead - new) @ (new - w) > 0:
            t = 1.0  # the momentum points uphill
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, moved = new + (t - 1) / later * (new - w), np.abs(new - w).max()
        w, t = new, later
        if moved < 1e-7:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, penalties: int = 12) -> Model:
    """Rules from three quarters of the rows, selection and weights from all rows. Selected is what the largest penalty
    keeps whose loss on the other quarter is within a standard error of the least; what is selected then gets its
    weights under the penalty of the least loss, for the larger one draws scores to the middle."""
    held = np.arange(len(y)) % 4 == 0
    rules = propose(x[~held], y[~held])
    if not rules:
        return Model((), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))))
    on = np.stack([holds(r, x) for r in rules], 1).astype(float)
    scale = np.maximum(on.std(0), 0.05)  # so that rare and common rules are penalised alike
    on /= scale
    top = np.abs(on[~held].T @ (y[~held] - y[~held].mean())).max() / (~held).sum()
    tried, w = [], None
    for penalty in top * 0.5 ** np.arange(1, penalties + 1):
        w = lasso(on[~held], y[~held], penalty, w, 200)
        z = on[held] @ w[:-1] + w[-1]
        loss = np.logaddexp(0, z) - y[held] * z
        tried.append((float(loss.mean()), float(loss.std() / np.sqrt(len(loss))), penalty))
    least, error, mildest = min(tried)
    sparse = max(p for loss, _, p in tried if loss <= least + error)
    kept = np.flatnonzero(lasso(on, y, sparse, w)[:-1])
    w = lasso(on[:, kept], y, mildest)
    return Model(tuple((rules[k], float(a)) for k, a in zip(kept, (w[:-1] / scale[kept]).round(9), strict=True) if a), float(w[-1]))


def train(measured: DataFrame, labels: DataFrame, sample: int = 3_000) -> Model | None:
    """Fits on labelled rows of ``measured`` (:func:`statistics`) with crc32(doc_id) mod 5 not 0: of either class the
    ``sample`` documents with the lowest hashes of their ids. The driver gets their statistics alone. A document with
    several labels is good if all say so; of a repeated id each row of the sample counts. None without both classes.

    Classes are sampled apart, so the shift is set back to the share of good documents among all labels."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rows = written(measured.join(marks, "doc_id"), "rulefit-labelled")
    found, of = [], {}
    for good in (0, 1):
        own = rows.where(F.col("good") == 1 if good else F.col("good") != 1)
        of[good] = own.count()
        found += [(good, *r) for r in own.orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS).limit(sample).select(*STATISTICS).collect()]
    if not of[0] or not of[1]:
        return None
    order = np.random.default_rng(2).permutation(len(found))
    data = np.array(found, float)[order]
    model = fit(data[:, 1:], data[:, 0])
    taken = {g: min(n, sample) for g, n in of.items()}
    return Model(model.rules, model.shift + float(np.log(of[1] / taken[1]) - np.log(of[0] / taken[0])))


def score(docs: DataFrame, labels: DataFrame, sample: int = 3_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: good likelier) and predicted (1 from 0.3 on).

    Statistics are measured once over all whole texts and written; fitting takes ``sample`` rows a class of them, scoring
    is a projection. Null text: empty; empty texts have statistics of 0 and a score like others. Null doc_id:
    held_out is false and it has no label. Repeated rows: each scored, alike. Very long texts: whole, one at a time.
    Without labels of both classes: there are no rules and the score is 0.5. Empty table: no rows. Other columns are ignored."""
    measured = written(statistics(docs), "rulefit-statistics")
    model = train(measured, labels, sample) or Model((), 0.0)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = measured.select("doc_id", held.alias("held_out"), F.round(model.column(), 9).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
