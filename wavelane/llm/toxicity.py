"""Toxicity: a support vector machine over a gapped subsequence string kernel with Nyström landmarks.

Units are short stretches of labelled texts: windows of one, two or four words, a blank being a symbol like a letter.
The kernel compares two units by the triples of symbols, in order, that both hold within a span of five, each
occurrence weighted by DECAY to the number of symbols skipped; so letters put in between, dots and digits for letters,
or a blank within an insult leave most of its triples in place. As the kernel is a dot product of explicit triples,
what the machine learned over its landmarks folds into one table of triples, and all windows of a text are scored by
running sums over its symbols.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, written

DECAY = 0.5
#: Places of the second and third symbol after the first.
GAPS = tuple((j, k) for k in range(2, 5) for j in range(1, k))
#: The table of triples has WIDTH**3 places, the first LATIN**3 for triples of Latin letters and blanks.
WIDTH = 64
LATIN = 32  # symbols: 1-26 Latin letters, 30 a blank; from LATIN on, letters of other scripts by code point
BLANK = 30
OTHERS = 8191
#: Words in a window. A word of over LONGEST letters is cut into pieces of half that, which count as words here.
SPANS = (1, 2, 4)
LONGEST = 40
#: So many of a text's words decide, besides its best wider windows.
TOP = 4
#: Signs that stand for letters beside a letter (! between two letters).
SIGNS = dict(zip("013457@$!", "oieastasi", strict=True))
#: Symbols scored at a time.
CHUNK = 1 << 19


@cache
def _plain() -> np.ndarray:
    """Symbol of each ASCII character: 0 is dropped, negative stands for a letter only beside letters."""
    out = np.zeros(128, np.int32)
    out[:33] = BLANK
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    for sign, letter in SIGNS.items():
        out[ord(sign)] = -(ord(letter) - 96)
    return out


def symbols(text: str) -> np.ndarray:
    """A text's symbols: letters without case and accents, one BLANK between words and at both ends; nothing else.

    Three or more single letters in a row, as in "i d i o t", are read as one word."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
    x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    y = _plain()[np.minimum(x, 127)]
    far = x > 127
    if far.any():
        z = x[far]
        dropped = ((z >= 0x300) & (z < 0x370)) | ((z > 0xA0) & (z < 0xC0)) | ((z > 0x200A) & (z < 0x2070)) | ((z > 0x3000) & (z < 0x3040))
        blank = (z <= 0xA0) | ((z >= 0x2000) & (z <= 0x200A)) | (z == 0x2028) | (z == 0x2029) | (z == 0x3000)
        y[far] = np.where(blank, BLANK, np.where(dropped, 0, LATIN + z % OTHERS))
    sign = np.flatnonzero(y < 0)
    if len(sign):
        letter = np.concatenate([[False], (y > 0) & (y != BLANK), [False]])
        before, after = letter[sign], letter[sign + 2]
        y[sign] = np.where(np.where(x[sign] == ord("!"), before & after, before | after), -y[sign], 0)
    y = np.concatenate([[BLANK], y[y != 0], [BLANK]]).astype(np.int32)
    y = y[np.append((y[1:] != BLANK) | (y[:-1] != BLANK), True)]
    at = np.flatnonzero(y == BLANK)
    single = np.diff(at) == 2
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        inner = [at[a + 1 : b] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 3]
        if inner:
            y = np.delete(y, np.concatenate(inner))
    return y


def cuts(y: np.ndarray) -> np.ndarray:
    """Where words begin and end: at the blanks, and within very long words."""
    at = np.flatnonzero(y == BLANK)
    long_ = np.flatnonzero(np.diff(at) > LONGEST + 1)
    if not len(long_):
        return at
    return np.unique(np.concatenate([at, *(np.arange(at[i] + LONGEST // 2, at[i + 1] - LONGEST // 4, LONGEST // 2) for i in long_)]))


def triple_code(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of triples in the table: those of Latin letters have their own, others share the rest by a hash."""
    latin = (a * LATIN + b) * LATIN + d
    other = (a >= LATIN) | (b >= LATIN) | (d >= LATIN)
    if not other.any():
        return latin
    mixed = ((a.astype(np.uint64) << np.uint64(26)) | (b.astype(np.uint64) << np.uint64(13)) | d.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    hashed = LATIN**3 + (mixed >> np.uint64(33)) % np.uint64(WIDTH**3 - LATIN**3)
    return np.where(other, hashed.astype(np.int32), latin)


def length_norm(n: np.ndarray) -> np.ndarray:
    """Norm of a unit of ``n`` symbols whose triples all differ; the kernel is divided by it for either unit."""
    return np.sqrt(np.maximum(sum((k - 1) * DECAY ** (2 * (k - 2)) * np.maximum(n - k, 0) for k in range(2, 5)), 1e-9))


def triples(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all triples of ``units``: which unit, the code, and the weight with the unit's norm divided out."""
    n = np.array(list(map(len, units)), np.int64)
    y = np.concatenate([np.concatenate([u, np.zeros(4, np.int32)]) for u in units] or [np.zeros(0, np.int32)])
    owner = np.repeat(np.arange(len(units)), n + 4)
    row, code, weight = [], [], []
    for j, k in GAPS:
        m = max(0, len(y) - k)
        at = np.flatnonzero((y[:m] > 0) & (y[k : k + m] > 0) & (owner[:m] == owner[k : k + m]))
        row.append(owner[at])
        code.append(triple_code(y[at], y[at + j], y[at + k]))
        weight.append(DECAY ** (k - 2) / length_norm(n)[owner[at]])
    return np.concatenate(row), np.concatenate(code), np.concatenate(weight)


@dataclass
class Model:
    table: np.ndarray = field(repr=False)  # weight of each triple
    bias: float = 0.0
    curve: np.ndarray | None = None  # weights of a text's features, then the shift

    def windows(self, y: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each of SPANS, the margins of the windows of so many words: of symbols ``y`` with word bounds ``at``."""
        out = [[] for _ in SPANS]
        begin = 0
        while begin < len(at) - 1:  # words begin .. end - 1 start windows here; a few more belong to them
            end = max(begin + 1, min(len(at) - 1, int(np.searchsorted(at, at[begin] + CHUNK))))
            last = min(len(at) - 1, end + max(SPANS) - 1)
            part, places = y[at[begin] : at[last] + 1], at[begin : last + 1] - at[begin]
            sums = []
            for k in range(2, 5):
                n = max(0, len(part) - k)
                total = np.zeros(n)
                for j in range(1, k):
                    total += self.table[triple_code(part[:n], part[j : n + j], part[k : k + n])]
                sums.append(np.concatenate([[0.0], np.cumsum(total * DECAY ** (k - 2))]))
            for found, m in zip(out, SPANS, strict=True):
                a, b = places[: end - begin], places[m:][: end - begin] + 1
                a = a[: len(b)]
                margin = sum(s[np.minimum(np.maximum(b - k, a), len(s) - 1)] - s[np.minimum(a, len(s) - 1)] for s, k in zip(sums, range(2, 5), strict=True))
                found.append(margin / length_norm(b - a) + self.bias)
            begin = end
        return [np.concatenate(x) if x else np.zeros(0) for x in out]

    def margin(self, text: str) -> float:
        """The largest of a text's windows; the bias if it has no word."""
        y = symbols(text)
        return max([float(x.max()) for x in self.windows(y, cuts(y)) if len(x)], default=self.bias)

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: the TOP largest margins of single words, the largest of each wider window, and the logarithm of the
        number of words. A text of fewer words repeats its last one, or its largest; one without words has the bias."""
        out = np.full((len(texts), TOP + len(SPANS)), self.bias)
        for row, t in zip(out, texts, strict=True):
            y = symbols(t)
            found = self.windows(y, cuts(y))
            words = found[0]
            best = np.sort(np.partition(words, len(words) - TOP)[-TOP:] if len(words) > TOP else words)[::-1]
            if len(words):
                row[:TOP] = best[np.minimum(np.arange(TOP), len(best) - 1)]
                row[TOP:-1] = [x.max() if len(x) else best[0] for x in found[1:]]
            row[-1] = np.log1p(len(words))
        out[:, :-1] = np.maximum(out[:, :-1], -1)  # from there on the machine takes a unit for clean
        return np.round(out, 9)

    def worst(self, text: str, most: int) -> list[tuple[float, bytes]]:
        """Up to ``most`` windows of the largest margins that don't overlap: margin and symbols."""
        y = symbols(text)
        at = cuts(y)
        found = self.windows(y, at)
        margin = np.concatenate(found)
        first = np.concatenate([np.arange(len(x)) for x in found])
        span = np.repeat(SPANS, list(map(len, found)))
        out, taken = [], np.zeros(len(at), bool)
        for w in np.argsort(-margin, kind="stable")[: 64 * most].tolist():
            words = slice(first[w], first[w] + span[w])
            if not taken[words].any():
                taken[words] = True
                out.append((float(margin[w]), y[at[first[w]] : at[first[w] + span[w]] + 1].astype("<i4").tobytes()))
                if len(out) == most:
                    break
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -50, 50)))


def gram(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The kernel between two lists of units."""
    places = np.unique(triples(b)[1])  # triples that ``b`` lacks don't count in a product with it
    if not len(places):
        return np.zeros((len(a), len(b)))

    def dense(units: list[np.ndarray]) -> np.ndarray:
        row, code, weight = triples(units)
        at = np.minimum(np.searchsorted(places, code), len(places) - 1)
        hit = places[at] == code
        return np.bincount(row[hit] * len(places) + at[hit], weight[hit], len(units) * len(places)).reshape(len(units), -1)

    held = dense(b).T
    return np.concatenate([dense(a[i : i + 256]) @ held for i in range(0, len(a), 256)])


def fit_machine(good: list[np.ndarray], bad: list[np.ndarray], landmarks: int = 240, cost: float = 1.0, seed: int = 3) -> Model:
    """A linear machine (squared hinge, balanced classes, Newton steps) on the Nyström features of units; the landmarks
    are units of either class."""
    rng = np.random.default_rng(seed)
    half = min(len(bad), landmarks // 2)
    marks = [bad[i] for i in rng.permutation(len(bad))[:half]] + [good[i] for i in rng.permutation(len(good))[: landmarks - half]]
    x = gram([*bad, *good], marks)
    value, vector = np.linalg.eigh(gram(marks, marks))
    root = vector[:, value > 1e-5] / np.sqrt(value[value > 1e-5])
    z = np.concatenate([x @ root, np.ones((len(x), 1))], 1)
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    c = cost * np.where(y > 0, len(y) / (2 * max(1, len(bad))), len(y) / (2 * max(1, len(good))))
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(20):
        act = y * (z @ w) < 1
        h = ridge + 2 * (z[act] * c[act, None]).T @ z[act]
        step = np.linalg.solve(h, 2 * (z[act] * c[act, None]).T @ y[act]) - w
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    beta = root @ w[:-1]
    table = np.zeros(WIDTH**3)
    row, code, weight = triples(marks)
    np.add.at(table, code, beta[row] * weight)
    return Model(table, float(w[-1]))


def _presence(rows: DataFrame) -> np.ndarray:
    """For clean and toxic texts, in how many each triple occurs; each task sends two sums a triple."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, WIDTH**3), np.int32)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = symbols(text or "")
                total[toxic, np.unique(np.concatenate([triple_code(y[: len(y) - k], y[j : len(y) - k + j], y[k:]) for j, k in GAPS if len(y) > k] or [np.zeros(0, np.int32)]))] += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([total.tobytes()])})

    parts = rows.select("toxic", "text").mapInArrow(run, "n binary").collect()
    return sum((np.frombuffer(r["n"], np.int32).reshape(2, -1) for r in parts), np.zeros((2, WIDTH**3), np.int64))


def train(docs: DataFrame, labels: DataFrame, sample: int = 2_000, windows: int = 3, rounds: int = 3) -> Model | None:
    """Fits on labelled rows with crc32(doc_id) mod 5 not 0: at most ``sample`` toxic and twice as many clean documents,
    those with the lowest hashes of their ids (of a repeated id, one text). A document with several labels is toxic if
    any says so. None if a class has no document.

    A label says that somewhere in a text there is something toxic. The first model weighs each triple by how much more
    of the toxic than of the clean texts hold it. In each of ``rounds``, the up to ``windows`` worst windows of every
    toxic text (the worst, and others with a positive margin) and of every clean text become the labelled examples of
    the next machine; the clean ones of all rounds stay. The sample is written once; the driver gets ``windows``
    windows a text and round."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    ids = [r for y, n in ((1, sample), (0, 2 * sample)) for r in marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if len({r["toxic"] for r in ids}) < 2:
        return None
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in ids], "doc_id long, toxic int"))  # at most 3 * sample rows
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL").join(chosen, "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).repartition(16, "doc_id"), "tox-sample")
    of = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        return None
    held = _presence(rows)
    model = Model(np.clip(np.log((held[1] + 0.5) / (of[1] + 1)) - np.log((held[0] + 0.5) / (of[0] + 1)), -3, 3))

    def worst(model: Model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(toxic, k, m, u) for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (m, u) in enumerate(model.worst(text, windows))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["toxic", "k", "margin", "unit"])

        return rows.select("toxic", "text").mapInArrow(run, "toxic int, k int, margin double, unit binary").collect()

    good: dict[bytes, None] = {}
    for turn in range(rounds):
        found = sorted(map(tuple, worst(model)))
        good |= dict.fromkeys(u for toxic, _, _, u in found if not toxic)
        bad = [u for toxic, k, m, u in found if toxic and (k == 0 or turn and m > 0)]
        # A window found in clean texts as often as in toxic ones says nothing.
        bad = [np.frombuffer(u, "<i4") for u in bad if u not in good]
        if not bad or not good:
            return None
        model = fit_machine([np.frombuffer(u, "<i4") for u in good], bad)

    names = [f"f{i}" for i in range(TOP + len(SPANS))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], ["toxic", *names])

    scored = rows.select("toxic", "text").mapInArrow(features, "toxic int, " + ", ".join(f"{n} double" for n in names)).collect()  # at most 3 * sample rows
    scored = np.array(sorted(map(tuple, scored)), float)
    model.curve = logistic(scored[:, 1:], scored[:, 0])
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, toxic_weight: float = 2.0) -> np.ndarray:
    """Weights and shift of a logistic regression by Newton steps; targets drawn in from 0 and 1 as Platt did."""
    c = np.where(y > 0, toxic_weight, 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (c * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (c * (t - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


@cache
def _model(table: bytes, bias: float) -> Model:
    return Model(np.frombuffer(table, np.float64), bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. A map over the rows without a shuffle.

    The score is a logistic curve over the largest margins of the whole text's windows and its number of words. Null or
    empty text: that of no word. Null doc_id: held_out is false. Without a model (no toxic or no clean label): score 0.
    Repeated rows: each scored. Very long texts are scored in chunks of CHUNK symbols, very long words in pieces. Empty
    table: no rows; other columns are ignored."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    if model is None:
        return docs.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    table, bias, curve = model.table.tobytes(), model.bias, Model(np.zeros(0), 0.0, model.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(table, bias)
        for batch in batches:
            for at, texts in batches_of(batch.column(1)):
                p = curve.probability(own.features(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
