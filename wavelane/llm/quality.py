"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, written

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long"
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Shares of a document, each with its unit; a document's score is the largest share in its unit.
SHARES = {"symbols": ("n_symbols", "word_chars", 0.1), "dup_lines": ("n_dup_lines", "n_lines", 0.6), "repeats": ("n_repeat_words", "n_words", 0.2), "upper": ("n_upper", "word_chars", 0.2)}
RULES = {name: f"{part} / greatest({whole}, 1) / double({unit})" for name, (part, whole, unit) in SHARES.items()}
#: A document is rejected if its score is above its stratum's cutoff. Cutoffs are tried from the mildest down.
CUTOFFS = tuple(round(5.0 - 0.1 * i, 1) for i in range(50))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    base, code, room = len(known), ids, len(known)
    for k in range(1, width):
        if room * base >= 2**62:  # dense codes for the prefixes again, so that codes stay exact
            code = np.unique(code, return_inverse=True)[1]
            room = len(words)
        code = code[:-1] * base + ids[k:]
        room *= base
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines (with a word)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six blanks
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return len(words), len(text) - sum(raw.count(b) for b in BLANKS), sum(raw.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), upper, len(lines)


def signals(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of :func:`measure` for every whole text; null text: empty. ``keep`` are columns carried along, the text too if it is one of them; it goes to Python once."""
    sent = docs.select(F.col("doc_id").cast("long"), "text", *(k for k in keep if k != "text"))
    schema = ", ".join([BASE, *(f"`{k}` {sent.schema[k].dataType.simpleString()}" for k in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BASE.split(", ")][1:]
        for batch in batches:
            found = np.array([measure(t.as_py() or "") for t in batch.column(1)], np.int64).reshape(len(batch), len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(names))), *(batch.column(k) for k in keep)], ["doc_id", *names, *keep])

    return sent.mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoff(rejected: list[int], n: int, caught: list[int], risk: float, error: float) -> float | None:
    """Of the cutoffs whose false rejections are proven to be at most ``risk``, the best on the holdout.

    Tests of "the rate is above risk" run from the mildest cutoff on and stop at the first that can't be refused at
    level ``error``; in such a fixed order each may use the whole level, and all refused ones hold together. Among
    them the one that rejects the most bad documents beyond the good ones wins, ties to the mildest. None: not even
    the mildest is proven, or no proven one is worth it."""
    best, gain = None, 0
    for cutoff, k, bad in zip(CUTOFFS, rejected, caught, strict=True):
        if n == 0 or k > risk * n or binomial_tail(k, n, risk) > error:
            break
        if bad - k > gain:
            best, gain = cutoff, bad - k
    return best


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Per stratum: cut (null: nothing is rejected there), n_holdout and n_false (good ones of them that it rejects).

    The holdout are the labelled documents that pass the base rules; label quality 1 is good. One score and so one
    sequence of tests a stratum, and ``error`` shared among the strata (Bonferroni): with probability 1 - error no
    stratum loses more than ``risk`` of its good documents that pass the base rules. With four strata, 217 good ones
    without a false rejection prove a cutoff. A document with several labels is good if all say so."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    held = measured.where(~F.col("base_failed")).join(marks, "doc_id")
    good, score = (F.col("__quality") == 1).cast("long"), F.expr(f"greatest({', '.join(RULES.values())})")
    counts = [F.sum((score > c).cast("long") * y).alias(f"{kind}_{i}") for kind, y in (("good", good), ("bad", 1 - good)) for i, c in enumerate(CUTOFFS)]
    rows = written(held.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.sum(good).alias("n"), *counts), "quality-holdout")
    tests = max(1, rows.count())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                of = {kind: [r[f"{kind}_{i}"] for i in range(len(CUTOFFS))] for kind in ("good", "bad")}
                cut = choose_cutoff(of["good"], r["n"], of["bad"], risk, error / tests)
                found.append((r["stratum"], r["n"], cut, None if cut is None else of["good"][CUTOFFS.index(cut)]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["stratum", "n_holdout", "cut", "n_false"])

    return rows.mapInArrow(choose, "stratum string, n_holdout long, cut double, n_false long")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its counts, base_failed, kept, and which rules rejected it.

    Base rules: under 10 words, or over 20% of words in repeated windows. Null text: empty, so it fails. Null
    stratum: one of its own. A stratum without proof keeps all that the base rules keep. Null doc_id: judged, but
    can't have a label. Repeated rows: each judged. Empty tables: no rows; without labels only base rules reject."""
    rows = written(signals(docs, tuple(dict.fromkeys([stratum, *keep]))), "quality-signals")
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    cuts = written(fit_cutoffs(rows, labels, stratum, risk, error), "quality-cutoffs")
    cuts = cuts.select(F.coalesce(F.concat(F.lit("s"), "stratum"), F.lit("-")).alias("__key"), "cut")
    rows = rows.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("-")))
    fails = F.array_compact(F.array(*(F.when(F.expr(rule) > F.col("cut"), F.lit(name)) for name, rule in RULES.items())))
    rows = sized_join(rows, cuts, "__key", "left").withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(fails))
    out = rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules", *(k for k in keep))
