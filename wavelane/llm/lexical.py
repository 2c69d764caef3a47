"""Ranked lexical search by NRA: no random access, sequential reads of impact-sorted lists only.

One pass over the documents keeps, of each, its length and the counts of the terms that some query asks for. From
there on documents stay where they are: a task gathers them into blocks, sorts each term's postings by impact, and
for each query reads its lists from the top down. A document's lower bound is what was read of it, its upper bound
that plus the last impact read of each list in which it wasn't met yet. The reads go on until every document that can
still be among the best is met in all its lists, so scores are exact and ties decided. The kth score is carried from
block to block; only each task's best rows are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of terms as they are, with A-Z as a-z; 32 for all that stands between terms.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: First and largest number of entries that a list is read by at a time.
READ, MOST = 64, 1 << 14
#: Entries (documents times lists) of the table of what was met, which a search keeps.
MET = 1 << 26


def terms(text: bytes) -> list[bytes]:
    """The runs of digits, Latin letters and all that is beyond ASCII, A-Z lower-cased."""
    return text.translate(_PLAIN).split()


@dataclass
class Query:
    """Which terms, by their numbers, how often each, and what it is called."""

    no: int
    item_id: int | None
    term: np.ndarray
    times: np.ndarray


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """A block of documents as one list of (document, impact) a term, in descending order of impact."""

    def __init__(self, n: np.ndarray, per_doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """``n``: lengths; ``per_doc``: how many of the entries (``term``, ``tf``) are each document's."""
        self.docs = len(n)
        if 25 * int(n.max(initial=0)) * n_docs < 2**63:
            m = 75 + 25 * n * n_docs // max(1, n_terms)
        else:
            m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
        doc = np.repeat(np.arange(len(n)), per_doc)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        kept = np.flatnonzero(impact > 0)
        order = kept[np.lexsort((-impact[kept], term[kept]))]
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.start[term], self.start[term + 1])
        return self.doc[at], self.impact[at]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The documents of ``n`` that can be among the ``k`` best (all that tie with the kth too), and their scores, which
    are over 0; documents that score under ``least`` may be left out. Lists descend; a document is in a list once.

    Each round reads on in the lists that can still change the result, twice as far as the round before. While an unmet
    document may get in, these are all that haven't ended; after that, those in which a contender wasn't met yet."""
    lists = [x for x in lists if len(x[0])]
    total = sum(int(x[1][0]) for x in lists)
    kind = np.float64 if total < 2**53 else np.int64  # products of floats are fast, and exact for such sums
    lower = np.zeros(n, np.int64)
    met = np.zeros((len(lists), n), bool)
    at, tail = [0] * len(lists), np.array([x[1][0] for x in lists], kind)
    wanted, depth = list(range(len(lists))), READ
    while True:
        for t in wanted:
            doc, impact = lists[t]
            i, j = at[t], min(at[t] + depth, len(doc))
            lower[doc[i:j]] += impact[i:j]
            met[t, doc[i:j]] = True
            at[t], tail[t] = j, impact[j - 1] if j < len(doc) else 0
        depth = min(2 * depth, MOST)
        rest = int(tail.sum())  # bound for a document that wasn't met
        found = np.flatnonzero(lower)
        kth = int(np.partition(lower[found], len(found) - k)[len(found) - k]) if len(found) >= k else 0
        floor = max(kth, least)
        near = found[lower[found] + rest >= floor]
        unmet = rest - (tail @ met[:, near]).astype(np.int64)
        near, unmet = near[lower[near] + unmet >= floor], unmet[lower[near] + unmet >= floor]
        if rest and rest >= floor:
            wanted = np.flatnonzero(tail > 0).tolist()
        else:
            open_ = near[unmet > 0]
            if not len(open_):
                near = near[lower[near] > 0]
                return near, lower[near]
            wanted = np.flatnonzero((tail > 0) & ~met[:, open_].all(1)).tolist()


def best(block: Lists, query: Query, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nra` of a query over a block; in slices of the documents where lists are very many."""
    lists = [(d, i * c) for (d, i), c in ((block.of(t), c) for t, c in zip(query.term.tolist(), query.times.tolist(), strict=True))]
    step = max(1, MET // max(1, len(lists)))
    if block.docs <= step:
        return nra(lists, block.docs, k, least)
    parts = []
    for a in range(0, block.docs, step):
        b = min(a + step, block.docs)
        own = [(d[inside] - a, i[inside]) for d, i in lists for inside in [(d >= a) & (d < b)]]
        rows, scores = nra(own, b - a, k, least)
        parts.append((rows + a, scores))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and term numbers and counts of the terms in ``vocabulary``; documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms(text.as_py() or b"")
                if found:
                    known = [(x, c) for w, c in Counter(found).items() if (x := number(w)) is not None]
                    rows.append((doc_id.as_py(), len(found), [x for x, _ in known], [c for _, c in known]))
                    held += len(known)
                    if held > 1 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n", "term", "tf"])


def _blocks(batches: Iterator[pa.RecordBatch], most_docs: int, most_entries: int) -> Iterator[pa.Table]:
    """Rows of a task in order, gathered until there are so many documents or entries."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        for i in range(0, len(batch), 1024):
            part = batch.slice(i, 1024)
            held.append(part)
            docs, entries = docs + len(part), entries + len(part.column("term").flatten())
            if docs >= most_docs or entries >= most_entries:
                yield pa.Table.from_batches(held)
                held, docs, entries = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def _ranked(docs: DataFrame, queries: list[Query], vocabulary: dict[bytes, int], k: int, block_docs: int, block_entries: int) -> DataFrame:
    counted = written(_counted(docs, vocabulary), "lexical-counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect())  # at most as many rows as the vocabulary
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores_so_far: dict[int, np.ndarray] = {}
        for t in _blocks(batches, block_docs, block_entries):
            column = {c: t.column(c).combine_chunks() for c in t.column_names}
            per_doc = column["term"].value_lengths().to_numpy().astype(np.int64)
            block = Lists(column["n"].to_numpy(), per_doc, column["term"].flatten().to_numpy(), column["tf"].flatten().to_numpy(), weights, n_docs, n_terms)
            none = column["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = column["doc_id"].fill_null(0).to_numpy()
            out = []
            for q in queries:
                before = scores_so_far.get(q.no, np.zeros(0, np.int64))
                rows, scores = best(block, q, k, int(before[0]) if len(before) == k else 0)
                first = np.lexsort((ids[rows], none[rows], -scores))[:k]
                if len(first):
                    rows, scores = rows[first], scores[first]
                    scores_so_far[q.no] = np.sort(np.concatenate([before, scores]))[-k:]
                    out.append((np.full(len(rows), q.no), [q.item_id] * len(rows), column["doc_id"].take(pa.array(rows)), scores))
            if out:
                no, item, doc, score = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(no)), pa.array([x for part in item for x in part], pa.int64()), pa.concat_arrays(doc), pa.array(np.concatenate(score))], ["no", "item_id", "doc_id", "score"])

    rows = counted.mapInArrow(run, "no long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, group_bytes: int = 8 << 20, block_docs: int = 32_768, block_entries: int = 4_000_000) -> DataFrame:
    """For each row of ``items`` (item_id, text) its ``k`` best documents with a score over 0: item_id, rank (from 1), doc_id, score.

    Score: sum over the item's terms, repeats included, of w * ((10**9 * tf) div (1000 * tf + 12 * m)), with w and m as
    integers from numbers over all documents. Ties go to the smaller doc_id, null last. Only a group of items of about
    ``group_bytes`` of text is on the driver and in the tasks at a time; more items make more groups, each with a pass
    over the documents. Blocks are bounded by documents and entries, so memory is, whatever a task's share or a word's
    frequency; a document's entries are at most the words its group of items asks for.

    Null or empty texts: no terms; such documents don't count and such items have no rows. Repeated doc_ids: documents
    of their own, which may both be ranked. Repeated item_ids: each ranked by itself. Null item_id: stays null. Very
    long texts: whole. Empty tables: no rows. Other columns are ignored."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-size // group_bytes) or 1
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    out = None
    for g in range(groups):
        vocabulary: dict[bytes, int] = {}
        queries = []
        for r in dealt.where(F.col("group") == g).orderBy("item_id", "text").select("item_id", "text").toLocalIterator():
            counts = Counter(terms(bytes(r["text"])))
            numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in counts]
            if numbers:
                queries.append(Query(len(queries), r["item_id"], np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))
        found = _ranked(docs, queries, vocabulary, k, block_docs, block_entries)
        out = found if out is None else out.unionByName(found)
    return out
