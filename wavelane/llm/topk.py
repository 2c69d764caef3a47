"""Exact top-k search by Fagin's threshold algorithm over per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, written

#: No second id.
NONE = -(2**63)


class SortedLists:
    """A block of integer vectors with, for each dimension, its rows in ascending order of the value there."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.exact = np.abs(vectors).max(initial=0)
        self.as_float = vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        values = np.take_along_axis(vectors, self.order, axis=0)
        n = len(vectors)
        #: Depths at which a search may stop, and the values last read there, from either end of each list.
        self.depths = np.array([d for d in (8 << i for i in range(40)) if d < n] + [n])
        self.low, self.high = (values[self.depths - 1], values[n - self.depths]) if n else (values, values)

    def top(self, query: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the k best (all that tie with the kth too) and their scores; rows that score under
        ``least`` (the kth score found elsewhere) may be left out.

        Sorted access goes down all lists at once, from the end that the query's sign favours; each row met is
        scored in full. The sum of the values last read is a bound for every row not met: when it is below the kth
        score or ``least``, the search stops. Bounds are known for doubling depths, so after the first rows are scored
        the search goes straight to where the kth score so far would end it. Lists of dimensions with 0 are not read."""
        n = len(self.vectors)
        dims = np.flatnonzero(query)
        exact = float(np.abs(query).max(initial=0)) * float(self.exact) * max(1, len(query)) < 2**53
        table, q = (self.as_float, query.astype(np.float64)) if exact else (self.vectors, query)
        if not len(dims) or n <= 4 * k:
            return self._best(np.arange(n), table @ q, k)
        falls = query[dims] < 0
        bounds = np.where(falls, self.low[:, dims], self.high[:, dims]).astype(table.dtype) @ q[dims]
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, table.dtype)
        at = done = 0
        while True:
            depth = int(self.depths[at])
            new = np.zeros(n, bool)
            if depth < n:
                new[self.order[done:depth, dims[falls]]] = True
                new[self.order[n - depth : n - done, dims[~falls]]] = True
                new &= ~met
            else:
                new = ~met
            met |= new
            new = np.flatnonzero(new)
            got = table[new] @ q if len(new) < n else table @ q
            rows, scores = self._best(np.concatenate([rows, new]), np.concatenate([scores, got]), k)
            kth = max(scores.min() if len(rows) >= k else -np.inf, least)
            if depth == n or bounds[at] < kth:
                return rows, scores
            ends = np.flatnonzero(bounds[at + 1 :] < kth)
            at, done = at + 1 + int(ends[0]) if len(ends) else len(self.depths) - 1, depth

    @staticmethod
    def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) <= k:
            return rows, scores
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= kth
        return rows[keep], scores[keep]


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) of each component; vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select("vec_id", F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e)).alias("v"))


def _packed(rows: DataFrame, block: str, name: str, ids: list[str]) -> DataFrame:
    """Blocks of rows as one row each: dim, block, and as int64 bytes the columns ``ids``, one after the other, and v, row by row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["dim", block]):
            held = b"".join(t.column(c).to_numpy().astype("<i8").tobytes() for c in ids)
            v = t.column("v").combine_chunks().flatten().to_numpy().astype("<i8")
            yield pa.RecordBatch.from_pydict({"dim": pa.array([t.column("dim")[0].as_py()], pa.int32()), block: pa.array([t.column(block)[0].as_py()], pa.int64()), name: pa.array([held]), f"{name}_v": pa.array([v.tobytes()])})

    dealt = rows.repartition("dim", block).sortWithinPartitions("dim", block, *ids)
    return dealt.mapInArrow(pack, f"dim int, {block} long, {name} binary, {name}_v binary")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = 16_384, block_queries: int = 2_048, least_blocks: int = 32) -> DataFrame:
    """For each query (vec_id divisible by ``every``) its k best other rows by integer inner product: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Equal vectors are searched once: a distinct vector carries its k + 1 smallest
    ids, found by a rank limit that each task applies before the shuffle, with a salt against a frequent vector.
    Vectors are compared with vectors of the same length only; vectors of length 0 score 0. A repeated vec_id is a
    row of its own and so can be found twice; as a query, its different vectors are searched and all their hits ranked
    together. No rows: no result.

    Distinct vectors form blocks of about ``block_rows`` (smaller ones if these are under ``least_blocks``, for the sake
    of more tasks), queries blocks of ``block_queries``. Each pair of blocks is a task's row; a task builds the lists of
    a block once for all its queries, carries each query's kth score from block to block, and gives at most k
    vectors a query and block. The pairs, and so the work, grow with rows times queries. How early the bound ends a
    search depends on the vectors: where no dimension stands out, as in 64 of equal spread, nearly all rows are met."""
    rows = written(quantised(vectors, scale).withColumn("dim", F.size("v")), "topk-vectors")
    n = rows.count()
    hashed = rows.withColumn("h", F.xxhash64("v"))
    # Of a vector, its k + 1 smallest different ids matter, and of an id k rows; each limit cuts before it shuffles.
    limited = lambda t, rank, most, *by: t.withColumn("__r", rank.over(Window.partitionBy("v", *by).orderBy("vec_id"))).where(F.col("__r") <= most).drop("__r")
    kept = limited(hashed, F.row_number(), k, "vec_id").withColumn("salt", F.pmod("vec_id", F.lit(32)))
    kept = limited(limited(kept, F.dense_rank(), k + 1, "salt").drop("salt"), F.dense_rank(), k + 1)
    blocks, query_blocks = max(1, -(-n // block_rows), min(least_blocks, n // 512)), max(1, -(-n // (every * block_queries)))
    distinct = kept.groupBy("v", "dim", "h").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k * (k + 1) ids
    distinct = written(distinct.withColumn("uid", F.monotonically_increasing_id()), "topk-distinct")
    # A vector stands for its smallest id, or, for a query of that very id, for the next one.
    reps = distinct.select("uid", F.col("ids")[0].alias("rep"), F.coalesce(F.get(F.array_distinct("ids"), F.lit(1)), F.lit(NONE)).alias("next"), "dim", "v", F.pmod("h", F.lit(blocks)).cast("long").alias("cb"))
    c = _packed(reps, "cb", "c", ["rep", "next", "uid"])
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("long"))
    q = _packed(queries.select("vec_id", "dim", "v", "qb"), "qb", "q", ["vec_id"])
    # A number of partitions of our own, for adaptive execution joins those of few bytes, however long they take.
    grid, each = ["dim", "cb", "qb"], lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    parts = min(2 * blocks * query_blocks, 20_000)
    pairs = c.select("*", each("qb", query_blocks)).repartition(parts, *grid).join(q.select("*", each("cb", blocks)).repartition(parts, *grid), grid)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_block, lists, kth = None, None, {}
        for batch in batches:
            for r in batch.to_pylist():
                rep, follows, uid = np.frombuffer(r["c"], "<i8").reshape(3, -1)
                asked = np.frombuffer(r["q"], "<i8")
                if at_block != (r["dim"], r["cb"]):
                    at_block, lists = (r["dim"], r["cb"]), SortedLists(np.frombuffer(r["c_v"], "<i8").reshape(len(rep), r["dim"]))
                for query, v in zip(asked.tolist(), np.frombuffer(r["q_v"], "<i8").reshape(len(asked), r["dim"]), strict=True):
                    own = rep == query
                    before = kth.get((query, v.tobytes()), np.zeros(0))
                    # Vectors that no other row holds are left out, so there must be room for them.
                    at, scores = lists.top(v, k + int((own & (follows == NONE)).sum()), before[0] if len(before) >= k else -np.inf)
                    stands = np.where(own[at], follows[at], rep[at])
                    at, scores, stands = (x[~(own[at] & (follows[at] == NONE))] for x in (at, scores, stands))
                    order = np.lexsort((stands, -scores))[:k]
                    kth[query, v.tobytes()] = np.sort(np.concatenate([before, scores[order]]))[-k:]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array([query] * len(order), pa.int64()), "uid": pa.array(uid[at][order], pa.int64()), "rep": pa.array(stands[order], pa.int64()), "score": pa.array(scores[order].astype(np.int64))})

    found = pairs.select("dim", "cb", "c", "c_v", "q", "q_v").mapInArrow(search, "query_id long, uid long, rep long, score long")
    found = found.groupBy("query_id", "uid", "rep").agg(F.max("score").alias("score"))  # of a repeated id's vectors
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rep")
    # A distinct vector brings its own ids, so k vectors by (score, smallest id) hold all of the k best rows.
    found = found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k)
    hits = found.join(distinct.select("uid", "ids"), "uid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
