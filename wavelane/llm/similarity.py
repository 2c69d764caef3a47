"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets form a class; the join runs on classes. Classes that share a band of their MinHash
values are compared value by value in steps; a pair is dropped when the posterior probability that its similarity
reaches the threshold falls below a tolerance. What survives links classes into candidate families. A family brings
signatures and shingle sets together, in blocks; there the same test picks out the surviving pairs again, and these
alone are compared exactly. Only counts and enough links to span the result leave the task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, runs, sized_join, written
from .components import components

BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
_M = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of the public SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` blank-separated words; a shorter text has one, of all its words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = mix64(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)) + np.uint64(1))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


@cache
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, np.uint64)


def minhash(x: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits) over a shingle set."""
    a, b = _coefficients()
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):  # bounded memory for very long texts
        low = np.minimum(low, ((x[i : i + 4096, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(0))
    return low


def set_key(x: np.ndarray) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(x.tobytes())


def fewest_matches(threshold: float, tolerance: float, step: int = 16) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): with fewer, P(similarity >= threshold | matches) < tolerance.

    The prior is uniform; values are compared as bytes, so unequal values match once in 256 and the chance of a
    match is s + (1 - s) / 256. P is a sum over similarities on a grid, normalised."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(step, HASHES + 1, step):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, need: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of signatures (bytes, one row each) that no step drops."""
    matches, at = np.zeros((len(a), len(b)), np.int16), 0
    i = j = got = None
    for n, m in need:
        if i is None:
            for k in range(at, n):
                matches += a[:, k, None] == b[None, :, k]
            i, j = np.nonzero(matches >= m)
            got = matches[i, j]
        else:
            got = got + (a[i, at:n] == b[j, at:n]).sum(1)
            keep = got >= m
            i, j, got = i[keep], j[keep], got[keep]
        at = n
    return i, j


class Forest:
    """Which of ``n`` rows are connected so far."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        r = self.up[rows]
        while not np.array_equal(up := self.up[r], r):
            r = up
        self.up[rows] = r
        return r

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Connects i[k] with j[k] for every k: larger roots go under the smallest they meet, until no pair is apart."""
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(i, j), np.minimum(i, j))

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows connected to a smaller one, and the smallest row each is connected to."""
        r = self.roots(np.arange(len(self.up)))
        rows = np.flatnonzero(r != np.arange(len(r)))
        return rows, r[rows]


def connect(sig: np.ndarray, left: np.ndarray, right: np.ndarray, need: list[tuple[int, int]], width: int = 512) -> Forest:
    """Connects the rows that surviving pairs of (left, right) connect. Rows already connected are not compared again:
    in a tile, those of the commonest component meet the others only."""
    f, same = Forest(len(sig)), left is right
    for x in range(0, len(left), width):
        for y in range(x if same else 0, len(right), width):
            a, b = left[x : x + width], right[y : y + width]
            ra, rb = f.roots(a), f.roots(b)
            names, counts = np.unique(np.concatenate([ra, rb]), return_counts=True)
            main = names[counts.argmax()]
            for p, q in ((a[ra != main], b), (a[ra == main], b[rb != main])):
                if len(p) and len(q):
                    i, j = surviving(sig[p], sig[q], need)
                    f.link(p[i], q[j])
    return f


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float, wanted=None, width: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with |a & b| >= threshold * |a | b|, exactly, in blocks of ``width`` rows.

    ``wanted(x, y)`` names the pairs to compare in the block that begins at rows x and y, by their places there;
    without it, all. Few pairs are compared one by one. For many, sets of sorted hashes become rows of 0 and 1 over
    the hashes that both sides hold, whose product counts the common ones (whole numbers far below 2 to the 24)."""
    for x in range(0, len(a), width):
        for y in range(0, len(b), width):
            left, right = a[x : x + width], b[y : y + width]
            i, j = wanted(x, y) if wanted else (g.ravel() for g in np.indices((len(left), len(right))))
            if not len(i):
                continue
            if 16 * len(i) < len(left) * len(right):
                common = np.array([np.isin(left[p], right[q], assume_unique=True).sum() for p, q in zip(i.tolist(), j.tolist(), strict=True)])
            else:
                common = _common(left, right)[i, j]
            sizes = np.array([len(v) for v in left])[i] + np.array([len(v) for v in right])[j]
            keep = (common > 0) & (common >= threshold * (sizes - common) - 1e-9)
            yield i[keep] + x, j[keep] + y


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    common = np.zeros((len(left), len(right)))
    for z in range(0, len(both), 8192):
        part = both[z : z + 8192]
        common += _incidence(left, part) @ _incidence(right, part).T
    return common


def _incidence(sets: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(of)), np.float32)
    for k, s in enumerate(sets):
        at = np.minimum(np.searchsorted(of, s), len(of) - 1)
        out[k, at[of[at] == s]] = 1
    return out


def class_keys(texts: list[str], ids: list[int | None]) -> tuple[list[np.ndarray], list[bytes | None]]:
    """Shingle sets, and the key of each text's class: of its set; without words, of its id; null without either."""
    sets = [shingles(t) for t in texts]
    return sets, [set_key(x) if len(x) else None if k is None else set_key(np.array([k], np.int64)) for x, k in zip(sets, ids, strict=True)]


def row_key(docs: DataFrame) -> Column:
    """A hash of id and text: equal for rows that repeat each other, and else different (up to collisions)."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key, the class's key, the size of its set, and the set's band keys and signature bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of(batch.column(2)):
                ids, rows = (batch.column(c).slice(at, len(texts)) for c in (0, 1))
                sets, keys = class_keys(texts, ids.to_pylist())
                found = [minhash(x) if len(x) else None for x in sets]
                bands = [None if m is None else _band_keys(m) for m in found]
                sigs = [None if m is None else (m & 255).astype(np.uint8).tobytes() for m in found]
                yield pa.RecordBatch.from_arrays([ids, rows, pa.array(keys, pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "row", "node", "n", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, node binary, n int, bands array<bigint>, sig binary")


def _band_keys(m: np.ndarray) -> list[int]:
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[k::ROWS][:BANDS].astype(np.uint64))
    return h.astype(np.int64).tolist()


def _blocks(rows: DataFrame, key: str, most: int, weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """``rows`` with ``i`` and ``j``: keys of at most ``most`` rows, which weigh ``heaviest`` at most, form one block
    (0, 0); larger ones are split at random into blocks, and each row goes to every pair of blocks that holds its own,
    as left (i) or right side."""
    parts = F.ceil(F.count("*") / most)
    if weight is not None:
        parts = F.least(F.count("*"), F.greatest(parts, F.ceil(F.sum(weight) / heaviest)))
    large = written(rows.groupBy(key).agg(parts.cast("int").alias("parts")).where("parts > 1"), "blocks")
    if large.isEmpty():
        return rows.withColumns(dict.fromkeys(("i", "j", "own"), F.lit(0)))
    rows = sized_join(rows, large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("own", "other").cast("int")).withColumn("j", F.greatest("own", "other").cast("int")).drop("other", "parts")


def _together(rows: DataFrame, key: str) -> DataFrame:
    """Each pair of blocks in one partition, in order of the class keys."""
    keys = [key, "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node")


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block pair's left and right side; both the same for a block with itself."""
    own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
    every = np.arange(len(t))
    return (every, every) if i[0] == j[0] else (every[own == i], every[own == j])


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), HASHES)


def links(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, bucket_rows: int = 16_384, family_rows: int = 2_048, block_shingles: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(members, classes). members: doc_id, row (see :func:`row_key`) and node (its class's key), a row per document.
    classes: node, copies, n (shingles), low (the first of its documents: by id, nulls last, then row key), linked
    (documents of other classes that are similar), root of its component."""
    members = written(_sketches(docs), "sim-sketches")
    # Copies meet here: sums and minima by task before the shuffle.
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("low")
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), low, *(F.first(c).alias(c) for c in ("bands", "sig", "n")))
    nodes = written(nodes, "sim-nodes")
    need = fewest_matches(threshold, tolerance)

    banded = nodes.select("node", "sig", F.posexplode("bands").alias("no", "h")).select("node", "sig", F.xxhash64("no", "h").alias("bucket"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket", "i", "j"], least=2):
            rows, low = connect(_signatures(t), *_sides(t), need).stars()
            if len(rows):
                node = t.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([node.take(pa.array(rows)), node.take(pa.array(low))], ["a", "b"])

    candidates = _together(_blocks(banded, "bucket", bucket_rows), "bucket").mapInArrow(prune, "a binary, b binary")
    families = components(candidates)

    # Shingle sets of the classes in families, made again from one document each.
    wanted = sized_join(nodes.select("node", F.col("low.row").alias("row"), "sig", "copies"), families, "node").withColumn("family", F.xxhash64("root")).drop("root")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            ids, node, rest = batch.column("doc_id").to_pylist(), batch.column("node").to_pylist(), batch.select(["node", "family", "copies", "sig"])
            for at, texts in batches_of(batch.column("text")):
                kept, found = [], []
                for k, t in enumerate(texts, at):
                    if node[k] not in done:
                        x, key = class_keys([t], [ids[k]])
                        if key[0] == node[k]:  # row keys are hashes
                            done.add(node[k])
                            kept.append(k)
                            found.append(x[0].tobytes())
                if kept:
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept)) for c in rest.columns), pa.array(found, pa.binary())], [*rest.schema.names, "s"])

    texts = docs.select(F.col("doc_id").cast("long"), row_key(docs).alias("row"), "text")
    found = sized_join(texts, written(wanted, "sim-wanted"), "row").drop("row")
    found = written(found.mapInArrow(sets, "node binary, family long, copies long, sig binary, s binary").dropDuplicates(["node"]), "sim-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["family", "i", "j"], least=2):
            sig, copies, (left, right) = _signatures(t), t.column("copies").to_numpy(), _sides(t)
            x = [np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()]
            linked, f, same = np.zeros(len(t), np.int64), Forest(len(t)), left is right

            def wanted(p: int, q: int, sig=sig, left=left, right=right, same=same) -> tuple[np.ndarray, np.ndarray]:
                i, j = (np.zeros(0, np.int64),) * 2 if same and q < p else surviving(sig[left[p : p + 256]], sig[right[q : q + 256]], need)
                once = i < j if same and p == q else slice(None)
                return i[once], j[once]

            for i, j in similar([x[k] for k in left], [x[k] for k in right], threshold, wanted, 256):
                a, b = left[i], right[j]
                np.add.at(linked, a, copies[b])
                np.add.at(linked, b, copies[a])
                f.link(a, b)
            node, at, (rows, low) = t.column("node").combine_chunks(), np.flatnonzero(linked), f.stars()
            other = [pa.nulls(len(at), pa.binary()), node.take(pa.array(low))]
            yield pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate([at, rows]))), pa.concat_arrays(other), pa.array(np.concatenate([linked[at], np.zeros(len(rows), np.int64)]))], ["a", "b", "linked"])

    blocks = _blocks(found, "family", family_rows, F.length("s") / 8, block_shingles)
    verified = written(_together(blocks, "family").mapInArrow(verify, "a binary, b binary, linked long"), "sim-links")
    roots = components(verified.where("b IS NOT NULL").select("a", "b"))
    counts = verified.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    few = written(roots.join(counts, "node", "left"), "sim-linked")
    classes = sized_join(nodes.select("node", "copies", "n", "low"), few, "node", "left")
    return members.select("doc_id", "row", "node"), classes.withColumn("linked", F.coalesce("linked", F.lit(0))).withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, **sizes: int) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of all documents that links connect), n_links (other
    documents with a Jaccard similarity of five-word shingles of ``threshold`` or more, copies included).

    Two classes never share a class_id: where a repeated doc_id is the smallest of several, the one with the smallest
    key has it, and the others, like classes without any doc_id, have a negative number made from their key (equal for
    two of them with a chance of 2 to the -63). A text under five words has one shingle, its words. Null or empty texts,
    or such without words, have none: they have 0 links, and only those of one doc_id share a class; without a doc_id
    their class_id is null. Null doc_id: linked like others. Repeated rows count as documents of their own. Empty
    table: no rows. Other columns are ignored.

    Pairs at the threshold are missed with a chance of about 3e-5 (no common band) plus ``tolerance`` a step; what is
    reported is exact (up to collisions of 64-bit hashes). ``sizes`` (see :func:`links`) bound a task: large buckets and
    families are split into pairs of blocks. In a dense family of m different texts, counting each one's links takes
    about m * m / 2 comparisons of signatures, spread over its pairs of blocks; copies cost nothing."""
    members, classes = links(docs, threshold, tolerance, **sizes)
    classes = written(classes, "sim-classes")
    ids = classes.groupBy("root").agg(F.min("low.doc_id").alias("id"))
    shared = ids.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("root").alias("first")).where("n > 1").drop("n")
    own = F.col("id").isNotNull() & (F.col("first").isNull() | (F.col("first") == F.col("root")))
    class_id = F.when(own, F.col("id")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("root"), 1))
    ids = sized_join(written(ids, "sim-ids"), written(shared, "sim-shared"), "id", "left").select("root", class_id.alias("class_id"))
    n_links = F.when(F.col("n") > 0, F.col("linked") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long")
    each = written(classes.join(ids, "root").select("node", "class_id", n_links.alias("n_links")), "sim-result")
    return sized_join(members, each, "node", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, **sizes: int) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class of :func:`join` its first document stays (by doc_id,
    nulls last, then a hash of the text), with all its columns; of rows that repeat each other, one.

    A class holds all that links connect, so a document can go that is similar to the one that stays only by way of
    others. Decisions are by row, not by doc_id: unrelated texts under one doc_id both stay. Texts without words stay,
    one for each doc_id, and all that have no doc_id."""
    members, classes = links(docs, threshold, tolerance, **sizes)
    classes = written(classes, "sim-classes")
    first = classes.groupBy("root").agg(F.min("low").alias("first"), F.sum("copies").alias("size")).where("size > 1")
    busy = written(classes.join(first, "root").select("node", F.col("first.row").alias("first")), "sim-busy")
    rows = sized_join(members, busy, "node").groupBy("row").agg(F.count("*").alias("n"), F.max(F.col("row") != F.col("first")).alias("goes"))
    rows = written(rows.where("goes OR n > 1"), "sim-rows").withColumnRenamed("row", "__row_key")
    keyed = docs.withColumn("__row_key", row_key(docs))
    kept = sized_join(keyed, rows.select("__row_key"), "__row_key", "left_anti").drop("__row_key")
    repeated = rows.where("NOT goes").select("__row_key")
    if repeated.isEmpty():
        return kept
    once = sized_join(keyed, repeated, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return kept.unionByName(once.select(kept.columns))
