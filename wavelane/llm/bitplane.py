"""Token-id shards: fixed-size blocks of ids are transposed into byte or bit planes, each plane is compressed with
zstandard, and each file ends in an index of its chunks.

A file: ``WLBP1`` and one byte for the kind of planes; the chunks' planes; the documents (ids and lengths); the index
as JSON (per chunk: ids, offset and size of each plane; where the documents are); 8 bytes with the index's size.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, fresh_path
from .tokens import encoder

MAGIC = b"WLBP1"
KINDS = {"byte": 8, "bit": 1}
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte k (or bit k, lowest first) of every id, for each k."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    return [np.packbits((rows[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        x = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            rows[:, k] = x
        else:
            rows[:, k // 8] |= np.unpackbits(x, count=n) << (k % 8)
    return rows.reshape(-1).view("<u4")


def _open(path: str):
    """The file system of a path or URI (local, S3, HDFS ...), and the path there."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class ShardWriter:
    """Writes one file chunk by chunk; memory holds one chunk of ids and two numbers a document."""

    def __init__(self, path: str, kind: str, chunk_ids: int, level: int = 3):
        import zstandard

        self.path, self.kind, self.chunk_ids = path, kind, chunk_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        # Each attempt of a task has a file of its own and moves it into place at its end; attempts write the same.
        self.fs, self.to = _open(path)
        self.part = f"{self.to}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.to.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.at, self.chunks, self.held, self.n_held = 0, [], [], 0
        self.keys, self.lengths, self.n_null = [], [], 0
        self._put(MAGIC + bytes([KINDS[kind]]))

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        if key is None:
            if self.n_null < len(self.keys):
                raise ValueError("documents without an id come first")
            self.n_null += 1
        self.keys.append(key or 0)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.chunk_ids:
            x = np.frombuffer(b"".join(self.held), "<u4")
            full = len(x) // self.chunk_ids * self.chunk_ids
            for i in range(0, full, self.chunk_ids):
                self._chunk(x[i : i + self.chunk_ids])
            self.held, self.n_held = [x[full:].tobytes()], len(x) - full

    def _chunk(self, ids: np.ndarray) -> None:
        at = self.at
        self.chunks.append({"ids": len(ids), "at": at, "planes": [self._put(self.pack(p)) for p in to_planes(ids, self.kind)]})

    def close(self) -> tuple[int, int, int]:
        if self.n_held:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        at = self.at
        sizes = [self._put(self.pack(np.array(x, "<i8").tobytes())) for x in (self.keys, self.lengths)]
        index = json.dumps({"docs": {"n": len(self.keys), "null": self.n_null, "at": at, "sizes": sizes}, "chunks": self.chunks}).encode()
        self._put(index)
        self._put(len(index).to_bytes(8, "little"))
        self.out.close()
        self.fs.move(self.part, self.to)
        return len(self.keys), sum(self.lengths), self.at


class ShardReader:
    """Reads a file's index, its documents, and any chunk by its place."""

    def __init__(self, path: str):
        import zstandard

        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        head, n = self._get(0, 6), int.from_bytes(self._get(size - 8, 8), "little")
        if head[:5] != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        self.kind = {v: k for k, v in KINDS.items()}[head[5]]
        self.index = json.loads(self._get(size - 8 - n, n))

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        d = self.index["docs"]
        a, b = d["sizes"]
        keys = np.frombuffer(self.unpack(self._get(d["at"], a)), "<i8")
        return keys, np.frombuffer(self.unpack(self._get(d["at"] + a, b)), "<i8")

    def chunk(self, k: int) -> np.ndarray:
        c = self.index["chunks"][k]
        at, planes = c["at"], []
        for n in c["planes"]:
            planes.append(self.unpack(self._get(at, n)))
            at += n
        return from_planes(planes, c["ids"], self.kind)

    def each(self) -> Iterator[tuple[int | None, bytes]]:
        """The documents in order with their ids; holds a chunk and a document at a time."""
        held, k, at = np.zeros(0, "<u4"), 0, 0
        for i, (key, n) in enumerate(zip(*(x.tolist() for x in self.documents()), strict=True)):
            parts = []
            while n > len(held) - at:
                parts.append(held[at:])
                n -= len(held) - at
                held, at, k = self.chunk(k), 0, k + 1
            parts.append(held[at : at + n])
            at += n
            yield None if i < self.index["docs"]["null"] else key, b"".join(p.tobytes() for p in parts)

    def close(self) -> None:
        self.file.close()


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, planes: str = "byte", chunk_ids: int = 65_536) -> DataFrame:
    """Encodes every text and writes shards under ``path`` in ascending order of doc_id; returns the manifest.

    Null text: only the end id. Null doc_id: first. Repeated doc_ids: all kept, in order of their texts' first 64
    characters, then of their place in the table. An empty table: no shard. The documents are dealt by ranges of these
    three, so that rows that repeat an id or each other can be split; one shard a partition. The manifest has a row a shard, so it is
    as small as a list of output files; that list is what the driver sees."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, texts in batches_of(batch.column(1)):
                out = out or ShardWriter(f"{path}/shard-{shard:06d}.wlbp", planes, chunk_ids)
                for key, ids in zip(keys[at : at + len(texts)], encode(texts), strict=True):
                    out.add(key, ids + end)
        if out:
            n_docs, n_ids, n_bytes = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [out.path], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]})

    order = [F.col("doc_id").asc_nulls_first(), "__h", "__row"]
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.substring("text", 1, 64).alias("__h"), F.monotonically_increasing_id().alias("__row"))
    rows = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, MANIFEST).collect()
    return spark.createDataFrame(sorted(map(tuple, rows)), MANIFEST)


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; ``with_ids``: its ids too."""
    spark, total, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r["path"], total))
        total += r["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    arrow = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.int64()) for c in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, found = ShardReader(path), []
                for key, ids in shard.each():
                    n = len(ids) // 4
                    found.append((key, start, n, zlib.crc32(ids), ids)[: 4 + with_ids])
                    start += n
                    if len(found) == 1024:
                        yield send(found)
                        found = []
                if found:
                    yield send(found)
                shard.close()

    shards = spark.createDataFrame(rows, "path string, start long")
    return shards.repartition(max(1, len(rows))).mapInArrow(read, schema)


def encode_decode(docs: DataFrame, tokenizer: str, end_id: int = 1, planes: str = "byte", path: str | None = None) -> DataFrame:
    """Writes the ids to ``path`` (default: a new folder in the shared one) and reads the files back."""
    return read_ids(write_ids(docs, tokenizer, path or fresh_path(docs.sparkSession, "ids"), end_id, planes))
