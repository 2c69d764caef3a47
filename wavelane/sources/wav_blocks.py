"""WAV files of any length as blocks of samples: tasks read byte ranges."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .wav import _filesystem

BLOCKS = "path string, sample_rate int, n_samples long, block long, pcm array<smallint>, error string"
#: Bytes of samples that a batch holds, about.
BATCH = 8 << 20


@dataclass
class Header:
    rate: int
    at: int  # first byte of the samples
    samples: int


def read_header(file, size: int) -> Header:
    """Walks the chunks of an open file by their heads; bodies are passed over unread. The last data chunk counts; one
    that the file is too short for ends with the file. Refuses what is not PCM, 16 bits, mono."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    top = read(0, 12)
    if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate, data = 12, None, None
    while at + 8 <= size:
        head = read(at, 8)
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = read(at + 8, 16)
            if length < 16 or len(body) < 16:
                raise ValueError("the format is cut off")
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body)
            if (code, channels, bits) != (1, 1, 16):
                raise ValueError(f"format {code}, {channels} channels, {bits} bits: only PCM, mono, 16 bits can be read")
        elif name == b"data":
            data = at + 8, min(length, size - at - 8)
        at += 8 + length
    if rate is None or data is None:
        raise ValueError("no format or no data")
    return Header(rate, data[0], data[1] // 2)


@dataclass
class Span(InputPartition):
    """Parts of files: path, first byte, the byte after the last, the file's size."""

    parts: list[tuple[str, int, int, int]]

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class WavBlocks(DataSource):
    """``spark.read.format("wav_blocks").option("path", folder_or_file)``; options: see :func:`read_wav_blocks`."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        only = json.loads(o["only"]) if "only" in o else None
        return _Reader(o["path"], int(o.get("block", 65_536)), int(o.get("span", 64 << 20)), only, int(o.get("first", 0)), int(o.get("last", 2**62)))


class _Reader(DataSourceReader):
    """The driver lists names and sizes only. A span of a file gives the blocks that begin in it; the head of a file is
    read by each of its tasks. Many small files share a span. Files and blocks that aren't asked for are not read.

    Filters are not taken from Spark (``pushFilters``): it keeps what one query pushed for every later query on the same
    DataFrame, so that these would miss rows (seen on version 4.1.2)."""

    def __init__(self, path: str, block: int, span: int, only: list[str] | None = None, first: int = 0, last: int = 2**62):
        self.path, self.block, self.span, self.low, self.high = path, block, span, first, last
        self.wanted = None if only is None else set(only)

    def _files(self) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.lower().endswith(".wav") and (self.wanted is None or f.path in self.wanted):
                yield f.path, f.size

    def partitions(self) -> list[Span]:
        out: list[list] = []
        room = 0
        for path, size in self._files():
            for lo in range(0, max(1, size), self.span):
                hi = min(lo + self.span, size)
                if not out or room < hi - lo:
                    out.append([])
                    room = self.span
                out[-1].append((path, lo, hi, size))
                room -= hi - lo
        return [Span(parts) for parts in out]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[4]) if row[4] is not None else 1
            if 2 * held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, partition: Span | None) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        for path, lo, hi, size in partition.parts if partition else ():
            with system.open_input_file(path) as file:
                try:
                    head = read_header(file, size)
                except (ValueError, struct.error) as e:
                    if lo == 0:
                        yield path, None, None, None, None, str(e)
                    continue
                wide = 2 * self.block
                first = max(self.low, -(-(lo - head.at) // wide) if lo > head.at else 0)
                last = min(self.high, -(-(hi - head.at) // wide) - 1 if hi < size else self.high, -(-head.samples // self.block) - 1)
                for b in range(first, last + 1):
                    file.seek(head.at + b * wide)
                    body = file.read(2 * min(self.block, head.samples - b * self.block))
                    yield path, head.rate, head.samples, b, np.frombuffer(body, "<i2"), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def read_wav_blocks(spark: SparkSession, path: str, block: int = 65_536, span: int = 64 << 20, only: list[str] | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """(path, sample_rate, n_samples, block, pcm, error): the samples of every ``.wav`` file at or below ``path`` in blocks,
    which fit :func:`blocks.as_blocks` once ``path`` is named ``clip``. No task reads more than ``span`` bytes of a file
    and the block that begins last in them, so files may be as long as their format allows (4 GB).

    ``only`` names the files to read (as in the column ``path``), ``first`` and ``last`` the blocks of each: no task is
    made for other files, and other blocks aren't read. A file that can't be read as WAV is one row with the reason in
    ``error``; one without samples has no row. For stores that only Spark can open, see :func:`wav.read_wav`."""
    spark.dataSource.register(WavBlocks)
    reader = spark.read.format("wav_blocks").option("path", path).option("block", block).option("span", span).option("first", first)
    if last is not None:
        reader = reader.option("last", last)
    if only is not None:
        reader = reader.option("only", json.dumps(only))
    return reader.load()
