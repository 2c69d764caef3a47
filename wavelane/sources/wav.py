"""WAV files: PCM, 16 bits, one channel."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

CLIPS = "path string, sample_rate int, pcm array<smallint>, error string"


def encode_wav(pcm: np.ndarray, rate: int = 16_000) -> bytes:
    data = np.ascontiguousarray(pcm, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples. Walks the chunks; the last data chunk counts. Refuses what is not PCM, 16 bits, mono."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if (code, channels, bits) != (1, 1, 16):
                raise ValueError(f"format {code}, {channels} channels, {bits} bits: only PCM, mono, 16 bits can be read")
        elif name == b"data":
            data = body
        at += 8 + size
    if rate is None or data is None:
        raise ValueError("no format or no data")
    return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """One row per file. Spark's own reader lists and reads the files; tasks parse them. A file that can't be read as
    WAV has its reason in ``error``, and neither rate nor samples."""
    return parse_wav(spark.read.format("binaryFile").load(path).select("path", "content"))


def parse_wav(files: DataFrame) -> DataFrame:
    """:func:`read_wav` of files that are there as (path, content)."""

    def parsed(content: bytes) -> tuple:
        try:
            return *decode_wav(content), None
        except (ValueError, struct.error) as e:
            return None, None, str(e)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate, pcm, error = zip(*map(parsed, b.column(1).to_pylist()), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rate, pa.int32()), pa.array(pcm, pa.list_(pa.int16())), pa.array(error, pa.string())], ["path", "sample_rate", "pcm", "error"])

    return files.mapInArrow(parse, CLIPS)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class WavSink(DataSource):
    """``df.write.format("wav_sink").save(path)`` for rows (name, sample_rate, pcm): one file each."""

    @classmethod
    def name(cls) -> str:
        return "wav_sink"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Tasks write under names of their own, in a folder of this job; the driver gives the files of the attempts that
    counted their final names."""

    def __init__(self, path: str):
        self.path, self.own = path, f"_attempts-{uuid.uuid4().hex}"

    def _open(self):
        return _filesystem(self.path)

    def write(self, rows) -> WriterCommitMessage:
        system, root = self._open()
        system.create_dir(f"{root}/{self.own}", recursive=True)
        files = []
        for r in rows:
            own = f"{root}/{self.own}/{uuid.uuid4().hex}"
            with system.open_output_stream(own, compression=None) as out:
                out.write(encode_wav(np.array(r["pcm"], "<i2"), r["sample_rate"]))
            files.append((own, f"{root}/{r['name']}.wav"))
        return _Written(files)

    def commit(self, messages) -> None:
        system, root = self._open()
        files = [f for m in messages if m for f in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("two clips have the same name")
        for own, to in files:
            system.move(own, to)
        if files:
            system.delete_dir(f"{root}/{self.own}")

    def abort(self, messages) -> None:
        """Drops what the job's tasks wrote, failed attempts included."""
        from pyarrow import fs

        system, root = self._open()
        if system.get_file_info(f"{root}/{self.own}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.own}")


def write_wav(clips: DataFrame, path: str) -> None:
    clips.sparkSession.dataSource.register(WavSink)
    clips.select("name", "sample_rate", "pcm").write.format("wav_sink").mode("append").save(path)
