"""WAV files read by byte ranges, against the reader of whole files."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.sources.wav import encode_wav, read_wav
from wavelane.sources.wav_blocks import _Reader, read_wav_blocks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("wav")
    rng = np.random.default_rng(1)
    for n in (0, 1, 9, 10, 11, 1000, 1003):
        (top / f"n{n}.wav").write_bytes(encode_wav(rng.integers(-30_000, 30_000, n).astype("<i2"), 8000 + n))
    (top / "below").mkdir()
    pcm = np.arange(25, dtype="<i2").tobytes()
    fmt = b"fmt " + struct.pack("<IHHIIHH", 18, 1, 1, 44_100, 88_200, 2, 16) + b"\0\0"
    # Chunks before, between and after; two data chunks; the last one longer than the file, with half a sample.
    (top / "below" / "odd.WAV").write_bytes(b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 4) + b"data" + b"data" + struct.pack("<I", 6) + b"abcdef" + fmt + b"data" + struct.pack("<I", 4_000_000_000) + pcm + b"x")
    (top / "stereo.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32_000, 4, 16) + b"data\0\0\0\0")
    (top / "cut.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 16) + b"\1")
    (top / "empty.wav").write_bytes(b"")
    (top / "other.txt").write_bytes(b"RIFF")
    return top


@pytest.mark.parametrize("block,span", [(10, 7), (10, 64), (7, 1000), (65_536, 64 << 20)])
def test_blocks_join_to_whole_files(spark, folder, block, span):
    rows = read_wav_blocks(spark, str(folder), block, span).collect()
    got: dict = {}
    for r in sorted((r for r in rows if r["error"] is None), key=lambda r: (r["path"], r["block"])):
        name = os.path.basename(r["path"])
        rate, pcm, blocks = got.setdefault(name, (r["sample_rate"], [], []))
        pcm += r["pcm"]
        blocks.append(r["block"])
        assert len(r["pcm"]) == min(block, r["n_samples"] - r["block"] * block)
    assert all(b == list(range(len(b))) for _, _, b in got.values())
    whole = read_wav(spark, f"file://{folder}/*.wav").unionByName(read_wav(spark, f"file://{folder}/below/*")).collect()
    want = {os.path.basename(r["path"]): (r["sample_rate"], r["pcm"]) for r in whole if r["error"] is None}
    assert {n: (rate, pcm) for n, (rate, pcm, _) in got.items()} == {n: w for n, w in want.items() if w[1]}
    assert sorted(os.path.basename(r["path"]) for r in rows if r["error"] is not None) == ["cut.wav", "empty.wav", "stereo.wav"]


def test_files_and_blocks_that_are_not_asked_for_are_not_read(spark, folder):
    one, two = f"{folder}/n1003.wav", f"{folder}/n9.wav"
    df = read_wav_blocks(spark, f"file://{folder}", 10, 64)
    every = df.where("error IS NULL").select("path", "block").collect()
    for options, keep in (({"only": [one]}, lambda p, b: p == one), ({"only": [one, two]}, lambda p, b: p in (one, two)), ({"only": [one], "first": 40, "last": 44}, lambda p, b: p == one and 40 <= b < 45), ({"last": 3}, lambda p, b: b <= 3), ({"only": []}, lambda p, b: False)):
        found = read_wav_blocks(spark, f"file://{folder}", 10, 64, **options)
        assert {(r["path"], r["block"]) for r in found.where("error IS NULL").collect()} == {(p, b) for p, b in every if keep(p, b)}
    assert read_wav_blocks(spark, f"file://{folder}", 10, 64, only=[one]).rdd.getNumPartitions() < df.rdd.getNumPartitions()
    # A filter in Spark leaves the DataFrame as it was, whatever the session allows.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        again = read_wav_blocks(spark, f"file://{folder}", 10, 64).where("error IS NULL")
        assert again.where(F.col("path") == two).count() == 1 and again.count() == len(every)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_file_of_over_two_gigabytes(spark, tmp_path):
    """A file with holes: its blocks lie over many tasks, and one far behind is read by itself."""
    n = 1_200_000_000
    path = tmp_path / "long.wav"
    with path.open("wb") as f:
        f.write(b"RIFF\0\0\0\0WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data" + struct.pack("<I", 2 * n))
        f.seek(2 * (n - 5), os.SEEK_CUR)
        f.write(np.arange(1, 6, dtype="<i2").tobytes())
    block = 65_536
    last = -(-n // block) - 1
    (r,) = read_wav_blocks(spark, str(path), block, first=last).collect()
    assert r["n_samples"] == n and r["pcm"][-6:] == [0, 1, 2, 3, 4, 5] and len(r["pcm"]) == n - last * block
    spans = _Reader(str(path), block, 64 << 20).partitions()
    assert len(spans) == 36 and max(hi - lo for s in spans for _, lo, hi, _ in s.parts) == 64 << 20
    part = read_wav_blocks(spark, str(path), block, only=[str(path)], first=last - 2)
    assert part.agg(F.sum(F.size("pcm"))).first()[0] == n - (last - 2) * block


def test_sinks_do_not_share_attempts(tmp_path):
    from wavelane.sources.wav import _Writer

    a, b = _Writer(str(tmp_path)), _Writer(str(tmp_path))
    one = a.write([{"name": "a", "pcm": [1], "sample_rate": 8000}])
    two = b.write([{"name": "b", "pcm": [2], "sample_rate": 8000}])
    a.commit([one])
    lost = b.write([{"name": "b", "pcm": [3], "sample_rate": 8000}])
    assert lost.files != two.files
    b.commit([two])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.wav", "b.wav"]
    c = _Writer(str(tmp_path))
    c.abort([c.write([{"name": "c", "pcm": [], "sample_rate": 8000}]), None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.wav", "b.wav"]
