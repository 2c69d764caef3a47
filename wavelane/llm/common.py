"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are neither blanks nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows and bytes (of its rows as JSON) may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one if the executors run
    in this very process (as in tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="wavelane-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitted(df: DataFrame, label: str, task_rows: int = 200_000) -> DataFrame:
    """Like :func:`written`, read back in no more partitions than ``task_rows`` rows each ask for. A table of few rows is
    one partition, which is grouped and joined without a shuffle; the rows are counted while they are written."""
    seen, path = Observation(), fresh_path(df.sparkSession, label)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    parts = max(1, -(-seen.get["rows"] // task_rows))
    return df.sparkSession.read.schema(df.schema).parquet(path).coalesce(parts)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes; the second is summed only if the first holds."""
    if df.count() > rows:
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0) <= size


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts ``right`` (a written table, or cheap to count) if it is :func:`small`; else a shuffled join, whose hot
    keys adaptive execution splits."""
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)


def batches_of(texts: pa.Array, rows: int = 128) -> Iterator[tuple[int, list[str]]]:
    """Slices of a text column, nulls as empty."""
    for i in range(0, len(texts), rows):
        yield i, [x or "" for x in texts.slice(i, rows).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``, of a partition sorted by them, as tables of at least ``least`` rows.

    Vectorised over batches: runs shorter than ``least`` cost next to nothing. Keys must not be null."""

    def ends(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t) - 1, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            x = c.to_numpy(zero_copy_only=False)
            change |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(change) + 1, len(t))

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        first = tuple(t.column(k)[0].as_py() for k in keys)
        if held and first != last:
            whole = pa.concat_tables(held)
            held = []
            if len(whole) >= least:
                yield whole
        last = tuple(t.column(k)[-1].as_py() for k in keys)
        e = ends(t)
        start = 0
        for end, wide in zip(e[:-1].tolist(), (np.diff(e, prepend=0)[:-1] >= least).tolist(), strict=True):
            if held:
                whole = pa.concat_tables([*held, t.slice(start, end - start)])
                held = []
                if len(whole) >= least:
                    yield whole
            elif wide:
                yield t.slice(start, end - start)
            start = end
        held.append(t.slice(start))
    if held and len(whole := pa.concat_tables(held)) >= least:
        yield whole
