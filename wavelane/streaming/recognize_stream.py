"""Recognition of clips that arrive in chunks, as a stateful stream; an extension, the batch plan is its measure."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.signal import merged, moments
from ..profile import Profile
from . import online

OUT = "clip long, seq long, text string, n_tokens long, final boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Recognizer(StatefulProcessor):
    """State of a clip in variables of their own: where the chunks are, detector, framer, decoder, the features' moments,
    and a list of feature blocks that only grows. A trigger reads and writes them once a clip and joins its chunks to
    blocks of ``Profile.block`` samples, so that the number of chunks costs next to nothing.

    The text of a finished clip needs the moments of all its features, so features are kept until then; they are scored
    block by block, and the state is dropped. Until then the text is provisional: under the moments so far."""

    def __init__(self, score, vocab: list[str], p: Profile, timeout_ms: int | None):
        self.score, self.vocab, self.p, self.timeout_ms = score, vocab, p, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "seq long, timer long")
        self.detector = handle.getValueState("detector", online.DETECTOR)
        self.framer = handle.getValueState("framer", online.FRAMER)
        self.decoder = handle.getValueState("decoder", online.DECODER)
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double")
        self.features = handle.getListState("features", "block binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, timer = self.place.get() if self.place.exists() else (-1, -1)
        out, latest = [], timer - self.timeout_ms if timer >= 0 else -1
        held, waiting, size = None, [], 0
        # A trigger's chunks of a clip; how many that are, its rate limit says.
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.reset:
                self._forget()
                seq, held, waiting, size = r.seq, None, [], 0
            elif r.seq > seq:  # else delivered again
                seq = r.seq
                latest = max(latest, int(r.ms))
                held = held or self._held()
                waiting.append(np.asarray(r.pcm if r.pcm is not None else [], float))
                size += len(waiting[-1])
                if r.is_end:
                    out.append((key[0], seq, *self._take(held, np.concatenate(waiting), True), True))
                    self._forget()
                    seq, held, waiting, size = -1, None, [], 0
                elif size >= self.p.block:
                    self._take(held, np.concatenate(waiting), False)
                    waiting, size = [], 0
        if held:
            out.append((key[0], seq, *self._take(held, np.concatenate([*waiting, np.zeros(0)]), False), False))
            self._keep(held)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = latest + self.timeout_ms if self.timeout_ms is not None and self.detector.exists() else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        if seq < 0:
            self.place.clear()
        else:
            self.place.update((seq, timer))
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The end mark is missing: the clip ends with what there is."""
        seq, _ = self.place.get()
        if self.detector.exists():
            text, n = self._take(self._held(), np.zeros(0), True)
            self._forget()
            self.place.clear()
            yield _rows([(key[0], seq, text, n, True)])
        else:
            yield _rows([])

    def _held(self) -> list:
        """Detector, framer, moments and decoder as the last trigger left them."""
        none = (online.QUIET, online.FRESH, (0, 0.0, 0.0), (self.p.blank_id, "", 0))
        return [v.get() if v.exists() else x for v, x in zip((self.detector, self.framer, self.moments, self.decoder), none, strict=True)]

    def _keep(self, held: list) -> None:
        for v, x in zip((self.detector, self.framer, self.moments, self.decoder), held, strict=True):
            v.update(x)

    def _take(self, held: list, samples: np.ndarray, ends: bool) -> tuple[str, int]:
        """The text after ``samples``, and its tokens; ``held`` goes on in place."""
        p = self.p
        held[0], speech = online.detect(held[0], samples, ends, p)
        held[1], rows = online.frame(held[1], speech, p)
        if len(rows):
            held[2] = merged(held[2], moments(rows))
            self.features.appendValue((rows.tobytes(),))
            if not ends:
                held[3] = online.decode(held[3], self._scores(rows, held[2]), self.vocab, p)
        text = held[3]
        if ends:
            text = (p.blank_id, "", 0)
            if held[2][0]:
                for (block,) in self.features.get():
                    text = online.decode(text, self._scores(np.frombuffer(block).reshape(-1, p.n_mels), held[2]), self.vocab, p)
        return text[1], text[2]

    def _scores(self, rows: np.ndarray, held: tuple) -> np.ndarray:
        n, mean, m2 = held
        return self.score((rows - mean) / (np.sqrt(m2 / n) + 1e-8))

    def _forget(self) -> None:
        for v in (self.detector, self.framer, self.decoder, self.moments, self.features):
            v.clear()

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["clip", "seq", "text", "n_tokens", "final"]).astype({"clip": "int64", "seq": "int64", "n_tokens": "int64", "final": "bool"})


def recognize_stream(chunks: DataFrame, score, vocab: list[str], p: Profile = Profile(), timeout: str | None = None) -> DataFrame:
    """Chunks of clips to text as it stands after each trigger: clip, seq, text, n_tokens, final. Append mode.

    ``chunks``: clip, seq (order of a clip's chunks, from 0; one delivered again before the end is passed over), pcm (an array of any length,
    null: none), is_end, and optionally ``reset`` (the clip's state is dropped and a new clip begins with the next chunk)
    and ``ts`` with a watermark. With an end mark the row is final and has the text of the batch plan for all samples
    since the start or the last reset; a clip that goes on has one provisional row a trigger, after its last chunk there. With ``timeout`` (like "30 seconds") a clip without chunks
    for so long, by event time, ends there. ``score`` maps features (a row a frame) to scores.

    Chunks of a clip come in order from trigger to trigger; within one they are sorted. Run it under :func:`state_store`."""
    wait = None
    if timeout is not None:
        wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    none: Column = F.lit(False)
    rows = chunks.select(
        F.col("clip").cast("long").alias("clip"), F.col("seq").cast("long").alias("seq"), F.col("pcm").cast("array<double>").alias("pcm"), F.coalesce("is_end", none).alias("is_end"),
        (F.coalesce("reset", none) if "reset" in chunks.columns else none).alias("reset"), *(["ts"] if wait is not None else []),
        (F.unix_millis("ts") if wait is not None else F.lit(-1).cast("long")).alias("ms"),
    )
    return rows.groupBy("clip").transformWithStateInPandas(Recognizer(score, vocab, p, wait), OUT, "Append", "None" if wait is None else "EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """State variables need the RocksDB provider; the setting is put back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now into Parquet files at ``path``, and gives them as a table."""
    spark = stream.sparkSession
    with state_store(spark):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def detector_states(spark: SparkSession, checkpoint: str, p: Profile = Profile(), batch: int | None = None) -> DataFrame:
    """What the detector of each clip knows after a trigger (the last one, or ``batch``), from the stream's state store:
    clip, state (silence, speech_start: set by the last frame, speech), position (samples in full frames), and the runs of
    speech in silence and of silence in speech that may turn the state."""
    reader = spark.read.format("statestore").option("stateVarName", "detector")
    if batch is not None:
        reader = reader.option("batchId", batch)
    v = F.col("value")
    state = F.when(v["latch"] == 0, "silence").when(v["started"], "speech_start").otherwise("speech")
    rows = reader.load(checkpoint)
    return rows.select(
        F.col("key")["clip"].alias("clip"), state.alias("state"), (v["frames"] * p.vad_frame).alias("position"),
        F.when((v["latch"] == 0) & (v["flag"] == 1), v["run"]).otherwise(F.lit(0)).cast("long").alias("consecutive_speech"),
        F.when((v["latch"] == 1) & (v["flag"] == 0), v["run"]).otherwise(F.lit(0)).cast("long").alias("consecutive_silence"),
    )
