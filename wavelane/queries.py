"""The speech operators over the given tables, each with the SQL that checks it.

Signals come from the tables: E = embeddings as audio per label, V = event values per user, L = embeddings as scores.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics
from .operators import beam, blocks, compare, decode, signal, vad
from .plans.recognize import METRICS, FilterScorer, LinearScorer, recognize, recognize_timed, stage_times, token_blocks
from .profile import Profile
from .shared import shared_path, written
from .sources.vocab import parse_vocab
from .sources.wav import parse_wav, read_wav, write_wav
from .sources.wav_blocks import read_wav_blocks
from .streaming.recognize_stream import detector_states, drained, recognize_stream

SHORT = Profile(vad_frame=4, calib_frames=5, start_frames=2, end_frames=3, factor=1.0)
GATED = Profile(vad_frame=64, calib_frames=5, start_frames=2, end_frames=3, factor=1.0)
FULL = Profile()
NARROW = Profile(block=1_280)
CHUNKS = 20_000  # of 150 samples, in a file of the stream
VOCAB = "<blank>\r\n<unk>\n<sos>\n<eos>\n" + "".join(f"w{i} \n" for i in range(4, 64))
TOKENS = VOCAB.replace("\r", "").split("\n")[:-1]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def audio(spark, sf):
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = read(spark, sf, "embeddings").select(F.col("label").alias("clip"), rank.alias("r"), "embedding").select("clip", "r", F.posexplode("embedding").alias("i", "e"))
    return rows.select("clip", (F.col("r") * 64 + F.col("i")).cast("long").alias("pos"), F.floor(F.col("e").cast("double") * 32767).cast("long").alias("sample"))


def audio_pieces(spark, sf):
    """:func:`audio` without single samples: each vector is a piece of its clip."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    pcm = F.transform("embedding", lambda e: F.floor(e.cast("double") * 32767).cast("long"))
    return read(spark, sf, "embeddings").select(F.col("label").alias("clip"), (rank * 64).cast("long").alias("at"), pcm.alias("pcm"))


def series(spark, sf):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf, "events").select(F.col("user_id").alias("clip"), pos.cast("long").alias("pos"), F.col("value").alias("sample"))


def logits(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("t"), F.col("embedding").alias("logits"))


def vocab(spark):
    return parse_vocab(spark.createDataFrame([(VOCAB,)], "value string"))


def tokens(spark, sf):
    return decode.argmax_tokens(logits(spark, sf))


def cut(df, *names, digits=6):
    """Rounds sums of doubles, whose order differs between engines; + 0.0 turns -0 into 0."""
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def _segments(spark, sf):
    return vad.segments(series(spark, sf), SHORT)


def _wav_files(spark, sf) -> str:
    """The folder of the clips as WAV files, written by the sink."""
    clips = audio(spark, sf).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("pos", "sample"))).alias("s"))
    path = shared_path(spark, "wav")
    write_wav(clips.select(F.col("clip").cast("string").alias("name"), F.lit(16_000).alias("sample_rate"), F.col("s.sample").cast("array<smallint>").alias("pcm")), path)
    return path


def _wav_blocks(spark, sf):
    """The files read in blocks of 500 samples, by tasks that each read 2,000 bytes of a file."""
    rows = read_wav_blocks(spark, _wav_files(spark, sf), 500, 2_000).where("error IS NULL").withColumn("clip", F.regexp_extract("path", r"([^/]*)\.wav\z", 1).cast("int"))
    each = rows.select("clip", "sample_rate", "block", F.posexplode("pcm").alias("i", "sample"))
    return each.select("clip", "sample_rate", (F.col("block") * 500 + F.col("i")).cast("long").alias("pos"), F.col("sample").cast("long").alias("sample"))


def _samples(files: DataFrame) -> DataFrame:
    rows = files.where("error IS NULL").withColumn("clip", F.regexp_extract("path", r"([^/]*)\.wav\z", 1).cast("int"))
    return rows.select("clip", "sample_rate", F.posexplode("pcm").alias("pos", "sample")).select("clip", "sample_rate", F.col("pos").cast("long").alias("pos"), F.col("sample").cast("long").alias("sample"))


def _wav(spark, sf):
    """Each clip written as a WAV file by the sink and read back by the source."""
    return _samples(read_wav(spark, _wav_files(spark, sf)))


def _integrity(spark, sf):
    rows = compare.compare(audio(spark, sf), _wav(spark, sf).select("clip", "pos", "sample"))
    return rows.agg(F.sum("n_samples").alias("n_samples"), F.sum("lost").alias("lost"), (F.sum("lost") == 0).alias("intact"))


def _damage(spark, sf):
    """Files of which two thirds are damaged on the way: a sample raised by 1, or the last seven cut off."""
    good = audio(spark, sf).groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sample"))), lambda x: x["sample"].cast("smallint")).alias("pcm"))
    raised = F.transform("pcm", lambda x, i: F.when(i == 100 + F.col("clip"), (x + 1).cast("smallint")).otherwise(x))
    bad = F.when(F.col("clip") % 3 == 1, raised).when(F.col("clip") % 3 == 2, F.slice("pcm", 1, F.size("pcm") - 7)).otherwise(F.col("pcm"))
    path = shared_path(spark, "wav")
    write_wav(good.select(F.col("clip").cast("string").alias("name"), F.lit(16_000).alias("sample_rate"), bad.alias("pcm")), path)
    return compare.compare(audio(spark, sf), _samples(read_wav(spark, path)).drop("sample_rate"), 512)


def _vocabulary(spark, sf):
    """How large the vocabulary is, and how it covers each clip's scores: best tokens that it lacks, and that are special."""
    known = F.broadcast(vocab(spark)).withColumn("known", F.lit(1))
    best = tokens(spark, sf).join(known, "token_id", "left").withColumn("size", F.lit(len(TOKENS)).cast("long"))
    return best.groupBy("clip").agg(F.max("size").alias("n_tokens"), F.count("*").alias("n_steps"), (F.count("*") - F.count("known")).alias("n_unknown"), F.count_if(F.col("token").isin(*decode.SPECIAL)).alias("n_special"))


def _windowed(spark, sf):
    """The window's weights, and what they make of the frames' samples at each place: how many, and their mean square."""
    at = signal.frames(audio_pieces(spark, sf)).groupBy("i").agg(F.count("*").alias("n"), F.avg(F.col("v") * F.col("v")).alias("power"))
    return cut(at.join(signal.hamming_table(spark), "i").select("i", "w", "n", "power"), "w", "power", digits=9)


def _filtered(spark, sf):
    """The filters' weights, and how much each passes of the mean spectrum of all frames."""
    mean = signal.dft_magnitude(audio_pieces(spark, sf)).select(F.posexplode("mag").alias("bin", "m")).groupBy("bin").agg(F.avg("m").alias("m"))
    return cut(signal.mel_filterbank(spark).join(mean, "bin").select("mel", "bin", "w", (F.col("w") * F.col("m")).alias("passed")), "w", "passed", digits=7)


def _statuses(spark, sf):
    """Files of the clips, of which some are cut off within their head or say that they are stereo; each one's status."""
    clips = audio_pieces(spark, sf).where("at = 0").select("clip", F.slice("pcm", 1, 20).cast("array<smallint>").alias("pcm")).withColumn("name", F.col("clip").cast("string"))
    path = shared_path(spark, "wav")
    write_wav(clips.select("name", F.lit(16_000).alias("sample_rate"), "pcm"), path)
    whole = F.col("content")
    clip = F.regexp_extract("path", r"([^/]*)\.wav\z", 1).cast("int")
    stereo = F.concat(F.substring(whole, 1, 22), F.unhex(F.lit("0200")), F.expr("substring(content, 25)"))
    damaged = F.when(clip % 3 == 1, F.substring(whole, 1, 30)).when(clip % 3 == 2, stereo).otherwise(whole)
    files = parse_wav(spark.read.format("binaryFile").load(path).select("path", damaged.alias("content")))
    code = F.when(F.col("error").isNull(), F.lit(0)).otherwise(F.lit(metrics.INVALID_AUDIO)).cast("long")
    return files.select(clip.alias("clip"), code.alias("code"), metrics.error_label(code).alias("label"), F.coalesce(F.size("pcm"), F.lit(0)).alias("n"))


def _rates(spark, sf):
    """Each event as a request that took so many milliseconds for a frame of audio: each user's audio, time and rate."""
    sums = read(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(metrics.duration_ms(F.count("*") * FULL.vad_frame).alias("audio_ms"), F.sum(F.abs("value")).alias("total_ms"))
    rates = sums.withColumn("rtf", metrics.real_time_factor(F.col("total_ms"), F.col("audio_ms")))
    return cut(cut(rates, "total_ms"), "rtf", digits=9)


def _by_mode(spark, sf):
    """Segments under each mode's factor, over energies that are worked out once."""
    measured, out = vad.energies(series(spark, sf), SHORT), None
    for mode in range(4):
        p = replace(SHORT, factor=None, mode=mode)
        found = vad.segments_of(vad.flagged(measured, p), p).drop("before").withColumn("mode", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


def _joined(spark, sf):
    size = blocks.block_size(SHORT)
    return blocks.as_samples(blocks.as_blocks(vad.segment_concat(series(spark, sf), _segments(spark, sf), SHORT), size), size)


def _chunks(spark, sf, ended: bool = True):
    """The audio as a stream of chunks of 150 samples, over three spans of time or more: (stream, folder for its state)."""
    chunks = written(blocks.as_blocks(audio_pieces(spark, sf), 150).withColumnRenamed("block", "seq"), "chunks")
    last = chunks.groupBy("clip").agg(F.max("seq").alias("last"))
    chunks = chunks.join(last, "clip").withColumn("is_end", F.lit(ended) & (F.col("seq") == F.col("last")))
    source = shared_path(spark, "stream")
    for part in range(3):  # files are read in order of time, four a trigger; a task writes its own in order of seq
        span = chunks.where(F.floor(3 * F.col("seq") / (F.col("last") + 1)) == part).drop("last")
        span.repartition(4, "clip").sortWithinPartitions("seq").write.option("maxRecordsPerFile", CHUNKS).mode("append").parquet(source)
    return spark.readStream.schema(chunks.drop("last").schema).option("maxFilesPerTrigger", 4).parquet(source), shared_path(spark, "state")


def _recognize_stream(spark, sf):
    """The text of each clip at its end mark."""
    stream, state = _chunks(spark, sf)
    rows = drained(recognize_stream(stream, LinearScorer(WEIGHTS).of, TOKENS, GATED), shared_path(spark, "texts"), state)
    return rows.where("final").select(F.col("clip").cast("int").alias("clip"), "text", "n_tokens")


def _stream_state(spark, sf):
    """The detectors' states after all chunks, without an end mark."""
    stream, state = _chunks(spark, sf, ended=False)
    drained(recognize_stream(stream, LinearScorer(WEIGHTS).of, TOKENS, GATED), shared_path(spark, "texts"), state)
    return detector_states(spark, state, GATED).withColumn("clip", F.col("clip").cast("int"))


def _context_tokens(spark, sf):
    """The best token of each frame by a scorer that looks two frames to either side; small blocks, so that it looks over their borders."""
    tokens = token_blocks(signal.fbank_blocks(audio_pieces(spark, sf), NARROW), FilterScorer(TAPS, WEIGHTS), NARROW)
    per_block = blocks.block_size(NARROW) // NARROW.hop
    return tokens.select("clip", "block", F.posexplode("tokens").alias("i", "token_id")).select("clip", (F.col("block") * per_block + F.col("i")).cast("long").alias("t"), "token_id")


def _clip_metrics(spark, sf):
    """The seven measures of each clip, as far as they don't hang on the clock: its length, and that the others fit together."""
    rows = recognize_timed(audio_pieces(spark, sf), LinearScorer(WEIGHTS), F.broadcast(vocab(spark)), GATED)
    parts = F.col("vad_ms") + F.col("preprocess_ms") + F.col("infer_ms") + F.col("decode_ms")
    every = F.array(*METRICS)
    return rows.select("clip", "audio_ms", (F.size(F.filter(every, lambda x: x >= 0)) == len(METRICS)).alias("whole"), (F.abs(F.col("total_ms") - parts) < 1e-9).alias("total_is_sum"), (F.abs(F.col("rtf") - F.col("total_ms") / F.col("audio_ms")) < 1e-12).alias("rtf_is_rate"))


TAPS = [1.0, 2.0, 3.0, 2.0, 1.0]
WEIGHTS = np.array([[((m * 7 + v * 13) % 17 - 8) / 8.0 for v in range(64)] for m in range(80)])


def queries() -> dict:
    long = lambda df, name, i: df.select("clip", "frame_idx", F.posexplode(name).alias(i, "v"))
    return {
        "argmax_tokens": tokens,
        "ctc_collapse": lambda s, d: decode.ctc_collapse(tokens(s, d)),
        "vocab_lookup": lambda s, d: decode.vocab_lookup(tokens(s, d), F.broadcast(vocab(s))),
        "ctc_greedy": lambda s, d: decode.decode(logits(s, d), F.broadcast(vocab(s))),
        "vocab_size": _vocabulary,
        "ctc_beam": lambda s, d: decode.decode(logits(s, d), F.broadcast(vocab(s)), beam_size=4),
        "token_topk": lambda s, d: decode.token_topk(logits(s, d)),
        "pcm_scale": lambda s, d: signal.pcm_scale(audio(s, d)),
        "pre_emphasis": lambda s, d: signal.pre_emphasis(audio(s, d)),
        "frame_count": lambda s, d: signal.frame_count(audio(s, d)),
        "frame_window": lambda s, d: cut(signal.frames(audio_pieces(s, d)), "v", digits=9),
        "hamming_table": _windowed,
        "vad_energy": lambda s, d: cut(vad.energy(series(s, d), SHORT), "energy"),
        "noise_floor": lambda s, d: cut(vad.noise_floor(series(s, d), SHORT), "noise_floor"),
        "vad_flags": lambda s, d: vad.flags(series(s, d), SHORT).select("clip", "frame_idx", "speech"),
        "vad_runs": lambda s, d: vad.runs(vad.flagged(vad.energies(series(s, d), SHORT), SHORT), SHORT),
        "vad_segments": lambda s, d: _segments(s, d).drop("before"),
        "segment_slice": lambda s, d: vad.segment_slice(series(s, d), _segments(s, d), SHORT),
        "segment_concat": _joined,
        "dft_magnitude": lambda s, d: cut(long(signal.dft_magnitude(audio_pieces(s, d)), "mag", "k"), "v", digits=8),
        "mel_filterbank": _filtered,
        "mel_log": lambda s, d: cut(long(signal.mel_log(audio_pieces(s, d)), "fbank", "mel"), "v"),
        "fbank_cmvn": lambda s, d: cut(long(signal.fbank(audio_pieces(s, d)), "fbank", "mel"), "v"),
        "clip_duration": lambda s, d: signal.frame_count(audio(s, d)).select("clip", metrics.duration_ms(F.col("n_samples")).alias("audio_ms")),
        "rtf_metrics": _rates,
        "error_label": _statuses,
        "segment_counts": lambda s, d: vad.segment_counts(series(s, d), _segments(s, d)),
        "wav_roundtrip": _wav,
        "wav_blocks": _wav_blocks,
        "integrity_check": _integrity,
        "damage_report": _damage,
        "beam_list": lambda s, d: cut(beam.hypotheses(logits(s, d), F.broadcast(vocab(s)), 4), "score"),
        "recognize": lambda s, d: recognize(audio_pieces(s, d), LinearScorer(WEIGHTS), F.broadcast(vocab(s)), FULL, gate=False),
        "recognize_gated": lambda s, d: recognize(audio_pieces(s, d), LinearScorer(WEIGHTS), F.broadcast(vocab(s)), GATED),
        "stage_times": lambda s, d: stage_times(audio_pieces(s, d), LinearScorer(WEIGHTS), F.broadcast(vocab(s)), GATED),
        "recognize_stream": _recognize_stream,
        "stream_state": _stream_state,
        "context_tokens": _context_tokens,
        "clip_metrics": _clip_metrics,
        "vad_modes": _by_mode,
        "vad_session": lambda s, d: vad.flags(series(s, d), SHORT, scope="session").select("clip", "frame_idx", "speech"),
    }


_AUDIO = """e0 AS (SELECT label AS clip, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
audio AS (SELECT clip, CAST(r * 64 + i - 1 AS BIGINT) AS pos, CAST(floor(CAST(embedding[i] AS DOUBLE) * 32767) AS BIGINT) AS sample
  FROM e0, (SELECT unnest(range(1, 65)) AS i))"""
_EMPH = _AUDIO + """,
emph AS (SELECT clip, pos, sample / 32768.0::DOUBLE - 0.97::DOUBLE * coalesce(lag(sample / 32768.0::DOUBLE) OVER (PARTITION BY clip ORDER BY pos), 0::DOUBLE) AS y FROM audio),
sizes AS (SELECT clip, count(*) AS n_samples, CASE WHEN count(*) < 400 THEN 0 ELSE (count(*) - 400) // 160 + 1 END AS n_frames FROM audio GROUP BY clip)"""
_FRAMES = _EMPH + """,
starts AS (SELECT clip, unnest(range(0, n_frames)) AS frame_idx FROM sizes),
frames AS (SELECT s.clip, s.frame_idx, CAST(e.pos - s.frame_idx * 160 AS INTEGER) AS i,
    e.y * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * (e.pos - s.frame_idx * 160) / 399)) AS v
  FROM starts s JOIN emph e ON e.clip = s.clip AND e.pos >= s.frame_idx * 160 AND e.pos < s.frame_idx * 160 + 400)"""
_DFT = _FRAMES + """,
basis AS (SELECT k, n, cos(2 * pi() * ((k * n) % 512) / 512) AS c, sin(2 * pi() * ((k * n) % 512) / 512) AS s
  FROM (SELECT unnest(range(0, 257)) AS k), (SELECT unnest(range(0, 400)) AS n)),
dft AS (SELECT clip, frame_idx, k, sqrt(pow(sum(v * c), 2) + pow(sum(v * s), 2)) / 512 AS mag
  FROM frames JOIN basis ON basis.n = frames.i GROUP BY clip, frame_idx, k)"""
_MEL = """pts AS (SELECT i, least(256, CAST(floor(513 * (700 * (pow(10, (2595 * log10(1 + 8000 / 700.0::DOUBLE)) * i / 81 / 2595) - 1)) / 16000) AS INTEGER)) AS b
  FROM (SELECT unnest(range(0, 82)) AS i)),
tri AS (SELECT l.i AS mel, l.b AS lo, m.b AS mid, h.b AS hi FROM pts l JOIN pts m ON m.i = l.i + 1 JOIN pts h ON h.i = l.i + 2),
bank AS (SELECT mel, bin, CASE WHEN bin < mid THEN (bin - lo)::DOUBLE / (mid - lo) ELSE (hi - bin)::DOUBLE / (hi - mid) END AS w
  FROM tri, (SELECT unnest(range(0, 257)) AS bin) WHERE bin > lo AND bin < mid OR bin >= mid AND bin < hi)"""
_FBANK = _DFT + ",\n" + _MEL + """,
pairs AS (SELECT clip, frame_idx, mel, sum(mag * w) AS s FROM dft JOIN bank ON bank.bin = dft.k GROUP BY clip, frame_idx, mel),
fb AS (SELECT s.clip, s.frame_idx, m.mel, ln(greatest(coalesce(p.s, 0), 1e-10::DOUBLE)) AS v
  FROM starts s CROSS JOIN (SELECT unnest(range(0, 80)) AS mel) m LEFT JOIN pairs p ON p.clip = s.clip AND p.frame_idx = s.frame_idx AND p.mel = m.mel),
cm AS (SELECT clip, frame_idx, mel, (v - avg(v) OVER (PARTITION BY clip)) / (stddev_pop(v) OVER (PARTITION BY clip) + 1e-8::DOUBLE) AS v FROM fb)"""
_SERIES = "ser AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS sample FROM events)"


def _flags(w: int = 4, factor: float = 1.0) -> str:
    """Of a series ``ser`` to its segments, with frames of ``w`` samples."""
    return f"""
en AS (SELECT clip, pos // {w} AS frame_idx, avg(sample * sample) AS energy FROM ser GROUP BY clip, pos // {w} HAVING count(*) = {w}),
fl AS (SELECT clip, avg(energy) AS f, count(*) AS n FROM en WHERE frame_idx < 5 GROUP BY clip),
sp AS (SELECT en.clip, frame_idx, frame_idx >= 5 AND n >= 5 AND energy > {factor} * f AS speech FROM en JOIN fl ON fl.clip = en.clip),
isl AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) - row_number() OVER (PARTITION BY clip, speech ORDER BY frame_idx) AS g FROM sp),
rn AS (SELECT clip, frame_idx, speech, row_number() OVER (PARTITION BY clip, speech, g ORDER BY frame_idx) AS run FROM isl),
la AS (SELECT clip, frame_idx, coalesce(last_value(CASE WHEN speech AND run >= 2 THEN 1 WHEN NOT speech AND run >= 3 THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY clip ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS state FROM rn),
ed AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY clip ORDER BY frame_idx), 0) AS before FROM la),
chg AS (SELECT *, lead((frame_idx + 1 - 3) * {w}) OVER (PARTITION BY clip ORDER BY frame_idx) AS stop FROM ed WHERE state <> before),
seg AS (SELECT c.clip, CAST(row_number() OVER (PARTITION BY c.clip ORDER BY frame_idx) - 1 AS INTEGER) AS seg_id,
    CAST((frame_idx + 1 - 2) * {w} AS BIGINT) AS start_sample, CAST(coalesce(stop, t.total) AS BIGINT) AS end_sample
  FROM chg c JOIN (SELECT clip, count(*) AS total FROM ser GROUP BY clip) t ON t.clip = c.clip
  WHERE state = 1 AND coalesce(stop, t.total) > (frame_idx + 1 - 2) * {w})"""


_FLAGS = _SERIES + "," + _flags()
_GATED = _AUDIO.replace("audio AS (", "ser AS (") + "," + _flags(64) + """,
audio AS (SELECT s.clip, row_number() OVER (PARTITION BY s.clip ORDER BY pos) - 1 AS pos, sample FROM ser s JOIN seg ON seg.clip = s.clip AND pos >= start_sample AND pos < end_sample)"""
_TOKENS = """am AS (SELECT label AS clip, vec_id AS t, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS token_id FROM embeddings),
col AS (SELECT clip, t, token_id FROM (SELECT *, coalesce(lag(token_id) OVER (PARTITION BY clip ORDER BY t), 0) AS b FROM am) WHERE token_id <> 0 AND token_id <> b),
voc AS (SELECT CAST(i AS INTEGER) AS token_id, CASE i WHEN 0 THEN '<blank>' WHEN 1 THEN '<unk>' WHEN 2 THEN '<sos>' WHEN 3 THEN '<eos>' ELSE 'w' || i || ' ' END AS token FROM (SELECT unnest(range(0, 64)) AS i))"""


def _text(source: str) -> str:
    return f"""SELECT c.clip, coalesce(string_agg(v.token, '' ORDER BY x.t), '') AS text, count(v.token) AS n_tokens
FROM (SELECT DISTINCT label AS clip FROM embeddings) c LEFT JOIN (SELECT * FROM {source} WHERE token_id > 3) x ON x.clip = c.clip
LEFT JOIN voc v ON v.token_id = x.token_id GROUP BY c.clip"""


def _recognized(features: str) -> str:
    return f"""WITH {features}, {_TOKENS},
lin AS (SELECT clip, frame_idx AS t, v.v AS token_id, round(sum(cm.v * (((mel * 7 + v.v * 13) % 17 - 8) / 8.0::DOUBLE)), 6) AS x FROM cm, (SELECT unnest(range(0, 64)) AS v) v GROUP BY ALL),
bst AS (SELECT clip, t, CAST(arg_max(token_id, (x, -token_id)) AS INTEGER) AS token_id FROM lin GROUP BY clip, t),
cl2 AS (SELECT clip, t, token_id FROM (SELECT *, coalesce(lag(token_id) OVER (PARTITION BY clip ORDER BY t), 0) AS b FROM bst) WHERE token_id <> 0 AND token_id <> b)
{_text('cl2')}"""


#: The labels as the check expects them, written out by hand.
_LABELS = """(0, 'Success'), (1, 'ACL init failed'), (2, 'ACL set device failed'), (3, 'ACL create context failed'), (4, 'OM model load failed'),
(5, 'Model execute failed'), (6, 'Host/Device memcpy failed'), (7, 'Invalid audio data'), (8, 'Audio preprocess failed'), (9, 'VAD failed'),
(10, 'CTC decode failed'), (11, 'Engine not initialized'), (12, 'Unknown error')"""


def oracle_sql() -> dict[str, str]:
    return {
        "argmax_tokens": f"WITH {_TOKENS} SELECT clip, t, token_id FROM am",
        "ctc_collapse": f"WITH {_TOKENS} SELECT clip, t, token_id FROM col",
        "vocab_lookup": f"WITH {_TOKENS} SELECT clip, t, token FROM am JOIN voc USING (token_id) WHERE token_id > 3",
        "ctc_greedy": f"WITH {_TOKENS} {_text('col')}",
        "vocab_size": f"""WITH {_TOKENS} SELECT clip, (SELECT count(*) FROM voc) AS n_tokens, count(*) AS n_steps, count(*) - count(voc.token_id) AS n_unknown, count(*) FILTER (am.token_id < 4) AS n_special
FROM am LEFT JOIN voc ON voc.token_id = am.token_id GROUP BY clip""",
        "ctc_beam": f"WITH {_TOKENS} {_text('am')}",
        "token_topk": """SELECT clip, t, CAST(rank AS INTEGER) AS rank, token_id FROM (
  SELECT label AS clip, vec_id AS t, CAST(i - 1 AS INTEGER) AS token_id, row_number() OVER (PARTITION BY label, vec_id ORDER BY embedding[i] DESC, i) AS rank
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) WHERE rank <= 3""",
        "pcm_scale": f"WITH {_AUDIO} SELECT clip, pos, sample / 32768.0::DOUBLE AS x FROM audio",
        "pre_emphasis": f"WITH {_EMPH} SELECT clip, pos, y FROM emph",
        "frame_count": f"WITH {_EMPH} SELECT clip, n_samples, CAST(n_frames AS BIGINT) AS n_frames FROM sizes",
        "frame_window": f"WITH {_FRAMES} SELECT clip, CAST(frame_idx AS BIGINT) AS frame_idx, i, round(v, 9) + 0.0::DOUBLE AS v FROM frames",
        "hamming_table": f"WITH {_FRAMES} SELECT i, round(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 399), 9) AS w, count(*) AS n, round(avg(v * v), 9) AS power FROM frames GROUP BY i",
        "vad_energy": f"WITH {_FLAGS} SELECT clip, frame_idx, round(energy, 6) AS energy FROM en",
        "noise_floor": f"WITH {_FLAGS} SELECT clip, CASE WHEN n >= 5 THEN round(f, 6) END AS noise_floor FROM fl",
        "vad_flags": f"WITH {_FLAGS} SELECT clip, frame_idx, speech FROM sp",
        "vad_runs": f"WITH {_FLAGS} SELECT clip, frame_idx, speech, run FROM rn",
        "vad_segments": f"WITH {_FLAGS} SELECT clip, seg_id, start_sample, end_sample FROM seg",
        "segment_slice": f"WITH {_FLAGS} SELECT s.clip, seg_id, pos, sample FROM ser s JOIN seg ON seg.clip = s.clip AND pos >= start_sample AND pos < end_sample",
        "segment_concat": f"WITH {_FLAGS} SELECT s.clip, row_number() OVER (PARTITION BY s.clip ORDER BY pos) - 1 AS pos, sample FROM ser s JOIN seg ON seg.clip = s.clip AND pos >= start_sample AND pos < end_sample",
        "dft_magnitude": f"WITH {_DFT} SELECT clip, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(k AS INTEGER) AS k, round(mag, 8) + 0.0::DOUBLE AS v FROM dft",
        "mel_filterbank": f"WITH {_DFT}, {_MEL}, mn AS (SELECT k, avg(mag) AS m FROM dft GROUP BY k) SELECT CAST(mel AS INTEGER) AS mel, CAST(bin AS INTEGER) AS bin, round(w, 7) AS w, round(w * m, 7) AS passed FROM bank JOIN mn ON mn.k = bank.bin",
        "mel_log": f"WITH {_FBANK} SELECT clip, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(mel AS INTEGER) AS mel, round(v, 6) + 0.0::DOUBLE AS v FROM fb",
        "fbank_cmvn": f"WITH {_FBANK} SELECT clip, CAST(frame_idx AS BIGINT) AS frame_idx, CAST(mel AS INTEGER) AS mel, round(v, 6) + 0.0::DOUBLE AS v FROM cm",
        "clip_duration": f"WITH {_EMPH} SELECT clip, n_samples * 1000.0::DOUBLE / 16000 AS audio_ms FROM sizes",
        "rtf_metrics": """SELECT user_id AS clip, count(*) * 320 * 1000.0::DOUBLE / 16000 AS audio_ms, round(sum(abs(value)), 6) AS total_ms, round(sum(abs(value)) / (count(*) * 320 * 1000.0::DOUBLE / 16000), 9) AS rtf
FROM events GROUP BY user_id""",
        "error_label": f"""SELECT clip, CAST(x.code AS BIGINT) AS code, label, CAST(CASE WHEN x.code = 0 THEN 20 ELSE 0 END AS INTEGER) AS n
FROM (SELECT DISTINCT label AS clip, CASE WHEN label % 3 = 0 THEN 0 ELSE 7 END AS c FROM embeddings) JOIN (VALUES {_LABELS}) x(code, label) ON code = c""",
        "segment_counts": f"WITH {_FLAGS} SELECT c.clip, count(seg.seg_id) AS n_segments FROM (SELECT DISTINCT user_id AS clip FROM events) c LEFT JOIN seg ON seg.clip = c.clip GROUP BY c.clip",
        "wav_roundtrip": f"WITH {_AUDIO} SELECT clip, CAST(16000 AS INTEGER) AS sample_rate, pos, sample FROM audio",
        "wav_blocks": f"WITH {_AUDIO} SELECT clip, CAST(16000 AS INTEGER) AS sample_rate, pos, sample FROM audio",
        "integrity_check": f"WITH {_AUDIO} SELECT count(*) AS n_samples, CAST(0 AS BIGINT) AS lost, true AS intact FROM audio",
        "damage_report": f"""WITH {_AUDIO}, sz AS (SELECT clip, count(*) AS n FROM audio GROUP BY clip),
got AS (SELECT a.*, n, CASE WHEN clip % 3 = 1 AND pos = 100 + clip THEN sample + 1 WHEN clip % 3 <> 2 OR pos < n - 7 THEN sample END AS received FROM audio a JOIN sz USING (clip)),
odd AS (SELECT clip, count(*) AS lost, min(pos) AS first_pos, arg_min(sample, pos) AS sent, arg_min([received], pos)[1] AS received FROM got WHERE received IS DISTINCT FROM sample GROUP BY clip)
SELECT g.clip, n_samples, coalesce(lost, 0) AS lost, first_pos, sent, received
FROM (SELECT clip, count(received) AS n_samples FROM got GROUP BY clip) g LEFT JOIN odd ON odd.clip = g.clip""",
        "beam_list": f"""WITH {_TOKENS},
sc AS (SELECT label AS clip, vec_id AS t, CAST(i - 1 AS INTEGER) AS token_id, CAST(embedding[i] AS DOUBLE) AS x, row_number() OVER (PARTITION BY label, vec_id ORDER BY embedding[i] DESC, i) AS r FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
b AS (SELECT clip, t, token_id, x FROM sc WHERE r = 1),
-- Of the four best, none has a change beyond the three that lose least: these three alone and no change are as good.
dv AS (SELECT sc.clip, sc.t, sc.token_id, sc.x - b.x AS loss FROM sc JOIN b ON b.clip = sc.clip AND b.t = sc.t WHERE r BETWEEN 2 AND 4),
ch AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY loss DESC) AS n FROM dv),
su AS (SELECT clip, m, sum(loss) AS loss FROM ch, (SELECT unnest(range(1, 8)) AS m) WHERE n <= 3 AND (m >> (n - 1)) & 1 = 1 GROUP BY clip, m HAVING count(DISTINCT t) = count(*) UNION ALL SELECT DISTINCT clip, 0, 0 FROM b),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip ORDER BY loss DESC) AS INTEGER) AS rank FROM su),
st AS (SELECT b.clip, rank, m, b.t, b.x, rk.loss, coalesce(ch.token_id, b.token_id) AS token_id FROM b JOIN rk ON rk.clip = b.clip AND rank <= 4 LEFT JOIN ch ON ch.clip = b.clip AND ch.t = b.t AND ch.n <= 3 AND (m >> (ch.n - 1)) & 1 = 1)
SELECT clip, rank, round(sum(x) + any_value(loss), 6) + 0.0::DOUBLE AS score, coalesce(string_agg(CASE WHEN st.token_id > 3 THEN token END, '' ORDER BY t), '') AS text, count(CASE WHEN st.token_id > 3 THEN token END) AS n_tokens
FROM st LEFT JOIN voc ON voc.token_id = st.token_id GROUP BY clip, rank""",
        "recognize": _recognized(_FBANK),
        "recognize_gated": _recognized(_FBANK.replace(_AUDIO, _GATED)),
        "recognize_stream": _recognized(_FBANK.replace(_AUDIO, _GATED)),
        "context_tokens": f"""WITH {_FBANK},
smo AS (SELECT a.clip, a.frame_idx, a.mel, sum(b.v * (3 - abs(b.frame_idx - a.frame_idx))) AS v FROM cm a JOIN cm b ON b.clip = a.clip AND b.mel = a.mel AND abs(b.frame_idx - a.frame_idx) <= 2 GROUP BY ALL),
lin AS (SELECT clip, frame_idx AS t, v.v AS token_id, round(sum(smo.v * (((mel * 7 + v.v * 13) % 17 - 8) / 8.0::DOUBLE)), 6) AS x FROM smo, (SELECT unnest(range(0, 64)) AS v) v GROUP BY ALL)
SELECT clip, CAST(t AS BIGINT) AS t, CAST(arg_max(token_id, (x, -token_id)) AS INTEGER) AS token_id FROM lin GROUP BY clip, t""",
        "clip_metrics": f"WITH {_EMPH} SELECT clip, n_samples * 1000.0::DOUBLE / 16000 AS audio_ms, true AS whole, true AS total_is_sum, true AS rtf_is_rate FROM sizes",
        "stream_state": f"""WITH {_AUDIO.replace("audio AS (", "ser AS (")},{_flags(64)},
lst AS (SELECT clip, max(frame_idx) AS frame_idx FROM la GROUP BY clip)
SELECT clip, CASE WHEN state = 0 THEN 'silence' WHEN before = 0 THEN 'speech_start' ELSE 'speech' END AS state, CAST((frame_idx + 1) * 64 AS BIGINT) AS position,
  CASE WHEN state = 0 AND speech THEN run ELSE 0 END AS consecutive_speech, CASE WHEN state = 1 AND NOT speech THEN run ELSE 0 END AS consecutive_silence
FROM lst JOIN ed USING (clip, frame_idx) JOIN rn USING (clip, frame_idx)""",
        "vad_modes": f"WITH {_SERIES}" + "".join(f", m{m} AS (WITH {_flags(4, x).lstrip()} SELECT *, CAST({m} AS INTEGER) AS mode FROM seg)" for m, x in enumerate((4.0, 2.0, 4.0, 8.0))) + " SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3",
        "vad_session": f"""WITH {_FLAGS}, hd AS (SELECT clip, frame_idx, energy FROM en ORDER BY clip, frame_idx LIMIT 5)
SELECT en.clip, en.frame_idx, hd.clip IS NULL AND (SELECT count(*) FROM hd) >= 5 AND en.energy > 1.0 * (SELECT avg(energy) FROM hd) AS speech
FROM en LEFT JOIN hd ON hd.clip = en.clip AND hd.frame_idx = en.frame_idx""",
    }
