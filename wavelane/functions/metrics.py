"""Durations, real-time factor and status labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels by status code.
STATUS = {
    0: "Success", 1: "ACL init failed", 2: "ACL set device failed", 3: "ACL create context failed", 4: "OM model load failed",
    5: "Model execute failed", 6: "Host/Device memcpy failed", 7: "Invalid audio data", 8: "Audio preprocess failed", 9: "VAD failed",
    10: "CTC decode failed", 11: "Engine not initialized",
}

INVALID_AUDIO = 7


def duration_ms(n_samples: Column, rate: int = 16_000) -> Column:
    return n_samples * 1000.0 / rate


def real_time_factor(total_ms: Column, audio_ms: Column) -> Column:
    """total / audio; 0 without audio."""
    return F.coalesce(F.try_divide(total_ms, audio_ms), F.lit(0.0))


def error_label(code: Column) -> Column:
    out = F.lit("Unknown error")
    for k, v in STATUS.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out
