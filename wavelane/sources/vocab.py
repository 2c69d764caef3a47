"""Vocabulary files: the line number is the token id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_vocab(files: DataFrame) -> DataFrame:
    """(token_id, token) from rows with the whole text of a file in ``value``. One trailing \\r of a line is dropped,
    blank lines stay, and what follows the last line break counts only if it isn't empty."""
    lines = F.split("value", "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return files.select(F.posexplode(lines).alias("token_id", "line")).select("token_id", F.regexp_replace("line", r"\r\z", "").alias("token"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return parse_vocab(spark.read.text(path, wholetext=True))
