"""A training corpus from the documents table: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelane.llm import mixing, packing, pii, quality, queries, similarity
from wavelane.llm.common import fresh_path, table

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled rules keep."""
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("__row")
    judged = quality.judge(docs.select("doc_id", "text", "lang", row), table(spark, sf_dir, "labels"), keep=("text", "__row"))
    return judged.where("kept").select(*(c if c == "text" else f"__row.{c}" for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the first by doc_id; see :func:`similarity.one_of_each`."""
    return similarity.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data in every text."""
    out = pii.surrogates(docs, queries.PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    row = F.struct(*docs.columns).alias("__row")
    taken = mixing.mix(docs.select("doc_id", "source", "text", row), keep=("__row",)).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("__row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids. Workers keep fewer words, as the stages share their executors' memory."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=0, keep=100_000)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
