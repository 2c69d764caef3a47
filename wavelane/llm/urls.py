"""URL filter: host rules, then a logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark's own ML estimators only; nothing runs in Python workers."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path). A rule fits its host and all subdomains where the path starts with its own; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled URL table that the model learns from; its head says where the rows come from.
LABELLED = Path(__file__).parent / "url_labels.txt"


def labelled() -> list[tuple[str, float]]:
    """(url, 1 for unwanted and 0 for ordinary) of the labelled table."""
    rows = [line.split(maxsplit=1) for line in LABELLED.read_text(encoding="utf-8").splitlines() if line and not line.startswith("#")]
    return [(url, float(verdict == "block")) for verdict, url in rows]


def host_path(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased, other letters as they are) and path of a url; both empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """Name and verdict of the longest rule that fits; null if none does, or there are no rules."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")

    def fits(h: str, p: str) -> F.Column:
        return ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))

    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    pick = lambda of: reduce(lambda c, r: c.when(fits(r[1], r[2]), F.lit(of(r))), longest_first[1:], F.when(fits(*longest_first[0][1:]), F.lit(of(longest_first[0]))))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def grams(host, path, sizes: tuple[int, ...] = (3, 4, 5)) -> F.Column:
    """Character n-grams of host and path, marked apart."""

    def of(mark: str, text: F.Column) -> list[F.Column]:
        t = F.concat(F.lit("^"), text, F.lit("$"))
        # One pass a size: the look-ahead takes a gram, the match itself one character.
        return [F.transform(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), lambda g: F.concat(F.lit(mark), g)) for n in sizes]

    return F.concat(*of("h", host), *of("p", path))


def _features(rows: DataFrame, buckets: int) -> DataFrame:
    # The last label says nothing about a page, whose names stand before it.
    name = F.regexp_replace("host", r"\.[a-z]{2,}$", "")
    tf = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=buckets, binary=True)
    return tf.transform(rows.withColumn("__grams", grams(name, F.col("path")))).drop("__grams")


def train(spark: SparkSession, buckets: int = 1 << 14, reg: float = 0.01, ordinary: float = 2.0, rows: list[tuple[str, float]] | None = None) -> LogisticRegressionModel:
    """Fits the model on ``rows`` of (url, label); without them, on the labelled table (a fixed number of rows).

    An ordinary row weighs ``ordinary`` times an unwanted one: the table holds as many of either, a corpus does not, and a
    url that tells nothing is to be allowed."""
    host, path = host_path(F.col("url"))
    table = spark.createDataFrame(rows or labelled(), "url string, label double").coalesce(1).withColumn("host", host).withColumn("path", path)
    table = table.withColumn("weight", F.when(F.col("label") == 0, F.lit(ordinary)).otherwise(F.lit(1.0)))
    lr = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="weight", regParam=reg, maxIter=40, standardization=False)
    return lr.fit(_features(table, buckets).select("__features", "label", "weight"))


def cross_validate(spark: SparkSession, folds: int = 5, **settings) -> tuple[float, float, float]:
    """(precision, recall, accuracy) of the model on the labelled table, each url judged by a model that was trained
    without its fold; rows of either label are dealt to the folds in turn. ``settings`` as for :func:`train`."""
    by_label = [[r for r in labelled() if r[1] == y] for y in (0.0, 1.0)]
    dealt = [(k % folds, *r) for rows in by_label for k, r in enumerate(rows)]
    right = caught = blocked = 0
    for f in range(folds):
        model = train(spark, rows=[(u, y) for k, u, y in dealt if k != f], **settings)
        test = [(i, u, y) for i, (k, u, y) in enumerate(dealt) if k == f]
        got = judge(spark.createDataFrame([(i, u) for i, u, _ in test], "page_id long, url string"), model, rules=())
        says = {r["page_id"]: r["verdict"] == "block" for r in got.collect()}
        right += sum(says[i] == (y == 1) for i, _, y in test)
        caught += sum(says[i] for i, _, y in test if y == 1)
        blocked += sum(says.values())
    return caught / max(blocked, 1), caught / len(by_label[1]), right / len(dealt)


def judge(pages: DataFrame, model: LogisticRegressionModel | None = None, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict, score (of the model).

    A fitting rule decides; else the model blocks at ``threshold`` or above. A null url, or one without ``://``, has
    empty host and path and is judged by the model like any other. One map over the rows: no shuffle, no grouping,
    so frequent hosts cost nothing. Repeated rows: each judged. Empty table: no rows; other columns are ignored."""
    model = model or train(pages.sparkSession)
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    model.setFeaturesCol("__features").setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(_features(rows, model.numFeatures)).withColumn("score", vector_to_array("__p")[1])
    return scored.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
