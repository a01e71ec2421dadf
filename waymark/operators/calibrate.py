"""Calibration: a logistic baseline of match correctness on agreement features, with its reports."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.diagnostics import reliability

#: Rows that the check for dependent columns looks at.
RANK_ROWS = 5000


def independent(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that are no combination of earlier ones (and an intercept), by a QR of a bounded sample."""
    rows = np.array(df.select(*[F.col(c).cast("double") for c in columns]).limit(RANK_ROWS).collect(), float)
    kept: list[str] = []
    basis = [np.ones(len(rows)) / max(np.sqrt(len(rows)), 1)]
    for k, c in enumerate(columns):
        v = rows[:, k] if len(rows) else np.zeros(0)
        rest = v - sum((b @ v) * b for b in basis)
        if np.linalg.norm(rest) > 1e-8 * max(np.linalg.norm(v), 1):
            basis.append(rest / np.linalg.norm(rest))
            kept.append(c)
    return kept


def fit(df: DataFrame, columns: list[str], label: str) -> tuple[LogisticRegressionModel, list[str]]:
    """An unpenalised logistic regression; nulls count as 0 beside an ``_unavailable`` flag of their own."""
    flagged, names = with_flags(df, columns)
    names = independent(flagged, names)
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(flagged).withColumn("_y", F.col(label).cast("double"))
    return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0, maxIter=100).fit(data), names


def with_flags(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    return df.withColumns(flags).withColumns(values), [*columns, *flags]


def predict(model: LogisticRegressionModel, df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    flagged, _ = with_flags(df, columns)
    out = model.transform(VectorAssembler(inputCols=names, outputCol="_x").transform(flagged))
    return out.withColumn("p", F.element_at(vector_to_array("probability"), 2)).drop("_x", "probability", "rawPrediction", "prediction")


def report(df: DataFrame, p: str, y: str) -> DataFrame:
    """n, Brier score and log loss."""
    q, t = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p))), F.col(y).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - t, F.lit(2))).alias("brier"), F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"))


def policy(df: DataFrame, p: str, y: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: rows accepted, their share and how many are right."""
    steps = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    rows = df.select(steps, p, F.col(y).cast("double").alias("_y"))
    return rows.groupBy("threshold").agg(F.count_if(F.col(p) >= F.col("threshold")).alias("accepted"), F.avg((F.col(p) >= F.col("threshold")).cast("double")).alias("share"), F.avg(F.when(F.col(p) >= F.col("threshold"), F.col("_y"))).alias("precision"))


def leaks(train: DataFrame, test: DataFrame, keys: list[str]) -> int:
    """Rows of the test set whose keys the training set holds as well."""
    return test.join(train.select(*keys).distinct(), keys, "left_semi").count()


__all__ = ["fit", "independent", "leaks", "policy", "predict", "reliability", "report", "with_flags"]
