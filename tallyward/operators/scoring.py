"""Scores, and the reads on the result log and the prediction records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def margin(weights: dict[str, float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for c, w in weights.items():
        z = z + F.lit(float(w)) * F.col(c).cast("double")
    return z


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float, threshold: float = 0.5) -> DataFrame:
    """Class and probability of a logistic model given as coefficients: a column expression."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(weights, intercept)))
    return df.withColumn("fraud_probability", p).withColumn(
        "predicted_class", (F.col("fraud_probability") > threshold).cast("int")
    )


def recent_results(results: DataFrame, k: int = 20, order: Sequence[str] = ("purchase_time", "transaction_id")) -> DataFrame:
    """The k newest results, oldest of them first."""
    return results.orderBy(*[F.col(c).desc() for c in order]).limit(k).orderBy(*order)


def latest_labels(labels: DataFrame) -> DataFrame:
    """One label per transaction: the last to arrive."""
    return labels.groupBy("transaction_id").agg(
        F.max_by(F.col("is_fraud").cast("int"), F.struct("arrival_time", "is_fraud")).alias("true_label")
    )


def join_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Prediction records with the label where one has arrived."""
    return predictions.drop("true_label").join(latest_labels(labels), "transaction_id", "left")


def result(predictions: DataFrame, labels: DataFrame | None, transaction_id) -> DataFrame:
    """The record of one transaction; no rows when there is none."""
    one = predictions.where(F.col("transaction_id") == F.lit(transaction_id))
    if labels is None:
        return one
    return join_labels(one, labels.where(F.col("transaction_id") == F.lit(transaction_id)))


def drop_duplicates(txns: DataFrame, keys: Sequence[str] = ("transaction_id",)) -> DataFrame:
    return txns.dropDuplicates(list(keys))
