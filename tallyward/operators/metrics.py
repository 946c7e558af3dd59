"""Quality of predictions: report, confusion matrix, area measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import ratio
from tallyward.plans.slices import Over, running
from tallyward.session import settle

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Hits, rows and predictions of each class, from the table of (label, prediction) counts."""
    counts = df.groupBy(F.col(label).cast("int").alias("t"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("long")
    as_label = F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("hit"), F.col("n").alias("support"), zero.alias("predicted"))
    as_guess = F.struct(F.col("p").alias("c"), zero.alias("hit"), zero.alias("support"), F.col("n").alias("predicted"))
    return (
        counts.select(F.inline(F.array(as_label, as_guess)))
        .groupBy("c")
        .agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
        .withColumns({"precision": _or_zero("hit", "predicted"), "recall": _or_zero("hit", "support")})
        .withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    )


def _or_zero(top: str, bottom: str):
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def classification_report(df: DataFrame, label: str = "is_fraud", prediction: str = "predicted_class") -> DataFrame:
    """Precision, recall, f1 and support per class, with accuracy, macro and weighted rows.

    A measure whose denominator is empty is 0. The accuracy row has its value in ``f1``.
    """
    per = settle(_per_class(df, label, prediction))  # a row per class, read four times below
    shown = ["precision", "recall", "f1"]
    none = F.lit(None).cast("double")
    total = F.sum("support")
    rows = [
        per.select(F.col("c").cast("string").alias("label"), *shown, "support"),
        per.agg(ratio(F.sum("hit"), total).alias("f1"), total.alias("support")).select(
            F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"), "f1", "support"
        ),
        per.agg(*[F.avg(m).alias(m) for m in shown], total.alias("support")).select(F.lit("macro avg").alias("label"), *shown, "support"),
        per.agg(*[ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in shown], total.alias("support")).select(
            F.lit("weighted avg").alias("label"), *shown, "support"
        ),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def confusion_matrix(df: DataFrame, label: str = "is_fraud", prediction: str = "predicted_class") -> DataFrame:
    """One row per true class, one column per predicted class (0 and 1)."""
    return df.groupBy(F.col(label).cast("int").alias("true_class")).agg(
        *[F.count(F.when(F.col(prediction) == c, 1)).alias(f"predicted_{c}") for c in (0, 1)]
    )


def binary_metrics(df: DataFrame, label: str = "is_fraud", prediction: str = "predicted_class", score: str = "fraud_probability", size: int | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 of class 1, area under ROC, average precision; one row.

    The counts are those of the distinct scores, so everything is one pass over the rows. Both areas come from one descending walk over distinct scores: a negative is beaten by the
    positives above it and by half of those it ties with; average precision weighs the precision at
    each score by its share of the positives. Rows without a score have no place in that walk and count in the
    other four measures only; rows without a label count nowhere.
    """
    y, p, scored = F.col(label) == 1, F.col(prediction) == 1, F.col(score).isNotNull()
    vals = df.groupBy((-F.col(score)).alias("__s")).agg(
        F.count(F.when(y & scored, 1)).alias("__pos"),
        F.count(F.when(~y & scored, 1)).alias("__neg"),
        F.count(label).alias("__rows"),
        F.count(F.when(y, 1)).alias("__frauds"),
        F.count(F.when(y & p, 1)).alias("__hit"),
        F.count(F.when(p & F.col(label).isNotNull(), 1)).alias("__flagged"),
        F.count(F.when(F.col(label) == F.col(prediction), 1)).alias("__right"),
    )
    walk = running(
        vals,
        [],
        ["__s"],
        [
            Over("__above", "sum", F.col("__pos"), "before"),
            Over("__tp", "sum", F.col("__pos"), "through"),
            Over("__fp", "sum", F.col("__neg"), "through"),
        ],
        size,
        derived=True,
    )
    pos, neg, hit = F.sum("__pos"), F.sum("__neg"), F.sum("__hit")
    won = F.sum(F.col("__neg").cast("double") * (F.col("__above") + F.col("__pos") / 2))
    precise = F.sum(F.col("__pos") * ratio(F.col("__tp"), F.col("__tp") + F.col("__fp")))
    row = walk.agg(
        ratio(F.sum("__right"), F.sum("__rows")).alias("accuracy"),
        F.coalesce(ratio(hit, F.sum("__flagged")), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(hit, F.sum("__frauds")), F.lit(0.0)).alias("recall"),
        ratio(won, pos.cast("double") * neg.cast("double")).alias("roc_auc"),
        ratio(precise, pos).alias("pr_auc"),
    )
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return row.withColumn("f1", f1).select(*METRICS)
