"""Summaries of a device or an IP over its whole history.

Where no entity can be too big for a task, the waiting times, their medians and the distinct counts all come from orderings of the
same groups: one exchange and several sorts, followed by one aggregation without another exchange. Otherwise counts of (entity, value),
combined on the map side, give both the distinct counts and the medians, and only the gaps need an order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import mean_of, ratio, seconds_between
from tallyward.operators.features import purchase_gap
from tallyward.plans.slices import Over, quantile_of, quantiles, ranked_for, running
from tallyward.session import group_rows

_ID = "transaction_id"


def summarize_entity(df: DataFrame, entity: str, size: int | None = None) -> DataFrame:
    """One row per device or IP: volume, frauds, reach, value level and spread, typical waiting times."""
    if entity not in ("device_id", "ip_address"):
        raise ValueError("entity must be 'device_id' or 'ip_address'")
    other, reach = ("ip_address", "unique_ips") if entity == "device_id" else ("device_id", "unique_device_ids")
    rows = df.where(F.col(entity).isNotNull()).select(
        F.col(entity).alias("__e"),
        _ID,
        "purchase_time",
        F.col("user_id").alias("__user"),
        F.col(other).alias("__other"),
        "purchase_value",
        "is_fraud",
        seconds_between("signup_time", "purchase_time").alias("__setup"),
    )
    rows = purchase_gap(rows, "__e", name="__gap", size=size)
    if size is None or size > group_rows(df.sparkSession):
        return _from_counts(rows, entity, reach, size)
    rows = ranked_for(rows, ["__e"], "__gap", _ID, "gap", size, derived=True)
    rows = ranked_for(rows, ["__e"], "__setup", _ID, "setup", size, derived=True)
    for c in ("__user", "__other"):
        rows = running(rows, ["__e"], [c, _ID], [Over(f"{c}_prev", "last", F.col(c), "before")], size, derived=True)
    return (
        rows.groupBy(F.col("__e").alias(entity))
        .agg(
            F.count("is_fraud").alias("transactions"),
            F.sum("is_fraud").cast("long").alias("frauds"),
            _new("__user").alias("unique_users"),
            _new("__other").alias(reach),
            mean_of("purchase_value").alias("mean_purchase_val"),
            F.stddev_samp(F.col("purchase_value").cast("double")).alias("purchase_val_std"),
            quantile_of("__setup", "setup", 0.5).alias("median_time_between_signup_and_purchase"),
            quantile_of("__gap", "gap", 0.5).alias("median_time_between_purchase"),
        )
        .withColumn("fraud_rate", ratio("frauds", "transactions"))
    )


def _from_counts(rows: DataFrame, entity: str, reach: str, size: int | None) -> DataFrame:
    sums = rows.groupBy("__e").agg(
        F.count("is_fraud").alias("transactions"),
        F.sum("is_fraud").cast("long").alias("frauds"),
        F.count_distinct("__user").alias("unique_users"),
        F.count_distinct("__other").alias(reach),
        mean_of("purchase_value").alias("mean_purchase_val"),
        F.stddev_samp(F.col("purchase_value").cast("double")).alias("purchase_val_std"),
    )
    waits = rows.unpivot(["__e"], ["__setup", "__gap"], "__kind", "__wait")
    middle = quantiles(waits, ["__e", "__kind"], "__wait", {"__mid": 0.5}, None if size is None else 2 * size)
    of = lambda kind: F.max(F.when(F.col("__kind") == kind, F.col("__mid")))
    medians = middle.groupBy("__e").agg(of("__setup").alias("median_time_between_signup_and_purchase"), of("__gap").alias("median_time_between_purchase"))
    out = sums.join(medians, "__e", "left").withColumn("fraud_rate", ratio("frauds", "transactions"))
    return out.withColumnRenamed("__e", entity)


def _new(c: str) -> Column:
    """Distinct values of a sorted column: those unlike the one before."""
    return F.count(F.when(~F.col(c).eqNullSafe(F.col(f"{c}_prev")), F.col(c)))


def device_value_stats(df: DataFrame, key: str = "device_id", size: int | None = None) -> DataFrame:
    """Sum, mean, median, ends, spread and number of a device's values, in one exchange."""
    rows = df.where(F.col(key).isNotNull()).select(key, _ID, "purchase_value")
    value = F.col("purchase_value").cast("double")
    return (
        ranked_for(rows, [key], "purchase_value", _ID, "v", size)
        .groupBy(key)
        .agg(
            F.sum("purchase_value").alias("total_value"),
            mean_of("purchase_value").alias("mean_value"),
            quantile_of("purchase_value", "v", 0.5).alias("median_value"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.stddev_samp(value).alias("std_value"),
            F.count("purchase_value").alias("count"),
        )
    )
