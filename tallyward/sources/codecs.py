"""Typed encoding and decoding of events and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.sources.schema import LABEL, TRANSACTION

STATE = (
    "device_id string, txn_count bigint, purchase_sum double, last_transaction timestamp, first_seen timestamp, "
    "ip_addresses array<double>, sources array<string>, fraud_count bigint"
)


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])


def decode_transactions(df: DataFrame, json_col: str | None = None) -> DataFrame:
    """All-text columns, or one JSON column, to typed transactions."""
    if json_col:
        df = df.select(F.from_json(json_col, "map<string,string>").alias("m"))
        df = df.select(*[F.col("m")[f.name].alias(f.name) for f in TRANSACTION.fields])
    return _typed(df, TRANSACTION)


def decode_labels(df: DataFrame, json_col: str | None = None) -> DataFrame:
    """Labels with ``is_fraud`` as a number: the text "0" is not a fraud."""
    if json_col:
        df = df.select(F.from_json(json_col, "map<string,string>").alias("m"))
        df = df.select(*[F.col("m")[f.name].alias(f.name) for f in LABEL.fields])
    return _typed(df, LABEL)


def encode_transactions(df: DataFrame) -> DataFrame:
    """Transactions as ``key`` (device) and ``value`` (JSON), ready for a message log."""
    times = {c: iso(F.col(c)) for c in ("signup_time", "purchase_time")}
    return _typed(df, TRANSACTION).withColumns(times).select(
        F.col("device_id").alias("key"), F.to_json(F.struct("*")).alias("value")
    )


def iso(c: Column) -> Column:
    """ISO text; the fraction of a second is written only where there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def result_events(scored: DataFrame) -> DataFrame:
    """The event a scored transaction is published as: flags as 0/1, durations cut to whole seconds."""
    whole = ["time_setup_to_txn_seconds", "time_since_last_device_txn", "device_lifespan"]
    return scored.select(
        "transaction_id",
        F.col("txn_count").cast("long").alias("txn_count"),
        *[F.col(c).cast("int").alias(c) for c in ("device_ip_consistency", "device_source_consistency")],
        *[F.col(c).cast("long").alias(c) for c in whole],
        *[F.col(c).cast("double").alias(c) for c in ("purchase_deviation_from_device_mean", "device_fraud_rate")],
        F.col("predicted_class").cast("int").alias("predicted_class"),
        F.col("fraud_probability").cast("double").alias("fraud_probability"),
    )


def encode_state(state: DataFrame) -> DataFrame:
    """Device state as text columns: sets as sorted JSON arrays, times as ISO text; a row for each part of a device's sets."""
    return state.withColumns(
        {
            "last_transaction": iso(F.col("last_transaction")),
            "first_seen": iso(F.col("first_seen")),
            "ip_addresses": F.to_json(F.array_sort("ip_addresses")),
            "sources": F.to_json(F.array_sort("sources")),
        }
    )


def decode_state(text: DataFrame) -> DataFrame:
    """Inverse of ``encode_state``; a missing field is the state of an unseen device."""
    part = [F.coalesce("part", F.lit(0)).alias("part")] if "part" in text.columns else []
    return text.select(
        "device_id",
        *part,
        F.coalesce(F.col("txn_count").cast("long"), F.lit(0)).alias("txn_count"),
        F.coalesce(F.col("purchase_sum").cast("double"), F.lit(0.0)).alias("purchase_sum"),
        F.to_timestamp("last_transaction").alias("last_transaction"),
        F.to_timestamp("first_seen").alias("first_seen"),
        F.coalesce(F.from_json("ip_addresses", "array<double>"), F.array().cast("array<double>")).alias("ip_addresses"),
        F.coalesce(F.from_json("sources", "array<string>"), F.array().cast("array<string>")).alias("sources"),
        F.coalesce(F.col("fraud_count").cast("long"), F.lit(0)).alias("fraud_count"),
    )


def label_events(txns: DataFrame, delay_days: float = 0) -> DataFrame:
    """The label of each transaction, arriving ``delay_days`` after the purchase."""
    seconds = F.make_dt_interval(secs=F.lit(float(delay_days) * 86400).cast("decimal(18,6)"))
    return txns.select(
        "transaction_id",
        "device_id",
        F.col("is_fraud").cast("int").alias("is_fraud"),
        (F.col("purchase_time") + seconds).alias("arrival_time"),
    )
