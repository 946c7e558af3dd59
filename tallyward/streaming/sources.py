"""Streams of transactions, labels and state seeds, merged into one tagged stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.sources.codecs import decode_labels, decode_transactions
from tallyward.sources.schema import LABEL, TRANSACTION

SEED, TXN, LABELLED = -1, 0, 1

EVENT = (
    "kind int, event_time timestamp, transaction_id string, device_id string, signup_time timestamp, "
    "purchase_value double, source string, ip_address double, is_fraud int, "
    "txn_count bigint, purchase_sum double, last_transaction timestamp, first_seen timestamp, "
    "ip_mixed boolean, source_mixed boolean, fraud_count bigint"
)


# What a trigger may read. It bounds what one busy device can bring to the task that folds it; history
# larger than that belongs in the batch features, whose snapshot then seeds the stream.
BYTES_PER_TRIGGER = 1 << 30


def file_stream(
    spark: SparkSession,
    path: str,
    schema,
    files: int | None = None,
    kind: str = "parquet",
    only: str | None = None,
    limit: int | None = BYTES_PER_TRIGGER,
) -> DataFrame:
    """New files of a folder, up to ``files`` or ``limit`` bytes a trigger; ``only`` is a pattern of names."""
    reader = spark.readStream.schema(schema).format(kind)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if kind == "csv":
        reader = reader.option("header", "true")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    elif limit:
        reader = reader.option("maxBytesPerTrigger", str(limit))
    return reader.load(path)


def transaction_files(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    return file_stream(spark, path, TRANSACTION, files)


def label_files(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    return file_stream(spark, path, LABEL, files)


def kafka_topic(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 5_000_000) -> DataFrame:
    """JSON messages of a topic; the offset cap bounds what one device can bring in one micro-batch."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def transaction_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return decode_transactions(kafka_topic(spark, servers, topic), "value")


def label_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return decode_labels(kafka_topic(spark, servers, topic), "value")


def _as_events(df: DataFrame) -> DataFrame:
    names = [c.strip().split(" ") for c in EVENT.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])


def tagged_events(txns: DataFrame, labels: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """One stream: transactions at their purchase time, labels at their arrival, snapshots of devices first."""
    out = _as_events(txns.drop("is_fraud").withColumns({"kind": F.lit(TXN), "event_time": F.col("purchase_time")}))
    if labels is not None:
        out = out.unionByName(_as_events(labels.withColumns({"kind": F.lit(LABELLED), "event_time": F.col("arrival_time")})))
    if seeds is not None:
        seeded = seeds.select(
            F.lit(SEED).alias("kind"),
            F.col("last_transaction").alias("event_time"),
            F.col("device_id").cast("string").alias("transaction_id"),
            "device_id",
            "txn_count",
            "purchase_sum",
            "last_transaction",
            "first_seen",
            F.col("ip_min").alias("ip_address"),
            "ip_mixed",
            F.col("source_min").alias("source"),
            "source_mixed",
            "fraud_count",
        )
        out = out.unionByName(_as_events(seeded))
    return out
