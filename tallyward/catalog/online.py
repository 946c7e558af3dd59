"""Queries that run the stream to its end."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.catalog.bindings import SQL, query, rounded, table
from tallyward.catalog.history import DOUBLES, INTERCEPT, WEIGHTS
from tallyward.operators.features import device_state
from tallyward.operators.scoring import linear_score
from tallyward.session import checkpoint_dir
from tallyward.sources.schema import FEATURES
from tallyward.streaming import job
from tallyward.streaming.sources import file_stream

# Deliveries of the event table by the queries that read it as several.
SLICES = 3


def _event_streams(spark, sf):
    """The event table as a stream of transactions and a stream of their labels, delay 0."""
    raw = table(spark, sf, "events")
    held = raw.select("_metadata.file_path").first()[0]
    if held.endswith("/events.parquet"):  # the table is one file, not a folder of parts
        stream = file_stream(spark, sf, raw.schema, only="events.parquet")
    else:
        stream = file_stream(spark, f"{sf}/events.parquet", raw.schema)
    return _transactions(stream), _labels(stream)


def _transactions(stream):
    return stream.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("device_id"),
        F.timestamp_add("DAY", (F.col("user_id") % 30).cast("int"), F.lit("2023-12-01").cast("timestamp")).alias("signup_time"),
        F.col("ts").cast("timestamp").alias("purchase_time"),
        F.col("value").alias("purchase_value"),
        F.col("event_type").alias("source"),
        F.get_json_object("props", "$.k").cast("double").alias("ip_address"),
    )


def _labels(stream, days=0):
    return stream.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("device_id"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
        F.timestamp_add("DAY", F.lit(days), F.col("ts").cast("timestamp")).alias("arrival_time"),
    )


def _slices(spark, sf):
    """The events in SLICES parts by time, oldest first."""
    raw = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = raw.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [raw]
    part = F.least(F.floor((at - low) * SLICES / (high - low + 1)), F.lit(SLICES - 1))
    return [raw.where(part == i) for i in range(SLICES)]


def _deliver(rows, folder) -> None:
    """Add files to a folder. A device's rows are in one of them, so files read one by one keep its order."""
    rows.repartition("user_id").write.mode("append").parquet(folder)


def _opened(spark, sf, folder):
    """The files of a folder as a stream that takes about SLICES triggers for what lies there now."""
    files = len(spark.read.parquet(folder).inputFiles())
    return file_stream(spark, folder, table(spark, sf, "events").schema, max(1, files // SLICES))


def _score(txns, labels, base, checkpoint="checkpoint", scorer=None) -> None:
    job.run_stream(txns, labels, scorer or job.linear_scorer(WEIGHTS, INTERCEPT), base, f"{base}/{checkpoint}").awaitTermination()


def _new_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def run_events(spark, sf) -> str:
    base = _new_folder(spark)
    _score(*_event_streams(spark, sf), base)
    return base


def _features(spark, base):
    out = job.results(spark, base).withColumn("transaction_id", F.col("transaction_id").cast("long"))
    return rounded(out.select("transaction_id", *FEATURES), *DOUBLES)


@query("stream_features", SQL["device_features_online"])
def stream_features(spark, sf):
    return _features(spark, run_events(spark, sf))


@query("stream_features_many_triggers", SQL["device_features_online"])
def stream_features_many_triggers(spark, sf):
    """The features do not depend on how the events are cut into micro-batches."""
    base = _new_folder(spark)
    for part in _slices(spark, sf):
        _deliver(part, f"{base}/events")
    stream = _opened(spark, sf, f"{base}/events")
    _score(_transactions(stream), _labels(stream), base)
    return _features(spark, base)


@query("stream_restart", SQL["device_features_online"])
def stream_restart(spark, sf):
    """The scorer stops after each delivery; every later one also repeats part of the one before."""
    base, before = _new_folder(spark), None
    for part in _slices(spark, sf):
        _deliver(part, f"{base}/events")
        if before is not None:
            _deliver(before.where(F.col("event_id") % 10 == 0), f"{base}/events")
        stream = file_stream(spark, f"{base}/events", table(spark, sf, "events").schema)
        _score(_transactions(stream), _labels(stream), base)
        before = part
    return _features(spark, base)


@query("stream_late_labels", "SELECT event_id AS transaction_id, CAST(event_type = 'error' AS INTEGER) AS true_label FROM events")
def stream_late_labels(spark, sf):
    """Labels are a week behind in their own time and come before, with and after later transactions."""
    base = _new_folder(spark)
    for part in _slices(spark, sf):
        _deliver(part, f"{base}/events")
    _score(_transactions(_opened(spark, sf, f"{base}/events")), _labels(_opened(spark, sf, f"{base}/events"), 7), base)
    out = job.records(spark, base)
    return out.select(F.col("transaction_id").cast("long").alias("transaction_id"), "true_label")


@query(
    "stream_out_of_order",
    "SELECT user_id AS device_id, count(*) AS results, count(DISTINCT event_id) AS transactions, max(rank) AS txn_count "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) GROUP BY user_id",
)
def stream_out_of_order(spark, sf):
    """The newest events are delivered first; a device's last count is that of all its transactions."""
    base = _new_folder(spark)
    for part in reversed(_slices(spark, sf)):
        _deliver(part, f"{base}/events")
    stream = _opened(spark, sf, f"{base}/events")
    _score(_transactions(stream), _labels(stream), base)
    return job.results(spark, base).groupBy(F.col("device_id").cast("long").alias("device_id")).agg(
        F.count(F.lit(1)).alias("results"), F.countDistinct("transaction_id").alias("transactions"), F.max("txn_count").alias("txn_count")
    )


@query("stream_scores", SQL["linear_score"])
def stream_scores(spark, sf):
    """Scores as the stream wrote them, of features rounded as those of the batch scores are."""
    base = _new_folder(spark)
    _score(*_event_streams(spark, sf), base, scorer=lambda df: linear_score(rounded(df, *DOUBLES), WEIGHTS, INTERCEPT))
    out = job.results(spark, base).select(F.col("transaction_id").cast("long").alias("transaction_id"), "predicted_class", "fraud_probability")
    return rounded(out, "fraud_probability")


@query("stream_new_checkpoint", "SELECT event_id AS transaction_id, CAST(n AS BIGINT) AS results FROM events, (VALUES (2)) AS twice(n)")
def stream_new_checkpoint(spark, sf):
    """Scoring again from a new checkpoint adds its results and removes none."""
    base = _new_folder(spark)
    for checkpoint in ("first", "second"):
        _score(*_event_streams(spark, sf), base, checkpoint)
    out = job.results(spark, base).groupBy(F.col("transaction_id").cast("long").alias("transaction_id"))
    return out.agg(F.count(F.lit(1)).alias("results"))


# Features and the label of every event; the last third by time of the same.
_LABELLED = f"SELECT f.*, CAST(event_type = 'error' AS INTEGER) AS true_label FROM ({SQL['device_features_online']}) f JOIN events ON event_id = f.transaction_id"
_LAST = f"""WITH b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events)
SELECT f.* FROM ({SQL['device_features_online']}) f JOIN events ON event_id = f.transaction_id, b
WHERE floor((epoch_us(ts) - low) * {SLICES} / (high - low + 1)) >= {SLICES - 1}"""


def _delivered(spark, sf, base, compacted):
    """One delivery after the other, the log compacted after some of them."""
    for i, part in enumerate(_slices(spark, sf)):
        _deliver(part, f"{base}/events")
        stream = file_stream(spark, f"{base}/events", table(spark, sf, "events").schema)
        _score(_transactions(stream), _labels(stream), base)
        if i in compacted:
            job.compact(spark, base, readers=False)


@query("stream_compacted", _LABELLED)
def stream_compacted(spark, sf):
    """Records of a base that two compactions made, and of the batches since; compacted batches are gone."""
    base = _new_folder(spark)
    _delivered(spark, sf, base, (0, 1))
    out = job.records(spark, base).withColumn("transaction_id", F.col("transaction_id").cast("long"))
    return rounded(out.select("transaction_id", "true_label", *FEATURES), *DOUBLES)


@query(
    "stream_latest",
    f"SELECT f.*, epoch_us(ts) AS purchase_us FROM ({SQL['device_features_online']}) f JOIN events ON event_id = f.transaction_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 100",
)
def stream_latest(spark, sf):
    """The 100 newest results, from the manifest's newest batches and the base's recent results."""
    base = _new_folder(spark)
    _delivered(spark, sf, base, (1,))
    out = job.latest(spark, base, 100).withColumn("purchase_us", F.unix_micros("purchase_time"))
    return rounded(out.withColumn("transaction_id", F.col("transaction_id").cast("long")).select("transaction_id", "purchase_us", *FEATURES), *DOUBLES)


@query("stream_record_by_id", f"SELECT * FROM ({_LABELLED}) WHERE transaction_id = (SELECT max(event_id) FROM events)")
def stream_record_by_id(spark, sf):
    """The record of the largest id, from its bucket of the base and the batches since."""
    base = _new_folder(spark)
    _delivered(spark, sf, base, (1,))
    newest = table(spark, sf, "events").agg(F.max("event_id").cast("string")).first()[0]
    out = job.record(spark, base, newest).withColumn("transaction_id", F.col("transaction_id").cast("long"))
    return rounded(out.select("transaction_id", "true_label", *FEATURES), *DOUBLES)


@query("stream_seeded", _LAST)
def stream_seeded(spark, sf):
    """The snapshot of older events, written and read as the stream's first rows, and the newest events: as if all had been streamed."""
    base, (*old, new) = _new_folder(spark), _slices(spark, sf)
    old = reduce(DataFrame.unionByName, old)
    txns, labels = _transactions(old), _labels(old)
    device_state(txns, labels).write.parquet(f"{base}/seeds")
    seeds = file_stream(spark, f"{base}/seeds", spark.read.parquet(f"{base}/seeds").schema, limit=None)
    _deliver(new, f"{base}/events")
    stream = file_stream(spark, f"{base}/events", table(spark, sf, "events").schema)
    job.run_stream(_transactions(stream), _labels(stream), job.linear_scorer(WEIGHTS, INTERCEPT), base, f"{base}/checkpoint", seeds).awaitTermination()
    return _features(spark, base)


@query("stream_records", "SELECT event_id AS transaction_id, CAST(event_type = 'error' AS INTEGER) AS true_label FROM events")
def stream_records(spark, sf):
    out = job.records(spark, run_events(spark, sf))
    return out.select(F.col("transaction_id").cast("long").alias("transaction_id"), "true_label")
