"""The log of the online scorer: batches as they come, and a compacted base of records that reads build on.

    log/run=R/batch=N/kind=K      results (kind 0) and labels (kind 1) of a micro-batch, its ``tail`` until it is compacted
    manifest/run=R/batch=N        one row: how many of each, and between which times the results lie
    base/version=V/bucket=B       records of all batches up to V: results with their latest label, and labels still without a result
    recent/version=V              the newest RECENT results of the base
    versions/version=V            which batches V covers, written last: a version exists once this does

Reads merge the newest version with the batches it does not cover. ``compact`` makes the next version and drops what no reader of the
one before can need. A batch that is written again after it was compacted is the same batch, and stays covered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.operators.scoring import recent_results
from tallyward.sources.files import remove
from tallyward.sources.schema import FEATURES
from tallyward.streaming.sources import LABELLED, TXN

BUCKETS = 64
# Files of one kind in a batch; rows of a bucket lie together in them.
BATCH_FILES = 8
# Newest results that a version keeps apart; the newest of more than these are found in the base itself.
RECENT = 10_000
OUTPUT = (
    "kind int, transaction_id string, device_id string, event_time timestamp, true_label int, txn_count bigint, "
    "device_ip_consistency boolean, device_source_consistency boolean, time_setup_to_txn_seconds double, "
    "time_since_last_device_txn double, purchase_deviation_from_device_mean double, device_lifespan double, "
    "device_fraud_rate double"
)
NO_LABEL = -1  # on transaction rows, and on labels that hold nothing
_SCORES = ", predicted_class int, fraud_probability double"
_ROW = ", ".join(p for p in OUTPUT.split(", ") if not p.startswith("kind")) + _SCORES + ", bucket int, kind int"
_MANIFEST = "results long, labels long, low long, high long"


def bucket_of(transaction_id: Column) -> Column:
    return F.pmod(F.xxhash64(transaction_id.cast("string")), F.lit(BUCKETS)).cast("int")


def append(scored: DataFrame, run: str, batch_id: int, path: str) -> None:
    """Write a micro-batch under its run's id and its own: only its own repeat replaces it."""
    on_txn = F.col("kind") == TXN
    out = scored.withColumns(
        {
            "predicted_class": F.when(on_txn, F.col("predicted_class")),
            "fraud_probability": F.when(on_txn, F.col("fraud_probability")),
            "true_label": F.nullif("true_label", F.lit(NO_LABEL)),
            **{f: F.when(on_txn, F.col(f)) for f in FEATURES},
            "bucket": bucket_of(F.col("transaction_id")),
        }
    )
    seen, at = Observation(), F.when(on_txn, F.unix_micros("event_time"))
    out = out.observe(seen, F.count(F.when(on_txn, 1)).alias("results"), F.count(F.when(~on_txn, 1)).alias("labels"), F.min(at).alias("low"), F.max(at).alias("high"))
    place = f"run={run}/batch={batch_id}"
    out.repartition(BATCH_FILES, "bucket").sortWithinPartitions("kind", "bucket").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/log/{place}")
    row = [tuple(seen.get[n] for n in ("results", "labels", "low", "high"))]
    scored.sparkSession.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{place}")


def _read(spark: SparkSession, folder: str, schema: str, parts: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, {parts}").parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _version(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """The newest version, 0 before the first, and the last batch of each run that it covers."""
    versions = _read(spark, f"{path}/versions", "covered string, upto long", "version long")
    rows = versions.collect() if versions is not None else []  # a row for each run and version
    newest = max((r["version"] for r in rows), default=0)
    return newest, {r["covered"]: r["upto"] for r in rows if r["version"] == newest}


def _uncovered(rows: DataFrame, upto: dict[str, int]) -> DataFrame:
    covered = reduce(lambda a, b: a | b, [(F.col("run") == r) & (F.col("batch") <= n) for r, n in upto.items()], F.lit(False))
    return rows.where(~covered)


def _manifest(spark: SparkSession, path: str, upto: dict[str, int]) -> list:
    """Completed batches that a version does not cover: one row each, few between compactions."""
    rows = _read(spark, f"{path}/manifest", _MANIFEST, "run string, batch long")
    return _uncovered(rows, upto).collect() if rows is not None else []


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """The tail and the base."""
    version, upto = _version(spark, path)
    tail = _read(spark, f"{path}/log", _ROW.removesuffix(", kind int"), "kind int, run string, batch long")
    if tail is None:
        raise ValueError(f"no log at {path}")
    tail = _uncovered(tail, upto).drop("run", "batch")
    base = _read(spark, f"{path}/base/version={version}", _ROW.replace("bucket int, ", "label_time timestamp, "), "bucket int") if version else None
    return tail, base


def _as_result(rows: DataFrame) -> DataFrame:
    return rows.withColumn("purchase_time", F.col("event_time")).drop("kind", "event_time")


def results(spark: SparkSession, path: str) -> DataFrame:
    """The immutable result events."""
    tail, base = _parts(spark, path)
    found = tail.where(F.col("kind") == TXN).drop("true_label")
    if base is not None:
        found = found.unionByName(base.where(F.col("kind") == TXN).drop("true_label", "label_time"))
    return _as_result(found)


def _label(time: str) -> Column:
    return F.when(F.col(time).isNotNull(), F.struct(F.col(time).alias("at"), F.col("true_label").alias("label")))


def _merged(tail: DataFrame, base: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(records with ``__label``, labels that have no result): the tail's labels meet the base's results and the other way round."""
    own = tail.where(F.col("kind") == TXN)
    labels = tail.where(F.col("kind") == LABELLED).groupBy("transaction_id").agg(F.max(_label("event_time")).alias("__label"))
    if base is None:
        return own.join(labels, "transaction_id", "left"), labels.join(own.select("transaction_id"), "transaction_id", "left_anti")
    old = base.where(F.col("kind") == TXN)
    orphans = base.where(F.col("kind") == LABELLED).select("transaction_id", _label("event_time").alias("__label"))
    held = old.where(F.col("label_time").isNotNull()).join(own.select("transaction_id"), "transaction_id", "left_semi")
    every = labels.unionByName(orphans).unionByName(held.select("transaction_id", _label("label_time").alias("__label")))
    new = own.join(every.groupBy("transaction_id").agg(F.max("__label").alias("__label")), "transaction_id", "left")
    kept = old.join(labels.withColumnRenamed("__label", "__new"), "transaction_id", "left")
    kept = kept.withColumn("__label", F.greatest(_label("label_time"), F.col("__new"))).drop("label_time", "__new")
    known = own.select("transaction_id").unionByName(old.select("transaction_id"))
    left = labels.unionByName(orphans).groupBy("transaction_id").agg(F.max("__label").alias("__label")).join(known, "transaction_id", "left_anti")
    return kept.unionByName(new), left


def records(spark: SparkSession, path: str) -> DataFrame:
    """One record per result: its latest label next to it, NULL until one arrives."""
    found, _ = _merged(*_parts(spark, path))
    return _as_result(found.withColumn("true_label", F.col("__label.label")).drop("__label"))


def record(spark: SparkSession, path: str, transaction_id: str) -> DataFrame:
    """The record of one transaction, from its bucket of the base and the tail; no rows when there is none."""
    bucket = spark.range(1).select(bucket_of(F.lit(transaction_id)).alias("b")).first()["b"]
    mine = (F.col("bucket") == bucket) & (F.col("transaction_id") == transaction_id)
    tail, base = _parts(spark, path)
    found, _ = _merged(tail.where(mine), None if base is None else base.where(mine))
    return _as_result(found.withColumn("true_label", F.col("__label.label")).drop("__label"))


def latest(spark: SparkSession, path: str, k: int = 20) -> DataFrame:
    """The k newest results, oldest of them first.

    Batches whose results are all older than k results of other batches, by the manifest, are not read; of the base only its
    recent results, as long as k does not exceed them.
    """
    version, upto = _version(spark, path)
    batches = [r for r in _manifest(spark, path, upto) if r["results"]]
    seen, bound = 0, None
    for r in sorted(batches, key=lambda r: -r["low"]):
        seen += r["results"]
        if seen >= k:
            bound = r["low"]
            break
    wanted = [f"{path}/log/run={r['run']}/batch={r['batch']}/kind={TXN}" for r in batches if bound is None or r["high"] >= bound]
    schema = _ROW.removesuffix(", kind int")
    rows = spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)
    rows = rows.drop("true_label")
    if version:
        if k <= RECENT:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/recent/version={version}").drop("true_label"))
        else:
            _, base = _parts(spark, path)
            rows = rows.unionByName(base.where(F.col("kind") == TXN).drop("true_label", "label_time", "kind"))
    return recent_results(_as_result(rows.withColumn("kind", F.lit(TXN))), k)


def compact(spark: SparkSession, path: str, readers: bool = True) -> int:
    """Cover all completed batches by a new version and return its number.

    What readers of the version before may be at stays until the next compaction, unless there are no ``readers``.
    """
    version, upto = _version(spark, path)
    batches = _manifest(spark, path, upto)
    if not batches:
        return version
    covers = dict(upto)
    for r in batches:
        covers[r["run"]] = max(covers.get(r["run"], -1), r["batch"])
    log = _read(spark, f"{path}/log", _ROW.removesuffix(", kind int"), "kind int, run string, batch long")
    done = reduce(lambda a, b: a | b, [(F.col("run") == r) & (F.col("batch") <= n) for r, n in covers.items()])
    _, base = _parts(spark, path)
    found, orphans = _merged(_uncovered(log, upto).where(done).drop("run", "batch"), base)
    names = T.StructType.fromDDL(_ROW).names
    left = orphans.select("transaction_id", F.lit(LABELLED).alias("kind"), F.col("__label.at").alias("event_time"), F.col("__label.label").alias("true_label"))
    left = left.withColumn("bucket", bucket_of(F.col("transaction_id")))
    merged = found.withColumns({"true_label": F.col("__label.label"), "label_time": F.col("__label.at")}).select(*names, "label_time")
    new = version + 1
    merged.unionByName(left, allowMissingColumns=True).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/version={new}")
    written = spark.read.schema(_ROW.replace("bucket int, ", "label_time timestamp, ") + ", bucket int").parquet(f"{path}/base/version={new}")
    newest = written.where(F.col("kind") == TXN).orderBy(F.desc("event_time"), F.desc("transaction_id")).limit(RECENT)
    newest.drop("label_time", "kind").coalesce(1).write.mode("overwrite").parquet(f"{path}/recent/version={new}")
    spark.createDataFrame(list(covers.items()), "covered string, upto long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={new}")
    _drop(spark, path, new - 1 if readers else new, upto if readers else covers)
    return new


def _drop(spark: SparkSession, path: str, version: int, upto: dict[str, int]) -> None:
    """Remove batches that ``version`` covers, and all versions before it."""
    rows = _read(spark, f"{path}/manifest", _MANIFEST, "run string, batch long")
    for r in rows.select("run", "batch").collect():
        if r["batch"] <= upto.get(r["run"], -1):
            remove(spark, f"{path}/log/run={r['run']}/batch={r['batch']}")
            remove(spark, f"{path}/manifest/run={r['run']}/batch={r['batch']}")
    for old in range(max(1, version - 2), version):
        for kind in ("base", "recent", "versions"):
            remove(spark, f"{path}/{kind}/version={old}")
