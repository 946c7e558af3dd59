"""Session set-up and the few settings the library reads."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows of one key that a single task may be handed before the key is cut into slices.
GROUP_ROWS = "spark.tallyward.groupRows"
GROUP_ROWS_DEFAULT = 2_000_000

# Rows from which the quantiles of few groups are found by counting instead of sorting.
SELECT_ROWS = "spark.tallyward.selectRows"
SELECT_ROWS_DEFAULT = 1_000_000

# Rows a side may have to be sent to every executor; checked by counting, never assumed.
BROADCAST_ROWS = "spark.tallyward.broadcastRows"
BROADCAST_ROWS_DEFAULT = 500_000

# Keeps the state of a stream on disk instead of in the executors' memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_session(app: str = "tallyward", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("TALLYWARD_DRIVER_MEMORY", "8g"))
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS, str(GROUP_ROWS_DEFAULT)))


def select_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SELECT_ROWS, str(SELECT_ROWS_DEFAULT)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS, str(BROADCAST_ROWS_DEFAULT)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyward-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage, on reliable storage so that a lost executor costs nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Rows that are read many times: as columns in memory, or on disk where it is full, until the block ends."""
    rows = df.persist()
    try:
        yield rows
    finally:
        rows.unpersist()
