"""Joins whose strategy follows a measured size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.plans.slices import MAX_SLICES, SAMPLE_PER_SLICE, SEED
from tallyward.session import broadcast_rows, group_rows, settle


def fits_broadcast(df: DataFrame) -> bool:
    limit = broadcast_rows(df.sparkSession)
    return df.limit(limit + 1).count() <= limit


def measured(table: DataFrame) -> tuple[DataFrame, bool]:
    """The table computed once, and whether it is small enough to broadcast."""
    table = settle(table)
    return table, fits_broadcast(table)


def heavy_keys(df: DataFrame, keys: Sequence[str], size: int | None = None) -> DataFrame | None:
    """Keys with more rows than one task should take, and a number of salts for each.

    At most MAX_SLICES rows, found in a bounded sample; None where there are none. A missed key costs
    balance, not correctness.
    """
    limit = group_rows(df.sparkSession)
    total = size if size is not None else df.count()
    if total <= limit:
        return None
    wanted = min(math.ceil(total / limit), MAX_SLICES)
    sample = df.select(*keys).sample(min(1.0, wanted * SAMPLE_PER_SLICE / total), seed=SEED)
    heavy = (
        sample.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > SAMPLE_PER_SLICE)
        .withColumn("__salts", F.ceil(F.col("__n") / SAMPLE_PER_SLICE).cast("int") + 1)
        .drop("__n")
    )
    rows = heavy.collect()
    if not rows:
        return None
    return df.sparkSession.createDataFrame(rows, heavy.schema)


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    salt: Sequence[str],
    how: str = "left",
    size: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table``, which has at most one row per key.

    Heavy keys of ``rows`` are spread over salts (a hash of the ``salt`` columns, so a retried task
    makes the same choice) and only their few ``table`` rows are repeated. The join type is left to
    the optimizer, which broadcasts ``table`` where its measured size allows. ``source`` is a cheaper
    table with the same keys to look for heavy ones in.
    """
    keys = list(keys)
    heavy = heavy_keys(rows if source is None else source, keys, size)
    if heavy is None:
        return rows.join(table, keys, how)
    heavy = heavy.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], "__salts")

    def mark(df: DataFrame) -> DataFrame:
        on = [df[k].eqNullSafe(heavy[f"__h{i}"]) for i, k in enumerate(keys)]
        return df.join(F.broadcast(heavy), on, "left").drop(*[f"__h{i}" for i in range(len(keys))])

    spread = F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*salt), F.col("__salts"))).otherwise(0).cast("int")
    left = mark(rows).withColumn("__salt", spread).drop("__salts")
    right = (
        mark(table)
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))))
        .drop("__salts")
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
