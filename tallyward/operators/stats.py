"""Rank test and density curves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyward.functions.columns import ratio
from tallyward.plans.joins import attach, measured
from tallyward.plans.slices import Over, running

# Groups of densities that a task keeps an array for.
ARRAY_GROUPS = 256
ALTERNATIVES = ("two-sided", "less", "greater")


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z) of the standard normal; used on one-row results."""
    return pd.Series(np.array([math.erfc(v / math.sqrt(2)) / 2 if v == v else np.nan for v in z.astype(float)]))


def mann_whitney(df: DataFrame, col: str, label: str = "is_fraud", alternative: str = "two-sided", size: int | None = None) -> DataFrame:
    """U of class 1 against class 0 with the tie-corrected normal approximation, one row (n1, n0, u, z, p).

    Equal values are counted together, so the ranking works on distinct values, and prefix counts give
    the mid-ranks.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")
    rows = df.where(F.col(col).isNotNull() & F.col(label).isNotNull())
    vals = rows.groupBy(F.col(col).alias("__v")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("__n1"), F.count(F.lit(1)).alias("__n")
    )
    ranked = running(vals, [], ["__v"], [Over("__below", "sum", F.col("__n"), "before")], size, derived=True)
    n = F.col("__n").cast("double")
    mid = F.col("__below").cast("double") + (n + 1) / 2
    sums = ranked.agg(
        F.sum("__n1").alias("n1"),
        F.sum(F.col("__n") - F.col("__n1")).alias("n0"),
        F.sum(mid * F.col("__n1")).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    total = n1 + n0
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1)))
    far = {"greater": u, "less": n1 * n0 - u, "two-sided": F.greatest(u, n1 * n0 - u)}[alternative]
    z = F.try_divide(far - n1 * n0 / 2 - 0.5, F.sqrt(var))
    tail = normal_tail("z")
    p = F.least(F.lit(1.0), 2 * tail) if alternative == "two-sided" else tail
    return sums.select("n1", "n0", u.alias("u"), z.alias("z")).withColumn("p", p)


def _grid_sums(rows: DataFrame, group: str, stats: list, points: int) -> DataFrame:
    """Sums of the kernels on each group's grid: values are never shuffled."""
    place = {r[group]: i for i, r in enumerate(stats)}
    n, h, start, step = (np.array([r[c] for r in stats], dtype=float) for c in ("n", "h", "start", "step"))
    grid = start[:, None] + np.arange(points) * step[:, None]
    kind = rows.schema[group].dataType.simpleString()

    def add(batches):
        sums = np.zeros_like(grid)
        for b in batches:
            codes = b.column(group).dictionary_encode()
            of = np.array([place.get(k, -1) for k in codes.dictionary.to_pylist()], dtype=int)[codes.indices.to_numpy()]
            values = b.column("__v").to_numpy()
            for g in np.unique(of[of >= 0]):
                own = values[of == g]
                for s in range(0, len(own), 1024):
                    t = (grid[g] - own[s : s + 1024, None]) / h[g]
                    sums[g] += np.exp(-0.5 * t * t).sum(axis=0)
        held = np.nonzero(sums.any(axis=1))[0]
        names = [r[group] for r in stats]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[g] for g in held for _ in range(points)], b_type), pa.array(np.tile(np.arange(points, dtype=np.int32), len(held))), pa.array(sums[held].ravel())], [group, "i", "sum"]
        )

    b_type = to_arrow_type(rows.schema[group].dataType)
    out = rows.select(group, "__v").mapInArrow(add, f"`{group}` {kind}, i int, sum double").groupBy(group, "i").agg(F.sum("sum").alias("sum"))
    shape = ", ".join(f"{c} double" for c in ("n", "h", "start", "step"))
    table = rows.sparkSession.createDataFrame([tuple(r[c] for c in (group, "n", "h", "start", "step")) for r in stats], f"`{group}` {kind}, {shape}")
    out = out.join(F.broadcast(table), group)
    return out.select(group, "i", (F.col("start") + F.col("i") * F.col("step")).alias("x"), (F.col("sum") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"), "n")


def _spread_sums(rows: DataFrame, group: str, stats: DataFrame, points: int) -> DataFrame:
    vals = rows.groupBy(group, "__v").agg(F.count(F.lit(1)).cast("double").alias("__n"))
    n, h = F.col("n"), F.col("h")
    stats, small = measured(stats)
    joined = vals.join(F.broadcast(stats), group) if small else attach(vals, stats, [group], ["__v"], "inner")
    spread = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    spread = spread.withColumn("x", F.col("start") + F.col("i") * F.col("step"))
    t = (F.col("x") - F.col("__v")) / h
    kernel = F.exp(-0.5 * t * t) * F.col("__n") / (n * h * math.sqrt(2 * math.pi))
    return spread.groupBy(group, "i").agg(F.max("x").alias("x"), F.sum(kernel).alias("density"), F.max("n").alias("n"))


def kde(
    df: DataFrame,
    col: str,
    by: str | None = None,
    log: bool = False,
    points: int = 200,
    cut: float = 3.0,
    common_norm: bool = True,
) -> DataFrame:
    """Gaussian density of ``col`` per group on an even grid, bandwidth by Scott's rule.

    Rows (group, i, x, density). ``cut`` bandwidths are added at both ends; with ``common_norm`` the
    areas of all groups add up to 1. Every value contributes to every grid point; a task adds its values up in one array per
    group, so only groups x points numbers a task are shuffled. Beyond ARRAY_GROUPS groups the sums are rows instead.
    """
    value = F.ln(F.when(F.col(col) > 0, F.col(col).cast("double"))) if log else F.col(col).cast("double")
    group = by or "group"
    rows = df.select((F.col(by) if by else F.lit("all")).alias(group), value.alias("__v")).dropna()
    n, h = F.col("n"), F.col("h")
    stats = rows.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.stddev_samp("__v").alias("sd"),
        F.min("__v").alias("low"),
        F.max("__v").alias("high"),
    )
    stats = stats.where(F.col("sd") > 0).withColumn("h", F.col("sd") * F.pow(n, F.lit(-0.2)))
    stats = stats.select(
        group,
        n,
        h,
        (F.col("low") - cut * h).alias("start"),
        ((F.col("high") - F.col("low") + 2 * cut * h) / (points - 1)).alias("step"),
    )
    few = stats.limit(ARRAY_GROUPS + 1).collect()
    if len(few) <= ARRAY_GROUPS:
        out = _grid_sums(rows, group, few, points)
    else:
        out = _spread_sums(rows, group, stats, points)
    weight = F.lit(1.0)
    if common_norm:
        weight = ratio(F.col("n"), rows.agg(F.count(F.lit(1)).alias("c")).scalar())
    return out.select(group, "i", "x", (F.col("density") * weight).alias("density"))
