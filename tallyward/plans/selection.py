"""Order statistics of few, large groups by counting instead of sorting.

Cuts from a bounded sample divide each group's values. One pass counts the rows between cuts and at them, with map-side sums, so that only
(group, interval) counts are shuffled. A wanted rank then lies at a cut, which is its value, or between two. Where more rows lie between
than one task may take, that interval is cut again; the last pass shuffles the rows of those few intervals alone. All groups and ranks
share each pass. Cuts decide the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.session import group_rows

# Groups at most, all in the sample; more of them are small and better sorted.
MAX_GROUPS = 1000
SEED = 23
SAMPLE_ROWS = 32_768
# Cuts of one group in one round, and of all groups together.
CUTS, ALL_CUTS = 256, 16_384


def _interval(cuts: Column, value: Column, most: int) -> Column:
    """2k between the k-th cut and the next, 2k - 1 at the k-th cut."""
    strides = [2**i for i in reversed(range(max(1, most.bit_length())))]
    size = F.size(cuts)
    at = F.aggregate(
        F.array(*[F.lit(s) for s in strides]),
        F.lit(0),
        lambda k, s: F.when((k + s <= size) & (F.get(cuts, k + s - 1) <= value), k + s).otherwise(k),
    )
    return F.when((at > 0) & (F.get(cuts, at - 1) == value), 2 * at - 1).otherwise(2 * at)


def _spread(values: list[float], most: int) -> list[float]:
    """Different values of a sorted sample, evenly spread."""
    step = max(1, math.ceil(len(values) / most))
    return sorted(set(values[step - 1 :: step]))


class _Groups:
    """Rows of the sampled groups as (group number, value), and the cuts of each group."""

    def __init__(self, df: DataFrame, by: list[str], keys: list[tuple]):
        self.spark, self.by, self.keys = df.sparkSession, by, keys
        self.df = df
        self.schema = ", ".join([*[f"__by{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by)], "__group int"])

    def _on(self, table: DataFrame) -> Column:
        on = F.lit(True)
        for i, c in enumerate(self.by):
            on = on & self.df[c].eqNullSafe(table[f"__by{i}"])
        return on

    def with_cuts(self, cuts: list[list[float]]) -> DataFrame:
        table = self.spark.createDataFrame([(*k, g, c) for g, (k, c) in enumerate(zip(self.keys, cuts))], self.schema + ", __cuts array<double>")
        most = max(len(c) for c in cuts)
        if self.by:
            rows = self.df.join(F.broadcast(table), self._on(table))
        else:
            rows = self.df.withColumn("__group", F.lit(0)).withColumn("__cuts", F.array(*[F.lit(c) for c in cuts[0]]).cast("array<double>"))
        return rows.select("__group", F.col("__value"), _interval(F.col("__cuts"), F.col("__value"), most).alias("__at"))

    def others(self) -> DataFrame | None:
        if not self.by:
            return None
        table = F.broadcast(self.spark.createDataFrame([(*k, g) for g, k in enumerate(self.keys)], self.schema))
        return self.df.join(table, self._on(table), "left_anti")


def ranks_of(total: int, probs: Sequence[float]) -> set[int]:
    return {f(p * (total - 1)) for p in probs for f in (math.floor, math.ceil)}


def few_group_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float], size: int) -> tuple[list[tuple], DataFrame | None] | None:
    """(group's values and its quantiles for each sampled group, the rows of all other groups); None where groups are many.

    ``size`` is about the number of rows; values are compared as doubles and NULL ones left out.
    """
    by, limit = list(by), group_rows(df.sparkSession)
    rows = df.select(*by, F.col(col).cast("double").alias("__value")).where(F.col("__value").isNotNull())
    drawn = rows.sample(min(1.0, SAMPLE_ROWS / max(1, size)), seed=SEED).limit(4 * SAMPLE_ROWS).collect()
    held: dict[tuple, list[float]] = {}
    for r in drawn:
        held.setdefault(tuple(r[: len(by)]), []).append(r["__value"])
    if len(held) > MAX_GROUPS or not held:
        return None
    keys, per_group = list(held), max(1, min(CUTS, ALL_CUTS // len(held)))
    groups = _Groups(rows, by, keys)
    cuts = [_spread(sorted(v for v in held[k] if v == v), per_group) for k in keys]
    while True:
        counted = groups.with_cuts(cuts).groupBy("__group", "__at").agg(F.count(F.lit(1)).alias("n")).collect()
        known, sought, totals = _located(counted, cuts, list(probs.values()))
        full = {(g, at) for (g, at), (n, _) in sought.items() if n > limit}
        if not full:
            break
        finer = _refined(groups, cuts, full, sum(sought[x][0] for x in full), per_group, sought, known)
        if finer is None:  # nothing between the cuts can be told apart any more
            break
        cuts = finer
    known |= _picked(groups, cuts, sought)
    out = []
    for g, key in enumerate(keys):
        values = []
        for p in probs.values():
            at = p * (totals[g] - 1)
            low, high = known[g, math.floor(at)], known[g, math.ceil(at)]
            values.append(low + (high - low) * (at - math.floor(at)))
        out.append((*key, *values))
    return out, groups.others()


def _located(counted, cuts, probs):
    """Values of ranks that lie at a cut; for the others {(group, interval): (rows, [(place in it, rank)])}; rows of each group."""
    by_group: dict[int, dict[int, int]] = {}
    for r in counted:
        by_group.setdefault(r["__group"], {})[r["__at"]] = r["n"]
    known, sought, totals = {}, {}, {}
    for g, counts in by_group.items():
        totals[g] = sum(counts.values())
        wanted, below = sorted(ranks_of(totals[g], probs)), 0
        for at in sorted(counts):
            n = counts[at]
            for rank in wanted:
                if below <= rank < below + n:
                    if at % 2:
                        known[g, rank] = cuts[g][at // 2]
                    else:
                        sought.setdefault((g, at), (n, []))[1].append((rank - below, rank))
            below += n
    return known, sought, totals


def _refined(groups: _Groups, cuts, full, rows: int, per_group: int, sought, known) -> list[list[float]] | None:
    """Cuts within the full intervals, together with those that hold or border a wanted rank."""
    spark = groups.spark
    table = F.broadcast(spark.createDataFrame(sorted(full), "__group int, __at int"))
    inside = groups.with_cuts(cuts).join(table, ["__group", "__at"]).select("__group", "__at", "__value")
    values: dict[tuple[int, int], list[float]] = {}
    for r in inside.sample(min(1.0, SAMPLE_ROWS / max(1, rows)), seed=SEED + 1).limit(4 * SAMPLE_ROWS).collect():
        values.setdefault((r["__group"], r["__at"]), []).append(r["__value"])
    new: list[set[float]] = [set() for _ in cuts]
    for g, at in sought:
        new[g] |= set(cuts[g][max(0, at // 2 - 1) : at // 2 + 1])
    for (g, _), value in known.items():
        new[g].add(value)
    before = [set(c) for c in new]
    for (g, _), found in values.items():
        new[g] |= set(_spread(sorted(v for v in found if v == v), per_group))
    return [sorted(c) for c in new] if new != before else None


def _picked(groups: _Groups, cuts, sought) -> dict[tuple[int, int], float]:
    """Values of the ranks within the sought intervals, whose rows alone are shuffled."""
    if not sought:
        return {}
    table = groups.spark.createDataFrame([(g, at, [p for p, _ in places]) for (g, at), (_, places) in sought.items()], "__group int, __at int, __places array<long>")
    rows = groups.with_cuts(cuts).join(F.broadcast(table), ["__group", "__at"])
    counts = rows.groupBy("__group", "__at", "__value", "__places").agg(F.count(F.lit(1)).alias("__n"))
    spec = Window.partitionBy("__group", "__at").orderBy("__value")
    counts = counts.withColumn("__through", F.sum("__n").over(spec.rowsBetween(Window.unboundedPreceding, 0)))
    hit = counts.withColumn("__place", F.explode("__places")).where((F.col("__place") < F.col("__through")) & (F.col("__place") >= F.col("__through") - F.col("__n")))
    out = {}
    for r in hit.select("__group", "__at", "__place", "__value").collect():
        ranks = dict(sought[r["__group"], r["__at"]][1])
        out[r["__group"], ranks[r["__place"]]] = r["__value"]
    return out
