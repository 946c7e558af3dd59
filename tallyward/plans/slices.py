"""Ordered work over groups of any size.

A window function hands each group to one task. That is fine until one device, class or IP holds a
large part of the table. Here a group that outgrows ``spark.tallyward.groupRows`` is cut into
contiguous slices of its sort order; every slice is its own window partition, and what the earlier
slices contribute (a count, a sum, the last value ...) is joined back from a carry table with one row
per slice. Where no group is too big there are no cuts and the plan is the
ordinary one: one exchange, one sort, one window.

Cuts come from a random sample. Up to ``MAX_SLICES`` of them are literals of the plan. Where more slices are
needed, these are the first of two levels: each first slice has a short array of cuts of its own, worked out on the
executors and joined from a table, and what earlier slices contribute is summed up in two steps, over the first slices and within
each. Cuts decide balance only, never results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.plans.selection import few_group_quantiles
from tallyward.session import broadcast_rows, group_rows, select_rows, settle

MAX_SLICES = 8192
FINER = 1 << 32
SAMPLE_PER_SLICE = 32
SEED = 17

_SLICE = "__slice"


def _sortable(df: DataFrame, name: str) -> Column:
    """The column in a form that survives a trip through the driver without a time zone."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    return F.col(name)


def search_sorted(cuts: Column, row: Column, most: int) -> Column:
    """How many of at most ``most`` sorted cuts are at or below the row."""
    strides = [2**i for i in reversed(range(max(1, most.bit_length())))]
    size = F.size(cuts)
    return F.aggregate(
        F.array(*[F.lit(s) for s in strides]),
        F.lit(0),
        lambda at, stride: F.when((at + stride <= size) & (F.get(cuts, at + stride - 1) <= row), at + stride).otherwise(at),
    )


@dataclass(frozen=True)
class Cuts:
    """Sorted cut points over (keys, order). A row's slice is the number of cuts at or below it.

    With a second level, ``finer`` (__first, __cuts) divides the first slices; a slice's number is then that of its first slice
    times ``FINER``, and its place in it.
    """

    keys: list[str]
    order: list[str]
    types: list[str] = field(default_factory=list)
    points: list[tuple] = field(default_factory=list)
    finer: DataFrame | None = None
    most_finer: int = 0

    def __bool__(self) -> bool:
        return bool(self.points)

    def _row(self, df: DataFrame) -> Column:
        return F.struct(*[_sortable(df, c).alias(f"c{i}") for i, c in enumerate(self.keys + self.order)])

    def _first(self, df: DataFrame) -> Column:
        names = [f"c{i}" for i in range(len(self.types))]
        schema = "array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, self.types)) + ">>"
        text = json.dumps([dict(zip(names, p)) for p in self.points], default=str)
        return search_sorted(F.from_json(F.lit(text), schema), self._row(df), len(self.points))  # folded to one literal array

    def sliced(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of each row's slice."""
        if not self.points:
            return df.withColumn(_SLICE, F.lit(0).cast("long"))
        if self.finer is None:
            return df.withColumn(_SLICE, self._first(df).cast("long"))
        table = self.finer if self.finer.count() > broadcast_rows(df.sparkSession) else F.broadcast(self.finer)  # a row for each first slice
        rows = df.withColumn("__row", self._row(df)).withColumn("__first", self._first(df)).join(table, "__first", "left")
        place = F.coalesce(search_sorted(F.col("__cuts"), F.col("__row"), self.most_finer), F.lit(0))
        return rows.select(*df.columns, (F.col("__first").cast("long") * FINER + place).alias(_SLICE))

    def big_keys(self, df: DataFrame) -> DataFrame:
        """The keys that are cut."""
        width = len(self.keys)
        rows = sorted({p[:width] for p in self.points}, key=repr)
        schema = ",".join(f"__key{i} {t}" for i, t in enumerate(self.types[:width]))
        first = df.sparkSession.createDataFrame(rows, schema)
        if self.finer is None:
            return first
        finer = self.finer.select(F.explode("__cuts").alias("p")).select(*[F.col(f"p.c{i}").alias(f"__key{i}") for i in range(width)])
        return first.union(finer).distinct()


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int | None = None) -> Cuts:
    """Cut points for the groups of ``df`` that one task should not take whole.

    ``size`` is an upper bound of the row count where the caller knows one; without it the table is
    counted. At or below the limit for one group nothing is sampled.
    """
    keys, order = list(keys), list(order)
    none = Cuts(keys, order)
    limit = group_rows(df.sparkSession)
    if size is not None and size <= limit:
        return none
    total = df.count()
    if total <= limit:
        return none
    slices = math.ceil(total / limit)
    wanted = min(slices, MAX_SLICES)
    rows = df.select(*[_sortable(df, c).alias(f"c{i}") for i, c in enumerate(keys + order)])
    types = [f.dataType.simpleString() for f in rows.schema.fields]
    fraction = min(1.0, wanted * SAMPLE_PER_SLICE / total)
    sample = [tuple(r) for r in rows.sample(fraction, seed=SEED).orderBy(*rows.columns).collect()]
    step = max(1, len(sample) // wanted)
    points = list(dict.fromkeys(sample[step - 1 :: step]))[:MAX_SLICES]
    if slices > MAX_SLICES and points:
        return _with_finer(Cuts(keys, order, types, points), rows, slices, total)
    if keys:
        width, seen = len(keys), {}
        for p in points:
            seen[p[:width]] = seen.get(p[:width], 0) + 1
        points = [p for p in points if seen[p[:width]] > 1]
    return Cuts(keys, order, types, points)


def _with_finer(cuts: Cuts, rows: DataFrame, slices: int, total: int) -> Cuts:
    """Second cuts for every first slice, from a larger sample that stays on the executors."""
    width = len(cuts.keys)
    sample = rows.sample(min(1.0, slices * SAMPLE_PER_SLICE / total), seed=SEED + 1).withColumn("__p", F.struct(*rows.columns))
    named = Cuts([], rows.columns, cuts.types, cuts.points)
    held = sample.withColumn("__first", named._first(rows)).groupBy("__first").agg(F.sort_array(F.collect_list("__p")).alias("__all"))
    step = F.lit(SAMPLE_PER_SLICE)
    every = F.filter("__all", lambda p, i: i % step == step - 1)  # a few samples' worth of a first slice: bounded by the sampling
    points = settle(held.select("__first", F.explode(F.array_distinct(every)).alias("__p")))
    if width:  # only groups with several cuts, or cut by the first level, are too big
        key = F.struct(*[F.col(f"__p.c{i}").alias(f"c{i}") for i in range(width)])
        first = rows.sparkSession.createDataFrame(cuts.points, ",".join(f"c{i} {t}" for i, t in enumerate(cuts.types)))
        first = first.select(F.struct(*[f"c{i}" for i in range(width)]).alias("__key"))
        points = points.withColumn("__key", key)
        big = points.select("__key").unionByName(first).groupBy("__key").count().where("count > 1").select("__key").unionByName(first).distinct()
        points = points.alias("a").join(big.alias("b"), F.col("a.__key").eqNullSafe(F.col("b.__key")), "left_semi").drop("__key")
    finer = settle(points.groupBy("__first").agg(F.sort_array(F.collect_list("__p")).alias("__cuts")))
    return replace(cuts, finer=finer, most_finer=finer.agg(F.max(F.size("__cuts"))).first()[0] or 0)


@dataclass(frozen=True)
class Over:
    """One running value: ``how`` in count, sum, min, max, last; ``frame`` in before, through, group.

    ``before`` ends at the previous row, ``through`` at the current one, ``group`` is the whole key.
    Sums and counts of an empty frame are 0, the others NULL. ``last`` skips NULL.
    """

    name: str
    how: str
    value: Column
    frame: str = "through"

    def window(self, spec) -> Column:
        agg = {
            "count": F.count,
            "sum": F.sum,
            "min": F.min,
            "max": F.max,
            "last": lambda c: F.last(c, ignorenulls=True),
        }[self.how](self.value)
        first = Window.unboundedPreceding
        if self.frame == "group":
            return agg.over(spec.rowsBetween(first, Window.unboundedFollowing))
        return agg.over(spec.rowsBetween(first, -1 if self.frame == "before" else 0))

    def total(self, position: Column) -> Column:
        if self.how == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), position))
        return {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[self.how](self.value)

    def rolled(self, total: Column, part: Column) -> Column:
        """Totals of slices as the total of the slices together."""
        if self.how == "last":
            return F.max_by(total, F.when(total.isNotNull(), part))
        return {"min": F.min, "max": F.max}.get(self.how, F.sum)(total)

    def carried(self, column: Column, spec) -> Column:
        how = "sum" if self.how == "count" else self.how
        frame = self.frame if self.frame == "group" else "before"
        return Over(self.name, how, column, frame).window(spec)

    def merged(self, here: Column, carry: Column | None) -> Column:
        if carry is not None:
            if self.frame == "group":
                here = F.coalesce(carry, here)
            elif self.how in ("count", "sum"):
                here = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            elif self.how == "min":
                here = F.least(here, carry)
            elif self.how == "max":
                here = F.greatest(here, carry)
            else:
                here = F.coalesce(here, carry)
        return F.coalesce(here, F.lit(0)) if self.how in ("count", "sum") else here


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[Over],
    size: int | None = None,
    derived: bool = False,
    cuts: Cuts | None = None,
) -> DataFrame:
    """``df`` with one column per ``Over``, computed per ``keys`` in ``order`` (ascending, NULL first).

    ``derived=True`` says that ``df`` is costly to compute (it has shuffles of its own): it is then
    settled before it is read for the second and third time, and only when cuts may be needed.
    """
    keys, order, values = list(keys), list(order), list(values)
    if cuts is None:
        if derived and (size is None or size > group_rows(df.sparkSession)):
            df = settle(df)
        cuts = cut_points(df, keys, order, size)
    by_order = [F.col(c).asc() for c in order]
    if not cuts:
        spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        spec = spec.orderBy(*by_order)
        plain = {f"__local{i}": v.window(spec) for i, v in enumerate(values)}
        out = df.select("*", *[c.alias(n) for n, c in plain.items()])
        return out.select(*df.columns, *[v.merged(F.col(f"__local{i}"), None).alias(v.name) for i, v in enumerate(values)])

    sliced = cuts.sliced(df)
    carry = _carry(sliced, keys, order, values, cuts)
    spec = Window.partitionBy(*keys, _SLICE).orderBy(*by_order)
    out = sliced.select("*", *[v.window(spec).alias(f"__local{i}") for i, v in enumerate(values)])
    on = out[_SLICE] == carry["__part"]
    for i, k in enumerate(keys):
        on = on & out[k].eqNullSafe(carry[f"__key{i}"])
    if cuts.finer is None:  # a row for each slice
        carry = F.broadcast(carry)
    out = out.join(carry, on, "left")
    return out.select(
        *[out[c] for c in df.columns],
        *[v.merged(out[f"__local{i}"], carry[f"__carry{i}"]).alias(v.name) for i, v in enumerate(values)],
    )


def _carry(sliced: DataFrame, keys, order, values, cuts: Cuts) -> DataFrame:
    """What earlier slices contribute to each slice of a cut group."""
    rows = sliced
    if keys:
        big = cuts.big_keys(sliced)
        on = [sliced[k].eqNullSafe(big[f"__key{i}"]) for i, k in enumerate(keys)]
        rows = sliced.join(F.broadcast(big) if cuts.finer is None else big, on, "left_semi")
    position = F.struct(*[F.col(c) for c in order])
    totals = rows.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col(_SLICE).alias("__part")).agg(
        *[v.total(position).alias(f"__total{i}") for i, v in enumerate(values)]
    )
    names = [f"__key{i}" for i in range(len(keys))]
    if cuts.finer is None:
        spec = (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("__part")
        return totals.select(*names, "__part", *[v.carried(F.col(f"__total{i}"), spec).alias(f"__carry{i}") for i, v in enumerate(values)])

    totals = settle(totals.withColumn("__first", F.floor(F.col("__part") / FINER).cast("long")))
    firsts = totals.groupBy(*names, "__first").agg(*[v.rolled(F.col(f"__total{i}"), F.col("__part")).alias(f"__total{i}") for i, v in enumerate(values)])
    spec = (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("__first")
    firsts = firsts.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("__first").alias("__first_"), *[v.carried(F.col(f"__total{i}"), spec).alias(f"__before{i}") for i, v in enumerate(values)])
    spec = Window.partitionBy(*names, "__first").orderBy("__part")
    within = totals.select(*names, "__first", "__part", *[replace(v, frame="before").carried(F.col(f"__total{i}"), spec).alias(f"__within{i}") for i, v in enumerate(values)])
    on = within["__first"] == firsts["__first_"]
    for n in names:
        on = on & within[n].eqNullSafe(firsts[f"{n}_"])
    met = within.join(firsts, on)
    return met.select(*names, "__part", *[v.merged(F.col(f"__within{i}"), F.col(f"__before{i}")).alias(f"__carry{i}") for i, v in enumerate(values)])


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", size: int | None = None, derived: bool = False) -> DataFrame:
    """1-based position of every row in the total order, without sending all rows to one task."""
    return running(df, [], order, [Over(name, "count", F.lit(1), "through")], size, derived)


def row_at(df: DataFrame, order: Sequence[str], position: int, size: int | None = None) -> tuple | None:
    """The order key of the row at a 0-based position, or None past the end.

    Counts per slice find the slice that holds the position; only that slice is sorted.
    """
    order = list(order)
    cuts = cut_points(df, [], order, size)
    rows = df.select(*[F.col(c) for c in order])
    if cuts:
        rows, seen = cuts.sliced(rows), 0
        for part in (F.floor(F.col(_SLICE) / FINER), F.col(_SLICE)) if cuts.finer is not None else (F.col(_SLICE),):
            for held, n in sorted(tuple(r) for r in rows.groupBy(part.alias("part")).count().collect()):
                if position < seen + n:
                    rows = rows.where(part == held)
                    break
                seen += n
            else:
                return None
        rows, position = rows.drop(_SLICE), position - seen
    spec = Window.partitionBy(F.lit(0)).orderBy(*order)
    hit = (
        rows.select(*[_sortable(rows, c).alias(f"c{i}") for i, c in enumerate(order)], F.row_number().over(spec).alias("__n"))
        .where(F.col("__n") == position + 1)
        .drop("__n")
        .first()
    )
    return tuple(hit) if hit else None


def precedes(df: DataFrame, order: Sequence[str], cut: tuple | None, inclusive: bool = False) -> Column:
    """Row comes before ``cut`` (a key from ``row_at``); every row does when ``cut`` is None.

    Written column by column rather than on a struct so that the leading comparison reaches the scan.
    """
    if cut is None:
        return F.lit(True)
    result = F.lit(inclusive)
    for name, value in reversed(list(zip(order, cut))):
        kind, col = df.schema[name].dataType, F.col(name)
        if value is None:  # NULL sorts first: nothing is below it
            result = col.isNull() & result
            continue
        point = F.lit(value)
        if isinstance(kind, T.TimestampType):
            point = F.timestamp_micros(point)
        elif isinstance(kind, T.TimestampNTZType):
            point = F.timestamp_micros(point).cast("timestamp_ntz")
        elif isinstance(kind, T.DateType):
            point = F.date_from_unix_date(point)
        else:
            point = point.cast(kind)
        result = col.isNull() | (col < point) | ((col == point) & result)
    return result


def ranked_for(
    df: DataFrame, by: Sequence[str], col: str, tie: str, name: str, size: int | None = None, derived: bool = False
) -> DataFrame:
    """``df`` with each row's place among the non-NULL values of its group, for ``quantile_of``.

    Several of these on the same ``by`` share one exchange: only the sort differs.
    """
    values = [Over(f"__below_{name}", "count", F.col(col), "before"), Over(f"__all_{name}", "count", F.col(col), "group")]
    return running(df, by, [col, tie], values, size, derived)


def quantile_of(col: str, name: str, p: float, n: Column | None = None) -> Column:
    """Aggregate: the interpolated quantile of a group of ranked rows (``n`` rows stand in one)."""
    value, below, total = F.col(col).cast("double"), F.col(f"__below_{name}"), F.col(f"__all_{name}")
    last = below + (F.lit(1) if n is None else n) - 1
    at = F.lit(float(p)) * (total - 1)
    low, high = F.floor(at), F.ceil(at)

    def held(x: Column) -> Column:
        return F.max(F.when(value.isNotNull() & (below <= x) & (x <= last), value))

    return held(low) + (held(high) - held(low)) * F.max(F.when(value.isNotNull(), at - low))


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float], size: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, NULL values skipped.

    Few groups of many rows are settled by counting (``plans.selection``): their values are not shuffled. Otherwise equal values are
    counted together before the shuffle, and for many small groups ``ranked_for`` and ``quantile_of`` save that exchange.
    """
    by, spark = list(by), df.sparkSession
    rows = df.count() if size is None or size > group_rows(spark) else size
    if rows > min(select_rows(spark), group_rows(spark)):
        selected = few_group_quantiles(df, by, col, probs, rows)
        if selected is not None:
            found, others = selected
            kinds = [df.schema[c].dataType.simpleString() for c in by]
            schema = ", ".join([*[f"{c} {t}" for c, t in zip(by, kinds)], *[f"`{n}` double" for n in probs]])
            out = spark.createDataFrame(found, schema)
            return out if others is None else out.unionByName(_sorted_quantiles(others, by, "__value", probs, rows))
    return _sorted_quantiles(df, by, col, probs, size)


def _sorted_quantiles(df: DataFrame, by: list[str], col: str, probs: dict[str, float], size: int | None) -> DataFrame:
    vals = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    ranked = running(vals, by, [col], [Over("__below_v", "sum", n, "before"), Over("__all_v", "sum", n, "group")], size, derived=True)
    return ranked.groupBy(*by).agg(*[quantile_of(col, "v", p, n).alias(name) for name, p in probs.items()])
