"""Descriptive statistics of transactions: counts, shares, risk tables, spread, outliers.

Group-bys combine on the map side, so a key of any size reaches its reducer as a few partial rows.
Medians and quartiles go through ``plans.slices.quantiles``: the built-in exact percentile gathers a
whole group in one task's memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.columns import age_group, mean_of, ratio, seconds_between, with_time_parts
from tallyward.plans.joins import attach, measured
from tallyward.plans.slices import Over, quantiles, running

_ID = "transaction_id"


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def schema_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "name string, type string")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False, size: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of each numeric column, one row per statistic.

    One pass for the moments of all columns and one shuffle of (column, value) for all quartiles.
    """
    cols = list(cols or numeric_columns(df))
    probs = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    aggs = []
    for c in cols:
        value = F.col(c).cast("double")
        stats = {
            "count": F.count(c).cast("double"),
            "mean": mean_of(c),
            "std": F.stddev_samp(value),
            "min": F.min(value),
            "max": F.max(value),
        }
        if approximate:
            stats |= {n: F.percentile_approx(value, p, 10000) for n, p in probs.items()}
        aggs += [
            F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("statistic"), v.alias("value")) for n, v in stats.items()])
        ]
    out = df.agg(F.concat(*aggs).alias("s")).select(F.inline("s"))
    if not approximate:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], [f"`{c}`" for c in cols], "column", "value")
        bound = None if size is None else size * len(cols)
        q = quantiles(long, ["column"], "value", probs, bound)
        out = out.unionByName(q.unpivot(["column"], [f"`{n}`" for n in probs], "statistic", "value"))
    return out


def value_counts(df: DataFrame, *cols: str, normalize: bool = False, keep_null: bool = False) -> DataFrame:
    """Rows per distinct value; as shares of the counted rows when ``normalize``."""
    rows = df if keep_null else df.dropna(subset=list(cols))
    counts = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
    if not normalize:
        return counts
    total = counts.agg(F.sum("count").alias("n")).scalar()  # over the same exchange: the rows are read once
    return counts.select(*cols, ratio(F.col("count"), total).alias("share"))


def shares_within(df: DataFrame, group: str, col: str, size: int | None = None) -> DataFrame:
    """Share of each value among the rows of its group."""
    counts = df.dropna(subset=[group, col]).groupBy(group, col).agg(F.count(F.lit(1)).alias("count"))
    out = running(counts, [group], [col], [Over("__all", "sum", F.col("count"), "group")], size, derived=True)
    return out.select(group, col, "count", ratio("count", "__all").alias("share"))


def counts_by_key(df: DataFrame, keys: Sequence[str] = ("user_id", "device_id", "ip_address"), size: int | None = None) -> DataFrame:
    """Next to each row, how many rows share its user, device and IP."""
    out = df
    for k in keys:
        counts = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias(f"transactions_by_{k}"))
        out = attach(out, counts, [k], [_ID], size=size, source=df)
    return out


def risk_table(df: DataFrame, *keys: str) -> DataFrame:
    """Transactions, frauds and fraud rate per key; rows without a key are left out."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count("is_fraud").alias("transactions"), F.sum("is_fraud").cast("long").alias("frauds"))
        .withColumn("fraud_rate", ratio("frauds", "transactions"))
    )


def risky(table: DataFrame, rate: float = 0.1, more_than: int = 1) -> DataFrame:
    return table.where((F.col("fraud_rate") > rate) & (F.col("transactions") > more_than))


def device_ip_consistency(df: DataFrame, size: int | None = None) -> DataFrame:
    """Devices per IP and IPs per device next to each row, and whether they belong only to each other.

    ``device_ip_user_consistency`` also asks that device and IP made one transaction each.
    """
    per_ip = df.groupBy("ip_address").agg(
        F.count_distinct("device_id").alias("devices_by_ip"), F.count(F.lit(1)).alias("users_by_ip_address")
    )
    per_device = df.groupBy("device_id").agg(
        F.count_distinct("ip_address").alias("ip_by_device"), F.count(F.lit(1)).alias("users_by_device_id")
    )
    out = attach(df, per_ip, ["ip_address"], [_ID], size=size)
    out = attach(out, per_device, ["device_id"], [_ID], size=size, source=df)
    pair = (F.col("devices_by_ip") == 1) & (F.col("ip_by_device") == 1)
    single = (F.col("users_by_ip_address") == 1) & (F.col("users_by_device_id") == 1)
    return out.withColumns({"device_ip_consistency": pair, "device_ip_user_consistency": pair & single})


def inconsistent_by_class(df: DataFrame, size: int | None = None) -> DataFrame:
    """Rows per class whose device and IP do not belong only to each other.

    Counted over distinct (device, ip) pairs with their rows per class, not over rows: nothing is
    joined back to the transactions.
    """
    pairs = (
        df.dropna(subset=["device_id", "ip_address"])
        .groupBy("device_id", "ip_address")
        .agg(
            F.count(F.when(F.col("is_fraud") == 0, F.col("user_id"))).alias("__c0"),
            F.count(F.when(F.col("is_fraud") == 1, F.col("user_id"))).alias("__c1"),
        )
    )
    one = F.lit(1)
    pairs = running(pairs, ["ip_address"], ["device_id"], [Over("__d", "count", one, "group")], size, derived=True)
    pairs = running(pairs, ["device_id"], ["ip_address"], [Over("__i", "count", one, "group")], size, derived=True)
    mixed = pairs.where((F.col("__d") > 1) | (F.col("__i") > 1)).agg(F.sum("__c0").alias("0"), F.sum("__c1").alias("1"))
    return mixed.unpivot([], ["0", "1"], "is_fraud", "transactions").select(
        F.col("is_fraud").cast("int").alias("is_fraud"), F.coalesce("transactions", F.lit(0)).alias("transactions")
    )


def repeated_pairs(df: DataFrame, a: str = "device_id", b: str = "ip_address", more_than: int = 1) -> DataFrame:
    return (
        df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("user_id").alias("transactions")).where(F.col("transactions") > more_than)
    )


def mean_by(table: DataFrame, by: str, col: str, name: str | None = None) -> DataFrame:
    """Second-level mean, for example the mean fraud rate of devices by their number of transactions."""
    return table.groupBy(by).agg(F.avg(col).alias(name or f"mean_{col}"))


def box_summary(df: DataFrame, by: str, col: str, size: int | None = None) -> DataFrame:
    """Quartiles, and whiskers at the last value within 1.5 IQR of the box, per group of ``by``."""
    box, small = measured(_fences(df, by, col, size))
    value = F.col(col).cast("double")
    inside = _with_box(df, box, small, by, size).where((value >= F.col("low")) & (value <= F.col("high")))
    ends = inside.groupBy(by).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return box.select(by, "q1", "median", "q3").join(ends, by, "left")


def iqr_outliers(df: DataFrame, by: str, col: str, size: int | None = None) -> DataFrame:
    """Rows strictly outside the 1.5 IQR fences of their group."""
    value = F.col(col).cast("double")
    outside = (value < F.col("low")) | (value > F.col("high"))
    rows = _with_box(df, *measured(_fences(df, by, col, size)), by, size)
    return rows.groupBy(by).agg(F.sum(F.when(outside, 1).otherwise(0)).alias("outliers"))


def _fences(df: DataFrame, by: str, col: str, size: int | None) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return quantiles(df.where(F.col(by).isNotNull()), [by], col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, size).withColumns(
        {"low": F.col("q1") - 1.5 * iqr, "high": F.col("q3") + 1.5 * iqr}
    )


def _with_box(df: DataFrame, box: DataFrame, small: bool, by: str, size: int | None) -> DataFrame:
    salt = [_ID] if _ID in df.columns else df.columns
    return df.join(F.broadcast(box), by) if small else attach(df, box, [by], salt, "inner", size)


def month_baselines(df: DataFrame, size: int | None = None) -> DataFrame:
    """Level, spread and fraud rate of each calendar month: at most twelve rows."""
    rows = df.withColumn("month", F.month("purchase_time").cast("long"))
    stats = rows.groupBy("month").agg(
        mean_of("purchase_value").alias("mean_value"),
        F.stddev_samp(F.col("purchase_value").cast("double")).alias("std_value"),
        ratio(F.sum("is_fraud"), F.count("is_fraud")).alias("fraud_rate"),
    )
    return stats.join(quantiles(rows, ["month"], "purchase_value", {"median_value": 0.5}, size), "month", "left")


def class_pivot(df: DataFrame, by: str, col: str) -> DataFrame:
    """Mean of ``col`` per group, one column per class."""
    cell = lambda c: ratio(
        F.sum(F.when(F.col("is_fraud") == c, F.col(col))), F.count(F.when(F.col("is_fraud") == c, F.col(col)))
    )
    return df.groupBy(by).agg(cell(0).alias("class_0"), cell(1).alias("class_1"))


def value_by_time_part(df: DataFrame, part: str) -> DataFrame:
    """Mean value by purchase_month, purchase_day or purchase_hour."""
    return with_time_parts(df).groupBy(part).agg(mean_of("purchase_value").alias("mean_value"))


def consistency_crosstab(df: DataFrame, col: str, key: str = "device_id", binary: bool = True) -> DataFrame:
    """Class shares of rows by how many distinct ``col`` their device shows (or whether it is one).

    Devices carry their class counts, so the table is built from one row per device.
    """
    devices = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_distinct(col).alias("__d"),
        F.count(F.when(F.col("is_fraud") == 0, 1)).alias("__c0"),
        F.count(F.when(F.col("is_fraud") == 1, 1)).alias("__c1"),
    )
    name = f"{col}_device_consistency" if binary else col
    level = (F.col("__d") == 1).cast("int") if binary else F.col("__d")
    table = devices.groupBy(level.alias(name)).agg(F.sum("__c0").alias("__c0"), F.sum("__c1").alias("__c1"))
    total = F.col("__c0") + F.col("__c1")
    return table.select(name, ratio(F.col("__c0"), total).alias("class_0"), ratio(F.col("__c1"), total).alias("class_1"))


def indicator_shares(df: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """Per 0/1 column: its sum in each class and the classes' shares of it."""
    sums = df.groupBy("is_fraud").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in indicators])
    long = sums.unpivot(["is_fraud"], [f"`{c}`" for c in indicators], "indicator", "n")
    cell = lambda c: F.coalesce(F.sum(F.when(F.col("is_fraud") == c, F.col("n"))), F.lit(0))
    table = long.groupBy("indicator").agg(cell(0).alias("class_0"), cell(1).alias("class_1"))
    total = F.col("class_0") + F.col("class_1")
    return table.withColumns({"share_0": ratio(F.col("class_0"), total), "share_1": ratio(F.col("class_1"), total)})


def class_balance(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows per class and positives over negatives, in one row."""
    one, zero = F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    return df.agg(zero.alias("negatives"), one.alias("positives")).withColumn("imbalance_ratio", ratio("positives", "negatives"))


def entity_lifespan(df: DataFrame, key: str = "device_id") -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min("purchase_time").alias("first_purchase"),
            F.max("purchase_time").alias("last_purchase"),
            F.count("purchase_time").alias("transactions"),
            F.max("is_fraud").alias("any_fraud"),
        )
        .withColumn("lifespan_days", seconds_between("first_purchase", "last_purchase") / 86400)
    )


def deviation_by_group(df: DataFrame, group: str | None = None, size: int | None = None) -> DataFrame:
    """Each value minus the mean and the median of its group (by default its age class)."""
    if group is None:
        df, group = df.withColumn("age_group", age_group()), "age_group"
    stats, small = measured(group_levels(df, group, size))
    value = F.col("purchase_value").cast("double")
    if small:
        out = df.join(F.broadcast(stats), group, "left")
    else:
        out = attach(df, stats, [group], [_ID], size=size)
    return out.select(
        *[df[c] for c in df.columns],
        "mean",
        "median",
        (value - F.col("mean")).alias("dev_from_mean"),
        (value - F.col("median")).alias("dev_from_median"),
    )


def group_levels(df: DataFrame, group: str, size: int | None = None) -> DataFrame:
    rows = df.where(F.col(group).isNotNull())
    means = rows.groupBy(group).agg(mean_of("purchase_value").alias("mean"))
    return means.join(quantiles(rows, [group], "purchase_value", {"median": 0.5}, size), group)


def sum_by_class(df: DataFrame, col: str, label: str = "is_fraud") -> DataFrame:
    if col not in df.columns:
        raise ValueError(f"no column {col} among {df.columns}")
    return df.groupBy(label).agg(F.sum(col).alias(f"sum_{col}"))


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, as rows (a, b, r), pairs with a NULL left out of that pair.

    NULL where a column does not vary. One pass over the table for all pairs.
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    def r(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        sx = F.stddev_samp(F.when(y.isNotNull(), x))
        sy = F.stddev_samp(F.when(x.isNotNull(), y))
        return F.try_divide(F.covar_samp(x, y), sx * sy)

    row = df.agg(*[r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"r{i}").alias("r")))
    return row.select(F.inline(F.array(*cells)))


def correlated_pairs(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairs of the upper triangle by strength of correlation; weaker ones are left out."""
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    strength = F.abs("r")
    return (
        matrix.where(place[F.col("a")] < place[F.col("b")])
        .withColumn(
            "bin",
            F.when(strength >= 0.9, "0.9-1").when(strength >= 0.8, "0.8-0.9").when(strength >= 0.7, "0.7-0.8"),
        )
        .where(F.col("bin").isNotNull())
    )
