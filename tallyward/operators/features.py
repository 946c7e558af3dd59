"""Point-in-time features of devices.

Everything is a running value per device in the order (purchase_time, transaction_id), so all of it
shares one exchange, one sort and one window, and a device of any size is cut (``plans.slices``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.columns import equals_flag, log_or_null, mean_of, month_cycle, ratio, seconds_between
from tallyward.operators.profile import month_baselines
from tallyward.plans.joins import attach
from tallyward.plans.slices import Over, cut_points, quantiles, running
from tallyward.session import settle

NO_PREVIOUS_SECONDS = 99999.0

_TIME, _ID, _KIND = "purchase_time", "transaction_id", "__kind"


def _same_so_far(prefix: str) -> Column:
    """One distinct member up to this row, NULL counting as a member."""
    present = F.col(f"{prefix}_n")
    return (present == 0) | ((present == F.col("__rows")) & (F.col(f"{prefix}_min") == F.col(f"{prefix}_max")))


def device_features(
    txns: DataFrame,
    mode: str = "online",
    labels: DataFrame | str | None = None,
    size: int | None = None,
) -> DataFrame:
    """The eight features of each transaction, from what was known before it.

    ``mode``: "online" numbers a device's transactions 1,2,3.. and divides frauds by the number
    including this one; "offline" numbers them 1,1,2.. and divides by the number before this one.

    ``labels``: None leaves the fraud rate at 0; "immediate" knows the label of every earlier row of
    the device; a label table (transaction_id, device_id, is_fraud, arrival_time) counts the frauds
    whose label arrived before the transaction, a label at the same instant being too late.
    """
    if mode not in ("online", "offline"):
        raise ValueError("mode must be 'online' or 'offline'")
    if isinstance(labels, str) and labels != "immediate":
        raise ValueError("labels must be None, 'immediate' or a label table")
    base = txns.columns
    by_table = isinstance(labels, DataFrame)
    if by_table:
        events = txns.withColumn(_KIND, F.lit(0)).unionByName(
            labels.select(
                _ID,
                "device_id",
                F.col("arrival_time").alias(_TIME),
                F.col("is_fraud").cast("int").alias("is_fraud"),
                F.lit(1).alias(_KIND),
            ),
            allowMissingColumns=True,
        )
        is_txn, order = F.col(_KIND) == 0, [_TIME, _KIND, _ID]
        frauds = F.when(~is_txn & (F.col("is_fraud") == 1), 1).otherwise(0).cast("long")
        size = None if size is None else 2 * size
    else:
        events, is_txn, order = txns, F.lit(True), [_TIME, _ID]
        known = labels == "immediate"
        frauds = F.when(F.col("is_fraud") == 1, 1).otherwise(0).cast("long") if known else F.lit(0).cast("long")

    def of_txn(c: str) -> Column:
        return F.when(is_txn, F.col(c)) if by_table else F.col(c)

    one = F.when(is_txn, 1) if by_table else F.lit(1)
    values = [
        Over("__rows", "count", one, "through"),
        Over("__before", "count", one, "before"),
        Over("__sum", "sum", of_txn("purchase_value"), "before"),
        Over("__last", "last", of_txn(_TIME), "before"),
        Over("__first", "min", of_txn(_TIME), "through"),
        Over("__frauds", "sum", frauds, "before"),
    ]
    for c, p in (("ip_address", "__ip"), ("source", "__src")):
        values += [
            Over(f"{p}_n", "count", of_txn(c), "through"),
            Over(f"{p}_min", "min", of_txn(c), "through"),
            Over(f"{p}_max", "max", of_txn(c), "through"),
        ]
    out = running(events, ["device_id"], order, values, size)
    if by_table:
        out = out.where(is_txn)
    n = F.col("__before")
    return out.select(
        *base,
        (n + 1 if mode == "online" else F.greatest(n, F.lit(1))).cast("long").alias("txn_count"),
        _same_so_far("__ip").alias("device_ip_consistency"),
        _same_so_far("__src").alias("device_source_consistency"),
        seconds_between("signup_time", _TIME).alias("time_setup_to_txn_seconds"),
        F.coalesce(seconds_between("__last", _TIME), F.lit(NO_PREVIOUS_SECONDS)).alias("time_since_last_device_txn"),
        F.coalesce(
            F.abs(F.col("purchase_value").cast("double") - ratio("__sum", F.nullif(n, F.lit(0)))), F.lit(0.0)
        ).alias("purchase_deviation_from_device_mean"),
        seconds_between("__first", _TIME).alias("device_lifespan"),
        F.coalesce(ratio("__frauds", n + 1 if mode == "online" else F.nullif(n, F.lit(0))), F.lit(0.0)).alias(
            "device_fraud_rate"
        ),
    )


def device_state(txns: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """State of every device after all of ``txns``: what an online scorer starts from.

    One row of constant size per device from one aggregation. Times are the extremes, so no order is
    needed. Of the sets of IPs and sources only the ends and "holds NULL" are kept, which is all the
    features ask for; the members themselves are ``device_members``.
    """
    sets = []
    for c, name in (("ip_address", "ip"), ("source", "source")):
        gone = F.max(F.col(c).isNull().cast("int")) == 1
        sets += [
            F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"),
            gone.alias(f"{name}_null"),
            ((F.min(c) != F.max(c)) | (gone & F.min(c).isNotNull())).alias(f"{name}_mixed"),
        ]
    state = txns.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("purchase_value").alias("purchase_sum"),
        F.max(_TIME).alias("last_transaction"),
        F.min(_TIME).alias("first_seen"),
        *sets,
    )
    state = state.withColumns({f"{n}_mixed": F.coalesce(f"{n}_mixed", F.lit(False)) for n in ("ip", "source")})
    if labels is None:
        return state.withColumn("fraud_count", F.lit(0).cast("long"))
    frauds = (
        labels.where(F.col("is_fraud").cast("int") == 1)
        .groupBy("device_id")
        .agg(F.count(F.lit(1)).alias("fraud_count"))
    )
    return state.join(frauds, "device_id", "left").withColumn("fraud_count", F.coalesce("fraud_count", F.lit(0)))


def device_members(txns: DataFrame, col: str) -> DataFrame:
    """The distinct values of ``col`` per device, one row each."""
    return txns.select("device_id", col).distinct()


def device_sets(txns: DataFrame, state: DataFrame, limit: int = 1000) -> DataFrame:
    """``state`` with its sets as sorted arrays (the export form) and their sizes, in parts of up to ``limit`` members a set.

    Almost every device has part 0 only. A larger set goes on in parts 1, 2 ...; each part repeats the device's other values, and
    has an empty array for a set that has ended. Together the parts hold all members, whatever their number.
    """
    parts = None
    for c, name, count in (("ip_address", "ip_addresses", "ip_count"), ("source", "sources", "source_count")):
        values = [Over("__place", "count", F.lit(1), "before"), Over(count, "count", F.lit(1), "group")]
        members = running(device_members(txns, c), ["device_id"], [c], values, derived=True)
        arrays = members.groupBy("device_id", F.floor(F.col("__place") / limit).cast("int").alias("part")).agg(F.array_sort(F.collect_list(c)).alias(name), F.max(count).alias(count))
        state = state.join(arrays.where("part = 0").select("device_id", count), "device_id", "left")
        arrays = arrays.drop(count)
        parts = arrays if parts is None else parts.join(arrays, ["device_id", "part"], "full")
    empty = {"ip_addresses": dict(txns.dtypes)["ip_address"], "sources": dict(txns.dtypes)["source"]}
    parts = parts.withColumns({n: F.coalesce(n, F.array().cast(f"array<{t}>")) for n, t in empty.items()})
    return state.join(parts, "device_id")


def device_set_sketches(txns: DataFrame, precision: int = 12) -> DataFrame:
    """Mergeable sketches of the devices' sets: sizes of unions over days or shards, within about two percent, without the members."""
    return txns.groupBy("device_id").agg(
        F.hll_sketch_agg(F.col("ip_address").cast("string"), precision).alias("ip_sketch"), F.hll_sketch_agg("source", precision).alias("source_sketch")
    )


def merged_set_sizes(sketches: DataFrame) -> DataFrame:
    """Estimated sizes of each device's sets over all its sketches."""
    sizes = [F.hll_sketch_estimate(F.hll_union_agg(f"{n}_sketch")).alias(f"{n}_count") for n in ("ip", "source")]
    return sketches.groupBy("device_id").agg(*sizes)


def purchase_gap(txns: DataFrame, key: str = "device_id", within_day: bool = False, name: str | None = None, size: int | None = None) -> DataFrame:
    """Seconds since the key's previous purchase; ``within_day`` keeps only the part below a day."""
    out = running(txns, [key], [_TIME, _ID], [Over("__prev", "last", F.col(_TIME), "before")], size)
    gap = seconds_between("__prev", _TIME)
    if within_day:
        gap = F.pmod(F.floor(gap), F.lit(86400)).cast("double")
    return out.select(*txns.columns, gap.alias(name or f"time_diff_{key}"))


def recent_count(txns: DataFrame, key: str = "device_id", seconds: int = 3600, include_current: bool = True, size: int | None = None) -> DataFrame:
    """Transactions of the key in the last ``seconds``, rows at the same instant included.

    A key too big for one task is counted as arrivals minus expiries up to each instant, two running
    sums over (key, instant) counts, instead of a sliding frame over its rows.
    """
    name = f"txns_last_{seconds}s"
    own = F.lit(0 if include_current else 1)
    cuts = cut_points(txns, [key], [_TIME], size)
    if not cuts:
        spec = Window.partitionBy(key).orderBy(F.unix_micros(_TIME)).rangeBetween(-seconds * 1_000_000, 0)
        return txns.withColumn(name, F.count(F.lit(1)).over(spec) - own)
    at = txns.groupBy(key, _TIME).agg(F.count(F.lit(1)).alias("__n"))
    moves = at.select(key, _TIME, F.lit(0).alias(_KIND), "__n").unionByName(
        at.select(
            key,
            (F.col(_TIME) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).alias(_TIME),
            F.lit(1).alias(_KIND),
            (-F.col("__n")).alias("__n"),
        )
    )
    counted = (
        running(moves, [key], [_TIME, _KIND], [Over("__open", "sum", F.col("__n"), "through")], derived=True)
        .where(F.col(_KIND) == 0)
        .select(key, _TIME, "__open")
    )
    out = attach(txns, counted, [key, _TIME], [_ID], size=size)
    return out.select(*[txns[c] for c in txns.columns], (F.col("__open") - own).cast("long").alias(name))


def device_value_features(txns: DataFrame, size: int | None = None) -> DataFrame:
    """Value statistics of the device next to each row, and how unusual row and device are.

    cv is std / mean and z is (value - mean) / std, NULL where std is 0 or unknown.
    """
    value = F.col("purchase_value").cast("double")
    stats = txns.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("__n"), mean_of("purchase_value").alias("__mean"), F.stddev_samp(value).alias("__std")
    )
    spread = stats.agg(F.avg("__n").alias("m"), F.stddev_samp("__n").alias("s"))
    stats = stats.withColumn(
        "__zn",
        ratio(F.col("__n") - spread.select("m").scalar(), F.nullif(spread.select("s").scalar(), F.lit(0.0))),
    )
    out = attach(txns, stats, ["device_id"], [_ID], size=size)
    std = F.nullif(F.col("__std"), F.lit(0.0))
    return out.select(
        *[txns[c] for c in txns.columns],
        F.col("__mean").alias("purchase_mean_by_device"),
        F.col("__std").alias("purchase_std_by_device"),
        F.try_divide(F.col("__std"), F.nullif(F.col("__mean"), F.lit(0.0))).alias("purchase_cv_by_device"),
        F.try_divide(value - F.col("__mean"), std).alias("purchase_zscore_by_device"),
        F.col("__zn").alias("txn_count_device_zscore"),
        (F.col("__n") == 1).alias("is_unique_device"),
    )


def month_deviation(txns: DataFrame, size: int | None = None) -> DataFrame:
    """Each value against its month: z-score, ratio to the median, and the month's fraud rate."""
    months = month_baselines(txns, size).select(
        "month",
        F.col("mean_value").alias("__mean"),
        F.col("median_value").alias("__median"),
        F.col("std_value").alias("__std"),
        F.col("fraud_rate").alias("month_fraud_rate"),
    )  # twelve rows
    value = F.col("purchase_value").cast("double")
    return (
        txns.withColumn("month", F.month(_TIME).cast("long"))
        .join(F.broadcast(months), "month", "left")
        .select(
            *txns.columns,
            "month",
            F.try_divide(value - F.col("__mean"), F.nullif("__std", F.lit(0.0))).alias("purchase_value_deviation_by_month"),
            F.try_divide(value, F.nullif("__median", F.lit(0.0))).alias("purchase_value_ratio_to_monthly_median"),
            "month_fraud_rate",
        )
    )


def month_features(txns: DataFrame) -> DataFrame:
    """Month as a point on the circle, its fraud rate, and sex as 0/1."""
    rates = (
        txns.groupBy(F.month(_TIME).cast("long").alias("month"))
        .agg(ratio(F.sum("is_fraud"), F.count("is_fraud")).alias("fraud_rate_by_month"))
    )  # twelve rows
    sin, cos = month_cycle("month")
    out = txns.withColumn("month", F.month(_TIME).cast("long")).join(F.broadcast(rates), "month", "left")
    cols = [*txns.columns, "month", "fraud_rate_by_month", sin.alias("month_sin"), cos.alias("month_cos")]
    if "sex" in txns.columns:
        cols.append(equals_flag("sex", "M").alias("sex_encoded"))
    return out.select(*cols)


def imputed_gap(txns: DataFrame, gap: str, how: str = "median", std: str | None = None, std_how: str = "zero", size: int | None = None) -> DataFrame:
    """Fill the gap of a first purchase with the median or the largest gap, and an unknown std with 0
    or the median std."""
    if how not in ("median", "max") or std_how not in ("zero", "median"):
        raise ValueError("gap is filled by 'median' or 'max', std by 'zero' or 'median'")

    txns = settle(txns)  # read for the gaps, for each middle and for the rows

    def middle(c: str) -> Column:
        return quantiles(txns, [], c, {"v": 0.5}, size).select("v").scalar()

    fill = middle(gap) if how == "median" else txns.agg(F.max(gap).cast("double").alias("v")).scalar()
    new = {f"{gap}_imputed": F.coalesce(F.col(gap).cast("double"), fill)}
    if std:
        new[f"{std}_imputed"] = F.coalesce(F.col(std).cast("double"), F.lit(0.0) if std_how == "zero" else middle(std))
    return txns.withColumns(new)


def log_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({f"log_{c}": log_or_null(c) for c in cols})


