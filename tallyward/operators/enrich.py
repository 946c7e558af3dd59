"""Country and economy of a transaction: range join on the IP, lookups by country."""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import ratio
from tallyward.operators.profile import risk_table
from tallyward.plans.joins import attach, fits_broadcast, measured
from tallyward.plans.slices import Over, running
from tallyward.session import broadcast_rows, settle

_ID = "transaction_id"

# Country names of the transactions and their spelling in the economy sheet.
COUNTRY_ALIASES = {
    "Korea Republic of": "Korea, Rep.",
    "Taiwan; Republic of China (ROC)": "Taiwan, China",
    "Hong Kong": "Hong Kong SAR, China",
    "Egypt": "Egypt, Arab Rep.",
    "Slovakia": "Slovakia (SLOVAK Republic)",
    "Croatia": "Croatia (LOCAL Name: Hrvatska)",
    "Oman": "EMDE Middle East, North Africa, Afghanistan & Pakistan",
    "Moldova Republic of": "Moldova, Rep.",
    "Bosnia and Herzegowina": "Bosnia and Herzegovina",
    "Macedonia": "North Macedonia",
}


def overlapping_ranges(ranges: DataFrame, size: int | None = None) -> DataFrame:
    """Ranges that start inside an earlier one. The country join assumes there are none."""
    out = running(ranges, [], ["lower", "upper"], [Over("__reach", "max", F.col("upper"), "before")], size)
    return out.where(F.col("lower") <= F.col("__reach")).drop("__reach")


def ip_to_country(txns: DataFrame, ranges: DataFrame, method: str = "auto", ip: str = "ip_address", size: int | None = None) -> DataFrame:
    """Country of the range that holds the IP, bounds included; NULL where none does.

    "broadcast"  ranges, which may nest and overlap, are cut into elementary intervals; an address finds its own by binary search in
                 their sorted starts, one array for all rows, and its countries by an equi-join with that place;
    "bucketed"   ranges are repeated for each bucket of the address line they touch, then an equi-join
                 on the bucket; the bucket table is broadcast when its count allows;
    "sorted"     addresses and ranges are walked together in order and each address remembers the last
                 range that started at or before it: linear in both, for ranges too many to send
                 around or too densely packed for buckets.
    "auto"       counts the ranges and picks.
    """
    if method == "auto":
        method = "sorted" if _too_many(ranges) else "bucketed"
    if method == "broadcast":
        if not fits_broadcast(ranges):
            raise ValueError("too many ranges to broadcast; use 'bucketed' or 'sorted'")
        return _searched(txns, ranges, ip)
    if method == "bucketed":
        width = _bucket_width(ranges)
        touched = F.sequence(F.floor(F.col("lower") / width), F.floor(F.col("upper") / width))
        r = ranges.select(F.explode(touched).alias("__at"), F.struct("lower", "upper", "country").alias("r"))
        r = r.groupBy("__at").agg(F.collect_list("r").alias("__ranges"))  # a row for each bucket, about one range in each
        rows = txns.withColumn("__at", F.floor(F.col(ip) / width))
        small = fits_broadcast(r)
        met = rows.join(F.broadcast(r), "__at", "left") if small else attach(rows, r, ["__at"], [_ID], size=size)
        held = F.filter("__ranges", lambda x: F.col(ip).between(x["lower"], x["upper"]))
        return met.select(*txns.columns, F.explode_outer(F.transform(held, lambda x: x["country"])).alias("country"))
    if method == "sorted":
        return _walk(txns, ranges, ip, size)
    raise ValueError("method must be auto, broadcast, bucketed or sorted")


def _elementary(ranges: list[tuple[float, float, str]]) -> tuple[list[float], list[list[str]]]:
    """Starts of the intervals in which the same ranges hold, and their countries; an interval ends where the next one starts."""
    edges = sorted([(low, i, True) for i, (low, _, _) in enumerate(ranges)] + [(math.nextafter(high, math.inf), i, False) for i, (_, high, _) in enumerate(ranges)])
    starts, held, active = [], [], {}
    for at, group in groupby(edges, key=lambda e: e[0]):
        for _, i, opens in group:
            if opens:
                active[i] = ranges[i][2]
            else:
                active.pop(i, None)
        starts.append(at)
        held.append(list(active.values()))
    return starts, held


def _searched(txns: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    spark = txns.sparkSession
    rows = ranges.select(F.col("lower").cast("double"), F.col("upper").cast("double"), "country").where("lower <= upper").collect()  # counted before
    starts, held = _elementary([tuple(r) for r in rows])
    if sum(map(len, held)) > 4 * broadcast_rows(spark):
        raise ValueError("ranges nest too deeply to be laid out; use 'bucketed' or 'sorted'")
    edges = np.array(starts)

    @F.pandas_udf("int")
    def interval(at: pd.Series) -> pd.Series:
        found = np.searchsorted(edges, at.to_numpy(float), side="right")
        return pd.Series(np.where(at.isna(), 0, found).astype(np.int32))

    table = [(i + 1, c) for i, countries in enumerate(held) for c in countries]
    table = F.broadcast(spark.createDataFrame(table, "__interval int, country string"))
    rows = txns.withColumn("__interval", interval(F.col(ip).cast("double")))
    return rows.join(table, "__interval", "left").select(*txns.columns, "country")


def _too_many(ranges: DataFrame) -> bool:
    """More bucket rows than may be broadcast, or buckets so full that an address meets many ranges."""
    if not fits_broadcast(ranges):
        return True
    width = _bucket_width(ranges)
    low, high = F.floor(F.col("lower") / width), F.floor(F.col("upper") / width)
    rows = ranges.agg(F.sum(high - low + 1)).first()[0] or 0
    if rows > broadcast_rows(ranges.sparkSession):
        return True
    full = ranges.select(F.explode(F.sequence(low, high)).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    return (full or 0) > 256


def _bucket_width(ranges: DataFrame) -> float:
    """The mean distance between range starts: about one range per bucket when evenly spread."""
    low, high, n = ranges.agg(F.min("lower"), F.max("upper"), F.count(F.lit(1))).first()
    if not n or high <= low:
        return 1.0
    return float(max(1, math.ceil((float(high) - float(low)) / n)))


def _walk(txns: DataFrame, ranges: DataFrame, ip: str, size: int | None) -> DataFrame:
    at = F.col(ip).cast("double")
    both = txns.where(F.col(ip).isNotNull()).select("*", at.alias("__at"), F.lit(1).alias("__kind")).unionByName(
        ranges.select(
            F.col("lower").cast("double").alias("__at"),
            F.lit(0).alias("__kind"),
            F.struct(F.col("upper").cast("double").alias("upper"), "country").alias("__range"),
        ),
        allowMissingColumns=True,
    )
    out = running(both, [], ["__at", "__kind", _ID], [Over("__hit", "last", F.col("__range"), "before")])
    country = F.when(F.col("__at") <= F.col("__hit.upper"), F.col("__hit.country"))
    found = out.where(F.col("__kind") == 1).select(*txns.columns, country.alias("country"))
    return found.unionByName(txns.where(F.col(ip).isNull()).withColumn("country", F.lit(None).cast("string")))


def lookup(df: DataFrame, table: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """Left join to a table with one row per key."""
    table, small = measured(table)
    if small:
        return df.join(F.broadcast(table), key, "left")
    return attach(df, table, [key], [_ID], size=size)


def mean_over_known(gdp: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """Mean of the known values as a scalar; regional aggregates in the sheet count unless excluded."""
    rows = gdp.where(~F.col("country").isin(*exclude)) if exclude else gdp
    return rows.agg(ratio(F.sum("gdp"), F.count("gdp")).alias("m")).scalar()


def alias_table(spark, aliases: dict[str, str] = COUNTRY_ALIASES) -> DataFrame:
    return spark.createDataFrame(list(aliases.items()), "country string, target string")


def add_gdp(df: DataFrame, gdp: DataFrame, size: int | None = None) -> DataFrame:
    """GDP by the country's own name only; NULL for a name the sheet does not have."""
    return lookup(df, gdp.select("country", "gdp"), "country", size)


def add_gdp_imputed(df: DataFrame, gdp: DataFrame, aliases: DataFrame, exclude: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """GDP through the alias table, with the mean for countries known to neither table.

    A country the sheet has keeps its value, NULL included; an alias takes its target's value, NULL
    when the sheet lacks the target; only the rest is imputed. The rules are worked out once per
    country, then looked up.
    """
    gdp = settle(gdp)  # read three times below
    own = gdp.select("country", F.col("gdp").alias("__own"), F.lit(True).alias("__in_sheet"))
    target = gdp.select(F.col("country").alias("target"), F.col("gdp").alias("__target"))
    via = aliases.join(target, "target", "left").select("country", "__target", F.lit(True).alias("__aliased"))
    names = own.join(via, "country", "full").select(
        "country",
        F.when(F.col("__in_sheet"), F.col("__own")).otherwise(F.col("__target")).alias("__gdp"),
        F.lit(True).alias("__known"),
    )
    out = lookup(df, names, "country", size)
    value = F.when(F.col("__known"), F.col("__gdp")).otherwise(mean_over_known(gdp, exclude))
    return out.select(*[c for c in df.columns], value.alias("gdp"))


def country_risk_features(df: DataFrame, threshold: float = 0.1, size: int | None = None) -> DataFrame:
    """Fraud rate of the row's country and whether it is above the threshold."""
    rates = risk_table(df, "country").select("country", F.col("fraud_rate").alias("country_fraud_rate"))
    out = lookup(df, rates, "country", size)
    return out.select(*df.columns, "country_fraud_rate", (F.col("country_fraud_rate") > threshold).alias("is_high_risk_country"))


def gdp_rank(gdp: DataFrame, size: int | None = None) -> DataFrame:
    """Relative rank in [0, 1] of each country's GDP (lowest rank for ties), NULL where it is unknown."""
    known = gdp.where(F.col("gdp").isNotNull())
    counts = known.groupBy("gdp").agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(
        counts,
        [],
        ["gdp"],
        [Over("__below", "sum", F.col("__n"), "before"), Over("__all", "sum", F.col("__n"), "group")],
        size,
        derived=True,
    )
    rank = F.when(F.col("__all") == 1, 0.0).otherwise(ratio(F.col("__below"), F.col("__all") - 1))
    return gdp.join(ranked.select("gdp", rank.alias("gdp_rank_normalized")), "gdp", "left").select(*gdp.columns, "gdp_rank_normalized")
