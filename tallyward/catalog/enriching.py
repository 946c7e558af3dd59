"""Queries of the enrichment operators, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog.bindings import (
    ALIAS_SQL,
    ALIASES,
    E,
    GDP,
    O,
    RANGES,
    events,
    gdp_sheet,
    ip_ranges,
    orders,
    query,
    r6,
    rounded,
    size_of,
)
from tallyward.operators import enrich, profile, splits
from tallyward.operators.scoring import drop_duplicates
from tallyward.plans.slices import global_rank
from tallyward.sources.files import year_values

_COUNTRY = f"{E}, {RANGES}, c AS (SELECT e.*, ranges.country FROM e LEFT JOIN ranges ON ip_address BETWEEN lower AND upper)"


def _register_ranges():
    for method in ("broadcast", "bucketed", "sorted", "auto"):

        def run(spark, sf, method=method):
            out = enrich.ip_to_country(events(spark, sf), ip_ranges(spark, sf), method)
            return out.select("transaction_id", "country")

        query(f"ip_to_country_{method}", f"WITH {_COUNTRY} SELECT transaction_id, country FROM c")(run)


_register_ranges()


@query("country_share", f"WITH {_COUNTRY} SELECT country, {r6('share=count(*) * 1.0 / sum(count(*)) OVER ()')} FROM c GROUP BY country")
def country_share(spark, sf):
    rows = enrich.ip_to_country(events(spark, sf), ip_ranges(spark, sf))
    return rounded(profile.value_counts(rows, "country", normalize=True, keep_null=True), "share")


@query(
    "unmatched_ips",
    f"WITH {_COUNTRY} SELECT ip_address, count(*) AS count FROM c WHERE country IS NULL GROUP BY ip_address",
)
def unmatched_ips(spark, sf):
    rows = enrich.ip_to_country(events(spark, sf), ip_ranges(spark, sf))
    return profile.value_counts(rows.where(F.col("country").isNull()), "ip_address")


@query(
    "range_overlaps",
    f"""WITH {RANGES}, w AS (SELECT lower, CASE WHEN country LIKE '%7' THEN upper + 3 ELSE upper END AS upper, country FROM ranges)
SELECT a.country FROM w a WHERE EXISTS (SELECT 1 FROM w b WHERE b.lower < a.lower AND b.upper >= a.lower)""",
)
def range_overlaps(spark, sf):
    """Some ranges are widened so that they reach into their successor."""
    wide = ip_ranges(spark, sf).withColumn("upper", F.when(F.col("country").endswith("7"), F.col("upper") + 3).otherwise(F.col("upper")))
    return enrich.overlapping_ranges(wide).select("country")


@query("gdp_of_year", f"WITH {GDP} SELECT country, {r6('gdp@2=gdp')} FROM gdp")
def gdp_of_year(spark, sf):
    return rounded(year_values(gdp_sheet(spark, sf), 2015), "gdp", places=2)


@query("gdp_lookup", f"WITH {O}, {GDP} SELECT transaction_id, country, {r6('gdp@2=gdp')} FROM o LEFT JOIN gdp USING (country)")
def gdp_lookup(spark, sf):
    out = enrich.add_gdp(orders(spark, sf), year_values(gdp_sheet(spark, sf), 2015), size_of(spark, sf, "orders"))
    return rounded(out.select("transaction_id", "country", "gdp"), "gdp", places=2)


@query(
    "gdp_alias_impute",
    f"""WITH {O}, {GDP}, {ALIAS_SQL} SELECT transaction_id, country, {r6('''gdp@2=CASE
  WHEN country IN (SELECT country FROM gdp) THEN (SELECT gdp FROM gdp g WHERE g.country = o.country)
  WHEN country IN (SELECT country FROM aliases) THEN (SELECT g.gdp FROM aliases a LEFT JOIN gdp g ON g.country = a.target WHERE a.country = o.country)
  ELSE (SELECT avg(gdp) FROM gdp) END''')} FROM o""",
)
def gdp_alias_impute(spark, sf):
    aliases = enrich.alias_table(spark, ALIASES)
    out = enrich.add_gdp_imputed(orders(spark, sf), year_values(gdp_sheet(spark, sf), 2015), aliases, size=size_of(spark, sf, "orders"))
    return rounded(out.select("transaction_id", "country", "gdp"), "gdp", places=2)


@query("gdp_rank", f"WITH {GDP} SELECT country, {r6('gdp_rank_normalized=percent_rank() OVER (ORDER BY gdp)')} FROM gdp")
def gdp_rank(spark, sf):
    out = enrich.gdp_rank(year_values(gdp_sheet(spark, sf), 2015))
    return rounded(out, "gdp_rank_normalized").select("country", "gdp_rank_normalized")


@query(
    "country_risk_features",
    f"""WITH {O}, r AS (SELECT country, sum(is_fraud) * 1.0 / count(*) AS f FROM o GROUP BY country)
SELECT transaction_id, {r6('country_fraud_rate=f')}, f > 0.33 AS is_high_risk_country FROM o JOIN r USING (country)""",
)
def country_risk_features(spark, sf):
    out = enrich.country_risk_features(orders(spark, sf), 0.33, size_of(spark, sf, "orders"))
    return rounded(out.select("transaction_id", "country_fraud_rate", "is_high_risk_country"), "country_fraud_rate")


_RANKED = f"{O}, k AS (SELECT *, row_number() OVER (ORDER BY purchase_time, transaction_id) - 1 AS pos, count(*) OVER () AS n FROM o)"
_TIME = ["purchase_time", "transaction_id"]


@query("time_split", f"WITH {_RANKED} SELECT transaction_id, pos < CAST(floor(0.8 * n) AS BIGINT) AS is_train FROM k")
def time_split(spark, sf):
    train, test = splits.time_split(orders(spark, sf), 0.8, size=size_of(spark, sf, "orders"))
    return train.select("transaction_id", F.lit(True).alias("is_train")).unionByName(test.select("transaction_id", F.lit(False).alias("is_train")))


@query(
    "initial_rows_split",
    f"WITH {_RANKED} SELECT transaction_id, pos < CAST(floor(0.8 * (n // 2)) AS BIGINT) AS is_train FROM k WHERE pos <= n // 2",
)
def initial_rows_split(spark, sf):
    """Train and test within the first rows of a table; the test part keeps the row at the bound as well."""
    rows, n = orders(spark, sf), size_of(spark, sf, "orders")
    train, test = splits.time_split(rows, 0.8, initial_rows=n // 2, inclusive_end=True, size=n)
    return train.select("transaction_id", F.lit(True).alias("is_train")).unionByName(test.select("transaction_id", F.lit(False).alias("is_train")))


@query("row_slice", f"WITH {_RANKED} SELECT transaction_id FROM k WHERE pos >= n // 3 AND pos < n // 3 + 100")
def row_slice(spark, sf):
    n = size_of(spark, sf, "orders")
    return splits.row_slice(orders(spark, sf), _TIME, n // 3, 100, n).select("transaction_id")


@query("chronological_rank", f"WITH {_RANKED} SELECT transaction_id, pos + 1 AS rank FROM k")
def chronological_rank(spark, sf):
    return global_rank(orders(spark, sf), _TIME, size=size_of(spark, sf, "orders")).select("transaction_id", "rank")


@query("union_split", f"WITH {O} SELECT is_fraud, count(*) AS rows, {r6('total=sum(purchase_value)')} FROM o GROUP BY is_fraud")
def union_split(spark, sf):
    train, test = splits.time_split(orders(spark, sf), 0.8, size=size_of(spark, sf, "orders"))
    both = train.unionByName(test)
    return rounded(both.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("rows"), F.sum("purchase_value").alias("total")), "total")


@query("dedupe", f"WITH {O} SELECT transaction_id, device_id, {r6('value=purchase_value')} FROM o")
def dedupe(spark, sf):
    """Orders and a second copy of the later ones; each id comes out once."""
    rows = orders(spark, sf)
    twice = rows.unionByName(rows.where(F.col("purchase_time") >= "1998-01-01"))
    out = drop_duplicates(twice).select("transaction_id", "device_id", F.col("purchase_value").alias("value"))
    return rounded(out, "value")
