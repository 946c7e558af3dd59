"""Queries of the profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog.bindings import E, O, events, orders, query, r6, rounded, size_of
from tallyward.functions.columns import age_group, columns_with_prefix, equals_flag, flag, log_or_null, to_number, with_time_parts
from tallyward.operators import entities, profile
from tallyward.operators.features import log_counts

_V = "CAST(purchase_value AS DOUBLE)"
_MEAN = "CAST(sum(purchase_value) AS DOUBLE) / count(purchase_value)"


def _describe_sql() -> str:
    parts = []
    for c in ("purchase_value", "age"):
        stats = {
            "count": f"count({c})",
            "mean": f"CAST(sum({c}) AS DOUBLE) / count({c})",
            "std": f"stddev_samp(CAST({c} AS DOUBLE))",
            "min": f"min({c})",
            "25%": f"quantile_cont(CAST({c} AS DOUBLE), 0.25)",
            "50%": f"quantile_cont(CAST({c} AS DOUBLE), 0.5)",
            "75%": f"quantile_cont(CAST({c} AS DOUBLE), 0.75)",
            "max": f"max({c})",
        }
        parts += [f"SELECT '{c}' AS \"column\", '{n}' AS statistic, {r6('value=' + x)} FROM o" for n, x in stats.items()]
    return f"WITH {O} " + " UNION ALL ".join(parts)


@query("describe_values", _describe_sql())
def describe_values(spark, sf):
    return rounded(profile.describe(orders(spark, sf), ["purchase_value", "age"], size=size_of(spark, sf, "orders")), "value")


@query("class_distribution", f"WITH {O} SELECT is_fraud, {r6('share=count(*) * 1.0 / sum(count(*)) OVER ()')} FROM o GROUP BY is_fraud")
def class_distribution(spark, sf):
    return rounded(profile.value_counts(orders(spark, sf), "is_fraud", normalize=True), "share")


@query("device_count_distribution", f"WITH {O}, d AS (SELECT count(*) OVER (PARTITION BY device_id) AS transactions_by_device_id FROM o) SELECT transactions_by_device_id, count(*) AS count FROM d GROUP BY 1")
def device_count_distribution(spark, sf):
    rows = profile.counts_by_key(orders(spark, sf), ["device_id"], size_of(spark, sf, "orders"))
    return profile.value_counts(rows, "transactions_by_device_id")


@query(
    "imbalance_ratio",
    f"WITH {O} SELECT count(*) FILTER (is_fraud = 0) AS negatives, count(*) FILTER (is_fraud = 1) AS positives, {r6('imbalance_ratio=count(*) FILTER (is_fraud = 1) * 1.0 / count(*) FILTER (is_fraud = 0)')} FROM o",
)
def imbalance_ratio(spark, sf):
    return rounded(profile.class_balance(orders(spark, sf)), "imbalance_ratio")


def _register_shares():
    for name, group, col in (
        ("value_counts_by_class", "is_fraud", "source"),
        ("time_part_share_hour", "is_fraud", "purchase_hour"),
        ("time_part_share_day", "purchase_day", "is_fraud"),
        ("time_part_share_hour_class", "purchase_hour", "is_fraud"),
    ):
        parts = "*, month(purchase_time) AS purchase_month, isodow(purchase_time) - 1 AS purchase_day, hour(purchase_time) AS purchase_hour"
        sql = f"""WITH {E}, t AS (SELECT {parts} FROM e)
SELECT {group}, {col}, count(*) AS count, {r6(f"share=count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY {group})")} FROM t GROUP BY {group}, {col}"""

        def run(spark, sf, group=group, col=col):
            out = profile.shares_within(with_time_parts(events(spark, sf)), group, col, size_of(spark, sf, "events"))
            return rounded(out, "share")

        query(name, sql)(run)


_register_shares()


@query(
    "txn_count_by_key",
    f"""WITH {E} SELECT transaction_id, count(user_id) OVER (PARTITION BY user_id) AS transactions_by_user_id,
  count(device_id) OVER (PARTITION BY device_id) AS transactions_by_device_id,
  count(ip_address) OVER (PARTITION BY ip_address) AS transactions_by_ip_address FROM e""",
)
def txn_count_by_key(spark, sf):
    keys = ["user_id", "device_id", "ip_address"]
    out = profile.counts_by_key(events(spark, sf), keys, size_of(spark, sf, "events"))
    return out.select("transaction_id", *[f"transactions_by_{k}" for k in keys])


def _consistency_sql(body: str, base: str) -> str:
    return f"""WITH {body}, i AS (SELECT ip_address, count(DISTINCT device_id) AS devices_by_ip, count(*) AS ni FROM {base} GROUP BY 1),
d AS (SELECT device_id, count(DISTINCT ip_address) AS ip_by_device, count(*) AS nd FROM {base} GROUP BY 1)
SELECT transaction_id, devices_by_ip, ip_by_device, devices_by_ip = 1 AND ip_by_device = 1 AS device_ip_consistency,
  devices_by_ip = 1 AND ip_by_device = 1 AND ni = 1 AND nd = 1 AS device_ip_user_consistency
FROM {base} JOIN i USING (ip_address) JOIN d USING (device_id)"""


_CONS = ["transaction_id", "devices_by_ip", "ip_by_device", "device_ip_consistency", "device_ip_user_consistency"]


@query("device_ip_consistency", _consistency_sql(E, "e"))
def device_ip_consistency(spark, sf):
    return profile.device_ip_consistency(events(spark, sf), size_of(spark, sf, "events")).select(*_CONS)


@query("device_ip_consistency_orders", _consistency_sql(O, "o"))
def device_ip_consistency_orders(spark, sf):
    return profile.device_ip_consistency(orders(spark, sf), size_of(spark, sf, "orders")).select(*_CONS)


@query(
    "inconsistent_by_class",
    f"""WITH {E}, i AS (SELECT ip_address, count(DISTINCT device_id) AS a FROM e GROUP BY 1),
d AS (SELECT device_id, count(DISTINCT ip_address) AS b FROM e GROUP BY 1)
SELECT CAST(is_fraud AS INTEGER) AS is_fraud, count(user_id) AS transactions FROM e JOIN i USING (ip_address) JOIN d USING (device_id)
WHERE NOT (a = 1 AND b = 1) GROUP BY is_fraud""",
)
def inconsistent_by_class(spark, sf):
    return profile.inconsistent_by_class(events(spark, sf), size_of(spark, sf, "events"))


_RISK = "count(*) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS frauds, round(sum(is_fraud) * 1.0 / count(*), 6) AS fraud_rate"


@query("country_risk", f"WITH {O} SELECT country, {_RISK} FROM o WHERE country IS NOT NULL GROUP BY country")
def country_risk(spark, sf):
    return rounded(profile.risk_table(orders(spark, sf), "country"), "fraud_rate").orderBy("fraud_rate")


@query(
    "country_high_risk",
    f"WITH {O} SELECT * FROM (SELECT country, {_RISK} FROM o GROUP BY country) WHERE fraud_rate > 0.33 AND transactions > 1",
)
def country_high_risk(spark, sf):
    return profile.risky(rounded(profile.risk_table(orders(spark, sf), "country"), "fraud_rate"), 0.33, 1)


@query("source_browser_risk", f"WITH {O} SELECT source, browser, {_RISK} FROM o GROUP BY source, browser")
def source_browser_risk(spark, sf):
    return rounded(profile.risk_table(orders(spark, sf), "source", "browser"), "fraud_rate")


@query("device_ip_pairs", f"WITH {E} SELECT device_id, ip_address, count(user_id) AS transactions FROM e GROUP BY 1, 2 HAVING count(user_id) > 1")
def device_ip_pairs(spark, sf):
    return profile.repeated_pairs(events(spark, sf))


_SUMMARY = [
    "mean_purchase_val",
    "purchase_val_std",
    "median_time_between_signup_and_purchase",
    "median_time_between_purchase",
    "fraud_rate",
]

_SUMMARY_PLACES = [f"{c}@{p}" for c, p in zip(_SUMMARY, (9, 5, 8, 8, 6))]


def _entity_ctes(entity: str) -> str:
    other, reach = ("ip_address", "unique_ips") if entity == "device_id" else ("device_id", "unique_device_ids")
    return f"""{E}, g AS (SELECT *, (epoch_us(purchase_time) - epoch_us(lag(purchase_time) OVER (PARTITION BY {entity}
    ORDER BY purchase_time, transaction_id))) / 1e6 AS gap, (epoch_us(purchase_time) - epoch_us(signup_time)) / 1e6 AS setup FROM e),
s AS (SELECT {entity}, count(is_fraud) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS frauds, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT {other}) AS {reach}, {_MEAN} AS mean_purchase_val, stddev_samp({_V}) AS purchase_val_std,
  median(setup) AS median_time_between_signup_and_purchase, median(gap) AS median_time_between_purchase,
  sum(is_fraud) * 1.0 / count(*) AS fraud_rate FROM g GROUP BY {entity})"""


def _summary(spark, sf, entity):
    return entities.summarize_entity(events(spark, sf), entity, size_of(spark, sf, "events"))


def _register_entities():
    for entity, short, reach in (("device_id", "device", "unique_ips"), ("ip_address", "ip", "unique_device_ids")):
        ctes = _entity_ctes(entity)

        def full(spark, sf, entity=entity):
            return rounded(_summary(spark, sf, entity), *_SUMMARY_PLACES)

        shown = r6(*_SUMMARY_PLACES)
        query(f"entity_summary_{short}", f"WITH {ctes} SELECT {entity}, transactions, frauds, unique_users, {reach}, {shown} FROM s")(full)

        def reuse(spark, sf, entity=entity):
            return rounded(profile.mean_by(_summary(spark, sf, entity), "transactions", "fraud_rate"), "mean_fraud_rate")

        query(f"risk_by_reuse_{short}", f"WITH {ctes} SELECT transactions, {r6('mean_fraud_rate=avg(fraud_rate)')} FROM s GROUP BY 1")(reuse)


_register_entities()

_CORR = ["transactions", *_SUMMARY]


def _corr_sql(more: int) -> str:
    cells = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM s WHERE transactions > {more}" for a in _CORR for b in _CORR)
    return f"WITH {_entity_ctes('device_id')}, m AS ({cells})"


@query("corr_matrix", f"{_corr_sql(2)} SELECT a, b, {r6('r@5=r')} FROM m")
def corr_matrix(spark, sf):
    rows = _summary(spark, sf, "device_id").where(F.col("transactions") > 2)
    return rounded(profile.correlation(rows, _CORR), "r", places=5)


_NUM = ["txn_hour", "purchase_value", "double_value", "noisy_value", "ip_address"]


@query(
    "corr_pairs_binned",
    f"""WITH {E}, n AS (SELECT CAST(hour(purchase_time) AS DOUBLE) AS txn_hour, {_V} AS purchase_value, 2 * {_V} AS double_value,
  {_V} + CAST(ip_address AS DOUBLE) / 8 AS noisy_value, CAST(ip_address AS DOUBLE) AS ip_address FROM e),
m AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM n" for i, a in enumerate(_NUM) for b in _NUM[i + 1:])})
SELECT a, b, {r6('r@5=r')}, CASE WHEN abs(r) >= 0.9 THEN '0.9-1' WHEN abs(r) >= 0.8 THEN '0.8-0.9' ELSE '0.7-0.8' END AS bin
FROM m WHERE abs(r) >= 0.7""",
)
def corr_pairs_binned(spark, sf):
    v = F.col("purchase_value").cast("double")
    rows = events(spark, sf).select(
        F.hour("purchase_time").cast("double").alias("txn_hour"),
        v.alias("purchase_value"),
        (v * 2).alias("double_value"),
        (v + F.col("ip_address").cast("double") / 8).alias("noisy_value"),
        F.col("ip_address").cast("double").alias("ip_address"),
    )
    return rounded(profile.correlated_pairs(profile.correlation(rows, _NUM), _NUM), "r", places=5)


_DEVICE = ["total_value", "mean_value", "median_value", "min_value", "max_value", "std_value"]
_DEVICE_SQL = f"""d AS (SELECT device_id, sum(purchase_value) AS total_value, {_MEAN} AS mean_value, median({_V}) AS median_value,
  min(purchase_value) AS min_value, max(purchase_value) AS max_value, stddev_samp({_V}) AS std_value, count(purchase_value) AS count
  FROM o GROUP BY device_id)"""


@query("device_value_stats", f"WITH {O}, {_DEVICE_SQL} SELECT device_id, {r6(*_DEVICE)}, count FROM d WHERE std_value > 0")
def device_value_stats(spark, sf):
    stats = entities.device_value_stats(orders(spark, sf), size=size_of(spark, sf, "orders"))
    hot = stats.where(F.col("std_value") > 0)
    return rounded(hot, *_DEVICE).orderBy(F.desc("max_value"), F.desc("std_value"))


@query("value_by_device_count", f"WITH {O}, {_DEVICE_SQL} SELECT count, {r6('mean_std_value@4=avg(std_value)')} FROM d GROUP BY count")
def value_by_device_count(spark, sf):
    stats = entities.device_value_stats(orders(spark, sf), size=size_of(spark, sf, "orders"))
    return rounded(profile.mean_by(stats, "count", "std_value"), "mean_std_value", places=4)


@query(
    "device_history",
    f"WITH {O} SELECT transaction_id, epoch_us(purchase_time) AS purchase_us, {r6('value=purchase_value')}, is_fraud FROM o WHERE device_id = 7",
)
def device_history(spark, sf):
    rows = orders(spark, sf).where(F.col("device_id") == 7)
    return rows.select("transaction_id", F.unix_micros("purchase_time").alias("purchase_us"), F.round(F.col("purchase_value").cast("double"), 6).alias("value"), "is_fraud")


_BOX = f"""b AS (SELECT is_fraud, quantile_cont({_V}, 0.25) AS q1, quantile_cont({_V}, 0.5) AS med, quantile_cont({_V}, 0.75) AS q3
  FROM e GROUP BY is_fraud)"""


@query(
    "iqr_outliers",
    f"""WITH {E}, {_BOX} SELECT is_fraud, count(*) FILTER ({_V} < q1 - 1.5 * (q3 - q1) OR {_V} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM e JOIN b USING (is_fraud) GROUP BY is_fraud""",
)
def iqr_outliers(spark, sf):
    return profile.iqr_outliers(events(spark, sf), "is_fraud", "purchase_value", size_of(spark, sf, "events"))


@query(
    "box_summary",
    f"""WITH {E}, {_BOX}, w AS (SELECT is_fraud, min(purchase_value) AS lo, max(purchase_value) AS hi FROM e JOIN b USING (is_fraud)
  WHERE {_V} >= q1 - 1.5 * (q3 - q1) AND {_V} <= q3 + 1.5 * (q3 - q1) GROUP BY is_fraud)
SELECT is_fraud, {r6('q1', 'median=med', 'q3', 'whisker_low=lo', 'whisker_high=hi')} FROM b JOIN w USING (is_fraud)""",
)
def box_summary(spark, sf):
    out = profile.box_summary(events(spark, sf), "is_fraud", "purchase_value", size_of(spark, sf, "events"))
    return rounded(out, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "month_baselines",
    f"""WITH {O} SELECT month(purchase_time) AS month, {r6('mean_value@4=' + _MEAN, f'median_value=median({_V})', f'std_value@4=stddev_samp({_V})',
  'fraud_rate=sum(is_fraud) * 1.0 / count(*)')} FROM o GROUP BY 1""",
)
def month_baselines(spark, sf):
    out = profile.month_baselines(orders(spark, sf), size_of(spark, sf, "orders"))
    return rounded(out, "mean_value@4", "median_value", "std_value@4", "fraud_rate")


@query(
    "month_class_pivot",
    f"""WITH {O} SELECT month(purchase_time) AS purchase_month, {r6(*[f'class_{c}@4=CAST(sum(purchase_value) FILTER (is_fraud = {c}) AS DOUBLE) / count(*) FILTER (is_fraud = {c})' for c in (0, 1)])}
FROM o GROUP BY 1""",
)
def month_class_pivot(spark, sf):
    out = profile.class_pivot(with_time_parts(orders(spark, sf)), "purchase_month", "purchase_value")
    return rounded(out, "class_0", "class_1", places=4)


def _register_time_parts():
    for part, expr in (("purchase_month", "month(purchase_time)"), ("purchase_day", "isodow(purchase_time) - 1"), ("purchase_hour", "hour(purchase_time)")):

        def run(spark, sf, part=part):
            return rounded(profile.value_by_time_part(events(spark, sf), part), "mean_value")

        query(f"value_by_{part}", f"WITH {E} SELECT {expr} AS {part}, {r6('mean_value=' + _MEAN)} FROM e GROUP BY 1")(run)


_register_time_parts()


def _register_crosstabs():
    for binary in (True, False):
        name = "source_device_consistency" if binary else "source"
        level = "CASE WHEN n = 1 THEN 1 ELSE 0 END" if binary else "n"
        sql = f"""WITH {O}, d AS (SELECT device_id, count(DISTINCT source) AS n FROM o GROUP BY device_id)
SELECT {level} AS {name}, {r6(*[f'class_{c}=count(*) FILTER (is_fraud = {c}) * 1.0 / count(*)' for c in (0, 1)])}
FROM o JOIN d USING (device_id) GROUP BY 1"""

        def run(spark, sf, binary=binary):
            return rounded(profile.consistency_crosstab(orders(spark, sf), "source", binary=binary), "class_0", "class_1")

        query("source_crosstab" if binary else "source_crosstab_levels", sql)(run)


_register_crosstabs()

_AGE_SQL = """CASE WHEN age > 0 AND age <= 18 THEN 'under_18' WHEN age > 18 AND age <= 25 THEN '18_25' WHEN age > 25 AND age <= 35 THEN '26_35'
  WHEN age > 35 AND age <= 50 THEN '36_50' WHEN age > 50 AND age <= 65 THEN '51_65' WHEN age > 65 AND age <= 100 THEN 'over_65' END"""
_AGES = ["under_18", "18_25", "26_35", "36_50", "51_65", "over_65"]


@query(
    "indicator_share",
    f"""WITH {O}, a AS (SELECT is_fraud, {_AGE_SQL} AS g FROM o)
SELECT 'age_' || g AS indicator, CAST(count(*) FILTER (is_fraud = 0) AS BIGINT) AS class_0, count(*) FILTER (is_fraud = 1) AS class_1,
  {r6(*[f'share_{c}=count(*) FILTER (is_fraud = {c}) * 1.0 / count(*)' for c in (0, 1)])} FROM a WHERE g IS NOT NULL GROUP BY g""",
)
def indicator_share(spark, sf):
    rows = orders(spark, sf).withColumn("g", age_group())
    rows = rows.select("is_fraud", *[equals_flag("g", a).alias(f"age_{a}") for a in _AGES])
    return rounded(profile.indicator_shares(rows, columns_with_prefix(rows, "age_")), "share_0", "share_1")


@query("sum_by_class", f"WITH {O} SELECT is_fraud, {r6('sum_purchase_value=sum(purchase_value)')} FROM o GROUP BY is_fraud")
def sum_by_class(spark, sf):
    return rounded(profile.sum_by_class(orders(spark, sf), "purchase_value"), "sum_purchase_value")


@query(
    "device_lifespan",
    f"""WITH {O} SELECT device_id, epoch_us(min(purchase_time)) AS first_us, epoch_us(max(purchase_time)) AS last_us, count(*) AS transactions,
  max(is_fraud) AS any_fraud, {r6('lifespan_days=(epoch_us(max(purchase_time)) - epoch_us(min(purchase_time))) / 1e6 / 86400')} FROM o GROUP BY device_id""",
)
def device_lifespan(spark, sf):
    out = profile.entity_lifespan(orders(spark, sf))
    return rounded(out, "lifespan_days").select(
        "device_id", F.unix_micros("first_purchase").alias("first_us"), F.unix_micros("last_purchase").alias("last_us"), "transactions", "any_fraud", "lifespan_days"
    )


@query(
    "binned_deviation",
    f"""WITH {O}, a AS (SELECT *, {_AGE_SQL} AS age_group FROM o),
s AS (SELECT age_group, {_MEAN} AS m, median({_V}) AS d FROM a WHERE age_group IS NOT NULL GROUP BY 1)
SELECT transaction_id, a.age_group, {r6(f'dev_from_mean@4={_V} - m', f'dev_from_median={_V} - d')} FROM a LEFT JOIN s ON a.age_group = s.age_group""",
)
def binned_deviation(spark, sf):
    out = profile.deviation_by_group(orders(spark, sf), size=size_of(spark, sf, "orders"))
    return rounded(out.select("transaction_id", "age_group", "dev_from_mean", "dev_from_median"), "dev_from_mean@4", "dev_from_median")


@query(
    "row_expressions",
    f"""WITH {O} SELECT transaction_id, CASE WHEN sex = 'M' THEN 1 ELSE 0 END AS is_male,
  {r6('log_value=ln(purchase_value)', "priority=TRY_CAST(substr(source, 1, 1) AS DOUBLE)", "not_a_number=TRY_CAST(source AS DOUBLE)")},
  {_AGE_SQL} IS NULL AS no_age_group, CASE WHEN coalesce(age > 50, false) THEN 1 ELSE 0 END AS over_50,
  month(purchase_time) AS purchase_month, isodow(purchase_time) - 1 AS purchase_day, hour(purchase_time) AS purchase_hour FROM o""",
)
def row_expressions(spark, sf):
    rows = with_time_parts(orders(spark, sf)).withColumns({"old": F.col("age") > 50, "first": F.substring("source", 1, 1)})
    out = rows.select(
        "transaction_id",
        equals_flag("sex", "M").alias("is_male"),
        log_or_null("purchase_value").alias("log_value"),
        to_number("first").alias("priority"),
        to_number("source").alias("not_a_number"),
        age_group().isNull().alias("no_age_group"),
        flag("old").alias("over_50"),
        "purchase_month",
        "purchase_day",
        "purchase_hour",
    )
    return rounded(out, "log_value", "priority", "not_a_number")


@query(
    "log_device_counts",
    f"WITH {O}, d AS (SELECT transaction_id, count(*) OVER (PARTITION BY device_id) AS n FROM o) SELECT transaction_id, {r6('log_transactions_by_device_id=ln(n)')} FROM d",
)
def log_device_counts(spark, sf):
    rows = profile.counts_by_key(orders(spark, sf), ["device_id"], size_of(spark, sf, "orders"))
    out = log_counts(rows, "transactions_by_device_id")
    return rounded(out.select("transaction_id", "log_transactions_by_device_id"), "log_transactions_by_device_id")


@query("null_age_groups", f"WITH {O} SELECT country, count(*) AS count FROM o WHERE {_AGE_SQL} IS NULL GROUP BY country")
def null_age_groups(spark, sf):
    rows = orders(spark, sf).withColumn("g", age_group()).where(F.col("g").isNull())
    return profile.value_counts(rows, "country")


@query(
    "chronological_rename",
    f"WITH {E} SELECT transaction_id, device_id AS users_device, {r6('amount=purchase_value')} FROM e WHERE is_fraud = 1",
)
def chronological_rename(spark, sf):
    rows = events(spark, sf).where(F.col("is_fraud") == 1).drop("source", "ip_address")
    rows = rows.orderBy("purchase_time", "transaction_id").withColumnsRenamed({"device_id": "users_device", "purchase_value": "amount"})
    return rounded(rows.select("transaction_id", "users_device", "amount"), "amount")
