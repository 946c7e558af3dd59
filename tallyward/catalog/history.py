"""Queries over device histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog.bindings import E, O, events, orders, query, r6, rounded, size_of
from tallyward.functions.columns import seconds_between
from tallyward.operators import features as ft
from tallyward.operators.scoring import join_labels, linear_score, recent_results
from tallyward.sources.codecs import label_events, result_events
from tallyward.sources.schema import FEATURES

# A mean over 32 or 64 values ends in a 5 at the seventh or eighth place, hence the extra places.
DOUBLES = [
    "time_setup_to_txn_seconds",
    "time_since_last_device_txn",
    "purchase_deviation_from_device_mean@9",
    "device_lifespan",
    "device_fraud_rate",
]

# Fixed coefficients, so that a score can be compared without a fit.
WEIGHTS = {
    "txn_count": 0.01,
    "device_ip_consistency": -0.8,
    "device_source_consistency": -0.4,
    "time_setup_to_txn_seconds": -1e-7,
    "time_since_last_device_txn": -2e-6,
    "purchase_deviation_from_device_mean": 0.002,
    "device_lifespan": 1e-7,
    "device_fraud_rate": 2.5,
}
INTERCEPT = -0.6


def _features_sql(base: str, mode: str, frauds: str, source: str = "ranked") -> str:
    """Select list of the eight features; ``n`` counts the earlier rows of the device."""
    count = "n + 1" if mode == "online" else "greatest(n, 1)"
    rate = "(n + 1)" if mode == "online" else "nullif(n, 0)"
    setup = "(epoch_us(purchase_time) - epoch_us(signup_time)) / 1e6" if base == "e" else "0"
    return f"""
  SELECT transaction_id, CAST({count} AS BIGINT) AS txn_count,
    ip_lo = ip_hi AS device_ip_consistency, src_lo = src_hi AS device_source_consistency,
    {r6(
        "time_setup_to_txn_seconds=" + setup,
        "time_since_last_device_txn=coalesce((epoch_us(purchase_time) - epoch_us(last)) / 1e6, 99999)",
        f"purchase_deviation_from_device_mean@{9 if base == 'e' else 6}=coalesce(abs(CAST(purchase_value AS DOUBLE) - CAST(total AS DOUBLE) / nullif(n, 0)), 0)",
        "device_lifespan=(epoch_us(purchase_time) - epoch_us(first)) / 1e6",
        f"device_fraud_rate=coalesce(CAST({frauds} AS DOUBLE) / {rate}, 0)",
    )}
  FROM {source}"""


def _ranked(base: str) -> str:
    return f"""ranked AS (
  SELECT *, count(*) OVER p AS n, sum(purchase_value) OVER p AS total, max(purchase_time) OVER p AS last,
    min(purchase_time) OVER c AS first, sum(is_fraud) OVER p AS frauds,
    min(ip_address) OVER c AS ip_lo, max(ip_address) OVER c AS ip_hi,
    min(source) OVER c AS src_lo, max(source) OVER c AS src_hi
  FROM {base}
  WINDOW p AS (PARTITION BY device_id ORDER BY purchase_time, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         c AS (PARTITION BY device_id ORDER BY purchase_time, transaction_id ROWS UNBOUNDED PRECEDING))"""


def _shown(df, bind="events"):
    doubles = DOUBLES if bind == "events" else [d.replace("@9", "") for d in DOUBLES]
    return rounded(df.select("transaction_id", *FEATURES), *doubles)


def _with_signup(df):
    return df if "signup_time" in df.columns else df.withColumn("signup_time", F.col("purchase_time"))


def _register_features():
    for base, bind, tag, body in ((events, "events", "", E), (orders, "orders", "_orders", O)):
        short = "e" if bind == "events" else "o"
        for mode in ("online", "offline"):

            def run(spark, sf, base=base, mode=mode, bind=bind):
                txns = _with_signup(base(spark, sf))
                return _shown(ft.device_features(txns, mode, "immediate", size_of(spark, sf, bind)), bind)

            sql = f"WITH {body}, {_ranked(short)} {_features_sql(short, mode, 'frauds')}"
            query(f"device_features_{mode}{tag}", sql)(run)


_register_features()


@query(
    "device_features_unlabelled",
    f"WITH {E}, {_ranked('e')} {_features_sql('e', 'online', '0')}",
)
def device_features_unlabelled(spark, sf):
    return _shown(ft.device_features(events(spark, sf), "online", None, size_of(spark, sf, "events")))


def _register_asof():
    for base, bind, body, short, tag in ((events, "events", E, "e", ""), (orders, "orders", O, "o", "_orders")):
        for days in (0, 1):

            def run(spark, sf, base=base, bind=bind, days=days):
                txns = _with_signup(base(spark, sf))
                return _shown(ft.device_features(txns, "online", label_events(txns, days), size_of(spark, sf, bind)), bind)

            sql = f"""WITH {body}, {_ranked(short)}, ev AS (
  SELECT device_id, purchase_time AS seen_at, 0 AS kind, transaction_id, 0 AS fraud FROM {short}
  UNION ALL
  SELECT device_id, purchase_time + to_days({days}), 1, transaction_id, is_fraud FROM {short}),
known AS (
  SELECT transaction_id, kind, sum(fraud) OVER (PARTITION BY device_id ORDER BY seen_at, kind, transaction_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asof_frauds FROM ev),
asof_ranked AS (SELECT ranked.*, coalesce(asof_frauds, 0) AS asof_frauds FROM ranked JOIN known USING (transaction_id) WHERE kind = 0)
{_features_sql(short, 'online', 'asof_frauds', 'asof_ranked')}"""
            query(f"device_features_label_asof_{days}d{tag}", sql)(run)


_register_asof()


@query(
    "label_event_log",
    f"""WITH {E} SELECT transaction_id, device_id, CAST(is_fraud AS INTEGER) AS is_fraud,
  epoch_us(purchase_time + to_days(3)) AS arrival_us FROM e""",
)
def label_event_log(spark, sf):
    out = label_events(events(spark, sf), 3)
    return out.select("transaction_id", "device_id", "is_fraud", F.unix_micros("arrival_time").alias("arrival_us"))


_STATE_SQL = """
  SELECT device_id, count(*) AS txn_count, CAST(sum(purchase_value) AS DOUBLE) AS purchase_sum,
    epoch_us(max(purchase_time)) AS last_us, epoch_us(min(purchase_time)) AS first_us,
    min(ip_address) AS ip_min, max(ip_address) AS ip_max, min(ip_address) <> max(ip_address) AS ip_mixed,
    min(source) AS source_min, max(source) AS source_max, min(source) <> max(source) AS source_mixed"""
_SETS_SQL = """count(DISTINCT ip_address) AS ip_count, count(DISTINCT source) AS source_count,
  '[' || string_agg(DISTINCT '"' || source || '"', ',' ORDER BY '"' || source || '"') || ']' AS sources"""


def _state_shown(state, *more):
    return state.select(
        "device_id",
        "txn_count",
        F.col("purchase_sum").cast("double").alias("purchase_sum"),
        F.unix_micros("last_transaction").alias("last_us"),
        F.unix_micros("first_seen").alias("first_us"),
        *[f"{n}_{s}" for n in ("ip", "source") for s in ("min", "max", "mixed")],
        "fraud_count",
        *more,
    )


@query("device_state_snapshot", f"WITH {E} {_STATE_SQL}, {_SETS_SQL}, CAST(0 AS BIGINT) AS fraud_count FROM e GROUP BY device_id")
def device_state_snapshot(spark, sf):
    txns = events(spark, sf)
    state = ft.device_sets(txns, ft.device_state(txns)).where("part = 0").withColumn("sources", F.to_json("sources"))
    return _state_shown(state, "ip_count", "source_count", "sources")


@query(
    "device_state_with_labels",
    f"WITH {E} {_STATE_SQL}, CAST(sum(is_fraud) AS BIGINT) AS fraud_count FROM e GROUP BY device_id",
)
def device_state_with_labels(spark, sf):
    txns = events(spark, sf)
    return _state_shown(ft.device_state(txns, label_events(txns)))


@query("device_members_ip", f"WITH {E} SELECT DISTINCT device_id, ip_address FROM e")
def device_members_ip(spark, sf):
    return ft.device_members(events(spark, sf), "ip_address")


def _gap_sql(body: str, base: str, key: str, within_day: bool) -> str:
    gap = "(epoch_us(purchase_time) - epoch_us(prev)) / 1e6"
    if within_day:
        gap = f"CAST(floor({gap}) AS BIGINT) % 86400"
    return f"""WITH {body}, g AS (SELECT transaction_id, purchase_time, lag(purchase_time) OVER
  (PARTITION BY {key} ORDER BY purchase_time, transaction_id) AS prev FROM {base})
SELECT transaction_id, {r6("gap=" + gap)} FROM g"""


def _register_gaps():
    for base, bind, body, short in ((events, "events", E, "e"), (orders, "orders", O, "o")):
        for key in ("device_id", "ip_address"):
            for within in (False, True):

                def run(spark, sf, base=base, bind=bind, key=key, within=within):
                    out = ft.purchase_gap(base(spark, sf), key, within, "gap", size_of(spark, sf, bind))
                    return rounded(out.select("transaction_id", "gap"), "gap")

                name = f"purchase_gap_{'within_day' if within else 'total'}_{bind}_{key}"
                query(name, _gap_sql(body, short, key, within))(run)


_register_gaps()


@query(
    "txns_last_hour",
    f"""WITH {E} SELECT transaction_id, count(*) OVER (PARTITION BY device_id ORDER BY epoch_us(purchase_time)
  RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS txns_last_3600s FROM e""",
)
def txns_last_hour(spark, sf):
    out = ft.recent_count(events(spark, sf), size=size_of(spark, sf, "events"))
    return out.select("transaction_id", "txns_last_3600s")


@query(
    "txns_last_day_before_this",
    f"""WITH {O} SELECT transaction_id, count(*) OVER (PARTITION BY device_id ORDER BY epoch_us(purchase_time)
  RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS txns_last_86400s FROM o""",
)
def txns_last_day_before_this(spark, sf):
    out = ft.recent_count(orders(spark, sf), seconds=86400, include_current=False, size=size_of(spark, sf, "orders"))
    return out.select("transaction_id", "txns_last_86400s")


@query(
    "device_value_zscore",
    f"""WITH {O}, d AS (SELECT device_id, count(*) AS n, CAST(sum(purchase_value) AS DOUBLE) / count(*) AS m,
  stddev_samp(CAST(purchase_value AS DOUBLE)) AS s FROM o GROUP BY device_id),
a AS (SELECT avg(n) AS am, stddev_samp(n) AS sd FROM d)
SELECT transaction_id, {r6("purchase_mean_by_device=m", "purchase_std_by_device=s", "purchase_cv_by_device=s / nullif(m, 0)",
  "purchase_zscore_by_device=(CAST(purchase_value AS DOUBLE) - m) / nullif(s, 0)", "txn_count_device_zscore=(n - am) / nullif(sd, 0)")},
  n = 1 AS is_unique_device FROM o JOIN d USING (device_id), a""",
)
def device_value_zscore(spark, sf):
    out = ft.device_value_features(orders(spark, sf), size_of(spark, sf, "orders"))
    cols = ["purchase_mean_by_device", "purchase_std_by_device", "purchase_cv_by_device", "purchase_zscore_by_device", "txn_count_device_zscore"]
    return rounded(out.select("transaction_id", *cols, "is_unique_device"), *cols)


@query(
    "month_deviation",
    f"""WITH {O}, m AS (SELECT month(purchase_time) AS month, CAST(sum(purchase_value) AS DOUBLE) / count(*) AS a,
  median(CAST(purchase_value AS DOUBLE)) AS d, stddev_samp(CAST(purchase_value AS DOUBLE)) AS s,
  CAST(sum(is_fraud) AS DOUBLE) / count(*) AS f FROM o GROUP BY 1)
SELECT transaction_id, m.month, {r6("purchase_value_deviation_by_month=(CAST(purchase_value AS DOUBLE) - a) / nullif(s, 0)",
  "purchase_value_ratio_to_monthly_median=CAST(purchase_value AS DOUBLE) / nullif(d, 0)", "month_fraud_rate=f")}
FROM o JOIN m ON month(purchase_time) = m.month""",
)
def month_deviation(spark, sf):
    out = ft.month_deviation(orders(spark, sf), size_of(spark, sf, "orders"))
    cols = ["purchase_value_deviation_by_month", "purchase_value_ratio_to_monthly_median", "month_fraud_rate"]
    return rounded(out.select("transaction_id", "month", *cols), *cols)


@query(
    "month_cyclic",
    f"""WITH {O}, m AS (SELECT month(purchase_time) AS month, CAST(sum(is_fraud) AS DOUBLE) / count(*) AS f FROM o GROUP BY 1)
SELECT transaction_id, m.month, {r6("fraud_rate_by_month=f", "month_sin=sin(m.month * 2 * pi() / 12)", "month_cos=cos(m.month * 2 * pi() / 12)")},
  CASE WHEN sex = 'M' THEN 1 ELSE 0 END AS sex_encoded FROM o JOIN m ON month(purchase_time) = m.month""",
)
def month_cyclic(spark, sf):
    out = ft.month_features(orders(spark, sf))
    cols = ["fraud_rate_by_month", "month_sin", "month_cos"]
    return rounded(out.select("transaction_id", "month", *cols, "sex_encoded"), *cols)


def _register_imputed():
    for how in ("median", "max"):
        sql = f"""WITH {O}, g AS (SELECT transaction_id, device_id, (epoch_us(purchase_time) - epoch_us(lag(purchase_time) OVER
  (PARTITION BY device_id ORDER BY purchase_time, transaction_id))) / 1e6 AS gap FROM o),
s AS (SELECT device_id, stddev_samp(CAST(purchase_value AS DOUBLE)) AS std FROM o GROUP BY device_id),
j AS (SELECT transaction_id, gap, std FROM g JOIN s USING (device_id))
SELECT transaction_id, {r6(f"gap_imputed=coalesce(gap, (SELECT {how}(gap) FROM j))",
  "std_imputed=coalesce(std, " + ("0" if how == "median" else "(SELECT median(std) FROM j)") + ")")} FROM j"""

        def run(spark, sf, how=how):
            n = size_of(spark, sf, "orders")
            rows = ft.device_value_features(ft.purchase_gap(orders(spark, sf), name="gap", size=n), n)
            rows = rows.withColumnRenamed("purchase_std_by_device", "std")
            out = ft.imputed_gap(rows, "gap", how, "std", "zero" if how == "median" else "median", n)
            return rounded(out.select("transaction_id", "gap_imputed", "std_imputed"), "gap_imputed", "std_imputed")

        query(f"imputed_gap_{how}", sql)(run)


_register_imputed()


_Z = " + ".join(
    [str(INTERCEPT)]
    + [f"({w!r}) * CAST({c if 'consistency' not in c else f'CAST({c} AS INTEGER)'} AS DOUBLE)" for c, w in WEIGHTS.items()]
)
_SCORED = f"""WITH {E}, {_ranked('e')}, f AS ({_features_sql('e', 'online', 'frauds')}),
s AS (SELECT *, 1 / (1 + exp(-({_Z}))) AS prob FROM f)"""
_RESULT = f"""transaction_id, txn_count, CAST(device_ip_consistency AS INTEGER) AS device_ip_consistency,
  CAST(device_source_consistency AS INTEGER) AS device_source_consistency,
  CAST(trunc(time_setup_to_txn_seconds) AS BIGINT) AS time_setup_to_txn_seconds,
  CAST(trunc(time_since_last_device_txn) AS BIGINT) AS time_since_last_device_txn,
  purchase_deviation_from_device_mean, CAST(trunc(device_lifespan) AS BIGINT) AS device_lifespan, device_fraud_rate,
  CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS predicted_class, {r6("fraud_probability=prob")}"""


def scored_events(spark, sf):
    """Events with features and the score of the fixed linear model."""
    txns = events(spark, sf)
    feats = rounded(ft.device_features(txns, "online", "immediate", size_of(spark, sf, "events")), *DOUBLES)
    return linear_score(feats, WEIGHTS, INTERCEPT)


@query("result_events", f"{_SCORED} SELECT {_RESULT} FROM s")
def result_event_log(spark, sf):
    return rounded(result_events(scored_events(spark, sf)), "fraud_probability")


@query(
    "recent_results",
    f"{_SCORED} SELECT {_RESULT} FROM s WHERE transaction_id IN (SELECT transaction_id FROM e ORDER BY purchase_time DESC, transaction_id DESC LIMIT 20)",
)
def recent(spark, sf):
    newest = recent_results(scored_events(spark, sf), 20, ["purchase_time", "transaction_id"])
    return rounded(result_events(newest), "fraud_probability")


@query(
    "linear_score",
    f"{_SCORED} SELECT transaction_id, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS predicted_class, {r6('fraud_probability=prob')} FROM s",
)
def linear_scores(spark, sf):
    out = scored_events(spark, sf).select("transaction_id", "predicted_class", "fraud_probability")
    return rounded(out, "fraud_probability")


@query(
    "prediction_with_label",
    f"""{_SCORED}, l AS (SELECT transaction_id, is_fraud FROM e WHERE purchase_time + to_days(3) <= (SELECT max(purchase_time) FROM e))
SELECT transaction_id, device_id, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS predicted_class, {r6('fraud_probability=prob')},
  l.is_fraud AS true_label FROM s JOIN e USING (transaction_id) LEFT JOIN l USING (transaction_id)""",
)
def prediction_with_label(spark, sf):
    """Labels take three days; the last transactions have none yet."""
    txns = events(spark, sf)
    now = txns.agg(F.max("purchase_time").alias("t")).scalar()
    labels = label_events(txns, 3).where(F.col("arrival_time") <= now)
    scored = scored_events(spark, sf).select("transaction_id", "device_id", "predicted_class", "fraud_probability")
    return rounded(join_labels(scored, labels), "fraud_probability")


@query(
    "signup_to_purchase",
    f"WITH {E} SELECT transaction_id, {r6('seconds=(epoch_us(purchase_time) - epoch_us(signup_time)) / 1e6')} FROM e",
)
def signup_to_purchase(spark, sf):
    out = events(spark, sf).select("transaction_id", seconds_between("signup_time", "purchase_time").alias("seconds"))
    return rounded(out, "seconds")


@query(
    "features_beside_label",
    f"WITH {E}, {_ranked('e')}, f AS ({_features_sql('e', 'online', '0')}) SELECT f.*, e.is_fraud FROM f JOIN e USING (transaction_id)",
)
def features_beside_label(spark, sf):
    """Features and label from two tables, put side by side on the transaction id."""
    txns = events(spark, sf)
    feats = ft.device_features(txns.drop("is_fraud"), "online", None, size_of(spark, sf, "events"))
    return _shown(feats).join(txns.select("transaction_id", "is_fraud"), "transaction_id")
