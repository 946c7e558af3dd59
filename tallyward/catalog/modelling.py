"""Queries of preparation, resampling, statistics, neighbours and metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyward.catalog.bindings import COORDS, E, O, POINTS, events, orders, points, query, r6, rounded, size_of
from tallyward.catalog.history import DOUBLES, INTERCEPT, WEIGHTS, _SCORED, scored_events
from tallyward.functions.columns import seconds_between
from tallyward.operators import metrics, neighbours, prep, resample, stats
from tallyward.operators.features import device_features
from tallyward.plans.slices import global_rank

_V = "CAST(purchase_value AS DOUBLE)"


def _input(spark, sf):
    """Orders with a boolean, a category and two numbers."""
    return orders(spark, sf).select(
        "transaction_id",
        F.col("purchase_value").cast("double").alias("purchase_value"),
        F.col("age").cast("double").alias("age"),
        F.lit(7.5).alias("constant"),
        "browser",
        (F.col("age") > 50).alias("senior"),
        "is_fraud",
    )


_BROWSERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "scaled_features",
    f"""WITH {O}, s AS (SELECT avg({_V}) AS mv, stddev_pop({_V}) AS sv, avg(age) AS ma, stddev_pop(age) AS sa FROM o)
SELECT transaction_id, is_fraud, {r6(f'purchase_value=({_V} - mv) / sv', 'age=(age - ma) / sa', 'constant=0')},
  CASE WHEN coalesce(age > 50, false) THEN 1 ELSE 0 END AS senior FROM o, s""",
)
def scaled_features(spark, sf):
    rows = _input(spark, sf).drop("browser")
    return rounded(prep.Preprocessor().fit_transform(rows), "purchase_value", "age", "constant")


@query(
    "one_hot",
    f"WITH {O} SELECT transaction_id, is_fraud, "
    + ", ".join(f"CASE WHEN browser = '{b}' THEN 1 ELSE 0 END AS browser_{b}" for b in _BROWSERS)
    + " FROM o",
)
def one_hot(spark, sf):
    rows = _input(spark, sf).select("transaction_id", "is_fraud", "browser")
    return prep.Preprocessor().fit_transform(rows)


@query(
    "class_weights",
    f"WITH {O} SELECT transaction_id, {r6('weight=(SELECT count(*) FROM o) / (2.0 * count(*) OVER (PARTITION BY is_fraud))')} FROM o",
)
def class_weights(spark, sf):
    return rounded(prep.with_class_weight(orders(spark, sf)).select("transaction_id", "weight"), "weight")


@query(
    "undersample",
    f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42-' || transaction_id), transaction_id) AS n FROM e)
SELECT transaction_id, is_fraud FROM k WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM e GROUP BY is_fraud))""",
)
def undersample(spark, sf):
    return resample.undersample(events(spark, sf)).select("transaction_id", "is_fraud")


def _dist(a: str, b: str, coords=COORDS) -> str:
    return "sqrt(" + " + ".join(f"power({a}.{c} - {b}.{c}, 2)" for c in coords) + ")"


def _enn_sql(src: str, k: int, minority: str) -> str:
    """Rows of ``src`` kept by editing; ``minority`` is the class never edited."""
    return f"""SELECT a.id FROM (
  SELECT a.id, a.is_fraud, b.is_fraud AS other, row_number() OVER (PARTITION BY a.id ORDER BY round({_dist('a', 'b')}, 9), b.id) AS n
  FROM {src} a JOIN {src} b ON a.id <> b.id) a WHERE n <= {k} GROUP BY a.id, a.is_fraud
HAVING a.is_fraud = {minority} OR bool_and(a.is_fraud = other)"""


def _register_enn():
    for k in (3, 5, 9):

        def run(spark, sf, k=k):
            return resample.edit_neighbours(points(spark, sf), COORDS, k, id_col="id").select("id")

        query("enn" if k == 3 else f"enn_{k}", f"WITH {POINTS} {_enn_sql('p', k, '1')}")(run)


_register_enn()

_UNIFORM = "CAST(('0x' || substr(md5('{seed}-' || r), 1, 13)) AS BIGINT) / 4503599627370496.0"


def _smote_sql(k: int) -> str:
    coords = ", ".join(f"b.{c} + gap * (t.{c} - b.{c})" for c in COORDS)
    return f"""{POINTS}, own AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM p WHERE is_fraud = 1),
need AS (SELECT CAST(unnest(range((SELECT count(*) FROM p WHERE is_fraud = 0) - (SELECT count(*) FROM own))) AS BIGINT) AS r),
near AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round({_dist('a', 'b')}, 9), b.id) - 1 AS pos
  FROM own a JOIN own b ON a.id <> b.id),
pick AS (SELECT r, r % (SELECT count(*) FROM own) AS i,
  CAST(floor({_UNIFORM.format(seed=42)} * least({k}, (SELECT count(*) - 1 FROM own))) AS BIGINT) AS pos, {_UNIFORM.format(seed=43)} AS gap FROM need),
sm(id, {", ".join(COORDS)}, is_fraud) AS (
  SELECT CAST(id AS VARCHAR), {", ".join(COORDS)}, is_fraud FROM p
  UNION ALL
  SELECT 'synthetic-' || r, {coords}, 1 FROM pick JOIN own b USING (i) JOIN near ON near.id = b.id AND near.pos = pick.pos JOIN own t ON t.id = near.other)"""


@query("smote", f"WITH {_smote_sql(5)} SELECT id, {r6(*COORDS)}, is_fraud FROM sm")
def smote(spark, sf):
    return rounded(resample.smote(points(spark, sf), COORDS, 5, id_col="id"), *COORDS)


@query("smote_enn", f"WITH {_smote_sql(5)} {_enn_sql('sm', 3, '0')}")
def smote_enn(spark, sf):
    return resample.smote_enn(points(spark, sf), COORDS, 5, 3, id_col="id").select("id")


@query("smote_enn_k4", f"WITH {_smote_sql(4)} {_enn_sql('sm', 3, '0')}")
def smote_enn_k4(spark, sf):
    return resample.smote_enn(points(spark, sf), COORDS, 4, 3, id_col="id").select("id")


def kth_sql(coords=COORDS) -> str:
    """The distance to the fifth nearest row, the row itself being the first."""
    dist = _dist("a", "b", coords)
    return f"""d AS (SELECT a.id, {dist} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round({dist}, 9), b.id) AS n
  FROM p a, p b), kd AS (SELECT id, dist FROM d WHERE n = 5)"""


@query("knn_distance", f"WITH {POINTS}, {kth_sql()} SELECT id, {r6('distance=dist')}, row_number() OVER (ORDER BY dist, id) AS rank FROM kd")
def knn_distance(spark, sf):
    out = neighbours.neighbour_distance(points(spark, sf), COORDS, 5)
    return rounded(global_rank(out, ["distance", "id"], derived=True), "distance")


@query(
    "knn_lists",
    f"""WITH {POINTS}, d AS (SELECT a.id, b.id AS other, {_dist('a', 'b')} AS dist,
  row_number() OVER (PARTITION BY a.id ORDER BY round({_dist('a', 'b')}, 9), b.id) AS place FROM p a JOIN p b ON a.id <> b.id)
SELECT id, place, other, {r6('distance=dist')} FROM d WHERE place <= 4""",
)
def knn_lists(spark, sf):
    near = neighbours.nearest(points(spark, sf), COORDS, 4)
    out = near.select("id", F.posexplode("neighbours").alias("place", "n"))
    out = out.select("id", (F.col("place") + 1).cast("long").alias("place"), F.col("n.id").alias("other"), F.col("n.dist").alias("distance"))
    return rounded(out, "distance")


_REPORT = """c AS (SELECT is_fraud AS t, predicted_class AS p FROM q),
k AS (SELECT unnest([0, 1]) AS cls),
m AS (SELECT cls, count(*) FILTER (t = cls AND p = cls) AS hit, count(*) FILTER (t = cls) AS support, count(*) FILTER (p = cls) AS predicted FROM c, k GROUP BY cls),
r AS (SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM m),
rep AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM r)"""
_Q = f"{_SCORED}, q AS (SELECT s.transaction_id, e.is_fraud, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS predicted_class, round(prob, 6) AS score FROM s JOIN e USING (transaction_id))"


def _scored(spark, sf):
    return rounded(scored_events(spark, sf).select("transaction_id", "is_fraud", "predicted_class", "fraud_probability"), "fraud_probability")


@query(
    "classification_report",
    f"""{_Q}, {_REPORT}
SELECT CAST(cls AS VARCHAR) AS label, {r6('precision=pr', 'recall=re', 'f1=f')}, support FROM rep WHERE support + predicted > 0
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM rep WHERE support + predicted > 0
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep""",
)
def classification_report(spark, sf):
    return rounded(metrics.classification_report(_scored(spark, sf)), "precision", "recall", "f1")


@query(
    "confusion",
    f"{_Q} SELECT is_fraud AS true_class, count(*) FILTER (predicted_class = 0) AS predicted_0, count(*) FILTER (predicted_class = 1) AS predicted_1 FROM q GROUP BY is_fraud",
)
def confusion(spark, sf):
    return metrics.confusion_matrix(_scored(spark, sf))


@query(
    "auc_metrics",
    f"""{_Q}, {_REPORT}, v AS (SELECT score, count(*) FILTER (is_fraud = 1) AS pos, count(*) FILTER (is_fraud = 0) AS neg FROM q GROUP BY score),
w AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM v),
a AS (SELECT sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)) AS roc, sum(pos * tp / (tp + fp)) / sum(pos) AS ap FROM w)
SELECT round((SELECT sum(hit) / sum(support) FROM rep), 6) AS accuracy, {r6('precision=pr', 'recall=re', 'f1=f', 'roc_auc=roc', 'pr_auc=ap')} FROM rep, a WHERE cls = 1""",
)
def auc_metrics(spark, sf):
    return rounded(metrics.binary_metrics(_scored(spark, sf), size=size_of(spark, sf, "events")), *metrics.METRICS)


def _mw_sql(body: str, base: str, value: str, z: str) -> str:
    return f"""WITH {body}, v AS (SELECT {value} AS v, count(*) FILTER (is_fraud = 1) AS c1, count(*) AS t FROM {base} GROUP BY 1),
m AS (SELECT c1, t, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS mid FROM v),
s AS (SELECT CAST(sum(c1) AS DOUBLE) AS n1, CAST(sum(t - c1) AS DOUBLE) AS n0, CAST(sum(c1 * mid) AS DOUBLE) AS r1,
  sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM m),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM s)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, {r6('u@1=u', f'z=({z} - n1 * n0 / 2 - 0.5) / sd')} FROM u"""


def _register_mann_whitney():
    for alt, far in (("two-sided", "greatest(u, n1 * n0 - u)"), ("less", "(n1 * n0 - u)"), ("greater", "u")):

        def run(spark, sf, alt=alt):
            out = stats.mann_whitney(orders(spark, sf), "purchase_value", alternative=alt, size=size_of(spark, sf, "orders"))
            return rounded(out.drop("p"), "u@1", "z")

        query(f"mann_whitney_{alt.replace('-', '_')}", _mw_sql(O, "o", "purchase_value", far))(run)


_register_mann_whitney()


@query("mann_whitney_signup", _mw_sql(E, "e", "epoch_us(purchase_time) - epoch_us(signup_time)", "greatest(u, n1 * n0 - u)"))
def mann_whitney_signup(spark, sf):
    rows = events(spark, sf).withColumn("setup", seconds_between("signup_time", "purchase_time"))
    return rounded(stats.mann_whitney(rows, "setup", size=size_of(spark, sf, "events")).drop("p"), "u@1", "z")


def _register_kde():
    for log in (False, True):
        value = f"ln({_V})" if log else _V
        where = "WHERE purchase_value > 0" if log else ""
        sql = f"""WITH {E}, v AS (SELECT is_fraud, {value} AS v, CAST(count(*) AS DOUBLE) AS c FROM e {where} GROUP BY 1, 2),
r AS (SELECT is_fraud, {value} AS v FROM e {where}),
s AS (SELECT is_fraud, CAST(count(*) AS DOUBLE) AS n, stddev_samp(v) * power(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM r GROUP BY is_fraud),
g AS (SELECT s.*, CAST(unnest(range(200)) AS INTEGER) AS i FROM s),
x AS (SELECT *, (lo - 3 * h) + i * ((hi - lo + 6 * h) / 199) AS x FROM g)
SELECT x.is_fraud, i, round(max(x), 6) AS x,
  round(sum(c * exp(-0.5 * power((x - v) / h, 2)) / (n * h * {math.sqrt(2 * math.pi)!r})) * max(n) / (SELECT count(*) FROM r), 6) AS density
FROM x JOIN v USING (is_fraud) GROUP BY x.is_fraud, i"""

        def run(spark, sf, log=log):
            return rounded(stats.kde(events(spark, sf), "purchase_value", "is_fraud", log), "x", "density")

        query("kde_by_class_log" if log else "kde_by_class", sql)(run)


_register_kde()
