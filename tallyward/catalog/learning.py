"""Queries of clustering and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog.bindings import COORDS, GDP, POINTS, O, events, gdp_sheet, orders, points, query, r6, rounded, size_of
from tallyward.catalog.modelling import kth_sql
from tallyward.operators import cluster, enrich, learn, neighbours
from tallyward.operators.features import device_features
from tallyward.operators.prep import Preprocessor
from tallyward.session import settle
from tallyward.sources.files import year_values
from tallyward.sources.schema import FEATURES

# The label of the events is their type, so what follows from the type is no model input.
INPUTS = [f for f in FEATURES if f != "device_source_consistency"]


def _bend_sql() -> str:
    return """r AS (SELECT dist, row_number() OVER (ORDER BY dist, id) AS rank FROM kd),
b AS (SELECT *, (rank - 1) / ((SELECT count(*) FROM r) - 1) - (dist - (SELECT min(dist) FROM r)) / ((SELECT max(dist) - min(dist) FROM r)) AS bend FROM r)"""


def _knee_sql(coords) -> str:
    return f"{kth_sql(coords)}, {_bend_sql()}"


_AT_KNEE = "FROM b ORDER BY round(bend, 12) DESC, rank LIMIT 1"


@query("knee_eps", f"WITH {POINTS}, {_knee_sql(COORDS)} SELECT rank, {r6('eps=dist')} {_AT_KNEE}")
def knee_eps(spark, sf):
    return rounded(cluster.knee(neighbours.neighbour_distance(points(spark, sf), COORDS, 5)), "eps")


def _near(coords) -> str:
    return "sqrt(" + " + ".join(f"power(a.{c} - b.{c}, 2)" for c in coords) + ")"


def _dbscan_sql(eps: float | str, before: str = "") -> str:
    return f"""WITH RECURSIVE {POINTS},{before}
pr AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {_near(COORDS)} <= {eps}),
core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) >= 8),
link AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
walk(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, w.root FROM walk w JOIN link l ON l.a = w.id),
comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM comp)),
cc AS (SELECT id, cluster FROM comp JOIN num USING (root)),
edge AS (SELECT pr.a AS id, min(cc.cluster) AS cluster FROM pr JOIN cc ON pr.b = cc.id WHERE pr.a NOT IN (SELECT id FROM core) GROUP BY pr.a)
SELECT p.id, coalesce(cc.cluster, edge.cluster, -1) AS cluster FROM p LEFT JOIN cc USING (id) LEFT JOIN edge ON edge.id = p.id"""


def _register_dbscan():
    for name, eps in (("dbscan", 1.19), ("dbscan_narrow", 1.16)):

        def run(spark, sf, eps=eps):
            return cluster.dbscan(points(spark, sf), COORDS, eps).select("id", "cluster")

        query(name, _dbscan_sql(eps))(run)


_register_dbscan()


@query(
    "dbscan_at_knee",
    f"""SELECT cluster, count(*) AS rows FROM ({_dbscan_sql("(SELECT eps FROM knee)", f" {_knee_sql(COORDS)}, knee AS (SELECT dist AS eps {_AT_KNEE}),")}) GROUP BY cluster""",
)
def dbscan_at_knee(spark, sf):
    """Sizes of the clusters at the distance the knee gives."""
    return cluster.dbscan_at_knee(points(spark, sf), COORDS).groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


def _customers(spark, sf):
    rows = enrich.add_gdp_imputed(
        orders(spark, sf), year_values(gdp_sheet(spark, sf), 2015), enrich.alias_table(spark), size=size_of(spark, sf, "orders")
    )
    return rows.withColumn("purchase_value", F.col("purchase_value").cast("double"))


# All orders on their scaled inputs; clusters by keeping, for each core row, the least id that has reached it.
_CUSTOMERS = f"""{O}, {GDP},
i AS (SELECT transaction_id AS id, CAST(age AS DOUBLE) AS age, CAST(purchase_value AS DOUBLE) AS value, coalesce(g.gdp, (SELECT avg(gdp) FROM gdp)) AS gdp,
      CASE WHEN sex = 'M' THEN 1 ELSE 0 END AS x3 FROM o LEFT JOIN gdp g USING (country) WHERE age IS NOT NULL AND purchase_value IS NOT NULL),
m AS (SELECT avg(age) AS ma, stddev_pop(age) AS sa, avg(value) AS mv, stddev_pop(value) AS sv, avg(gdp) AS mg, stddev_pop(gdp) AS sg FROM i),
p AS (SELECT id, (age - ma) / sa AS x0, (value - mv) / sv AS x1, (gdp - mg) / sg AS x2, x3 FROM i, m)"""
_INPUTS = ["x0", "x1", "x2", "x3"]


@query(
    "dbscan_customers",
    f"""WITH RECURSIVE {_CUSTOMERS},
kd AS (SELECT a.id, min({_near(_INPUTS)}, 5)[5] AS dist FROM p a, p b GROUP BY a.id),
{_bend_sql()}, knee AS (SELECT dist AS eps {_AT_KNEE}),
pr AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {_near(_INPUTS)} <= (SELECT eps FROM knee)),
core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) >= 8),
link AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
comp(id, root) USING KEY (id) AS (
  SELECT id, id FROM core
  UNION
  SELECT l.b, min(c.root) FROM comp c JOIN link l ON l.a = c.id JOIN recurring.comp r ON r.id = l.b WHERE c.root < r.root GROUP BY l.b),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM comp)),
cc AS (SELECT id, cluster FROM comp JOIN num USING (root)),
edge AS (SELECT pr.a AS id, min(cc.cluster) AS cluster FROM pr JOIN cc ON pr.b = cc.id WHERE pr.a NOT IN (SELECT id FROM core) GROUP BY pr.a)
SELECT p.id AS transaction_id, coalesce(cc.cluster, edge.cluster, -1) AS cluster FROM p LEFT JOIN cc USING (id) LEFT JOIN edge ON edge.id = p.id""",
)
def dbscan_customers(spark, sf):
    """Density clusters of all orders on age, value, GDP and sex, at the distance the knee gives."""
    inputs, names = cluster.cluster_inputs(_customers(spark, sf))
    inputs = settle(inputs)
    return cluster.dbscan_at_knee(inputs, names, id_col="transaction_id").select("transaction_id", "cluster")


CENTRES, ROUNDS = 16, 8


def _groups_sql() -> str:
    """Rounds of k-means from the first rows; g holds the group of every row."""
    far = " + ".join(f"power(p.{c} - c.{c}, 2)" for c in _INPUTS)
    place = f"SELECT p.*, k FROM p JOIN (SELECT p.id, arg_min(k, {{'d': {far}, 'k': k}}) AS k FROM p, c{{0}} c GROUP BY p.id) n USING (id)"
    parts = [f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, * FROM p QUALIFY k < {CENTRES})"]
    for r in range(1, ROUNDS + 1):
        means = ", ".join(f"coalesce(avg(a.{c}), any_value(c.{c})) AS {c}" for c in _INPUTS)
        parts.append(f"a{r} AS MATERIALIZED ({place.replace('{0}', str(r - 1))}), c{r} AS MATERIALIZED (SELECT c.k, {means} FROM c{r - 1} c LEFT JOIN a{r} a ON a.k = c.k GROUP BY c.k)")
    return ", ".join(parts) + f", g AS MATERIALIZED ({place.replace('{0}', str(ROUNDS))})"


def _groups(spark, sf):
    rows = _customers(spark, sf)
    inputs, names = cluster.cluster_inputs(rows)
    inputs = settle(inputs)
    start = [tuple(r) for r in inputs.orderBy("transaction_id").limit(CENTRES).select(*names).collect()]
    return rows, cluster.kmeans(inputs, names, start=start, rounds=ROUNDS), names


@query(
    "kmeans_profile",
    f"""WITH {_CUSTOMERS}, {_groups_sql()}
SELECT CAST(k AS INTEGER) AS customer_group, {r6('purchase_value=avg(value)', 'age=avg(age)', 'gdp=avg(gdp)', 'is_male=avg(i.x3)')} FROM g JOIN i USING (id) GROUP BY k""",
)
def kmeans_profile(spark, sf):
    """Sixteen groups of all orders from fixed centres, and what their members are like."""
    rows, groups, _ = _groups(spark, sf)
    shown = rows.withColumn("is_male", (F.col("sex") == "M").cast("int")).join(groups.select("transaction_id", "customer_group"), "transaction_id")
    return rounded(cluster.cluster_profile(shown, ["purchase_value", "age", "gdp", "is_male"]), "purchase_value", "age", "gdp", "is_male")


@query(
    "silhouette",
    f"""WITH {_CUSTOMERS}, {_groups_sql()}, n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
f AS (SELECT a.id, a.k AS own, b.k AS other, avg({_near(_INPUTS)} * {_near(_INPUTS)}) AS far FROM g a, g b GROUP BY ALL),
s AS (SELECT f.id, max(far) FILTER (own = other) * any_value(n.n) / nullif(any_value(n.n) - 1, 0) AS a, min(far) FILTER (own <> other) AS b, any_value(n.n) AS n
      FROM f JOIN n ON n.k = f.own GROUP BY f.id)
SELECT count(*) AS rows, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
def silhouette(spark, sf):
    """Mean silhouette, with squared distances, of those groups; the SQL goes over all pairs."""
    _, groups, names = _groups(spark, sf)
    score = cluster.silhouette(settle(groups), names)
    return groups.agg(F.count(F.lit(1)).alias("rows")).withColumn("silhouette", F.round(F.lit(score), 6))


@query("pca2")
def pca2(spark, sf):
    return rounded(cluster.pca2(points(spark, sf), COORDS).select("id", "pc1", "pc2"), "pc1", "pc2")


def _component_sql() -> str:
    """Components v1 and v2 by squaring the covariance matrix until one direction is left, then taking that direction out."""
    at = lambda i, j: 4 * i + j + 1
    square = ", ".join(" + ".join(f"m[{at(i, k)}] * m[{at(k, j)}]" for k in range(4)) for i in range(4) for j in range(4))
    trace = " + ".join(f"q[{at(i, i)}]" for i in range(4))
    parts = [f"cov0 AS (SELECT [{', '.join(f'covar_samp({a}, {b})' for a in _INPUTS for b in _INPUTS)}] AS m FROM p)"]
    for n in (1, 2):
        parts += [
            f"s{n}(n, m) AS (SELECT 0, m FROM cov{n - 1} UNION ALL SELECT n + 1, list_transform(q, lambda x: x / ({trace})) FROM (SELECT n, [{square}] AS q FROM s{n} WHERE n < 30))",
            f"d{n} AS (SELECT m, list_position([{', '.join(f'm[{at(i, i)}]' for i in range(4))}], greatest({', '.join(f'm[{at(i, i)}]' for i in range(4))})) AS j FROM s{n} WHERE n = 30)",
            f"u{n} AS (SELECT [m[j], m[4 + j], m[8 + j], m[12 + j]] AS u FROM d{n})",
            f"v{n} AS (SELECT list_transform(u, lambda x: x / sqrt(list_inner_product(u, u)) * sign(u[list_position(list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))])) AS v FROM u{n})",
        ]
        along = " + ".join(f"v[{i + 1}] * v[{j + 1}] * m[{at(i, j)}]" for i in range(4) for j in range(4))
        parts.append(f"cov{n} AS (SELECT [{', '.join(f'm[{at(i, j)}] - l * v[{i + 1}] * v[{j + 1}]' for i in range(4) for j in range(4))}] AS m FROM (SELECT m, v, {along} AS l FROM cov{n - 1}, v{n}))")
    return ", ".join(parts)


def _along(v: str) -> str:
    return " + ".join(f"{v}.v[{i + 1}] * (p.{c} - mid.{c})" for i, c in enumerate(_INPUTS))


@query(
    "pca2_customers",
    f"""WITH RECURSIVE {_CUSTOMERS}, {_component_sql()}, mid AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in _INPUTS)} FROM p)
SELECT p.id AS transaction_id, {r6(f'pc1={_along("v1")}', f'pc2={_along("v2")}')} FROM p, mid, v1, v2""",
)
def pca2_customers(spark, sf):
    """Two components of all orders' age, value, GDP and sex."""
    inputs, names = cluster.cluster_inputs(_customers(spark, sf))
    return rounded(cluster.pca2(settle(inputs), names).select("transaction_id", "pc1", "pc2"), "pc1", "pc2")


def model_inputs(spark, sf):
    txns = events(spark, sf)
    feats = device_features(txns, "online", "immediate", size_of(spark, sf, "events"))
    rows = settle(feats.select("transaction_id", "is_fraud", *INPUTS))
    prep = Preprocessor().fit(rows)
    return prep.transform(rows), prep.feature_names


def _register_models():
    for name, kind, params in (
        ("train_lr", "logistic_regression", {"C": 0.01, "penalty": "l1", "class_weight": "balanced", "max_iter": 500}),
        ("train_rf", "random_forest", {"n_estimators": 20, "max_depth": 5, "min_samples_leaf": 2, "class_weight": "balanced"}),
        ("train_gbt", "xgboost", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1, "scale_pos_weight": 5}),
        ("train_svc", "svc", {"C": 1, "max_iter": 50}),
    ):

        def run(spark, sf, kind=kind, params=params):
            rows, names = model_inputs(spark, sf)
            model = learn.RiskModel(kind, "random_undersampling", params).fit(rows, names)
            score = "fraud_margin" if kind == "svc" else "fraud_probability"
            return rounded(model.predict(rows).select("transaction_id", "is_fraud", "predicted_class", score), score)

        query(name)(run)


_register_models()


@query("feature_importance")
def feature_importance(spark, sf):
    rows, names = model_inputs(spark, sf)
    params = {"C": 0.01, "penalty": "l2", "class_weight": "balanced"}
    model = learn.RiskModel("logistic_regression", "random_undersampling", params).fit(rows, names)
    return rounded(model.importance(spark), "coefficient")


@query("grid_search")
def grid_search(spark, sf):
    rows, names = model_inputs(spark, sf)
    return rounded(learn.grid_search(rows, names)[1], "recall")


@query("training_report")
def training_report(spark, sf):
    """The offline job on all events, with a fixed candidate."""
    params = {"C": 0.01, "penalty": "l1", "class_weight": "balanced", "max_iter": 500}
    n = size_of(spark, sf, "events")
    run = learn.train(events(spark, sf), "random_undersampling", params=params, initial_rows=None, labels="immediate", size=n)
    return rounded(run.report, "precision", "recall", "f1")


# The date of an order tells its status; Newton's steps to the optimum that the classifier also seeks.
_PENALTY = {"C": 0.001, "penalty": "l2", "max_iter": 500, "tol": 1e-14}
_DAYS = f"""{O}, x AS (SELECT transaction_id, is_fraud AS y, CAST(date_diff('day', DATE '1990-01-01', CAST(purchase_time AS DATE)) AS DOUBLE) AS days FROM o),
m AS (SELECT avg(days) AS mean, stddev_pop(days) AS sd FROM x), p AS (SELECT transaction_id, y, (days - mean) / sd AS x FROM x, m),
w(n, b, c) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT n + 1, b - (hcc * gb - hbc * gc) / (hbb * hcc - hbc * hbc), c - (hbb * gc - hbc * gb) / (hbb * hcc - hbc * hbc) FROM (
    SELECT n, any_value(b) AS b, any_value(c) AS c, sum(q - y) AS gb, sum((q - y) * x) + any_value(c) / {_PENALTY['C']} AS gc,
           sum(q * (1 - q)) AS hbb, sum(q * (1 - q) * x) AS hbc, sum(q * (1 - q) * x * x) + 1 / {_PENALTY['C']} AS hcc
    FROM (SELECT n, b, c, x, y, 1 / (1 + exp(-(b + c * x))) AS q FROM w, p WHERE n < 20) GROUP BY n)),
best AS (SELECT b, c FROM w WHERE n = 20)"""


def _of_days(spark, sf):
    rows = orders(spark, sf).select("transaction_id", "is_fraud", F.date_diff(F.to_date("purchase_time"), F.lit("1990-01-01").cast("date")).cast("double").alias("days"))
    ready = settle(Preprocessor().fit_transform(rows))
    return ready, learn.RiskModel("logistic_regression", None, _PENALTY).fit(ready, ["days"])


@query("logistic_coefficients", f"WITH RECURSIVE {_DAYS} SELECT 'days' AS feature, {r6('coefficient@5=c')}, {r6('intercept@5=b')} FROM best")
def logistic_coefficients(spark, sf):
    """The importance table of a classifier of all orders, and its intercept."""
    _, model = _of_days(spark, sf)
    return rounded(model.importance(spark).withColumn("intercept", F.lit(model.coefficients()[1])), "coefficient", "intercept", places=5)


@query("logistic_classes", f"WITH RECURSIVE {_DAYS} SELECT transaction_id, y AS is_fraud, CASE WHEN b + c * x > 0 THEN 1 ELSE 0 END AS predicted_class FROM p, best")
def logistic_classes(spark, sf):
    ready, model = _of_days(spark, sf)
    return model.predict(ready).select("transaction_id", "is_fraud", "predicted_class")


def _register_separable():
    """Where one input tells the classes apart, every classifier must find it."""
    for name, kind, params in (
        ("random_forest", "random_forest", {"n_estimators": 10, "max_depth": 4}),
        ("boosted_trees", "boosted_trees", {"n_estimators": 5, "max_depth": 2}),
        ("svc", "svc", {"C": 1, "max_iter": 100}),
    ):

        def run(spark, sf, kind=kind, params=params):
            noise = F.pmod(F.xxhash64("transaction_id"), F.lit(97)).cast("double")
            rows = events(spark, sf).select("transaction_id", "is_fraud", (noise + 200 * F.col("is_fraud")).alias("telling"), noise.alias("idle"))
            ready = settle(Preprocessor().fit_transform(rows))
            model = learn.RiskModel(kind, "random_undersampling", params).fit(ready, ["telling", "idle"])
            return model.predict(ready).select("transaction_id", "predicted_class")

        query(f"separable_{name}", "SELECT event_id AS transaction_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS predicted_class FROM events")(run)


_register_separable()
