import json
import math
import random

import numpy as np
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from tallyward.operators import cluster, learn, metrics, resample, stats
from tallyward.operators.neighbours import BOX_ROWS, nearest
from tallyward.operators.prep import Preprocessor, with_class_weight
from tallyward.operators.scoring import drop_duplicates


@pytest.fixture(params=[None, "12"])
def boxes(request, spark):
    if request.param:
        spark.conf.set(BOX_ROWS, request.param)
    yield
    spark.conf.unset(BOX_ROWS)


def cloud(spark, n=150, seed=4):
    """Two blobs, a bridge, noise, and one location that holds a third of the rows."""
    rnd = np.random.default_rng(seed)
    pts = np.vstack(
        [
            rnd.normal((0, 0), 0.3, (n // 3, 2)),
            np.repeat([[0.25, 0.25]], n // 3, axis=0),
            rnd.normal((3, 3), 0.3, (n // 6, 2)),
            rnd.uniform(-3, 6, (n // 6, 2)),
        ]
    )
    rows = [(i, float(p[0]), float(p[1]), int(i % 4 == 0)) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "id long, x double, y double, is_fraud int"), rows


def brute(rows, k, with_self=False):
    out = {}
    for i, x, y, _ in rows:
        d = sorted((round(math.hypot(x - q[1], y - q[2]), 9), q[0]) for q in rows if with_self or q[0] != i)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("with_self", [False, True])
def test_nearest_is_exact(spark, boxes, k, with_self):
    df, rows = cloud(spark)
    got = nearest(df, ["x", "y"], k, include_self=with_self)
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in got.collect()}
    assert got == brute(rows, k, with_self)


def test_editing(spark, boxes):
    df, rows = cloud(spark)
    cls, near = {r[0]: r[3] for r in rows}, brute(rows, 3)
    want = {i for i in cls if cls[i] == 1 or all(cls[j] == 0 for j in near[i])}
    assert {r["id"] for r in resample.edit_neighbours(df, ["x", "y"], 3, id_col="id").collect()} == want


def dbscan_by_hand(rows, eps, least):
    near = {a[0]: [b[0] for b in rows if math.hypot(a[1] - b[1], a[2] - b[2]) <= eps] for a in rows}
    label, nxt = {}, 0
    core = {i for i in near if len(near[i]) >= least}
    for i in sorted(near):
        if i in label or i not in core:
            continue
        todo = [i]
        label[i] = nxt
        while todo:
            for j in near[todo.pop()]:
                if j not in label:
                    label[j] = nxt
                    if j in core:
                        todo.append(j)
        nxt += 1
    return {i: label.get(i, -1) for i in near}


@pytest.mark.parametrize("eps", [0.25, 0.6])
def test_dbscan(spark, boxes, eps):
    df, rows = cloud(spark)
    assert rows_by(cluster.dbscan(df, ["x", "y"], eps, 5), "id", "cluster") == dbscan_by_hand(rows, eps, 5)


def test_dbscan_cells_that_only_just_meet(spark):
    """Two rings of rows whose nearest members are a hair within, or beyond, eps."""
    for off, clusters in ((-1e-7, {0}), (1e-7, {0, 1})):
        rows = [(i, 0.02 * i, 0.01 * (i % 3), 0) for i in range(10)]
        edge = max(r[1] for r in rows)
        rows += [(100 + i, edge + 0.5 + off + 0.02 * i, 0.01 * (i % 3), 0) for i in range(10)]
        df = spark.createDataFrame(rows, "id long, x double, y double, is_fraud int")
        got = rows_by(cluster.dbscan(df, ["x", "y"], 0.5, 5), "id", "cluster")
        assert set(got.values()) == clusters
        assert got == dbscan_by_hand(rows, 0.5, 5)


def test_resampling_sizes(spark):
    df, rows = cloud(spark)
    ones = sum(r[3] for r in rows)
    under = resample.undersample(df, id_col="id")
    assert rows_by(under.groupBy("is_fraud").count(), "is_fraud", "count") == {0: ones, 1: ones}
    assert sorted(under.collect()) == sorted(resample.undersample(df.repartition(7), id_col="id").collect())
    over = resample.smote(df, ["x", "y"], id_col="id")
    assert rows_by(over.groupBy("is_fraud").count(), "is_fraud", "count") == {0: len(rows) - ones, 1: len(rows) - ones}
    with pytest.raises(ValueError):
        resample.resample(df, "magic", ["x", "y"])


def test_scaling_and_encoding(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", 1.0, 7, "a", True, 0), ("2", 3.0, 7, "b", None, 1)], "transaction_id string, x double, c int, cat string, ok boolean, is_fraud int"
    )
    prep = Preprocessor().fit(df)
    assert prep.feature_names == ["x", "c", "cat_a", "cat_b", "ok"]
    assert rows_by(prep.transform(df), "transaction_id", *prep.feature_names) == {"1": (-1.0, 0.0, 1, 0, 1), "2": (1.0, 0.0, 0, 1, 0)}
    unseen = df.withColumn("cat", F.lit("z"))
    assert rows_by(prep.transform(unseen), "transaction_id", "cat_a", "cat_b")["1"] == (0, 0)
    prep.save(spark, str(tmp_path / "prep"))
    again = Preprocessor.load(spark, str(tmp_path / "prep"))
    assert again.transform(df).collect() == prep.transform(df).collect()
    assert Preprocessor(drop_first=True).fit(df).feature_names == ["x", "c", "cat_b", "ok"]
    with pytest.raises(ValueError):
        Preprocessor().transform(df)
    weights = with_class_weight(spark.createDataFrame([(0,), (0,), (0,), (1,)], "is_fraud int"))
    assert {(r[0], round(r[1], 6)) for r in weights.collect()} == {(0, 0.666667), (1, 2.0)}


def test_report_with_an_empty_class(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.2)], "is_fraud int, predicted_class int, fraud_probability double")
    got = rows_by(metrics.classification_report(df), "label", "precision", "recall", "f1", "support")
    assert got["1"] == (0.0, 0.0, 0.0, 1)
    assert got["0"] == pytest.approx((0.5, 1.0, 2 / 3, 1))
    assert got["accuracy"][2:] == (0.5, 2)
    assert metrics.binary_metrics(df).first()["roc_auc"] == 1.0
    assert rows_by(metrics.confusion_matrix(df), "true_class", "predicted_0", "predicted_1") == {0: (1, 0), 1: (1, 0)}


def test_mann_whitney_with_ties(spark):
    one, zero = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(v, 1) for v in one] + [(v, 0) for v in zero], "v double, is_fraud int")
    u = sum((a > b) + 0.5 * (a == b) for a in one for b in zero)
    n = 9
    ties = (3**3 - 3) + (2**3 - 2)
    sd = math.sqrt(4 * 5 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = {"two-sided": (max(u, 20 - u) - 10 - 0.5) / sd, "greater": (u - 10 - 0.5) / sd, "less": (20 - u - 10 - 0.5) / sd}
    for alt, want in z.items():
        row = stats.mann_whitney(df, "v", alternative=alt).first()
        tail = math.erfc(want / math.sqrt(2)) / 2
        assert (row["u"], row["z"], row["p"]) == pytest.approx((u, want, min(1, 2 * tail) if alt == "two-sided" else tail))
    with pytest.raises(ValueError):
        stats.mann_whitney(df, "v", alternative="up")


def test_densities_add_up(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(rnd.gauss(i % 2, 1.0), i % 2) for i in range(200)], "v double, is_fraud int")
    rows = stats.kde(df, "v", "is_fraud").orderBy("is_fraud", "i").collect()
    area = sum((b["x"] - a["x"]) * a["density"] for a, b in zip(rows, rows[1:]) if a["is_fraud"] == b["is_fraud"])
    assert area == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest", "xgboost", "svc"])
def test_models_on_separable_rows(spark, tmp_path, kind):
    rows = [(str(i), float(i % 2) * 4 + (i % 7) / 10, float(i % 5), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "transaction_id string, x double, y double, is_fraud int")
    params = {"n_estimators": 5, "max_depth": 3, "max_iter": 30, "C": 1.0}
    model = learn.RiskModel(kind, "random_undersampling", params).fit(df, ["x", "y"])
    out = model.predict(df)
    assert out.where("is_fraud = 1 and predicted_class = 0").count() == 0
    assert model.importance(spark).first()["feature"] == "x"
    model.save(spark, str(tmp_path / kind))
    again = learn.RiskModel.load(spark, str(tmp_path / kind))
    assert sorted(again.predict(df).collect()) == sorted(out.collect())
    with pytest.raises(ValueError):
        learn.RiskModel(kind).predict(df)


def test_grid_and_unknown_model(spark):
    rows = [(str(i), float(i % 2) * 4 + (i % 7) / 10, float(i % 5), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "transaction_id string, x double, y double, is_fraud int")
    grid = {"C": [0.01, 1.0], "penalty": ["l2"], "max_iter": [20]}
    for leaky in (False, True):
        model, table = learn.grid_search(df, ["x", "y"], "logistic", grid=grid, folds=3, leaky=leaky)
        assert table.count() == 2 and table.first()["recall"] == 1.0
        assert model.params["C"] in (0.01, 1.0)
    with pytest.raises(ValueError):
        learn.RiskModel("oracle")
    folds = learn.with_fold(df, 5).groupBy("is_fraud", "fold").count().collect()
    assert {r["count"] for r in folds} == {6}


def test_grid_repeats_no_fit_that_ended(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(str(i), rnd.gauss(i % 3 == 0, 1.0), rnd.gauss(i % 3 == 0, 2.0), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "transaction_id string, x double, y double, is_fraud int")
    grid = {"max_iter": [400, 2, 200], "C": [1.0], "penalty": ["l2"], "class_weight": ["balanced"]}
    caps, fit = [], learn.RiskModel.fit_prepared

    def counted(self, *args, **named):
        caps.append(self.params["max_iter"])
        return fit(self, *args, **named)

    monkeypatch.setattr(learn, "PART_ROWS", 50)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(learn.RiskModel, "fit_prepared", counted)
    model, table = learn.grid_search(df, ["x", "y"], "logistic", grid=grid, folds=2)
    got = {json.loads(r["params"])["max_iter"]: r["recall"] for r in table.collect()}
    assert sorted(caps[:-1]) == [2, 2, 200, 200] and caps[-1] == model.params["max_iter"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    folded = learn.with_fold(df, 2).cache()
    for cap in grid["max_iter"]:
        want = 0
        for f in range(2):
            params = {**learn.candidates(grid)[0], "max_iter": cap}
            one = learn.RiskModel("logistic", "random_undersampling", params).fit(folded.where(F.col("fold") != f).drop("fold"), ["x", "y"])
            want += one.predict(folded.where((F.col("fold") == f) & (F.col("is_fraud") == 1))).agg(F.avg("predicted_class")).first()[0] / 2
        assert got[cap] == pytest.approx(want)
    folded.unpersist()


def test_draws_with_ids_repeated_or_missing(spark, tiny_groups):
    rows = [(None if i % 10 == 0 else str(i // 3), int(i % 4 == 0)) for i in range(200)] + [("same", 0)] * 9
    df = spark.createDataFrame(rows, "id string, is_fraud int").withColumn("__h", F.md5(F.concat(F.lit("42-"), "id")))
    most = df.where("is_fraud = 0")
    n = most.count()
    for at in (0, 7, 50, 120, n - 1, n):
        assert resample._hash_cut(most, "id", at) == resample.row_at(most, ["__h", "id"], at, n)


def test_clusters(spark):
    df, rows = cloud(spark)
    groups = cluster.kmeans(df, ["x", "y"], 3)
    assert groups.select("customer_group").distinct().count() == 3
    assert -1 <= cluster.silhouette(groups, ["x", "y"]) <= 1
    pcs = cluster.pca2(df, ["x", "y"])
    means = pcs.agg(F.avg("pc1"), F.avg("pc2")).first()
    assert tuple(means) == pytest.approx((0, 0), abs=1e-9)
    assert cluster.dbscan_eps(df, ["x", "y"]) > 0


def test_training_run(make, spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, f"d{rnd.randrange(12)}", i * 60, rnd.randrange(1, 50) + 40 * (i % 4 == 0), "web", rnd.randrange(3), int(i % 4 == 0)) for i in range(160)]
    run = learn.train(make(rows), "random_undersampling", params={"C": 1.0, "max_iter": 20}, initial_rows=100, save_to=str(tmp_path))
    assert run.predictions.count() == 100
    assert rows_by(run.report, "label", "support")["accuracy"] == 20
    late = sum(r[6] for r in rows[80:100])
    assert spark.read.parquet(str(tmp_path / "device_state")).agg(F.sum("fraud_count"), F.sum("txn_count")).first() == (late, 100)
    parity = learn.train(make(rows), "random_undersampling", params={"C": 1.0, "max_iter": 20}, initial_rows=100, inclusive_end=True)
    assert rows_by(parity.report, "label", "support")["accuracy"] == 21


@pytest.mark.parametrize("most", [256, 1])
def test_densities_of_arrays_and_rows_agree_with_numpy(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "ARRAY_GROUPS", most)
    r = np.random.default_rng(2)
    data = [(str(i % 3), float(x)) for i, x in enumerate(r.lognormal(0, 1, 400))] + [("flat", 2.0)] * 5 + [(None, 1.0), ("0", None)]
    got = {}
    for x in stats.kde(spark.createDataFrame(data, "k string, v double").repartition(5), "v", "k", points=30).collect():
        got.setdefault(x["k"], {})[x["i"]] = (x["x"], x["density"])
    assert set(got) == {"0", "1", "2"}
    total = sum(k is not None and v is not None for k, v in data)
    for k, curve in got.items():
        own = np.array([v for g, v in data if g == k and v is not None])
        h = own.std(ddof=1) * len(own) ** -0.2
        x = own.min() - 3 * h + np.arange(30) * (own.max() - own.min() + 6 * h) / 29
        want = np.exp(-0.5 * ((x[:, None] - own) / h) ** 2).sum(axis=1) / (h * np.sqrt(2 * np.pi)) / total
        assert [curve[i][0] for i in range(30)] == pytest.approx(x.tolist()) and [curve[i][1] for i in range(30)] == pytest.approx(want.tolist())


def test_drop_duplicates(make):
    df = make([(1, "d", 0, 1.0, "web", 5, 0), (1, "d", 0, 1.0, "web", 5, 0), (2, "d", 0, 1.0, "web", 5, 0)])
    assert drop_duplicates(df).count() == 2


def test_dbscan_customers_uses_the_four_inputs_of_all_orders(spark):
    import numpy as np
    from tallyward import catalog
    from tallyward.catalog.learning import _customers
    from tallyward.operators import cluster

    sf = "/root/testdata/sf0.001"
    out = {r["transaction_id"]: r["cluster"] for r in catalog.queries()["dbscan_customers"](spark, sf).collect()}
    data = _customers(spark, sf).select("transaction_id", "age", "purchase_value", "gdp", "sex").orderBy("transaction_id").collect()
    assert len(out) == len(data) == spark.read.parquet(f"{sf}/orders.parquet").count()
    x = np.array([[float(r["age"]), float(r["purchase_value"]), float(r["gdp"])] for r in data])
    x = np.column_stack(((x - x.mean(axis=0)) / x.std(axis=0), [float(r["sex"] == "M") for r in data]))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    kth = np.sort(np.sort(d, axis=1)[:, 4])
    bend = np.arange(len(kth)) / (len(kth) - 1) - (kth - kth[0]) / (kth[-1] - kth[0])
    near = d <= kth[np.argmax(np.round(bend, 12))] * (1 + 1e-9)
    core, label, number = near.sum(axis=1) >= 8, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = number
                    todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
            number += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    assert number > 1 and (label >= 0).mean() > 0.2
    # pairs at just the knee distance may fall on either side of it by rounding
    assert np.mean([out[r["transaction_id"]] == c for r, c in zip(data, label)]) > 0.99
