"""Classifiers on Spark ML: fit, tune, predict, explain, store; and the whole training run."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.features import device_features, device_state
from tallyward.operators.metrics import classification_report
from tallyward.operators.prep import Preprocessor, class_counts, with_class_weight
from tallyward.operators.resample import resample
from tallyward.operators.splits import TIME_ORDER, time_split
from tallyward.plans.slices import Over, precedes, row_at, running
from tallyward.session import kept, settle
from tallyward.sources.files import write_predictions
from tallyward.sources.schema import FEATURES

MODELS = ("logistic_regression", "random_forest", "boosted_trees", "svc")

# Rows of the folds in a partition: a pass of a fit is a task for each.
PART_ROWS = 500_000

# The grids to tune over.
GRIDS = {
    "logistic_regression": {
        "C": [0.001, 0.01],
        "penalty": ["l1", "l2"],
        "class_weight": ["balanced"],
        "max_iter": [500, 1000],
    },
    "svc": {"C": [1]},
    "random_forest": {
        "n_estimators": [50, 100, 200],
        "max_depth": [5, 10, 15, 20],
        "min_samples_leaf": [2, 5, 10],
        "class_weight": ["balanced"],
    },
    # 16 of the candidates below, so that tuning without a grid ends
    "boosted_trees": {
        "n_estimators": [100],
        "max_depth": [3, 7],
        "learning_rate": [0.05, 0.1],
        "min_child_weight": [1],
        "subsample": [0.8],
        "colsample_bytree": [0.8],
        "scale_pos_weight": [5, 10, 15, 20],
    },
}

# Every candidate for boosted trees, 1,728 of them, to be passed as ``grid``.
ALL_BOOSTED = {
    "n_estimators": [100, 200, 300],
    "max_depth": [3, 5, 7, 10],
    "learning_rate": [0.01, 0.05, 0.1],
    "min_child_weight": [1, 3, 5],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.8, 1.0],
    "scale_pos_weight": [5, 10, 15, 20],
}


def _kind(model: str) -> str:
    if model.startswith("logistic"):
        return "logistic_regression"
    model = {"xgboost": "boosted_trees", "gbt": "boosted_trees"}.get(model, model)
    if model not in MODELS:
        raise ValueError(f"no classifier {model!r}: choose one of {MODELS}")
    return model


def estimator(model: str, params: dict, rows: int, features: int, label: str = "is_fraud"):
    """Spark ML estimator for parameters in the usual names of single-machine libraries.

    ``C`` weighs the summed loss there and the mean loss is penalised here, so regParam = 1 / (C rows).
    """
    model, seed = _kind(model), params.get("random_state", 42)
    common = {"labelCol": label, "featuresCol": "features", "weightCol": "__weight", "predictionCol": "__prediction"}
    if model == "logistic_regression":
        return LogisticRegression(
            **common,
            regParam=1.0 / (params.get("C", 1.0) * max(rows, 1)),
            elasticNetParam=1.0 if params.get("penalty", "l2") == "l1" else 0.0,
            maxIter=params.get("max_iter", 100),
            tol=params.get("tol", 1e-6),
            standardization=False,
        )
    if model == "svc":
        return LinearSVC(**common, regParam=1.0 / (params.get("C", 1.0) * max(rows, 1)), maxIter=params.get("max_iter", 100), standardization=False)
    if model == "random_forest":
        return RandomForestClassifier(
            **common,
            numTrees=params.get("n_estimators", 100),
            maxDepth=params.get("max_depth", 10),
            minInstancesPerNode=params.get("min_samples_leaf", 1),
            seed=seed,
        )
    share = params.get("colsample_bytree", 1.0)
    return GBTClassifier(
        **common,
        maxIter=params.get("n_estimators", 100),
        maxDepth=params.get("max_depth", 6),
        stepSize=params.get("learning_rate", 0.3),
        subsamplingRate=params.get("subsample", 1.0),
        minInstancesPerNode=max(1, int(params.get("min_child_weight", 1))),
        featureSubsetStrategy="all" if share >= 1 else str(max(1, round(share * features))),
        seed=seed,
    )


def _ready(df: DataFrame, features: Sequence[str], params: dict, label: str, counts: dict[int, int] | None = None, assembled: bool = False) -> DataFrame:
    if params.get("class_weight") == "balanced":
        df = with_class_weight(df, label, "__weight", counts)
    else:
        heavy = float(params.get("scale_pos_weight", 1))
        df = df.withColumn("__weight", F.when(F.col(label) == 1, heavy).otherwise(1.0))
    return df if assembled else VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


@dataclass
class RiskModel:
    """A classifier with the resampling it is fitted under."""

    model_type: str = "logistic_regression"
    resampling: str | None = "random_undersampling"
    params: dict = field(default_factory=dict)
    label: str = "is_fraud"
    id_col: str = "transaction_id"
    features: list[str] = field(default_factory=list)
    model: PipelineModel | None = None

    def __post_init__(self):
        self.model_type = _kind(self.model_type)

    def fit(self, df: DataFrame, features: Sequence[str]) -> RiskModel:
        self.features = list(features)
        rows = df if self.resampling is None else resample(df, self.resampling, self.features, self.label, self.id_col)
        return self.fit_prepared(settle(rows))

    def fit_prepared(self, rows: DataFrame, size: int | None = None, counts: dict[int, int] | None = None, assembled: bool = False) -> RiskModel:
        """``size`` and ``counts``, the rows in all and by class, are counted here unless the caller knows them.

        ``assembled`` rows have their features as the vector ``features`` already.
        """
        fit = estimator(self.model_type, self.params, rows.count() if size is None else size, len(self.features), self.label)
        fitted = fit.fit(_ready(rows, self.features, self.params, self.label, counts, assembled))
        self.model = PipelineModel([VectorAssembler(inputCols=self.features, outputCol="features"), fitted])
        return self

    def ended(self) -> bool:
        """The fit is known to have stopped before ``max_iter``: with a higher one it would take the same passes to the same model."""
        fitted = self.model.stages[-1]
        if self.model_type != "logistic_regression" or not fitted.hasSummary:
            return False
        return len(fitted.summary.objectiveHistory) - 1 < fitted.getMaxIter()

    def predict(self, df: DataFrame, assembled: bool = False) -> DataFrame:
        """``predicted_class`` and ``fraud_probability``; a margin classifier has ``fraud_margin`` instead."""
        if self.model is None:
            raise ValueError("there is no fitted model yet")
        model = self.model.stages[-1] if assembled else self.model
        out = model.transform(df).withColumn("predicted_class", F.col("__prediction").cast("int"))
        score = "fraud_margin" if self.model_type == "svc" else "fraud_probability"
        source = "rawPrediction" if self.model_type == "svc" else "probability"
        return out.withColumn(score, vector_to_array(source)[1]).select(*df.columns, "predicted_class", score)

    def importance(self, spark: SparkSession, top: int | None = 20, non_zero: bool = False) -> DataFrame:
        """Coefficients by size, or importances; one row per feature."""
        if self.model is None:
            raise ValueError("there is no fitted model yet")
        fitted = self.model.stages[-1]
        name = "coefficient" if hasattr(fitted, "coefficients") else "importance"
        values = fitted.coefficients if name == "coefficient" else fitted.featureImportances
        table = spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, values.toArray())], f"feature string, {name} double")
        if non_zero:
            table = table.where(F.col(name) != 0)
        table = table.orderBy(F.abs(name).desc(), "feature")
        return table if top is None else table.limit(top)

    def coefficients(self) -> tuple[dict[str, float], float]:
        fitted = self.model.stages[-1]
        return dict(zip(self.features, map(float, fitted.coefficients.toArray()))), float(fitted.intercept)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        about = {"model_type": self.model_type, "resampling": self.resampling, "params": self.params, "label": self.label, "id_col": self.id_col, "features": self.features}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(**about, model=PipelineModel.load(f"{path}/model"))


def with_fold(df: DataFrame, folds: int = 5, label: str = "is_fraud", id_col: str = "transaction_id", size: int | None = None) -> DataFrame:
    """Stratified folds: the position of a row within its class, modulo the number of folds."""
    out = running(df, [label], [id_col], [Over("__pos", "count", F.lit(1), "before")], size)
    return out.withColumn("fold", F.pmod(F.col("__pos"), F.lit(folds)).cast("int")).drop("__pos")


def candidates(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def by_passes(options: list[dict]) -> list[list[int]]:
    """Positions of the candidates, together where only ``max_iter`` differs, its lowest first."""
    groups: dict[str, list[int]] = {}
    for i, o in enumerate(options):
        same = {**o, "max_iter": "any"} if "max_iter" in o else o
        groups.setdefault(json.dumps(same, sort_keys=True, default=str), []).append(i)
    return [sorted(g, key=lambda i: options[i].get("max_iter", 0)) for g in groups.values()]


def grid_search(
    df: DataFrame,
    features: Sequence[str],
    model_type: str = "logistic_regression",
    resampling: str | None = "random_undersampling",
    grid: dict[str, list] | None = None,
    folds: int = 5,
    label: str = "is_fraud",
    id_col: str = "transaction_id",
    leaky: bool = False,
    parallelism: int = 4,
) -> tuple[RiskModel, DataFrame]:
    """Mean recall of every candidate over stratified folds; the best is refitted on all rows.

    Only the training part of a fold is resampled. ``leaky`` resamples before folding, so that
    synthetic rows may sit on both sides. Returns the model and (params, recall), best first. Candidates
    that differ in ``max_iter`` only share a fit that ends below the lower one.
    """
    options = candidates(grid or GRIDS[_kind(model_type)])
    features = list(features)

    def rebalanced(rows: DataFrame) -> DataFrame:
        return rows if resampling is None else resample(rows, resampling, features, label, id_col)

    base = rebalanced(df) if leaky else df
    size = base.count()
    parts = math.ceil(size / PART_ROWS) or 1
    settled = settle(with_fold(base, folds, label, id_col, size).repartition(parts))
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    score = MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=1.0, labelCol=label, predictionCol="predicted_class", weightCol="count")
    groups = by_passes(options)
    totals = [0.0] * len(options)

    def recalls(job: tuple) -> list[tuple[int, float]]:
        group, train, test, held, counts = job
        out, model = [], None
        for i in group:
            if model is None or not model.ended():
                model = RiskModel(model_type, None, options[i], label, id_col, features).fit_prepared(train, held, counts, assembled=True)
                seen = model.predict(test, assembled=True).groupBy(F.col(label).cast("double").alias(label), F.col("predicted_class").cast("double").alias("predicted_class"))
                recall = score.evaluate(seen.count().withColumn("count", F.col("count").cast("double")))
            out.append((i, recall))
        return out

    def of_fold(f: int) -> list[tuple[int, float]]:
        rows = folded.where(F.col("fold") != f).drop("fold")
        train = assembler.transform(rows if leaky else rebalanced(rows)).select(label, "features")
        test = assembler.transform(folded.where(F.col("fold") == f)).select(label, "features")
        with kept(train) as train, kept(test) as test:
            held = train.count()
            counts = class_counts(train, label) if any(o.get("class_weight") == "balanced" for o in options) else None
            return [x for found in fits.map(recalls, [(g, train, test, held, counts) for g in groups]) for x in found]

    # Two folds at a time: while the rows of one are drawn, the other's fits have the executors.
    with kept(settled) as folded:
        with ThreadPool(2) as pair, ThreadPool(parallelism) as fits:
            for found in pair.map(of_fold, range(folds)):
                for i, recall in found:
                    totals[i] += recall / folds
        ranked = sorted(range(len(options)), key=lambda i: (-totals[i], i))
        table = df.sparkSession.createDataFrame([(json.dumps(options[i], sort_keys=True), totals[i]) for i in ranked], "params string, recall double")
        best = RiskModel(model_type, resampling, options[ranked[0]], label, id_col).fit(df if leaky else folded.drop("fold"), features)
    return best, table


@dataclass
class TrainingRun:
    preprocessor: Preprocessor
    model: RiskModel
    report: DataFrame
    predictions: DataFrame
    state: DataFrame
    search: DataFrame | None = None


def train(
    txns: DataFrame,
    resampling: str = "smote",
    model: str = "logistic_regression",
    params: dict | None = None,
    save_to: str | None = None,
    initial_rows: int | None = None,
    train_share: float = 0.8,
    mode: str = "online",
    labels: DataFrame | str | None = None,
    inclusive_end: bool = False,
    leaky: bool = False,
    size: int | None = None,
) -> TrainingRun:
    """The offline job: features in time order, split by time, tune and fit, report, snapshot.

    All rows are used. With ``initial_rows`` the whole job, the snapshot included, sees that many of the
    oldest rows, as if no others had come yet.

    The features of the test part continue the device histories of the training part. ``labels=None``
    leaves fraud rates at 0; see ``device_features``. The snapshot carries the frauds of the test
    part, the labels that became known after the fit.
    """
    spark = txns.sparkSession
    cut = None if initial_rows is None else row_at(txns, TIME_ORDER, initial_rows, size)
    first = txns.where(precedes(txns, TIME_ORDER, cut, inclusive_end))
    feats = settle(device_features(first, mode, labels, size).select("transaction_id", "device_id", "purchase_time", "is_fraud", *FEATURES))
    early, late = time_split(feats, train_share, initial_rows=None if initial_rows is None else min(initial_rows, feats.count()), inclusive_end=inclusive_end)
    prep = Preprocessor().fit(early.select("transaction_id", "is_fraud", *FEATURES))
    x_early, x_late = settle(prep.transform(early)), prep.transform(late)
    search = None
    if params is None:
        fitted, search = grid_search(x_early, prep.feature_names, model, resampling, leaky=leaky)
    else:
        fitted = RiskModel(model, resampling, params).fit(x_early, prep.feature_names)

    def scored(raw: DataFrame, x: DataFrame) -> DataFrame:
        out = fitted.predict(x)
        kept = [c for c in ("predicted_class", "fraud_probability", "fraud_margin") if c in out.columns]
        return raw.join(out.select("transaction_id", *kept), "transaction_id").withColumnRenamed("is_fraud", "true_label")

    predictions = scored(early, x_early).unionByName(scored(late, x_late))
    report = classification_report(fitted.predict(x_late))
    state = device_state(first, late.select("device_id", "is_fraud"))
    if save_to:
        prep.save(spark, f"{save_to}/preprocessor")
        fitted.save(spark, f"{save_to}/classifier")
        write_predictions(predictions, f"{save_to}/predictions", "overwrite")
        state.write.mode("overwrite").parquet(f"{save_to}/device_state")
    return TrainingRun(prep, fitted, report, predictions, state, search)
