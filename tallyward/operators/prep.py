"""Scaling, encoding and weighting of model inputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.columns import feature_roles, flag

MAX_CATEGORIES = 1000


@dataclass
class Preprocessor:
    """Standard-scaled numeric columns, then one-hot categories, then booleans as 0/1; the rest dropped.

    Fitting is one aggregation for means and deviations and one per categorical column; what is kept
    has one entry per output column. Deviations are those of the population, and a constant column is
    divided by 1. A category not seen in the fit is all zeros.
    """

    label: str = "is_fraud"
    keep: tuple[str, ...] = ("transaction_id",)
    drop_first: bool = False
    numeric: dict[str, tuple[float, float]] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    booleans: list[str] = field(default_factory=list)
    fitted: bool = False

    def fit(self, df: DataFrame) -> Preprocessor:
        roles = feature_roles(df, self.label, self.keep)
        numeric = roles["numeric"]
        self.numeric = {}
        if numeric:
            value = {c: F.col(c).cast("double") for c in numeric}
            row = df.agg(
                *[F.avg(v).alias(f"m{i}") for i, v in enumerate(value.values())],
                *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(value.values())],
            ).first()
            for i, c in enumerate(numeric):
                mean, scale = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
                # A deviation within rounding error of the mean's size is a constant column.
                self.numeric[c] = (mean, scale if scale > 1e-14 * max(1.0, abs(mean)) else 1.0)
        self.categories = {}
        for c in roles["categorical"]:
            seen = [r[0] for r in df.select(c).distinct().orderBy(c).limit(MAX_CATEGORIES + 1).collect()]
            if len(seen) > MAX_CATEGORIES:
                raise ValueError(f"{c} has more than {MAX_CATEGORIES} values: not a category to one-hot encode")
            self.categories[c] = seen[1:] if self.drop_first else seen
        self.booleans = roles["boolean"]
        self.fitted = True
        return self

    @property
    def feature_names(self) -> list[str]:
        hot = [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]
        return [*self.numeric, *hot, *self.booleans]

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError("nothing to transform by: call fit or load")
        kept = [c for c in (*self.keep, self.label) if c in df.columns]
        scaled = [((F.col(c).cast("double") - m) / F.lit(s)).alias(c) for c, (m, s) in self.numeric.items()]
        hot = [F.col(c).eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}") for c, vs in self.categories.items() for v in vs]
        return df.select(*kept, *scaled, *hot, *[flag(c).alias(c) for c in self.booleans])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row per output column, in order."""
        rows = [("numeric", c, None, m, s) for c, (m, s) in self.numeric.items()]
        rows += [("category", c, None if v is None else str(v), None, None) for c, vs in self.categories.items() for v in vs]
        rows += [("boolean", c, None, None, None) for c in self.booleans]
        rows = [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "position int, role string, column string, value string, mean double, scale double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, label: str = "is_fraud", keep: tuple[str, ...] = ("transaction_id",)) -> Preprocessor:
        p = cls(label=label, keep=keep, fitted=True)
        for r in spark.read.parquet(path).orderBy("position").collect():
            if r["role"] == "numeric":
                p.numeric[r["column"]] = (r["mean"], r["scale"])
            elif r["role"] == "category":
                p.categories.setdefault(r["column"], []).append(r["value"])
            else:
                p.booleans.append(r["column"])
        return p


def class_counts(df: DataFrame, label: str = "is_fraud") -> dict[int, int]:
    """Rows per class; a label has few values, and more than MAX_CATEGORIES raise instead of being left out."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).count().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{label} has more than {MAX_CATEGORIES} classes")
    return {r[0]: r[1] for r in rows}


def with_class_weight(df: DataFrame, label: str = "is_fraud", name: str = "weight", counts: dict[int, int] | None = None) -> DataFrame:
    """n / (classes * rows of the class) next to each row. ``counts`` are the ``class_counts`` where they are known."""
    counts = class_counts(df, label) if counts is None else counts
    total, k = sum(counts.values()), len(counts)
    weights = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(total / (k * n)))])
    return df.withColumn(name, F.try_element_at(weights, F.col(label)))
