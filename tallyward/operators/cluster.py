"""Customer clusters: k-means, density clusters, their quality, and a two-dimensional view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import ratio
from tallyward.operators.neighbours import Located, distances_of_places, located, neighbour_distance, parts_within, search
from tallyward.operators.prep import Preprocessor
from tallyward.plans.components import connected_components
from tallyward.plans.joins import attach
from tallyward.plans.slices import Over, global_rank, running
from tallyward.session import settle

NOISE = -1


def cluster_inputs(df: DataFrame, numeric: Sequence[str] = ("age", "purchase_value", "gdp"), category: str = "sex", id_col: str = "transaction_id") -> tuple[DataFrame, list[str]]:
    """Scaled numbers and the category without its first value; rows with a NULL number are left out."""
    rows = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in numeric], category).dropna(subset=list(numeric))
    prep = Preprocessor(keep=(id_col,), drop_first=True).fit(rows)
    return prep.transform(rows), prep.feature_names


def _assembled(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def kmeans(
    df: DataFrame, features: Sequence[str], k: int = 16, seed: int = 42, name: str = "customer_group", start: Sequence[Sequence[float]] | None = None, rounds: int = 50
) -> DataFrame:
    """Groups by Spark ML from seeded centres, or, where ``start`` gives the centres, by up to ``rounds`` repeatable rounds from those."""
    if start is not None:
        return _from_centres(df, list(features), start, rounds, name)
    model = KMeans(k=k, seed=seed, initMode="k-means||", predictionCol=name)
    rows = _assembled(df, features)
    return model.fit(rows).transform(rows).drop("features")


def _nearest_centre(features: list[str], centres: list[tuple[float, ...]]) -> Column:
    far = F.array(*[reduce(lambda a, b: a + b, [(F.col(f) - v) * (F.col(f) - v) for f, v in zip(features, c)]) for c in centres])
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def _from_centres(df: DataFrame, features: list[str], start: Sequence[Sequence[float]], rounds: int, name: str) -> DataFrame:
    """Rows go to the nearest centre, the lower number for ties; centres move to the mean of their rows, those without rows stay."""
    centres = [tuple(map(float, c)) for c in start]
    for _ in range(rounds):
        means = df.groupBy(_nearest_centre(features, centres).alias("g")).agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)])
        found = {r["g"]: tuple(r)[1:] for r in means.collect()}  # a row for each centre
        moved = [found.get(g, c) for g, c in enumerate(centres)]
        still = max(abs(a - b) for x, y in zip(moved, centres) for a, b in zip(x, y)) < 1e-12
        centres = moved
        if still:
            break
    return df.withColumn(name, _nearest_centre(features, centres))


def silhouette(df: DataFrame, features: Sequence[str], cluster: str = "customer_group") -> float:
    """Mean silhouette with squared distances, which needs cluster sums only and no pairs of rows."""
    rows = _assembled(df, features).withColumn(cluster, F.col(cluster).cast("double"))
    return ClusteringEvaluator(predictionCol=cluster, featuresCol="features").evaluate(rows)


def cluster_profile(df: DataFrame, cols: Sequence[str], cluster: str = "customer_group") -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols])


def pca2(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two principal components of the centred features; the largest loading of each is positive."""
    rows = _assembled(df, features, "__raw")
    rows = StandardScaler(inputCol="__raw", outputCol="__centred", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="__centred", outputCol="__pc").fit(rows)
    loadings = model.pc.toArray()
    turn = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] > 0 else -1.0 for i in (0, 1)]
    pc = vector_to_array("__pc")
    return model.transform(rows).select(*df.columns, (pc[0] * turn[0]).alias("pc1"), (pc[1] * turn[1]).alias("pc2"))


def knee(distances: DataFrame, col: str = "distance", rows: str | None = None) -> DataFrame:
    """Where the sorted curve bends away most from its chord, as one row (rank, eps).

    The global maximum of normalised rank minus normalised distance, the lowest rank for ties. Of equal distances the last bends most, so
    each distance is ranked once; column ``rows`` says how many rows one stands for.
    """
    counts = distances.where(F.col(col).isNotNull()).groupBy(col).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("__n"))
    ranked = settle(running(counts, [], [col], [Over("rank", "sum", F.col("__n"))], derived=True))
    ends = ranked.agg(F.min(col).alias("low"), F.max(col).alias("high"), F.max("rank").alias("n"))
    low, high, n = (ends.select(c).scalar() for c in ("low", "high", "n"))
    bend = F.coalesce(ratio(F.col("rank") - 1, n - 1), F.lit(0.0)) - F.coalesce(F.try_divide(F.col(col) - low, high - low), F.lit(0.0))
    best = F.max_by(F.struct("rank", F.col(col).alias("eps")), F.struct(F.round(bend, 12), -F.col("rank")))
    return ranked.agg(best.alias("k")).select("k.rank", "k.eps")


def dbscan_eps(df: DataFrame, coords: Sequence[str], k: int = 5, id_col: str = "id") -> float | None:
    """The k-th neighbour distance (the row itself counted) at the knee of its sorted curve."""
    row = knee(neighbour_distance(df, coords, k, id_col)).first()
    return row["eps"] if row else None


def dbscan(df: DataFrame, coords: Sequence[str], eps: float, min_samples: int = 8, id_col: str = "id", name: str = "cluster") -> DataFrame:
    """Density clusters, numbered by their smallest core id from 0; noise is -1.

    A core row has ``min_samples`` rows within ``eps``, itself included: one nearest-neighbour search. Rows at one location are core
    together, so clusters are components of the core locations, each named by its first id. Core locations of a box are joined where they
    are, and then the parts of boxes, so neither pairs of rows nor cells of a grid are listed and any number of dimensions will do. A
    border row takes the lowest cluster in its reach, found in its own neighbour list, which is complete because it is short.
    Rows that lack a coordinate are noise.
    """
    where = located(df, coords, id_col, None, min_samples + 1)
    return _dbscan(df, where, search(where, min_samples + 1, True), eps, min_samples, id_col, name)


def dbscan_at_knee(df: DataFrame, coords: Sequence[str], k: int = 5, min_samples: int = 8, id_col: str = "id", name: str = "cluster") -> DataFrame:
    """``dbscan`` at ``dbscan_eps``; one search serves both."""
    keep = max(k, min_samples + 1)
    where = located(df, coords, id_col, None, keep)
    lists = search(where, keep, True)
    row = knee(distances_of_places(where, lists, k), rows="rows").first()
    return _dbscan(df, where, lists, row["eps"] if row else None, min_samples, id_col, name)


def _dbscan(df: DataFrame, where: Located, lists: DataFrame, eps: float, min_samples: int, id_col: str, name: str) -> DataFrame:
    is_core = F.coalesce(F.get("dists", F.lit(min_samples - 1)) <= eps, F.lit(False))
    core = lists.where(is_core).select("id", "at", "loc")
    placed, links = parts_within(core, where.dims, core.count(), eps)
    again = settle(core.groupBy("id").agg(F.count(F.lit(1)).alias("__times")).where("__times > 1"))  # ids of several locations: they are one core row
    same = placed.join(again, "id").select("id", "part")
    links = links.unionByName(same.join(same.groupBy("id").agg(F.min("part").alias("a")), "id").select("a", F.col("part").alias("b")))
    parts = settle(connected_components(links, placed.select(F.col("part").alias("node")).distinct()))
    number = global_rank(parts.select("component").distinct(), ["component"], "__rank", derived=True)
    numbered = parts.join(number, "component").select(F.col("node").alias("part"), (F.col("__rank") - 1).alias(name))
    of_core = attach(placed.select("id", "loc", "part"), numbered, ["part"], ["id"], "inner").join(again, "id", "left")
    of_core = settle(of_core.select("loc", F.col("id").alias("first"), name, F.explode(F.sequence(F.lit(1), F.coalesce("__times", F.lit(1).cast("long"))))).drop("col"))

    reach = lists.where(~is_core).select("loc", F.inline(F.arrays_zip("dists", "firsts")).alias("dist", "first")).where(F.col("dist") <= eps).select("first", F.col("loc").alias("__of"))
    of_border = attach(reach, of_core.select("first", name), ["first"], ["__of"], "inner").groupBy(F.col("__of").alias("loc")).agg(F.min(name).alias(name))
    found = of_core.select("loc", name).unionByName(of_border)
    rows = attach(where.rows.select("id", "loc"), found, ["loc"], ["id"], size=where.total).select(F.col("id").alias(id_col), F.coalesce(name, F.lit(NOISE).cast("long")).alias(name))
    return df.join(rows, id_col)
