"""Exact top-k by inner product: a Voronoi join of queries and data (after Lu et al., 2012).

One more component, sqrt(M^2 - |x|^2) for data and 0 for queries, M the largest norm, makes the highest product the smallest
distance. Data and queries go to their nearest pivot. Each cell is summarised by its number of rows, its radius and its k + 1
smallest distances; from those follow, by the triangle inequality, a distance within which every query of a cell finds k + 1 rows,
and for each pair of cells the distance from the pivot that a data row must have to matter. Neighbouring query cells form groups;
a data row is sent to the groups for which it matters. Large query cells are split and the rows a group needs are dealt over
chunks by a hash, so a task holds at most about QUERY_ROWS queries and DATA_ROWS rows whatever the skew; the best of the chunks are
merged. Where no cell can be ruled out (uniform directions in many dimensions) this is all queries against all rows, in blocks.

Rows without an id, or whose vector is null or holds null or non-finite components, take no part. Equal rows count once. A row with a
repeated id and another vector is a row of its own, and a query never meets itself. Shorter vectors end in zeros; an empty vector scores
0 with all. Ties go to the smaller id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.vectors import best, drawn, matrix, measures, products, row_key, usable
from tallyward.session import settle

# Pivots at most; they and their pairs decide balance and pruning, never results.
PIVOTS = 256
QUERY_ROWS = 2048
DATA_ROWS = 65_536
_BLOCK = 256


def _distances(points: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T + (extra[:, None] - pivot_extra) ** 2
    return np.sqrt(np.maximum(square, 0.0))


def _extra(points: np.ndarray, longest: float) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0.0))


def _in_cells(rows: DataFrame, pivots: np.ndarray, dims: int, scale: int, longest: float) -> DataFrame:
    """Nearest pivot and distance of every row as data, and of every query as a query."""
    pivot_extra = _extra(pivots, longest)

    def nearest(points, extra):
        d = _distances(points, extra, pivots, pivot_extra)
        at = np.nan_to_num(d, nan=np.inf).argmin(axis=1)
        return pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])

    def assign(batches):
        for b in batches:
            points = matrix(b.column("vec"), dims, scale)
            cell, dist = nearest(points, _extra(points, longest))
            query_cell, query_dist = nearest(points, np.zeros(len(points)))
            yield pa.RecordBatch.from_arrays([*b.columns, cell, dist, query_cell, query_dist], [*b.schema.names, "cell", "dist", "query_cell", "query_dist"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(assign, f"{kinds}, cell int, dist double, query_cell int, query_dist double")


def _grouped(apart: np.ndarray, queries: dict[int, int], most: int) -> list[list[int]]:
    """Query cells in groups of near ones with at most ``most`` queries; larger cells stand alone."""
    left, groups = set(queries), []
    while left:
        here = max(left, key=lambda c: (apart[c].sum(), c))
        group, held = [], 0
        while here is not None and (not group or held + queries[here] <= most):
            group.append(here)
            held += queries[here]
            left.discard(here)
            here = min(left, key=lambda c: (apart[group, c].max(), c), default=None)
        groups.append(group)
    return groups


def _visits(pivots, longest, data, queries, lists, k, query_rows, data_rows):
    """(groups, visits): which group a query cell is in, and which distances each group needs from a data cell."""
    extra = _extra(pivots, longest)
    apart = _distances(pivots, extra, pivots, extra)
    slack = 1e-5 * (longest + 1)
    near = sorted((cell, d) for cell, ds in lists.items() for d in ds)
    cells, dists = np.array([c for c, _ in near], int), np.array([d for _, d in near])
    bound = {}
    for cell, (_, radius) in queries.items():
        within = np.sort(radius + apart[cell, cells] + dists)
        reach = within[k] if len(within) > k else np.inf
        bound[cell] = apart[cell] - radius - reach - slack
    groups, visits = [], []
    for g, members in enumerate(_grouped(apart, {c: n for c, (n, _) in queries.items()}, query_rows)):
        least = np.nan_to_num(np.min([bound[c] for c in members], axis=0), nan=-np.inf)
        needed = [c for c, (_, radius) in data.items() if not radius < least[c]]
        chunks = max(1, math.ceil(sum(data[c][0] for c in needed) / data_rows))
        parts = math.ceil(sum(queries[c][0] for c in members) / query_rows)
        groups += [(c, g, parts, chunks) for c in members]
        visits += [(c, g, float(least[c]), parts, chunks) for c in needed]
    return groups, visits


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    data_rows: int = DATA_ROWS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest product of floor(scale * x) for each query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("vec")).withColumn("key", row_key("vec_id", "vec"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, dims, longest = measures(rows, "vec", scale)
    wanted = max(1, min(pivots, int(math.sqrt(n))))
    sample = rows.where(drawn("key", 2 * wanted / max(n, 1))).select("key", "vec").distinct().limit(4 * wanted).toArrow()
    if not sample.num_rows:
        sample = rows.select("key", "vec").limit(1).toArrow()
    held = matrix(sample.column("vec"), dims, scale)
    held = np.unique(held, axis=0)[:: max(1, len(held) // wanted)][:wanted]
    if not len(held):
        held = np.zeros((1, dims))
    cells = settle(_in_cells(rows.distinct(), held, dims, scale, longest))

    data = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()}
    asked = cells.where("query").groupBy("query_cell").agg(F.count(F.lit(1)).alias("n"), F.max("query_dist").alias("radius"))
    asked = {r["query_cell"]: (r["n"], r["radius"]) for r in asked.collect()}
    place = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    lists: dict[int, list[float]] = {}
    for r in cells.select("cell", "dist", place.alias("place")).where(F.col("place") <= k + 1).collect():  # k + 1 numbers a pivot
        lists.setdefault(r["cell"], []).append(r["dist"])
    share = math.ceil(n / (2 * spark.sparkContext.defaultParallelism))  # enough tasks where the table is small
    groups, visits = _visits(held, longest, data, asked, lists, k, query_rows, max(1, min(data_rows, max(4096, share))))
    groups = F.broadcast(spark.createDataFrame(groups, "query_cell int, grp int, parts int, chunks int"))
    visits = F.broadcast(spark.createDataFrame(visits, "cell int, grp int, least double, parts int, chunks int"))

    own_names = [F.col(c).alias(c) for c in ("vec_id", "key", "vec")]  # both sides come from one table: new columns for each
    hosts = cells.join(visits, "cell").where(~(F.col("dist") < F.col("least")))
    hosts = hosts.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod("key", "chunks").cast("int").alias("chunk"), *own_names)
    guests = cells.where("query").join(groups, "query_cell")
    guests = guests.select("grp", F.pmod("key", "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *own_names)

    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, keys = rows.column("vec_id").combine_chunks(), rows.column("key").to_numpy()
        by_key = np.argsort(keys, kind="stable")
        right, left = matrix(rows.column("vec"), dims, scale), matrix(queries.column("vec"), dims, scale)
        own_keys, own, hits, values = queries.column("key").to_numpy(), [], [], []
        for at in range(0, len(left), _BLOCK):
            scores = products(left[at : at + _BLOCK], right)
            lowest = -np.inf if scores.dtype == float else -(2**63)
            block = own_keys[at : at + _BLOCK]
            first, last = (np.searchsorted(keys[by_key], block, side=s) for s in ("left", "right"))
            for i in np.nonzero(last > first)[0]:
                scores[i, by_key[first[i] : last[i]]] = lowest
            row, col = best(scores, k)
            real = scores[row, col] != lowest
            own.append(row[real] + at)
            hits.append(col[real])
            values.append(scores[row, col][real].astype(np.int64))
        own, hits = np.concatenate([np.empty(0, np.int64), *own]), np.concatenate([np.empty(0, np.int64), *hits])
        return pa.table(
            {
                "query_id": queries.column("vec_id").take(pa.array(own)),
                "query_key": queries.column("key").take(pa.array(own)),
                "vec_id": ids.take(pa.array(hits)),
                "score": pa.array(np.concatenate([np.empty(0, np.int64), *values])),
            }
        )

    places = ["grp", "part", "chunk"]
    met = guests.groupBy(*places).cogroup(hosts.groupBy(*places)).applyInArrow(solve, f"query_id {kind}, query_key long, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
