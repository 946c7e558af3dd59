"""Hard negatives by threshold joins over inverted indexes with bounds on norms (in the manner of L2AP, Anastasiu and Karypis, 2014).

A join finds all rows whose product with an anchor reaches the anchor's threshold. Rows are dealt over blocks by a hash; in a block,
each row's components are indexed only up to the point from which the norm of the rest, times the longest anchor, stays below the least
threshold: what is left out cannot reach it alone. An anchor walks the index a strip of components at a time, adds up partial products and
drops every row whose partial product plus the norms of both remainders stays below its threshold; only rows that survive get their whole,
exact product. Thresholds start where a bounded sample of rows suggests that a window will just fill, and are lowered for the windows that
did not, in the last round to the window's own lower end. A task holds at most about ANCHOR_ROWS anchors and DATA_ROWS rows, and
returns only the best rows of each window in its block.

Rows without an id or label, or whose vector is null or holds null or non-finite components, take no part. Equal rows count once; a row with
a repeated id and another vector is a row of its own. Ties go to the smaller id. Shorter vectors end in zeros. Other columns are not
read. An anchor without positives, or a positive without negatives in its window, gives no row; an empty table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.vectors import best, drawn, matrix, measures, norms, products, row_key, usable
from tallyward.session import settle

# Rows, expected, of the sample that first thresholds come from; it decides the number of rounds, never results.
SAMPLE = 4096
# A first threshold is set where so many times the wanted rows are expected above it.
MARGIN = 3
ANCHOR_ROWS = 8192
DATA_ROWS = 65_536
STRIP = 8


@dataclass(frozen=True)
class Index:
    """Postings by component, in an order of falling weight; rows with more indexed components come first."""

    order: np.ndarray
    rows: np.ndarray
    postings: np.ndarray
    indexed: np.ndarray
    held: np.ndarray
    tails: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, longest: float, threshold: float) -> Index:
        weight = np.abs(vectors).sum(axis=0)
        order = np.argsort(-weight, kind="stable")
        rows = vectors[:, order]
        with np.errstate(over="ignore"):
            tails = np.sqrt(np.concatenate([np.cumsum(rows[:, ::-1] ** 2, axis=1)[:, ::-1], np.zeros((len(rows), 1))], axis=1))
        if threshold > 0:
            indexed = (tails[:, :-1] * longest * (1 + 1e-9) >= threshold).sum(axis=1)
        else:
            indexed = np.full(len(rows), rows.shape[1])
        by = np.argsort(-indexed, kind="stable")
        indexed = indexed[by]
        postings = np.ascontiguousarray(np.where(np.arange(rows.shape[1]) < indexed[:, None], rows[by], 0.0).T)
        held = np.searchsorted(-indexed, -np.arange(rows.shape[1]), side="left")
        return Index(order, by, postings, indexed, held, tails[by])

    def reaching(self, anchor: np.ndarray, threshold: float) -> np.ndarray:
        """Rows, by their number, that may have a product of ``threshold`` or more with the anchor."""
        if threshold == -np.inf:
            return np.arange(len(self.rows))
        q = anchor[self.order]
        with np.errstate(over="ignore"):
            rest = np.sqrt(np.concatenate([np.cumsum(q[::-1] ** 2)[::-1], [0.0]]))
        dims = len(q)
        alive = np.arange(self.held[0] if threshold > 0 and dims else len(self.rows))
        partial, whole = np.zeros(len(alive)), True
        for j in range(0, dims, STRIP):
            end = min(dims, j + STRIP)
            if whole:
                n = min(len(alive), self.held[j])
                partial[:n] += q[j:end] @ self.postings[j:end, :n]
            else:
                partial += q[j:end] @ self.postings[j:end, alive]
            left = np.minimum(self.indexed[alive], end)
            with np.errstate(over="ignore", invalid="ignore"):
                most = partial + rest[left] * self.tails[alive, left]
            stay = ~(most * (1 + np.sign(most) * 1e-9) + 1e-6 < threshold)
            if stay.sum() <= 0.75 * len(alive):
                alive, partial, whole = alive[stay], partial[stay], False
        return self.rows[alive]


def _thresholds(scores: np.ndarray, first: int, want: int, last: float) -> list[float]:
    """Falling thresholds: the scores of a sample at growing places, then the place that is sure to fill, then ``last``."""
    scores, out, at = -np.sort(-scores), [], first
    while at < want and at <= len(scores):
        out.append(float(scores[at - 1]))
        at *= 4
    out.append(float(scores[want - 1]) if len(scores) >= want else last)
    return out


def _with_thresholds(rows: DataFrame, sample: pa.Table, total: int, dims: int, scale: int, want: int, windows: bool) -> DataFrame:
    """Each row (an anchor, or an anchor with a positive's window) with ``steps``, the thresholds of its rounds."""
    vecs, keys, labels = matrix(sample.column("vec"), dims, scale), sample.column("key").to_numpy(), sample.column("label").to_numpy()
    first = max(1, math.ceil(MARGIN * want * max(1, len(vecs)) / max(1, total)))

    def add(batches):
        for b in batches:
            own, label = b.column("key").to_numpy(), b.column("label").to_numpy()
            scores = products(matrix(b.column("vec"), dims, scale), vecs).astype(float)
            high, low = (b.column(c).to_numpy() for c in ("high", "low")) if windows else (None, None)
            steps = []
            for i in range(b.num_rows):
                if windows:
                    row = scores[i, labels != label[i]]
                    row, last = row[(row <= high[i]) & (row >= low[i])], float(low[i])
                else:
                    row, last = scores[i, (labels == label[i]) & (keys != own[i])], -np.inf
                steps.append(_thresholds(row, first, want, last))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(steps, pa.list_(pa.float64()))], [*b.schema.names, "steps"])

    return rows.mapInArrow(add, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", steps array<double>")


def _met(anchors: DataFrame, data: DataFrame, places: list[str], solve, shape: str) -> DataFrame:
    return anchors.groupBy(*places).cogroup(data.groupBy(*places)).applyInArrow(solve, shape)


def _positives_in_block(dims: int, scale: int, k: int):
    def solve(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        data, points = matrix(rows.column("vec"), dims, scale), matrix(anchors.column("vec"), dims, scale)
        least, keys, own = anchors.column("least").to_numpy(), rows.column("key").to_numpy(), anchors.column("key").to_numpy()
        index = Index.of(data, norms(points).max(initial=0.0), least.min()) if len(data) and len(points) else None
        who, hits, values = [], [], []
        for i in range(len(points) if index else 0):
            found = np.sort(index.reaching(points[i], least[i]))
            found = found[keys[found] != own[i]]
            scores = products(points[i : i + 1], data[found])
            real = scores[0] >= least[i]
            found, scores = found[real], scores[:, real]
            _, col = best(scores, k)
            who.append(np.full(len(col), i))
            hits.append(found[col])
            values.append(scores[0, col].astype(np.int64))
        none = [np.empty(0, np.int64)]
        who, hits = np.concatenate(none + who), np.concatenate(none + hits)
        return pa.table({"key": anchors.column("key").take(pa.array(who)), "anchor_id": anchors.column("vec_id").take(pa.array(who)), "positive_id": rows.column("vec_id").take(pa.array(hits)), "positive_key": rows.column("key").take(pa.array(hits)), "positive_score": np.concatenate(none + values)})

    return solve


def _negatives_in_block(dims: int, scale: int, k: int):
    def solve(windows: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        data, labels = matrix(rows.column("vec"), dims, scale), rows.column("label").to_numpy()
        points = matrix(windows.column("vec"), dims, scale)
        own, label, least, low, high = (windows.column(c).to_numpy() for c in ("key", "label", "least", "low", "high"))
        index = Index.of(data, norms(points).max(initial=0.0), least.min()) if len(data) and len(points) else None
        who, hits, values = [], [], []
        by_anchor = np.argsort(own, kind="stable")
        for same in np.split(by_anchor, np.nonzero(np.diff(own[by_anchor]))[0] + 1) if index else []:
            anchor = points[same[0]]
            found = np.sort(index.reaching(anchor, least[same].min()))
            found = found[labels[found] != label[same[0]]]
            scores = products(anchor[None], data[found])[0]
            for i in same:  # the few windows of one anchor
                fits = (scores >= max(least[i], low[i])) & (scores <= high[i])
                _, col = best(scores[None, fits], k)
                who.append(np.full(len(col), i))
                hits.append(found[fits][col])
                values.append(scores[fits][col].astype(np.int64))
        none = [np.empty(0, np.int64)]
        who, hits = np.concatenate(none + who), np.concatenate(none + hits)
        taken = {c: windows.column(c).take(pa.array(who)) for c in ("key", "anchor_id", "positive_id", "positive_key", "positive_score")}
        return pa.table(taken | {"negative_id": rows.column("vec_id").take(pa.array(hits)), "negative_key": rows.column("key").take(pa.array(hits)), "negative_score": np.concatenate(none + values)})

    return solve


def _rounds(asked: DataFrame, names: list[str], join, k: int, order: list) -> DataFrame | None:
    """Join with falling thresholds until each of ``asked`` has ``k`` rows or no lower threshold is left."""
    done, pending, step = None, asked, 0
    while True:
        now = pending.withColumn("least", F.get("steps", F.lit(step)))
        rank = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
        found = settle(join(now).withColumn("rank", rank).where(F.col("rank") <= k))
        counts = found.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        more = pending.join(counts, names, "left").where((F.coalesce("n", F.lit(0)) < k) & (F.size("steps") > step + 1)).drop("n")
        more = settle(more)
        last = more.isEmpty()
        kept = found if last else found.join(more.select(*names), names, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        pending, step = more, step + 1


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    anchor_rows: int = ANCHOR_ROWS,
    data_rows: int = DATA_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best ``positives`` other rows of the same label; its negatives for each are the best ``negatives`` rows of
    other labels that score between ``low`` and ``high`` percent of the positive.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vec"))
    rows = settle(rows.distinct().withColumn("key", row_key("vec_id", "label", "vec")))
    kind = rows.schema["vec_id"].dataType.simpleString()
    total, dims, _ = measures(rows, "vec", scale)
    sample = rows.where(drawn("key", SAMPLE / max(total, 1))).select("key", "label", "vec").limit(2 * SAMPLE).toArrow()
    asked = rows.where("anchor").select("vec_id", "key", "label", "vec")
    n_anchors = asked.count()

    blocks = max(1, math.ceil(n_anchors / anchor_rows))
    share = math.ceil(total / (2 * spark.sparkContext.defaultParallelism))  # enough tasks where the table is small
    chunks = max(1, math.ceil(total / max(1, min(data_rows, max(2048, share)))))
    dealt = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod("key", F.lit(chunks)).cast("int").alias("chunk")
    data = rows.select(*dealt, *[F.col(c).alias(c) for c in ("vec_id", "key", "label", "vec")])  # new columns: anchors come from the same table

    def everywhere(df: DataFrame) -> DataFrame:
        return df.select("*", F.pmod("key", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    shape = f"key long, anchor_id {kind}, positive_id {kind}, positive_key long, positive_score long"
    best_first = [F.desc("positive_score"), F.asc("positive_id"), F.asc("positive_key")]
    steps = settle(_with_thresholds(asked, sample, total, dims, scale, positives, windows=False))
    found = _rounds(steps, ["key"], lambda now: _met(everywhere(now), data, ["label", "block", "chunk"], _positives_in_block(dims, scale, positives), shape), positives, best_first)

    windows = found.drop("rank").where(F.col("positive_score") >= 0).join(asked.select("key", "label", "vec"), "key")
    score = F.col("positive_score").cast("decimal(38,0)")
    windows = windows.withColumn("low", F.ceil(score * low / 100).cast("long")).withColumn("high", F.floor(score * high / 100).cast("long")).where("low <= high")
    steps = settle(_with_thresholds(windows, sample, total, dims, scale, negatives, windows=True))
    shape += f", negative_id {kind}, negative_key long, negative_score long"
    best_first = [F.desc("negative_score"), F.asc("negative_id"), F.asc("negative_key")]
    names = ["key", "positive_key"]
    found = _rounds(steps, names, lambda now: _met(everywhere(now), data, ["block", "chunk"], _negatives_in_block(dims, scale, negatives), shape), negatives, best_first)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
