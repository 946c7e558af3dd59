"""Vectors as matrices of whole numbers: reading, padding, exact products and bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Products of whole numbers are exact in doubles while norms multiply to less than this.
EXACT = float(2**52)
LONG = 2**63 - 1
SEED = 29


def usable(vec: str) -> Column:
    """Vector that is there and holds finite components only."""
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def row_key(*cols: str) -> Column:
    """64 bits that tell rows of one id apart."""
    return F.xxhash64(*cols)


def drawn(key: str, share: float) -> Column:
    """A share of the rows, chosen by their key, so a repeated task draws the same ones."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 31)) < int(min(1.0, share) * (1 << 31))


def matrix(vecs: pa.Array | pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, one row per vector; shorter vectors end in zeros."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * scale), -1e300, 1e300)
    sizes = vecs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((rows * rows).sum(axis=1))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both sides, exact; those beyond a long are held at its ends."""
    most = norms(left).max(initial=0.0) * norms(right).max(initial=0.0)
    if most < EXACT:
        return left @ right.T
    whole = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left]
    return np.array([[max(-LONG, min(LONG, v)) for v in row] for row in whole], dtype=np.int64).reshape(len(left), len(right))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row, ties to the smaller column, in that order."""
    if not scores.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), scores.shape[1])
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


def measures(rows: DataFrame, vec: str, scale: int) -> tuple[int, int, float]:
    """Number of rows, of components, and the largest norm after scaling."""

    def each(batches):
        for b in batches:
            sizes = b.column(vec).value_lengths().to_numpy(zero_copy_only=False)
            dims = int(sizes.max(initial=0))
            yield pa.RecordBatch.from_pydict({"n": [len(sizes)], "dims": [dims], "norm": [float(norms(matrix(b.column(vec), dims, scale)).max(initial=0.0))]})

    got = rows.select(vec).mapInArrow(each, "n long, dims long, norm double").agg(F.sum("n"), F.max("dims"), F.max("norm")).first()
    return (got[0] or 0), (got[1] or 0), (got[2] or 0.0)
