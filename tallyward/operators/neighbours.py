"""Nearest neighbours of every row within a table: exact, or by an inverted file.

Rows at one location are represented by their first few ids, which is enough because ties are ordered by id; a location holding
a third of the table is therefore as cheap as any other. Searching rows and rows searched meet by a key: the box of a k-d tree, the
list of an inverted file, or nothing at all. Where they meet, both sides are dealt evenly over chunks of bounded size, so no task
holds more than a chunk of each, whatever the key's share of the rows.

*Boxes.* Space is cut into boxes of similar population over a bounded sample. A row first looks in its own box; the distance of its last
hit bounds the search, and only boxes nearer than that are visited. Within a box a task grows a finer tree over the rows it holds, so a
row is measured against few of them. *Blocks.* In many dimensions a tree rules nothing out; where a
sample shows that, all chunks meet all chunks. A block is a matrix product; rows that its rounding leaves in question are measured
again in full. The cost is square in the number of locations. *Inverted file.* ``approximate_nearest`` searches only the lists near a
row, as many as a sample says are needed for a recall; what it returns are exact distances, but some neighbours may be missed.

Rows that lack a coordinate (null or not a number) have no neighbours and are nobody's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.plans.joins import attach
from tallyward.plans.slices import SEED
from tallyward.session import settle

BOX_ROWS = "spark.tallyward.boxRows"
BOX_ROWS_DEFAULT = 4096
MAX_DEPTH = 16  # at most 65,536 boxes; fuller boxes are dealt over more chunks
SAMPLE_PER_BOX = 32
PLACES = 9  # distances that agree to this many places are ties
# Share of the boxes that a row of the sample may visit on average before blocks are used instead.
PRUNES_NOTHING = 0.5
# Rows of a chunk of searching rows, and of rows searched, for each row of BOX_ROWS.
CHUNK = 4
# Rows, expected, of the sample an inverted file is fitted and its number of visited lists is chosen on.
FIT_ROWS = 8192
# Rows of a block and of a tile of a meeting, and pairs measured at a time: they bound a worker's memory.
_BLOCK, _TILE, _PAIRS = 256, 4096, 1 << 16
# Rows of a leaf of the tree a task grows, rows that ask it at a time, and the share of its leaves they may visit before blocks are used.
_LEAF, _ASKED, _LEAVES_PRUNE_NOTHING = 32, 4096, 0.25


@dataclass(frozen=True)
class Boxes:
    """A complete binary tree of cuts in heap order, with the box of every node; leaves come last."""

    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def count(self) -> int:
        return len(self.axis) + 1

    @staticmethod
    def of(sample: np.ndarray, depth: int, dims: int) -> Boxes:
        inner, leaves = 2**depth - 1, 2**depth
        axis, at = np.zeros(inner, int), np.full(inner, np.inf)
        low, high = np.full((inner + leaves, dims), -np.inf), np.full((inner + leaves, dims), np.inf)
        held = {0: sample}
        for node in range(inner):
            pts = held.pop(node)
            if len(pts):
                spread = pts.max(axis=0) - pts.min(axis=0)
                axis[node] = int(spread.argmax())
                along = pts[:, axis[node]]
                at[node] = float(np.median(along))
                if spread.max() > 0 and not (along < at[node]).any():  # half of them or more at the least value: both sides get some
                    at[node] = along[along > at[node]].min()
            right = pts[:, axis[node]] >= at[node]
            for child, part in ((2 * node + 1, pts[~right]), (2 * node + 2, pts[right])):
                low[child], high[child], held[child] = low[node], high[node], part
            high[2 * node + 1, axis[node]] = low[2 * node + 2, axis[node]] = at[node]
        return Boxes(axis, at, low, high)

    def around(self, leaf: np.ndarray, low: np.ndarray, high: np.ndarray) -> Boxes:
        """The same cuts with the boxes around the rows of these leaves; the others hold nothing."""
        lows, highs, inner = np.full_like(self.low, np.inf), np.full_like(self.high, -np.inf), len(self.axis)
        lows[inner + leaf], highs[inner + leaf] = low, high
        for level in reversed(range(int(math.log2(inner + 1)))):
            here, below = slice(2**level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
            lows[here] = lows[below].reshape(2**level, 2, -1).min(axis=1)
            highs[here] = highs[below].reshape(2**level, 2, -1).max(axis=1)
        return Boxes(self.axis, self.at, lows, highs)

    def find(self, pts: np.ndarray) -> np.ndarray:
        node, inner = np.zeros(len(pts), int), len(self.axis)
        rows = np.arange(len(pts))
        for _ in range(int(math.log2(inner + 1))):
            node = 2 * node + 1 + (pts[rows, self.axis[node]] >= self.at[node])
        return node - inner

    def within(self, pts: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, box) where the box comes as near to the point as its radius.

        Walks down the tree with the pairs still in reach, so far boxes are never looked at.
        """
        point, node, inner = np.arange(len(pts)), np.zeros(len(pts), int), len(self.axis)
        reach = radius + 10.0**-PLACES
        for _ in range(int(math.log2(inner + 1))):
            point, node = np.repeat(point, 2), np.column_stack([2 * node + 1, 2 * node + 2]).ravel()
            gap = np.maximum(np.maximum(self.low[node] - pts[point], pts[point] - self.high[node]), 0.0)
            near = np.sqrt((gap**2).sum(axis=1)) <= reach[point]
            point, node = point[near], node[near]
        return point, node - inner

    def prunes(self, sample: np.ndarray) -> bool:
        """Whether rows of the sample, looking as far as the nearest other one, leave out enough boxes."""
        some = sample[:: max(1, len(sample) // _BLOCK)]
        if self.count <= 2 or len(sample) < 2:
            return False
        nearest = np.array([np.sort(row)[1] for row in distances(some, sample)])
        return len(self.within(some, nearest)[0]) <= PRUNES_NOTHING * self.count * len(some)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        square += (a[:, d : d + 1] - b[:, d]) ** 2
    return np.sqrt(square)


def _of_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances between rows ``i`` of ``a`` and ``j`` of ``b``, a bounded number of pairs at a time."""
    out = np.empty(len(i))
    for s in range(0, len(i), _PAIRS):
        p, q = i[s : s + _PAIRS], j[s : s + _PAIRS]
        square = np.zeros(len(p))
        for d in range(a.shape[1]):
            square += (a[p, d] - b[q, d]) ** 2
        out[s : s + _PAIRS] = np.sqrt(square)
    return out


def _kth(i: np.ndarray, square: np.ndarray, keep: int, rows: int) -> np.ndarray:
    """The ``keep``-th least square of each row, infinite where it has fewer."""
    order = np.lexsort((square, i))
    i, square = i[order], square[order]
    at = np.arange(len(i)) - np.searchsorted(i, i, side="left") == keep - 1
    out = np.full(rows, np.inf)
    out[i[at]] = square[at]
    return out


def _near_pairs(a: np.ndarray, b: np.ndarray, keep: int | None, limit: np.ndarray | None):
    """(from, row of ``a``, row of ``b``, distance) block by block, for pairs that may be among the ``keep`` nearest, or within the limit.

    Squares come from a matrix product about the middle of ``b``, for a tile of both at a time; pairs within its error of the bound, which
    sharpens from tile to tile, are kept, and all are measured again.
    """
    middle = b.mean(axis=0)
    x, y = a - middle, b - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    error = 8 * np.finfo(float).eps * max(4, a.shape[1]) * (xx + yy.max())
    for s in range(0, len(a), _BLOCK):
        part = slice(s, s + _BLOCK)
        widened = lambda square: (np.sqrt(np.maximum(square, 0.0)) + 2 * 10.0**-PLACES) ** 2 + error[part]
        n = len(xx[part])
        bound = widened(np.full(n, np.inf) if limit is None else limit[part] ** 2)
        i, j, held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for t in range(0, len(b), _TILE):
            square = x[part] @ y[t : t + _TILE].T
            square *= -2
            square += xx[part, None]
            square += yy[t : t + _TILE]
            if not t and keep is not None and keep < square.shape[1]:
                bound = np.minimum(bound, widened(np.partition(square, keep - 1, axis=1)[:, keep - 1] + error[part]))
            row, col = np.nonzero(square <= bound[:, None])
            if len(row):
                i, j, held = np.concatenate((i, row)), np.concatenate((j, t + col)), np.concatenate((held, square[row, col]))
            if t and len(row) and keep is not None:
                bound = np.minimum(bound, widened(_kth(i, held, keep, n) + error[part]))
                near = held <= bound[i]
                i, j, held = i[near], j[near], held[near]
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        yield s, i, j, _of_pairs(a, b, s + i, j)


@dataclass(frozen=True)
class Leaves:
    """Rows in leaves of one size; level by level, the box around the rows of every node and their middle. The first rows come twice to fill them."""

    rows: np.ndarray
    held: np.ndarray
    at: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    middle: list[np.ndarray]

    @staticmethod
    def of(pts: np.ndarray, size: int = _LEAF) -> Leaves:
        depth = max(0, math.ceil(math.log2(max(1.0, len(pts) / size))))
        rows = np.arange(-(-len(pts) // 2**depth) << depth)
        held = rows < len(pts)
        rows %= len(pts)
        for level in range(depth):
            rows, held = rows.reshape(2**level, -1), held.reshape(2**level, -1)
            at = pts[rows]
            axis = (at.max(axis=1) - at.min(axis=1)).argmax(axis=1)
            order = np.argpartition(np.take_along_axis(at, axis[:, None, None], 2)[:, :, 0], rows.shape[1] // 2, axis=1)
            rows, held = np.take_along_axis(rows, order, 1), np.take_along_axis(held, order, 1)
        rows, held = rows.reshape(2**depth, -1), held.reshape(2**depth, -1)
        at = pts[rows]
        low, high, middle = [at.min(axis=1)], [at.max(axis=1)], [at.mean(axis=1)]
        for _ in range(depth):
            for level, of in ((low, np.min), (high, np.max), (middle, np.mean)):
                level.insert(0, of(level[0].reshape(-1, 2, pts.shape[1]), axis=1))
        return Leaves(rows, held, np.ascontiguousarray(at.transpose(2, 0, 1)), low, high, middle)

    def _gap(self, level: int, node: np.ndarray, pts: np.ndarray, point: np.ndarray) -> np.ndarray:
        square = np.zeros(len(node))
        for d in range(pts.shape[1]):
            at = pts[point, d]
            square += np.maximum(np.maximum(self.low[level][node, d] - at, at - self.high[level][node, d]), 0.0) ** 2
        return np.sqrt(square)

    def home(self, pts: np.ndarray) -> np.ndarray:
        """A leaf near each point, by middles: where many rows share a coordinate, the boxes of both halves may hold the point."""
        node = np.zeros(len(pts), np.int64)
        for middle in self.middle[1:]:
            left, right = (sum((pts[:, d] - middle[half, d]) ** 2 for d in range(pts.shape[1])) for half in (2 * node, 2 * node + 1))
            node = 2 * node + (right < left)
        return node

    def within(self, pts: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs (point, leaf) where the leaf comes as near to the point as its radius; none where the tree rules too little out."""
        point, node = np.arange(len(pts)), np.zeros(len(pts), np.int64)
        for level in range(len(self.low)):
            if level:
                point, node = np.repeat(point, 2), np.column_stack([2 * node, 2 * node + 1]).ravel()
            near = self._gap(level, node, pts, point) <= radius[point]
            point, node = point[near], node[near]
            if level > 4 and len(point) > _LEAVES_PRUNE_NOTHING * len(pts) * len(self.low[level]):
                return None
        return point, node

    def measured(self, pts: np.ndarray, point: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Distances of points to all rows of a leaf, infinite to what fills it."""
        square = np.zeros((len(leaf), self.rows.shape[1]))
        for d in range(pts.shape[1]):
            square += (pts[point, d][:, None] - self.at[d][leaf]) ** 2
        return np.where(self.held[leaf], np.sqrt(square), np.inf)

    def pairs(self, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of leaves, each also with itself, that come within ``eps`` of each other; whether all their rows do."""
        x = y = np.zeros(1, np.int64)
        for level, (low, high) in enumerate(zip(self.low, self.high)):
            if level:
                x, y = (2 * x[:, None] + [0, 0, 1, 1]).ravel(), (2 * y[:, None] + [0, 1, 0, 1]).ravel()
                x, y = x[x <= y], y[x <= y]
            gap, span = np.zeros(len(x)), np.zeros(len(x))
            for d in range(low.shape[1]):
                up, down = low[y, d] - high[x, d], low[x, d] - high[y, d]
                gap += np.maximum(np.maximum(up, down), 0.0) ** 2
                span += np.minimum(up, down) ** 2
            near = np.sqrt(gap) <= eps
            x, y, span = x[near], y[near], span[near]
        return x, y, np.sqrt(span) <= eps


def _near_in_leaves(a: np.ndarray, b: np.ndarray, keep: int | None, limit: np.ndarray | None):
    """As ``_near_pairs``, in no order, by a tree over ``b`` where that rules out enough."""
    leaves = Leaves.of(b, max(_LEAF, 2 * (keep or 0)))
    near = min(4, len(leaves.rows))  # the first bound comes from so many leaves
    for s in range(0, len(a), _ASKED):
        asked, most = a[s : s + _ASKED], None if limit is None else limit[s : s + _ASKED]
        bound = np.full(len(asked), np.inf) if most is None else most
        if keep is not None and keep <= len(b):
            some = leaves.home(asked)[:, None] // near * near + np.arange(near)
            far = leaves.measured(asked, np.repeat(np.arange(len(asked)), near), some.ravel()).reshape(len(asked), -1)
            bound = np.minimum(bound, np.partition(far, keep - 1, axis=1)[:, keep - 1])
        bound = bound + 2 * 10.0**-PLACES
        met = leaves.within(asked, bound)
        if met is None:
            for t, i, j, d in _near_pairs(asked, b, keep, most):
                yield s + t, i, j, d
            continue
        step = max(1, (_PAIRS << 4) // leaves.rows.shape[1])
        for t in range(0, max(1, len(met[0])), step) if keep is None else [0]:
            i, j, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for u in range(t, t + step if keep is None else len(met[0]), step):
                point, leaf = met[0][u : u + step], met[1][u : u + step]
                d = leaves.measured(asked, point, leaf)
                row, col = np.nonzero((d <= bound[point, None]) & leaves.held[leaf])
                i.append(point[row])
                j.append(leaves.rows[leaf[row], col])
                far.append(d[row, col])
            yield s, np.concatenate(i), np.concatenate(j), np.concatenate(far)


def _join(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Links rows ``a`` and ``b``: ``top`` holds the least row that each is linked to, before and after."""
    while True:
        a, b = top[a], top[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := top[top], top):
            top[:] = up


def _parts(pts: np.ndarray, eps: float) -> np.ndarray:
    """The least row that each is linked to by steps of ``eps`` at most.

    Leaves that lie within ``eps`` of each other as a whole are linked unmeasured, and pairs of leaves that are one part already are passed over.
    """
    top, leaves = np.arange(len(pts)), Leaves.of(pts)
    x, y, whole = leaves.pairs(eps)
    rows = leaves.rows
    for leaf in (x[whole], y[whole]):
        leaf = np.unique(leaf)
        _join(top, np.repeat(rows[leaf, 0], rows.shape[1]), rows[leaf].ravel())
    _join(top, rows[x[whole], 0], rows[y[whole], 0])
    order = np.argsort(y[~whole] - x[~whole], kind="stable")
    x, y = x[~whole][order], y[~whole][order]
    step = max(1, (_PAIRS << 3) // rows.shape[1] ** 2)
    for s in range(0, len(x), step):
        p, q = x[s : s + step], y[s : s + step]
        one = top[np.concatenate((rows[p], rows[q]), axis=1)]
        todo = one.min(axis=1) < one.max(axis=1)
        p, q = p[todo], q[todo]
        square = np.zeros((len(p), rows.shape[1], rows.shape[1]))
        for at in leaves.at:
            square += (at[p][:, :, None] - at[q][:, None, :]) ** 2
        pair, i, j = np.nonzero(np.sqrt(square) <= eps)
        _join(top, rows[p[pair], i], rows[q[pair], j])
    return top


def _rows_of(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _box_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BOX_ROWS, str(BOX_ROWS_DEFAULT)))


def _drawn(rows: DataFrame, wanted: int, total: int, dims: int) -> np.ndarray:
    """A sample of about ``wanted`` different places."""
    sample = rows.select("at").sample(min(1.0, wanted / max(total, 1)), seed=SEED).limit(2 * wanted).toArrow()
    return np.unique(_rows_of(sample.column("at"), dims), axis=0) if sample.num_rows else np.zeros((0, dims))


def grow_boxes(rows: DataFrame, dims: int, total: int) -> tuple[Boxes, bool]:
    """A tree over ``at``, and whether it is of use."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1.0, total / _box_rows(rows))))))
    if not depth:
        return Boxes.of(np.zeros((0, dims)), 0, dims), False
    sample = _drawn(rows, 2**depth * SAMPLE_PER_BOX, total, dims)
    boxes = Boxes.of(sample, depth, dims)
    return boxes, boxes.prunes(sample)


def _keyed(rows: DataFrame, dims: int, key: Callable[[np.ndarray], np.ndarray] | None, many: bool = False) -> DataFrame:
    """Rows with ``box``: 0, or the key of ``at``, or one row for each of its keys where there are many."""
    if key is None:
        return rows.withColumn("box", F.lit(0))

    def find(batches):
        for b in batches:
            found = key(_rows_of(pa.chunked_array([b.column("at")]), dims))
            if many:
                point, found = found
                b = b.take(pa.array(point))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.astype(np.int32))], [*b.schema.names, "box"])

    return rows.mapInArrow(find, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", box int")


def _chunk(n) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _chunked(hosts: DataFrame, boxes: Boxes, dims: int) -> tuple[DataFrame, Boxes, np.ndarray]:
    """Rows of boxes in chunks ``h``, the same that ``_dealt`` makes of hosts; the boxes around them; and which are more than one chunk."""
    most = _box_rows(hosts) * CHUNK
    ends = [of(F.get("at", F.lit(d))).alias(f"{name}{d}") for name, of in (("low", F.min), ("high", F.max)) for d in range(dims)]
    held = hosts.groupBy("box").agg(F.count(F.lit(1)).alias("rows"), *ends).toArrow()  # a row for each box
    box, rows = held.column("box").to_numpy(), held.column("rows").to_numpy()
    low, high = (np.stack([held.column(f"{name}{d}").to_numpy() for d in range(dims)], axis=1) for name in ("low", "high"))
    cut = [(int(b), math.ceil(n / most)) for b, n in zip(box, rows) if n > most]
    table = F.broadcast(hosts.sparkSession.createDataFrame(cut, "box int, chunks int"))
    chunks = hosts.join(table, "box", "left").withColumn("h", _chunk(F.coalesce("chunks", F.lit(1)))).drop("chunks")
    return chunks, boxes.around(box, low, high), np.array([b for b, _ in cut], int)


def _dealt(guests: DataFrame, hosts: DataFrame, one_box: bool, n_guests: int, n_hosts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a meeting in chunks: a chunk of each meets every chunk of the other within a box.

    Guests with a column ``home`` have met their own chunk of that box.
    """
    spark, rows = guests.sparkSession, _box_rows(guests) * CHUNK
    if one_box:  # enough tasks where the table is small
        share = max(256, math.ceil(n_guests / spark.sparkContext.defaultParallelism))
        sizes = [(0, math.ceil(n_guests / min(rows // 2, share)), math.ceil(n_hosts / (2 * rows)))]
    else:
        counts: dict[int, list[int]] = {}
        for side, df in enumerate((guests, hosts)):
            for r in df.groupBy("box").count().collect():  # a row for each box or list
                counts.setdefault(r["box"], [0, 0])[side] = r["count"]
        sizes = [(box, math.ceil(g / rows), math.ceil(h / rows)) for box, (g, h) in counts.items() if g and h]
    table = F.broadcast(spark.createDataFrame(sizes or [(0, 1, 1)], "box int, guest_chunks int, host_chunks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    g, h = F.col("guest_chunks"), F.col("host_chunks")
    guests = guests.join(table, "box").withColumn("g", _chunk(g)).withColumn("h", every(h))
    if "home" in guests.columns:
        guests = guests.where((F.col("home") != F.col("box")) | (F.col("h") != _chunk(h))).drop("home")
    hosts = hosts.join(table, "box").withColumn("h", _chunk(h)).withColumn("g", every(g)).drop("guest_chunks", "host_chunks")
    return guests.drop("guest_chunks", "host_chunks"), hosts


def _meet(guests: DataFrame, hosts: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], shape: str) -> DataFrame:
    places = ["box", "g", "h"]
    names = [c for c in hosts.columns if c not in places]
    hosts = hosts.select(*places, *[F.col(c).alias(c) for c in names])  # new columns: both sides may come from one table
    return guests.groupBy(*places).cogroup(hosts.groupBy(*places)).applyInArrow(solve, shape)


def _best_pairs(a: np.ndarray, b: np.ndarray, keep: int, limit: np.ndarray | None, pairs: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance) for the best ``keep`` rows of ``b`` within the limit, ties by their order."""
    own, hit, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for s, i, j, d in pairs(a, b, keep, limit) if len(a) and len(b) else ():
        if limit is not None:
            near = d <= limit[s + i]
            i, j, d = i[near], j[near], d[near]
        order = np.lexsort((j, np.round(d, PLACES), i))
        i, j, d = i[order], j[order], d[order]
        best = np.arange(len(i)) - np.searchsorted(i, i, side="left") < keep
        own.append(s + i[best])
        hit.append(j[best])
        far.append(d[best])
    return np.concatenate(own), np.concatenate(hit), np.concatenate(far)


def _hits_in_block(dims: int, keep: int, limited: bool, pairs: Callable = _near_pairs):
    """The best ``keep`` of the hosts for each guest, ties by id."""

    def solve(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        hosts = hosts.sort_by("id")
        a, b = _rows_of(guests.column("at"), dims), _rows_of(hosts.column("at"), dims)
        limit = guests.column("radius").to_numpy() + 10.0**-PLACES if limited else None
        own, hit, far = _best_pairs(a, b, keep, limit, pairs)
        own, hit = pa.array(own), pa.array(hit)
        return pa.table({"loc": guests.column("loc").take(own), **{c: hosts.column(c).take(hit) for c in ("id", "label", "first")}, "dist": far})

    return solve


def _listed(rows: np.ndarray, many: int, values: pa.Array) -> pa.Array:
    """A list for each of ``many`` rows, of the values of that row, which come in order."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=many)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _others(boxes: Boxes, pts: np.ndarray, radius: np.ndarray, home: np.ndarray, cut: np.ndarray) -> pa.Array:
    """For each point the boxes within its radius, its own only where that is one of the ``cut``."""
    point, box = boxes.within(pts, radius)
    going = (box != home[point]) | np.isin(box, cut)
    return _listed(point[going], len(pts), pa.array(box[going].astype(np.int32)))


def _hits_at_home(dims: int, keep: int, boxes: Boxes, cut: np.ndarray):
    """The best ``keep`` rows of its own chunk for each location, how far others need be looked for, and in which boxes."""

    def solve(rows: pa.Table) -> pa.Table:
        hosts, guests = rows.sort_by("id"), rows.filter(pc.equal(rows.column("__n"), 1))
        a = _rows_of(guests.column("at"), dims)
        own, hit, far = _best_pairs(a, _rows_of(hosts.column("at"), dims), keep, None, _near_in_leaves)
        radius = np.zeros(len(a))
        np.maximum.at(radius, own, far)
        radius[np.bincount(own, minlength=len(a)) < keep] = np.inf
        hits = {c: hosts.column(c).take(pa.array(hit)).combine_chunks() for c in ("id", "label", "first")} | {"dist": pa.array(far)}
        lists = {f"{c}s": _listed(own, len(a), values) for c, values in hits.items()}
        away = _others(boxes, a, radius, guests.column("box").to_numpy(), cut)
        return pa.table({**{c: guests.column(c) for c in ("loc", "id", "at", "box")}, **lists, "radius": radius, "away": away})

    return solve


def _best(hits: DataFrame, keep: int) -> DataFrame:
    place = Window.partitionBy("loc").orderBy(F.round("dist", PLACES), "id")
    return hits.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= keep).drop("__n")


@dataclass(frozen=True)
class Located:
    """Rows with the key of their location; each location's first ids, and its first row."""

    rows: DataFrame
    firsts: DataFrame
    places: DataFrame
    dims: int
    total: int


def located(points: DataFrame, coords: Sequence[str], id_col: str, label: str | None, keep: int) -> Located:
    at = [F.col(c).cast("double") + F.lit(0.0) for c in coords]
    whole = F.lit(True)
    for c in at:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    rows = points.select(F.col(id_col).alias("id"), (F.col(label).cast("int") if label else F.lit(0)).alias("label"), F.when(whole, F.array(*at)).alias("at"))
    key = F.concat(F.hex(F.xxhash64("at")), F.lit("."), F.hex(F.hash("at")))
    rows = settle(rows.withColumn("loc", F.when(F.col("at").isNotNull(), key)))
    place = Window.partitionBy("loc").orderBy("id")
    firsts = rows.where(F.col("at").isNotNull()).withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= keep)
    firsts = firsts.withColumn("first", F.first("id").over(place))
    return Located(rows, firsts, firsts.where(F.col("__n") == 1).drop("__n"), len(coords), rows.count())


def _lists(hits: DataFrame) -> DataFrame:
    found = F.struct(F.round("dist", PLACES).alias("near"), "id", "dist", "label", "first")
    return hits.groupBy("loc").agg(F.array_sort(F.collect_list(found)).alias("hits"))  # at most ``keep`` of each location


def _as_columns(lists: DataFrame) -> DataFrame:
    return lists.select("*", F.col("hits.dist").alias("dists"), F.col("hits.first").alias("firsts")).drop("hits")


def search(points: Located, keep: int, whole: bool = False) -> DataFrame:
    """(loc, hits): the ``keep`` nearest rows of every location, itself included.

    With ``whole`` settled (loc, id, at, dists, firsts): each location's first id and coordinates, and of its hits how far they are and the
    first ids of their locations.
    """
    kind = points.rows.schema["id"].dataType.simpleString()
    shape = f"loc string, id {kind}, label int, first {kind}, dist double"
    boxes, useful = grow_boxes(points.rows.where("at IS NOT NULL"), points.dims, points.total)
    if not useful:
        firsts = points.firsts.drop("__n")
        guests, hosts = _dealt(_keyed(points.places, points.dims, None), _keyed(firsts, points.dims, None), True, points.total, points.total)
        lists = _lists(_best(_meet(guests, hosts, _hits_in_block(points.dims, keep, False), shape), keep))
        return settle(_as_columns(points.places.select("loc", "id", "at").join(lists, "loc"))) if whole else lists
    hosts = settle(_keyed(points.firsts, points.dims, boxes.find))
    chunks, boxes, cut = _chunked(hosts, boxes, points.dims)
    listed = f"loc string, id {kind}, at array<double>, box int, ids array<{kind}>, labels array<int>, firsts array<{kind}>, dists array<double>, radius double, away array<int>"
    home = settle(chunks.groupBy("box", "h").applyInArrow(_hits_at_home(points.dims, keep, boxes, cut), listed))
    stays, goes = home.where(F.size("away") == 0), home.where(F.size("away") > 0)
    trips = goes.select("loc", "id", "at", "radius", F.col("box").alias("home"), F.explode("away").alias("box"))
    away = _meet(*_dealt(trips, hosts.drop("__n"), False, 0, 0), _hits_in_block(points.dims, keep, True, _near_in_leaves), shape)
    hits = F.arrays_zip("ids", "labels", "firsts", "dists")
    so_far = goes.select("loc", F.inline(hits).alias("id", "label", "first", "dist"))
    found = _lists(_best(so_far.unionByName(away), keep))
    if whole:
        names = ["loc", "id", "at", "dists", "firsts"]
        return stays.select(*names).unionByName(settle(_as_columns(goes.select("loc", "id", "at").join(found, "loc")).select(*names)))
    named = lambda x: F.struct(F.round(x["dists"], PLACES).alias("near"), x["ids"].alias("id"), x["dists"].alias("dist"), x["labels"].alias("label"), x["firsts"].alias("first"))
    return stays.select("loc", F.array_sort(F.transform(hits, named)).alias("hits")).unionByName(found)


def _shown(points: Located, lists: DataFrame, k: int, id_col: str, include_self: bool) -> DataFrame:
    rows = attach(points.rows.select("id", "loc"), lists.select("loc", "hits"), ["loc"], ["id"], size=points.total)
    hits = F.col("hits") if include_self else F.filter("hits", lambda x: x["id"] != F.col("id"))
    shown = F.transform(F.slice(hits, 1, k), lambda x: F.struct(x["dist"].alias("dist"), x["id"].alias("id"), x["label"].alias("label")))
    return rows.select(F.col("id").alias(id_col), shown.alias("neighbours"))


def nearest(
    points: DataFrame,
    coords: Sequence[str],
    k: int,
    id_col: str = "id",
    label: str | None = None,
    include_self: bool = False,
) -> DataFrame:
    """(id, neighbours): the k nearest rows as structs (dist, id, label), nearest first, ties by id; null where a coordinate lacks."""
    where = located(points, coords, id_col, label, k + 1)
    return _shown(where, search(where, k + 1), k, id_col, include_self)


def neighbour_distance(points: DataFrame, coords: Sequence[str], k: int = 5, id_col: str = "id") -> DataFrame:
    """Distance to the k-th nearest row, the row itself being the first."""
    return _kth_distance(nearest(points, coords, k, id_col, include_self=True), k, id_col)


def _kth_distance(near: DataFrame, k: int, id_col: str) -> DataFrame:
    return near.select(id_col, F.get("neighbours", F.lit(k - 1))["dist"].alias("distance"))


def distances_of_places(where: Located, lists: DataFrame, k: int) -> DataFrame:
    """(distance, rows): how far the k-th nearest row of a location is, and how many rows are there; ``lists`` are whole and keep ``k`` rows or more."""
    many = where.rows.where(F.col("loc").isNotNull()).groupBy("loc").agg(F.count(F.lit(1)).alias("rows"))
    return lists.select("loc", F.get("dists", F.lit(k - 1)).alias("distance")).join(many, "loc").select("distance", "rows")


@dataclass(frozen=True)
class InvertedFile:
    """Centres of lists, and how many lists near a row are searched."""

    centres: np.ndarray
    probes: int

    def nearest_lists(self, pts: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        square = (self.centres**2).sum(axis=1) - 2 * pts @ self.centres.T
        many = min(many, len(self.centres))
        order = np.argpartition(square, many - 1, axis=1)[:, :many]
        return np.repeat(np.arange(len(pts)), many), order.ravel()

    @staticmethod
    def fit(sample: np.ndarray, lists: int, k: int, recall: float, rounds: int = 8) -> InvertedFile:
        """Centres by Lloyd's rounds on the sample; as many lists as hold ``recall`` of the sample's own k nearest rows."""
        centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]]
        for _ in range(rounds):
            own = ((centres**2).sum(axis=1) - 2 * sample @ centres.T).argmin(axis=1)
            size = np.bincount(own, minlength=len(centres))
            sums = np.stack([np.bincount(own, sample[:, d], len(centres)) for d in range(sample.shape[1])], axis=1)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        square = (centres**2).sum(axis=1) - 2 * sample @ centres.T
        own = square.argmin(axis=1)
        asked = sample[:: max(1, len(sample) // 512)]
        place = np.argsort(np.argsort(((centres**2).sum(axis=1) - 2 * asked @ centres.T), axis=1), axis=1)
        near = np.argsort(distances(asked, sample), axis=1)[:, 1 : k + 1]
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else len(centres)
        return InvertedFile(centres, probes)


def fit_lists(where: Located, k: int, recall: float) -> InvertedFile:
    sample = _drawn(where.rows.where("at IS NOT NULL"), FIT_ROWS, where.total, where.dims)
    if not len(sample):
        return InvertedFile(np.zeros((1, where.dims)), 1)
    lists = max(1, min(int(math.sqrt(where.total)), len(sample) // 8))
    return InvertedFile.fit(sample, lists, k, recall)


def approximate_nearest(
    points: DataFrame,
    coords: Sequence[str],
    k: int,
    id_col: str = "id",
    label: str | None = None,
    include_self: bool = False,
    recall: float = 0.95,
    lists: InvertedFile | None = None,
) -> DataFrame:
    """As ``nearest``, from the lists near each row only. ``recall`` is aimed at on a bounded sample, every row is in a list."""
    where = located(points, coords, id_col, label, k + 1)
    file = lists or fit_lists(where, k, recall)
    kind = where.rows.schema["id"].dataType.simpleString()
    hosts = settle(_keyed(where.firsts.drop("__n"), where.dims, lambda pts: file.nearest_lists(pts, 1)[1]))
    guests = settle(_keyed(where.places, where.dims, lambda pts: file.nearest_lists(pts, file.probes), many=True))
    shape = f"loc string, id {kind}, label int, first {kind}, dist double"
    hits = _meet(*_dealt(guests, hosts, False, 0, 0), _hits_in_block(where.dims, k + 1, False), shape)
    return _shown(where, _lists(_best(hits, k + 1)), k, id_col, include_self)


def _forest_in_block(dims: int, eps: float):
    """Edges that connect whatever guests and hosts within ``eps`` of each other connect: each linked row and the least id of its part."""

    def solve(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        a, b = _rows_of(guests.column("at"), dims), _rows_of(hosts.column("at"), dims)
        part, met, linked = np.arange(len(b)), np.full(len(a), -1), np.zeros(len(b), bool)
        limit = np.full(len(a), eps)
        for s, i, j, d in _near_pairs(a, b, None, limit) if len(a) and len(b) else ():
            i, j = i[d <= eps], j[d <= eps]
            linked[j] = True
            for of in np.split(np.arange(len(i)), np.nonzero(np.diff(i))[0] + 1):
                if len(of):
                    parts = np.unique(part[j[of]])
                    met[s + i[of[0]]] = j[of[0]]
                    if len(parts) > 1:
                        part[np.isin(part, parts)] = parts[0]
        own, other = np.flatnonzero(met >= 0), np.flatnonzero(linked)
        ids = pa.concat_arrays([guests.column("id").combine_chunks().take(pa.array(own)), hosts.column("id").combine_chunks().take(pa.array(other))])
        parts, of = np.unique(np.concatenate((part[met[own]], part[other])), return_inverse=True)
        order = pc.sort_indices(ids).to_numpy()
        first = np.empty(len(parts), np.int64)
        first[of[order[::-1]]] = order[::-1]  # the last to be set is the least
        return pa.table({"a": ids, "b": ids.take(pa.array(first[of]))})

    return solve


def _parts_in_chunk(dims: int, eps: float, boxes: Boxes, cut: np.ndarray):
    """Rows with the least id that links of ``eps`` lead to within their chunk, and the other boxes in reach."""

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").drop_columns(["h"])
        at = _rows_of(rows.column("at"), dims)
        part = rows.column("id").take(pa.array(_parts(at, eps)))
        away = _others(boxes, at, np.full(len(at), eps), rows.column("box").to_numpy(), cut)
        return rows.append_column("part", part).append_column("away", away)

    return solve


def _links_of_parts(dims: int, eps: float):
    """Parts of guests and of hosts that come within ``eps`` of each other."""

    def solve(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        a, b = _rows_of(guests.column("at"), dims), _rows_of(hosts.column("at"), dims)
        of = [t.column("part").combine_chunks().dictionary_encode() for t in (guests, hosts)]
        own, other = (c.indices.fill_null(len(c.dictionary)).to_numpy() for c in of)
        met, width = np.empty(0, np.int64), len(of[1].dictionary) + 1
        for s, i, j, d in _near_in_leaves(a, b, None, np.full(len(a), eps)) if len(a) and len(b) else ():
            i, j = i[d <= eps], j[d <= eps]
            met = np.union1d(met, own[s + i].astype(np.int64) * width + other[j])
        names = [pa.concat_arrays([c.dictionary, pa.nulls(1, c.dictionary.type)]) for c in of]
        return pa.table({"a": names[0].take(pa.array(met // width)), "b": names[1].take(pa.array(met % width))})

    return solve


def parts_within(places: DataFrame, dims: int, total: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """``places`` with ``part``, an id that links within ``eps`` lead to, and (a, b): parts that are linked to each other.

    ``places`` holds id, at and what else is to be kept. Rows of a box are joined where they are, by a tree over them, so what is left
    to be joined are the parts of boxes, and only rows near another box look for them. In blocks every row is its own part.
    """
    kind = places.schema["id"].dataType.simpleString()
    boxes, useful = grow_boxes(places, dims, total)
    if not useful:
        rows = places.select("id", "at")
        guests, hosts = _dealt(_keyed(rows, dims, None), _keyed(rows, dims, None), True, total, total)
        links = _meet(guests, hosts, _forest_in_block(dims, eps), f"a {kind}, b {kind}").where(F.col("a") != F.col("b"))
        return places.withColumn("part", F.col("id")), links
    chunks, boxes, cut = _chunked(settle(_keyed(places, dims, boxes.find)), boxes, dims)
    shape = ", ".join(f"{n} {t}" for n, t in chunks.drop("h").dtypes) + f", part {kind}, away array<int>"
    rows = settle(chunks.groupBy("box", "h").applyInArrow(_parts_in_chunk(dims, eps, boxes, cut), shape))
    edge = rows.where(F.size("away") > 0)
    guests = edge.select("id", "at", "part", F.col("box").alias("home"), F.explode("away").alias("box")).where("box >= home")
    guests, hosts = _dealt(guests, edge.select("id", "at", "part", "box"), False, 0, 0)
    links = _meet(guests, hosts, _links_of_parts(dims, eps), f"a {kind}, b {kind}").where(F.col("a") != F.col("b"))
    return rows.drop("box", "away"), links


def links_within(places: DataFrame, dims: int, total: int, eps: float) -> DataFrame:
    """(a, b): ids of rows, no more than are needed to connect all that are connected by steps of ``eps`` at most.

    ``places`` holds id and at. Chunks meet as in a search; each meeting gives a forest, so pairs are never listed.
    """
    rows, links = parts_within(places, dims, total, eps)
    return rows.select(F.col("id").alias("a"), F.col("part").alias("b")).where(F.col("a") != F.col("b")).unionByName(links)
