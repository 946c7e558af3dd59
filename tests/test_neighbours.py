"""Neighbour search and density clusters in many dimensions, by blocks, boxes and an inverted file."""

import numpy as np
import pytest
from conftest import rows_by

from tallyward.operators import cluster, neighbours
from tallyward.operators.neighbours import BOX_ROWS, Boxes, InvertedFile, approximate_nearest, nearest

DIMS = 32
COORDS = [f"x{i}" for i in range(DIMS)]
SHAPE = "id long, " + ", ".join(f"{c} double" for c in COORDS) + ", is_fraud int"


def frame(spark, pts):
    return spark.createDataFrame([(i, *map(float, p), i % 3) for i, p in enumerate(pts)], SHAPE)


def clouds(n, centres, spread, seed=1):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (centres, DIMS))
    return middle[np.arange(n) % centres] + r.normal(0, spread, (n, DIMS))


def brute(pts, k):
    d = np.round(neighbours.distances(pts, pts), neighbours.PLACES)
    d[np.arange(len(pts)), np.arange(len(pts))] = np.inf
    return {i: np.lexsort((np.arange(len(pts)), row))[:k].tolist() for i, row in enumerate(d)}


def found(df):
    return {r["id"]: [n["id"] for n in r["neighbours"]] for r in df.collect()}


@pytest.fixture(params=[None, "16", "40"])
def box_rows(request, spark):
    if request.param:
        spark.conf.set(BOX_ROWS, request.param)
    yield int(request.param or neighbours.BOX_ROWS_DEFAULT)
    spark.conf.unset(BOX_ROWS)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_blocks_are_exact_in_many_dimensions(spark, box_rows, offset):
    """Also far from the origin, where a matrix product alone would lose the differences; a third of the rows share a place."""
    pts = clouds(300, 300, 0.0) + offset
    pts[::3] = pts[0]
    assert found(nearest(frame(spark, pts), COORDS, 4)) == brute(pts, 4)


def test_the_tree_is_used_where_it_rules_out_and_blocks_where_not():
    r = np.random.default_rng(3)
    flat = np.zeros((2000, DIMS))
    flat[:, :2] = r.uniform(0, 1, (2000, 2))
    assert Boxes.of(flat, 6, DIMS).prunes(flat)
    round_ = r.normal(0, 1, (2000, DIMS))
    assert not Boxes.of(round_, 6, DIMS).prunes(round_)


def test_boxes_are_exact_on_flat_data_in_many_dimensions(spark, box_rows):
    r = np.random.default_rng(3)
    pts = np.zeros((400, DIMS))
    pts[:, :2] = np.round(r.uniform(0, 1, (400, 2)), 2)  # many ties
    assert found(nearest(frame(spark, pts), COORDS, 3)) == brute(pts, 3)


def test_a_task_holds_a_chunk_of_each_side(spark, monkeypatch):
    """Chunks stay bounded when one box or list holds all rows."""
    sizes = []
    plain = neighbours._dealt

    def watched(guests, hosts, *args):
        g, h = plain(guests, hosts, *args)
        sizes.append(max([r["count"] for side in (g, h) for r in side.groupBy("box", "g", "h").count().collect()]))
        return g, h

    monkeypatch.setattr(neighbours, "_dealt", watched)
    monkeypatch.setattr(neighbours, "MAX_DEPTH", 0)
    spark.conf.set(BOX_ROWS, "8")
    try:
        pts = clouds(400, 400, 0.0)
        assert found(nearest(frame(spark, pts), COORDS, 2)) == brute(pts, 2)
        assert max(sizes) <= 2 * 8 * 2 * neighbours.CHUNK
        sizes.clear()
        lists = InvertedFile(np.zeros((1, DIMS)), 1)
        assert found(approximate_nearest(frame(spark, pts), COORDS, 2, lists=lists)) == brute(pts, 2)
        assert max(sizes) <= 2 * 8 * neighbours.CHUNK
    finally:
        spark.conf.unset(BOX_ROWS)


@pytest.mark.parametrize("spread", [0.3, 1.0])
def test_recall_of_the_inverted_file(spark, box_rows, spread):
    pts, k = clouds(900, 40, spread, seed=6), 5
    df = frame(spark, pts)
    where = neighbours.located(df, COORDS, "id", None, k + 1)
    lists = neighbours.fit_lists(where, k, 0.95)
    got, want = found(approximate_nearest(df, COORDS, k, lists=lists)), brute(pts, k)
    assert set(got) == set(want)
    assert np.mean([len(set(got[i]) & set(want[i])) / k for i in want]) >= 0.9
    if spread < 1:
        assert lists.probes < len(lists.centres) / 2


def test_rows_without_a_coordinate(spark):
    pts = clouds(60, 60, 0.0)
    rows = [(i, *map(float, p), 0) for i, p in enumerate(pts)] + [(100, None, *[0.0] * (DIMS - 1), 0), (101, float("nan"), *[0.0] * (DIMS - 1), 0)]
    df = spark.createDataFrame(rows, SHAPE)
    out = rows_by(nearest(df, COORDS, 2), "id", "neighbours")
    assert out[100] is None and out[101] is None
    assert {i: [n["id"] for n in ns] for i, ns in out.items() if ns is not None} == brute(pts, 2)
    clusters = rows_by(cluster.dbscan(df, COORDS, 50.0, 3), "id", "cluster")
    assert clusters[100] == clusters[101] == -1 and {clusters[i] for i in range(60)} == {0}
    none = df.limit(0)
    assert nearest(none, COORDS, 2).count() == 0 and approximate_nearest(none, COORDS, 2).count() == 0 and cluster.dbscan(none, COORDS, 1.0).count() == 0


@pytest.mark.parametrize("eps", [1.0, 2.2, 3.4])
def test_density_clusters_in_many_dimensions(spark, box_rows, eps):
    pts = np.vstack([clouds(240, 6, 0.3, seed=2), np.repeat(clouds(1, 1, 0.0, seed=9), 60, axis=0), clouds(30, 30, 0.0, seed=4)])
    near = neighbours.distances(pts, pts) <= eps
    core, label = near.sum(axis=1) >= 8, np.full(len(pts), -1)
    for n, i in enumerate(np.flatnonzero(core)):
        todo = [i] if label[i] < 0 else []
        number = label.max() + 1
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = number
                todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    assert rows_by(cluster.dbscan(frame(spark, pts), COORDS, eps), "id", "cluster") == dict(enumerate(label.tolist()))


def test_links_connect_what_is_in_reach_without_listing_pairs(spark, box_rows):
    pts = clouds(500, 3, 0.2, seed=5)
    places = frame(spark, pts).selectExpr("id", f"array({', '.join(COORDS)}) AS at")
    links = neighbours.links_within(places, DIMS, len(pts), 3.0).collect()
    home = list(range(len(pts)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in links:
        home[top(a)] = top(b)
    near = neighbours.distances(pts, pts) <= 3.0
    assert all(near[a, b] for a, b in links) and len({top(i) for i in range(len(pts))}) == 3
    assert len(links) < near.sum() / 8


@pytest.mark.parametrize("keep, limit", [(10, None), (None, 100.0), (3, 100.0)])
def test_meeting_in_bounded_memory(keep, limit):
    """A meeting of chunks holds a tile of squares, not all of them, nor the coordinates of all pairs in reach."""
    import tracemalloc

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 64)), rng.normal(size=(30_000, 64))
    tracemalloc.start()
    found = list(neighbours._near_pairs(a, b, keep, None if limit is None else np.full(40, limit)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    (_, i, j, d), far = found[0], np.sqrt(((a[:, None] - b) ** 2).sum(axis=2)) if keep else None
    if keep:
        for r in range(40):
            assert np.argsort(far[r])[:keep].tolist() == j[i == r][np.argsort(d[i == r])][:keep].tolist()
    else:
        assert len(i) == 40 * 30_000


def test_many_hosts_in_tiles():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(300, 64)), rng.normal(size=(30_000, 64))
    import tracemalloc

    tracemalloc.start()
    parts = list(neighbours._near_pairs(a, b, 5, None))
    assert tracemalloc.get_traced_memory()[1] < 90e6
    tracemalloc.stop()
    assert [p[0] for p in parts] == [0, 256]


def test_knee_and_clusters_from_one_search(spark, monkeypatch):
    from tallyward.operators import cluster

    rng = np.random.default_rng(4)
    at = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(3, 0.1, (60, 2)), rng.uniform(-5, 8, (20, 2))])
    df = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(at)], "id long, x double, y double")
    eps = cluster.dbscan_eps(df, ["x", "y"])
    plain = {r["id"]: r["cluster"] for r in cluster.dbscan(df, ["x", "y"], eps).collect()}
    calls, search = [], cluster.search
    monkeypatch.setattr(cluster, "search", lambda *args: calls.append(args) or search(*args))
    got = {r["id"]: r["cluster"] for r in cluster.dbscan_at_knee(df, ["x", "y"]).collect()}
    assert got == plain and len(calls) == 1 and len(set(got.values())) > 1


def test_boxes_where_most_rows_share_a_value():
    """A cut leaves rows on both sides, so boxes stay small where half the rows or more have one value of the widest axis."""
    r = np.random.default_rng(5)
    pts = np.column_stack([(r.uniform(0, 1, 4000) > 0.6) * 9.0, r.uniform(0, 1, 4000)])
    boxes = Boxes.of(pts, 5, 2)
    assert np.bincount(boxes.find(pts), minlength=32).max() <= 200


def test_boxes_around_rows():
    r = np.random.default_rng(6)
    pts = r.integers(0, 4, (500, 3)).astype(float)
    loose = Boxes.of(pts, 4, 3)
    box = loose.find(pts)
    held = np.unique(box)
    boxes = loose.around(held, np.stack([pts[box == b].min(axis=0) for b in held]), np.stack([pts[box == b].max(axis=0) for b in held]))
    point, met = boxes.within(pts, np.full(500, 0.5))
    assert np.array_equal(point, np.arange(500)) and np.array_equal(met, box)  # rows of whole numbers reach no other box
    assert len(loose.within(pts, np.full(500, 0.5))[0]) > 500


@pytest.mark.parametrize("dims, whole", [(2, False), (2, True), (4, False), (4, True)])
def test_a_box_is_searched_by_a_tree(monkeypatch, dims, whole):
    """Rows of a box are measured against few others, and find the same: before, all pairs of a box were measured."""
    r = np.random.default_rng(7)
    pts = r.uniform(0, 1, (6000, dims))
    pts = np.round(pts * 40) / 40 if whole else pts
    measured = []
    plain = neighbours.Leaves.measured
    monkeypatch.setattr(neighbours.Leaves, "measured", lambda self, *args: measured.append(plain(self, *args)) or measured[-1])
    limit = r.uniform(0, 0.1, 6000)
    for most in (None, limit):
        found = neighbours._best_pairs(pts, pts, 5, most, neighbours._near_in_leaves)
        assert sum(d.size for d in measured) < len(pts) ** 2 / 5
        assert all(np.array_equal(a, b) for a, b in zip(found, neighbours._best_pairs(pts, pts, 5, most, neighbours._near_pairs)))
        measured.clear()


@pytest.mark.parametrize("eps", [0.0, 0.02, 0.05, 0.3, 3.0])
def test_parts_of_a_box(eps):
    r = np.random.default_rng(8)
    pts = np.round(r.uniform(0, 1, (900, 2)) ** 2, 3)
    near, part = neighbours.distances(pts, pts) <= eps, np.arange(900)
    while not np.array_equal(part, step := np.where(near, part, 900).min(axis=1)):
        part = step
    assert np.array_equal(neighbours._parts(pts, eps), part)


def test_pairs_of_components_are_those_between_boxes(spark):
    """Rows are joined in their box, so what is left to be joined is few: before, every row was a node of the components."""
    r = np.random.default_rng(9)
    pts = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(r.uniform(0, 1, (3000, 2)))]
    places = spark.createDataFrame(pts, "id long, at array<double>")
    spark.conf.set(BOX_ROWS, "400")
    try:
        rows, links = neighbours.parts_within(places, 2, 3000, 0.05)
        part = rows_by(rows, "id", "part")
        assert len(part) == 3000 and len(set(part.values())) <= 16 and links.count() < 300
        assert neighbours.links_within(places, 2, 3000, 0.05).count() < 3300
    finally:
        spark.conf.unset(BOX_ROWS)


def test_knee_ranks_a_distance_once(spark):
    far = [0.0] * 40 + [0.1] * 30 + [0.2, 0.3, 0.3, 0.9, 2.0]
    one = spark.createDataFrame([(i, d) for i, d in enumerate(far)] + [(99, None)], "id int, distance double")
    counted = spark.createDataFrame([(0.0, 25), (0.0, 15), (0.1, 30), (0.2, 1), (0.3, 2), (0.9, 1), (2.0, 1), (None, 1)], "distance double, rows long")
    d = np.array(far)
    rank = int((np.arange(75) / 74 - d / 2.0).round(12).argmax()) + 1
    assert cluster.knee(one).collect() == cluster.knee(counted, rows="rows").collect() == [(rank, far[rank - 1])]


def test_ids_at_several_places_are_one_core_row(spark):
    """As in the components of ids: what an id links is one cluster."""
    at = [(i, 0.01 * i, 0.0) for i in range(12)] + [(100 + i, 9 + 0.01 * i, 0.0) for i in range(12)] + [(200 + i, 50 + 0.01 * i, 0.0) for i in range(12)]
    df = spark.createDataFrame([*at, (3, 9.005, 0.0)], "id long, x double, y double")
    got = {(r["id"], r["cluster"]) for r in cluster.dbscan(df, ["x", "y"], 0.2).collect()}
    assert got == {(i, 0 if i < 200 else 1) for i, _, _ in at}
