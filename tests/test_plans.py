import random

import numpy as np
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from tallyward.operators.entities import device_value_stats, summarize_entity
from tallyward.operators.features import device_features
from tallyward.operators.splits import row_slice, time_split
from tallyward.plans import components, slices
from tallyward.plans.components import connected_components
from tallyward.plans.joins import attach
from tallyward.plans.slices import Over, cut_points, global_rank, quantile_of, quantiles, ranked_for, row_at, running
from tallyward.session import GROUP_ROWS, settle


@pytest.fixture(params=[None, "5", "two levels"])
def limit(request, spark, monkeypatch):
    """Groups of five rows are cut; with two levels, by three first slices and cuts of their own."""
    if request.param:
        spark.conf.set(GROUP_ROWS, "5")
    if request.param == "two levels":
        monkeypatch.setattr(slices, "MAX_SLICES", 3)
        monkeypatch.setattr(slices, "SAMPLE_PER_SLICE", 4)
    yield request.param
    spark.conf.unset(GROUP_ROWS)


def skewed(spark, n=300):
    rnd = random.Random(5)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 20}", rnd.randrange(40), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, t int, v double"), rows


def test_running_values(spark, limit):
    df, rows = skewed(spark)
    out = running(
        df,
        ["k"],
        ["t", "id"],
        [
            Over("n", "count", F.lit(1), "before"),
            Over("s", "sum", F.col("v"), "through"),
            Over("lo", "min", F.col("v"), "through"),
            Over("hi", "max", F.col("v"), "before"),
            Over("prev", "last", F.col("id"), "before"),
            Over("all", "count", F.lit(1), "group"),
        ],
    )
    got = rows_by(out, "id", "n", "s", "lo", "hi", "prev", "all")
    for i, k, t, v in rows:
        group = sorted((r[2], r[0], r[3]) for r in rows if r[1] == k)
        at = group.index((t, i, v))
        vals = [g[2] for g in group]
        want = (at, sum(vals[: at + 1]), min(vals[: at + 1]), max(vals[:at]) if at else None, group[at - 1][1] if at else None, len(group))
        assert got[i] == pytest.approx(want)


def test_only_big_groups_are_cut(spark, limit):
    df, _ = skewed(spark)
    cuts = cut_points(df, ["k"], ["t", "id"])
    assert bool(cuts) == bool(limit) and (cuts.finer is not None) == (limit == "two levels")
    if cuts:
        assert {r[0] for r in cuts.big_keys(df).collect()} <= {"hot", None} | {f"k{i}" for i in range(20)}
        held = cuts.sliced(df).groupBy("k", slices._SLICE).count().agg(F.max("count")).first()[0]
        assert held < 60  # of 190 rows of the hot key


def test_global_rank_and_row_at(spark, limit):
    df, rows = skewed(spark)
    order = sorted((r[2], r[0]) for r in rows)
    got = rows_by(global_rank(df, ["t", "id"]), "id", "rank")
    assert got == {i: n + 1 for n, (_, i) in enumerate(order)}
    for pos in (0, 7, 150, 299):
        assert row_at(df, ["t", "id"], pos) == order[pos]
    assert row_at(df, ["t", "id"], 300) is None


def test_quantiles(spark, limit):
    df, rows = skewed(spark)
    probs = {"q1": 0.25, "mid": 0.5, "q9": 0.9}
    got = rows_by(quantiles(df, ["k"], "t", probs), "k", *probs)
    for k in {r[1] for r in rows}:
        vals = [r[2] for r in rows if r[1] == k]
        assert got[k] == pytest.approx(tuple(np.quantile(vals, list(probs.values()))))
    ranked = ranked_for(df, ["k"], "v", "id", "v")
    got = rows_by(ranked.groupBy("k").agg(*[quantile_of("v", "v", p).alias(n) for n, p in probs.items()]), "k", *probs)
    for k in {r[1] for r in rows}:
        assert got[k] == pytest.approx(tuple(np.quantile([r[3] for r in rows if r[1] == k], list(probs.values()))))
    whole = quantiles(df, [], "v", probs).first()
    assert tuple(whole) == pytest.approx(tuple(np.quantile([r[3] for r in rows], list(probs.values()))))


def test_attach_salts_heavy_keys(spark, limit):
    df, rows = skewed(spark)
    sizes = df.groupBy("k").count()
    got = attach(df, sizes, ["k"], ["id"])
    assert got.count() == len(rows)
    want = {r[0]: sum(q[1] == r[1] for q in rows) if r[1] is not None else None for r in rows}
    assert rows_by(got, "id", "count") == want


def test_time_split(spark, limit):
    df = spark.range(10).select(F.col("id").cast("string").alias("transaction_id"), F.timestamp_seconds(F.lit(100) - F.col("id")).alias("purchase_time"))
    ids = lambda d: sorted(int(r[0]) for r in d.select("transaction_id").collect())
    train, test = time_split(df, 0.8)
    assert (ids(train), ids(test)) == ([2, 3, 4, 5, 6, 7, 8, 9], [0, 1])
    train, test = time_split(df, 0.75, initial_rows=8)
    assert (ids(train), ids(test)) == ([4, 5, 6, 7, 8, 9], [2, 3])
    train, test = time_split(df, 0.75, initial_rows=8, inclusive_end=True)
    assert (ids(train), ids(test)) == ([4, 5, 6, 7, 8, 9], [1, 2, 3])
    assert ids(row_slice(df, ["purchase_time", "transaction_id"], 2, 3)) == [5, 6, 7]
    assert ids(row_slice(df, ["purchase_time", "transaction_id"], 8, 9)) == [0, 1]
    assert ids(row_slice(df, ["purchase_time", "transaction_id"], 50)) == []


def test_components(spark, limit):
    rnd = random.Random(9)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 25)]
    nodes = sorted({x for e in edges for x in e} | {999})
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = connected_components(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(n,) for n in nodes], "node int"))
    assert rows_by(out, "node", "component") == {n: find(n) for n in nodes}


def test_components_of_few_pairs_take_few_tasks(spark, monkeypatch):
    """Whatever the number of shuffle partitions, a round over few pairs leaves few files."""
    parts = []

    def settled(df):
        out = settle(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "settle", settled)
    held = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        edges, nodes = spark.createDataFrame([(i, i + 1) for i in range(20)], "a int, b int"), spark.range(30).selectExpr("cast(id as int) as node")
        out = rows_by(connected_components(edges, nodes), "node", "component")
        assert out == {i: 0 if i <= 20 else i for i in range(30)} and set(parts[1:]) == {1}
        parts.clear()
        monkeypatch.setattr(components, "PAIRS_PER_TASK", 5)
        assert rows_by(connected_components(edges, nodes), "node", "component") == out and max(parts[1:]) == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_split_keeps_rows_without_a_time(spark, limit):
    df = spark.createDataFrame([(str(i), None if i < 4 else i) for i in range(12)], "transaction_id string, purchase_time int")
    ids = lambda d: sorted(int(r[0]) for r in d.select("transaction_id").collect())
    for share in (0.2, 0.5):
        train, test = time_split(df, share)
        assert (ids(train), ids(test)) == (list(range(int(share * 12))), list(range(int(share * 12), 12)))


def test_plans_have_one_exchange(spark, tmp_path, capsys):
    """Features and summaries of a device: one shuffle of the rows, only needed columns read."""
    df, _ = skewed(spark)
    rows = df.select(
        F.col("id").cast("string").alias("transaction_id"), F.col("k").alias("device_id"), F.col("k").alias("user_id"),
        F.timestamp_seconds("t").alias("purchase_time"), F.timestamp_seconds(F.lit(0)).alias("signup_time"),
        F.col("v").alias("purchase_value"), F.lit("web").alias("source"), F.col("t").alias("ip_address"),
        F.lit(0).alias("is_fraud"), F.lit("unread").alias("browser"),
    )
    rows.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for out in (device_features(rows, "online", "immediate").drop("browser"), summarize_entity(rows, "device_id", 300), device_value_stats(rows)):
        out.explain()
        text = capsys.readouterr().out
        assert text.count("Exchange hashpartitioning") == 1
        assert "browser" not in text


def test_big_entities_are_summarised_from_counts(spark, limit, monkeypatch):
    """The same summary whether groups are sorted or counted; counting settles nothing of the size of the rows."""
    from tallyward.operators import entities

    df, _ = skewed(spark)
    rows = df.select(
        F.col("id").cast("string").alias("transaction_id"), F.col("k").alias("device_id"), (F.col("t") % 5).alias("user_id"), F.timestamp_seconds(F.col("t") * 7).alias("purchase_time"),
        F.timestamp_seconds(F.lit(0)).alias("signup_time"), F.col("v").alias("purchase_value"), F.when(F.col("t") > 3, F.col("t")).alias("ip_address"), (F.col("id") % 2).cast("int").alias("is_fraud"),
    )
    counted = {r["device_id"]: r.asDict() for r in summarize_entity(rows, "device_id").collect()}
    monkeypatch.setattr(entities, "group_rows", lambda _: 10**9)
    ordered = {r["device_id"]: r.asDict() for r in summarize_entity(rows, "device_id", 300).collect()}
    assert counted.keys() == ordered.keys()
    for k, want in ordered.items():
        for name, value in want.items():
            assert counted[k][name] == (pytest.approx(value) if isinstance(value, float) else value), (k, name)
