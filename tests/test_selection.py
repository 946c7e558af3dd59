"""Quantiles by counting against numpy, for skewed, equal and odd values, and the plan they leave."""

import random

import numpy as np
import pytest
from conftest import rows_by

from tallyward.operators import profile
from tallyward.plans import selection
from tallyward.plans.slices import quantiles
from tallyward.session import GROUP_ROWS, SELECT_ROWS

PROBS = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.99, "q10": 1.0}


@pytest.fixture(params=[("4", 65_536), ("4", 40), ("200", 40)])
def by_counting(request, spark, monkeypatch):
    """Intervals of more than a few rows are cut again; with a small sample, several times."""
    spark.conf.set(SELECT_ROWS, "1")
    spark.conf.set(GROUP_ROWS, request.param[0])
    monkeypatch.setattr(selection, "SAMPLE_ROWS", request.param[1])
    yield
    spark.conf.unset(SELECT_ROWS)
    spark.conf.unset(GROUP_ROWS)


def values(n=1500):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([7.0, r.lognormvariate(0, 3), -r.random(), float(r.randrange(9))])) for i in range(n)]
    rows += [(n + i, "equal", 3.5) for i in range(300)] + [(n + 400, "one", -1.0), (n + 401, "none", None)] + [(n + 500 + i, "a", None) for i in range(9)]
    return rows


def test_equal_to_numpy(spark, by_counting):
    rows = values()
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = rows_by(quantiles(df, ["k"], "v", PROBS), "k", *PROBS)
    for k in {r[1] for r in rows if r[2] is not None}:
        assert got[k] == pytest.approx(tuple(np.quantile([r[2] for r in rows if r[1] == k and r[2] is not None], list(PROBS.values()))), abs=1e-12)
    assert "none" not in got
    whole = quantiles(df, [], "v", PROBS).first()
    assert tuple(whole) == pytest.approx(tuple(np.quantile([r[2] for r in rows if r[2] is not None], list(PROBS.values()))), abs=1e-12)
    assert quantiles(df.limit(0), ["k"], "v", PROBS).count() == 0


def test_groups_outside_the_sample_are_not_lost(spark, by_counting):
    rows = [(i, i % 3, float(i * 7919 % 1009)) for i in range(900)] + [(5000 + i, 100 + i // 2, float(i)) for i in range(60)]
    got = rows_by(quantiles(spark.createDataFrame(rows, "id long, k long, v double"), ["k"], "v", PROBS), "k", *PROBS)
    assert len(got) == 33
    for k, q in got.items():
        assert q == pytest.approx(tuple(np.quantile([r[2] for r in rows if r[1] == k], list(PROBS.values()))))


def test_many_groups_are_sorted_instead(spark, by_counting, monkeypatch):
    monkeypatch.setattr(selection, "MAX_GROUPS", 2)
    rows = values(200)
    got = rows_by(quantiles(spark.createDataFrame(rows, "id long, k string, v double"), ["k"], "v", PROBS), "k", *PROBS)
    assert got["a"] == pytest.approx(tuple(np.quantile([r[2] for r in rows if r[1] == "a" and r[2] is not None], list(PROBS.values()))), abs=1e-12)


def test_values_are_not_shuffled(spark, monkeypatch):
    """Of many rows only counts, and the rows of the sought intervals, leave their tasks."""
    spark.conf.set(SELECT_ROWS, "1000")
    seen, plain = [], selection._picked

    def watched(groups, cuts, sought):
        seen.append(sum(n for n, _ in sought.values()))
        return plain(groups, cuts, sought)

    monkeypatch.setattr(selection, "_picked", watched)
    try:
        df = spark.range(200_000).selectExpr("id AS transaction_id", "id % 4 AS k", "cast(hash(id) AS double) AS v")
        box = rows_by(profile.box_summary(df, "k", "v"), "k", "q1", "median", "q3")
    finally:
        spark.conf.unset(SELECT_ROWS)
    given = df.toPandas()
    for k, q in box.items():
        assert q == pytest.approx(tuple(np.quantile(given.v[given.k == k], [0.25, 0.5, 0.75])))
    assert seen and max(seen) < 200_000 / 8


def test_describe_by_counting(spark, by_counting):
    rows = values(400)
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = {(r["column"], r["statistic"]): r["value"] for r in profile.describe(df, ["v", "id"]).collect()}
    for c, i in (("v", 2), ("id", 0)):
        held = [r[i] for r in rows if r[i] is not None]
        assert [got[c, p] for p in ("25%", "50%", "75%")] == pytest.approx(np.quantile(held, [0.25, 0.5, 0.75]).tolist(), abs=1e-12)
