import datetime as dt
import random

import pytest
from conftest import T0, rows_by
from pyspark.sql import functions as F

from tallyward.operators import features as ft
from tallyward.sources.codecs import label_events
from tallyward.sources.schema import FEATURES


def twin(rows, mode, labels="immediate"):
    """The features by walking the rows one at a time."""
    state, out = {}, {}
    for i, d, s, v, src, ip, y in sorted(rows, key=lambda r: (r[2], str(r[0]))):
        st = state.setdefault(d, {"n": 0, "sum": 0.0, "last": None, "first": None, "ips": set(), "srcs": set(), "frauds": 0})
        n = st["n"]
        out[str(i)] = (
            n + 1 if mode == "online" else max(n, 1),
            st["ips"] in (set(), {ip}),
            st["srcs"] in (set(), {src}),
            float(s),
            99999.0 if st["last"] is None else float(s - st["last"]),
            0.0 if n == 0 else abs(v - st["sum"] / n),
            0.0 if st["first"] is None else float(s - st["first"]),
            0.0 if labels is None else st["frauds"] / (n + 1) if mode == "online" else (st["frauds"] / n if n else 0.0),
        )
        st["n"] += 1
        st["sum"] += v
        st["last"], st["first"] = s, s if st["first"] is None else st["first"]
        st["ips"].add(ip)
        st["srcs"].add(src)
        st["frauds"] += y
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def random_rows(seed, n=200):
    rnd = random.Random(seed)
    hot = ["hot"] * 6 + [f"d{i}" for i in range(6)]
    return [
        (f"t{i:04d}", rnd.choice(hot), rnd.randrange(0, 400), rnd.randrange(1, 10_000) / 4, rnd.choice(["a", "b", "a", None]),
         rnd.choice([1, 1, 1, 2, None]), int(rnd.random() < 0.3))
        for i in range(n)
    ]


@pytest.mark.parametrize("mode", ["online", "offline"])
@pytest.mark.parametrize("seed", [1, 2])
def test_row_at_a_time_twin(make, mode, seed):
    rows = random_rows(seed)
    close(rows_by(ft.device_features(make(rows), mode, "immediate"), "transaction_id", *FEATURES), twin(rows, mode))


@pytest.mark.parametrize("mode", ["online", "offline"])
def test_twin_with_cut_groups(make, tiny_groups, mode):
    rows = random_rows(3, 120)
    close(rows_by(ft.device_features(make(rows), mode, "immediate"), "transaction_id", *FEATURES), twin(rows, mode))


def test_first_transaction(make):
    got = rows_by(ft.device_features(make([(1, "d", 60, 100.0, "web", 5, 0)])), "transaction_id", *FEATURES)
    assert got == {"1": (1, True, True, 60.0, 99999.0, 0.0, 0.0, 0.0)}


def test_counts_by_mode(make):
    df = make([(i, "d", i, 1.0, "web", 5, 0) for i in (1, 2, 3)])
    count = lambda mode: sorted(r[0] for r in ft.device_features(df, mode).select("txn_count").collect())
    assert count("offline") == [1, 1, 2]
    assert count("online") == [1, 2, 3]


def test_fraud_rate_by_mode(make):
    df = make([(1, "d", 1, 1.0, "web", 5, 1), (2, "d", 2, 1.0, "web", 5, 0)])
    assert rows_by(ft.device_features(df, "offline", "immediate"), "transaction_id", "device_fraud_rate")["2"] == 1.0
    assert rows_by(ft.device_features(df, "online", "immediate"), "transaction_id", "device_fraud_rate")["2"] == 0.5
    assert rows_by(ft.device_features(df, "online", None), "transaction_id", "device_fraud_rate")["2"] == 0.0


def test_consistency_never_recovers(make):
    df = make([(1, "d", 1, 1.0, "web", 5, 0), (2, "d", 2, 1.0, "web", 6, 0), (3, "d", 3, 1.0, "web", 5, 0)])
    assert rows_by(ft.device_features(df), "transaction_id", "device_ip_consistency") == {"1": True, "2": False, "3": False}


@pytest.mark.parametrize("ips", [(None, 5), (5, None)])
def test_null_is_a_member(make, ips):
    df = make([(i, "d", i, 1.0, "web", ip, 0) for i, ip in enumerate(ips)])
    assert rows_by(ft.device_features(df), "transaction_id", "device_ip_consistency") == {"0": True, "1": False}


def test_equal_times_go_by_id_and_hide_the_label(make):
    df = make([(1, "d", 5, 1.0, "web", 5, 1), (2, "d", 5, 1.0, "web", 5, 0)])
    got = rows_by(ft.device_features(df, "online", label_events(df)), "transaction_id", "txn_count", "device_fraud_rate")
    assert got == {"1": (1, 0.0), "2": (2, 0.0)}


@pytest.mark.parametrize("cut", [False, True])
def test_delayed_labels(make, spark, cut, request):
    if cut:
        request.getfixturevalue("tiny_groups")
    day = 86400
    df = make([(i, "d", i * day, 1.0, "web", 5, 1) for i in range(6)])
    got = rows_by(ft.device_features(df, "online", label_events(df, 1.5)), "transaction_id", "device_fraud_rate")
    # A label is known two purchases later.
    assert got == pytest.approx({str(i): max(0, i - 1) / (i + 1) for i in range(6)})


def test_gap_rules(make):
    df = make([(1, "d", 0, 1.0, "web", 5, 0), (2, "d", 2 * 86400 + 5, 1.0, "web", 5, 0)])
    assert rows_by(ft.purchase_gap(df), "transaction_id", "time_diff_device_id") == {"1": None, "2": 172805.0}
    assert rows_by(ft.purchase_gap(df, within_day=True), "transaction_id", "time_diff_device_id") == {"1": None, "2": 5.0}


def test_recent_count_with_cut_groups(make, spark):
    rows = [(i, "hot" if i % 3 else f"d{i % 4}", (i * 37) % 500, 1.0, "web", 5, 0) for i in range(90)]
    want = rows_by(ft.recent_count(make(rows), seconds=60), "transaction_id", "txns_last_60s")
    spark.conf.set("spark.tallyward.groupRows", "3")
    try:
        got = rows_by(ft.recent_count(make(rows), seconds=60), "transaction_id", "txns_last_60s")
    finally:
        spark.conf.unset("spark.tallyward.groupRows")
    brute = {str(r[0]): sum(q[1] == r[1] and r[2] - 60 <= q[2] <= r[2] for q in rows) for r in rows}
    assert got == want == brute


def test_state_and_members(make):
    df = make([(1, "d", 0, 1.5, "web", 5, 0), (2, "d", 9, 2.0, "app", None, 1), (3, "e", 4, 7.0, "web", 6, 0)])
    state = rows_by(ft.device_state(df, label_events(df)), "device_id", "txn_count", "purchase_sum", "ip_mixed", "ip_null", "source_mixed", "fraud_count", "last_transaction")
    assert state["d"][:6] == (2, 3.5, True, True, True, 1)
    assert state["e"][:6] == (1, 7.0, False, False, False, 0)
    assert state["d"][6].replace(tzinfo=None) - state["e"][6].replace(tzinfo=None) == dt.timedelta(seconds=5)
    sets = rows_by(ft.device_sets(df, ft.device_state(df)), "device_id", "sources", "ip_count")
    assert sets == {"d": (["app", "web"], 2), "e": (["web"], 1)}
    parts = {(r["device_id"], r["part"]): (r["sources"], r["source_count"]) for r in ft.device_sets(df, ft.device_state(df), 1).collect()}
    assert {k: v for k, v in parts.items() if v[0]} == {("d", 0): (["app"], 2), ("d", 1): (["web"], 2), ("e", 0): (["web"], 1)}
    assert ft.device_members(df, "ip_address").count() == 3


def test_value_features_of_single_rows(make):
    df = make([(1, "d", 0, 5.0, "web", 5, 0), (2, "e", 0, 1.0, "web", 5, 0), (3, "e", 1, 1.0, "web", 5, 0)])
    got = rows_by(ft.device_value_features(df), "transaction_id", "purchase_std_by_device", "purchase_zscore_by_device", "is_unique_device")
    assert got["1"] == (None, None, True)
    assert got["2"] == (0.0, None, False)


def test_gap_imputation(make):
    df = ft.purchase_gap(make([(1, "d", 0, 5.0, "web", 5, 0), (2, "d", 10, 1.0, "web", 5, 0), (3, "d", 40, 1.0, "web", 5, 0)]), name="gap")
    assert rows_by(ft.imputed_gap(df, "gap"), "transaction_id", "gap_imputed")["1"] == 20.0
    assert rows_by(ft.imputed_gap(df, "gap", "max"), "transaction_id", "gap_imputed")["1"] == 30.0
    with pytest.raises(ValueError):
        ft.imputed_gap(df, "gap", "mode")


def test_sub_second_gap_keeps_its_fraction(spark, make):
    df = make([(1, "d", 0, 5.0, "web", 5, 0), (2, "d", 0, 1.0, "web", 5, 0)])
    df = df.withColumn("purchase_time", F.when(F.col("transaction_id") == "2", F.lit(T0 + dt.timedelta(milliseconds=250))).otherwise(F.col("purchase_time")))
    assert rows_by(ft.device_features(df), "transaction_id", "time_since_last_device_txn")["2"] == 0.25
