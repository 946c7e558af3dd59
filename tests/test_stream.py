import datetime as dt
import random

import pytest
from conftest import T0, rows_by
from pyspark.sql import functions as F

from tallyward.operators.features import device_features, device_state
from tallyward.operators.prep import Preprocessor
from tallyward.operators.learn import RiskModel
from tallyward.operators.scoring import latest_labels, recent_results, result
from tallyward.sources.codecs import (
    decode_labels,
    decode_state,
    decode_transactions,
    encode_state,
    encode_transactions,
    label_events,
    result_events,
)
from tallyward.operators.features import device_set_sketches, device_sets, merged_set_sizes
from tallyward.sources.schema import FEATURES, LABEL, TRANSACTION
from tallyward.streaming import job
from tallyward.streaming.sources import file_stream, label_files, transaction_files

SCORER = job.linear_scorer({"txn_count": 0.1, "device_fraud_rate": 2.0}, -0.5)


def write(df, schema, path):
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    df.select(*cols).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, seeds=None, labels=True, per_trigger=None, scorer=SCORER):
    txns = transaction_files(spark, f"{tmp}/txns", per_trigger)
    labs = label_files(spark, f"{tmp}/labels", per_trigger) if labels else None
    job.run_stream(txns, labs, scorer, f"{tmp}/out", f"{tmp}/check", seeds=seeds, delay="2 days").awaitTermination()


def random_txns(make, n=60, seed=8):
    rnd = random.Random(seed)
    return make([(f"t{i:03d}", rnd.choice("aabc"), i * 50 + rnd.randrange(40), rnd.randrange(1, 900) / 4, rnd.choice(["web", "web", "app", None]), rnd.choice([1, 1, 2, None]), int(rnd.random() < 0.4)) for i in range(n)])


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_one_transaction_then_its_label(make, spark, tmp_path):
    txn = make([("t1", "device-a", 86400, 80.0, "web", 41.5, 1)])
    write(txn, TRANSACTION, f"{tmp_path}/txns")
    write(label_events(txn).limit(0), LABEL, f"{tmp_path}/labels")
    run(spark, tmp_path)
    rows = job.results(spark, f"{tmp_path}/out").collect()
    assert [(r["transaction_id"], r["txn_count"]) for r in rows] == [("t1", 1)]
    rec = job.record(spark, f"{tmp_path}/out", "t1").first()
    assert rec["true_label"] is None and rec["predicted_class"] in (0, 1) and 0 < rec["fraud_probability"] < 1
    write(label_events(txn), LABEL, f"{tmp_path}/labels")
    second = make([("t2", "device-a", 86500, 30.0, "web", 41.5, 0)])
    run(spark, tmp_path)
    assert job.record(spark, f"{tmp_path}/out", "t1").first()["true_label"] == 1
    write(second, TRANSACTION, f"{tmp_path}/txns")
    run(spark, tmp_path)
    rec = job.record(spark, f"{tmp_path}/out", "t2").first()
    assert (rec["txn_count"], rec["device_fraud_rate"], rec["purchase_deviation_from_device_mean"]) == (2, 0.5, 50.0)
    assert job.record(spark, f"{tmp_path}/out", "none").count() == 0
    job.compact(spark, f"{tmp_path}/out")
    assert rows_by(job.records(spark, f"{tmp_path}/out"), "transaction_id", "true_label") == {"t1": 1, "t2": None}


def test_stream_equals_windows_over_restarts(make, spark, tmp_path):
    txns = random_txns(make)
    for low, high in ((0, 20), (20, 40), (40, 60)):
        part = txns.where(F.substring("transaction_id", 2, 3).cast("int").between(low, high - 1))
        write(part, TRANSACTION, f"{tmp_path}/txns")
        write(label_events(part), LABEL, f"{tmp_path}/labels")
        if low:  # a re-sent row
            write(txns.where("transaction_id = 't007'"), TRANSACTION, f"{tmp_path}/txns")
        run(spark, tmp_path)
    got = rows_by(job.results(spark, f"{tmp_path}/out"), "transaction_id", *FEATURES)
    same(got, rows_by(device_features(txns, "online", label_events(txns)), "transaction_id", *FEATURES))
    want = rows_by(txns, "transaction_id", "is_fraud")
    assert rows_by(job.records(spark, f"{tmp_path}/out"), "transaction_id", "true_label") == want


def run_by_default(spark, tmp, check="check", per_trigger=1):
    txns, labels = transaction_files(spark, f"{tmp}/txns", per_trigger), label_files(spark, f"{tmp}/labels", per_trigger)
    job.run_stream(txns, labels, SCORER, f"{tmp}/out", f"{tmp}/{check}").awaitTermination()


@pytest.mark.parametrize("days, order", [(1, (0, 1, 2)), (0, (2, 0, 1))])
def test_nothing_is_too_late(make, spark, tmp_path, days, order):
    """Labels a day behind, and files out of order, over several triggers at the default delay."""
    txns = make([(f"t{i:03d}", f"d{i % 3}", 3600 * i, 5.0, "web", 1, i % 2) for i in range(60)])
    labels = label_events(txns).withColumn("arrival_time", F.timestamp_add("DAY", F.lit(days), "arrival_time"))
    for i in order:
        mine = F.floor(F.substring("transaction_id", 2, 3).cast("int") / 20) == i
        write(txns.where(mine), TRANSACTION, f"{tmp_path}/txns")
        write(labels.where(mine), LABEL, f"{tmp_path}/labels")
    run_by_default(spark, tmp_path)
    got = job.records(spark, f"{tmp_path}/out").select("transaction_id", "true_label").collect()
    assert len(got) == 60 and dict(map(tuple, got)) == rows_by(txns, "transaction_id", "is_fraud")


def test_a_new_checkpoint_keeps_older_results(make, spark, tmp_path):
    txns = make([(f"t{i}", "d", i, 5.0, "web", 1, 0) for i in range(8)])
    write(txns.limit(6), TRANSACTION, f"{tmp_path}/txns")
    write(label_events(txns).limit(0), LABEL, f"{tmp_path}/labels")
    run_by_default(spark, tmp_path, "one")
    run_by_default(spark, tmp_path, "two")
    assert job.results(spark, f"{tmp_path}/out").count() == 12


def test_seeded_stream_continues_the_batch(make, spark, tmp_path):
    txns = random_txns(make, 50, 3)
    cut = T0 + dt.timedelta(seconds=1500)
    old, new = txns.where(F.col("purchase_time") < cut), txns.where(F.col("purchase_time") >= cut)
    state = device_state(old, label_events(old))
    state.select("*").write.parquet(f"{tmp_path}/seeds")
    seeds = file_stream(spark, f"{tmp_path}/seeds", spark.read.parquet(f"{tmp_path}/seeds").schema, limit=None)
    write(new, TRANSACTION, f"{tmp_path}/txns")
    write(label_events(new), LABEL, f"{tmp_path}/labels")
    run(spark, tmp_path, seeds)
    got = rows_by(job.results(spark, f"{tmp_path}/out"), "transaction_id", *FEATURES)
    whole = rows_by(device_features(txns, "online", label_events(txns)), "transaction_id", *FEATURES)
    same(got, {k: whole[k] for k in got})
    assert len(got) == new.count()


def test_model_in_the_stream(make, spark, tmp_path):
    txns = random_txns(make, 40, 5)
    feats = device_features(txns, "online", "immediate").select("transaction_id", "is_fraud", *FEATURES)
    prep = Preprocessor().fit(feats)
    model = RiskModel("logistic", "random_undersampling", {"C": 1.0}).fit(prep.transform(feats), prep.feature_names)
    write(txns, TRANSACTION, f"{tmp_path}/txns")
    write(label_events(txns), LABEL, f"{tmp_path}/labels")
    run(spark, tmp_path, scorer=job.model_scorer(prep, model))
    got = rows_by(job.results(spark, f"{tmp_path}/out"), "transaction_id", "fraud_probability")
    want = rows_by(model.predict(prep.transform(feats)), "transaction_id", "fraud_probability")
    same(got, want)


def test_text_events(make, spark):
    txns = make([("t1", "d", 1, 2.5, "web", 5, 0)]).withColumns({"browser": F.lit("chrome"), "sex": F.lit("M"), "age": F.lit(30)})
    back = decode_transactions(encode_transactions(txns), "value").first()
    assert (back["purchase_value"], back["age"], back["purchase_time"]) == (2.5, 30, txns.first()["purchase_time"])
    labels = spark.createDataFrame([("t1", "d", "0", "2025-01-01T12:00:00"), ("t2", "d", "1", None)], "transaction_id string, device_id string, is_fraud string, arrival_time string")
    decoded = decode_labels(labels)
    assert rows_by(decoded, "transaction_id", "is_fraud") == {"t1": 0, "t2": 1}
    assert rows_by(device_state(txns, decoded.where("transaction_id = 't1'")), "device_id", "fraud_count") == {"d": 0}


def test_state_as_text(make):
    txns = random_txns(make, 20)
    state = device_sets(txns, device_state(txns)).select("device_id", "part", "txn_count", "purchase_sum", "last_transaction", "first_seen", "ip_addresses", "sources", "fraud_count")
    text = encode_state(state)
    assert dict(text.dtypes)["ip_addresses"] == "string"
    assert sorted(decode_state(text).collect()) == sorted(state.collect())


def test_large_sets_come_back_whole(make, tiny_groups):
    txns = make([(f"t{i:05d}", "big" if i % 5 else f"d{i % 7}", i, 1.0, f"s{i % 3}", i, 0) for i in range(6200)])
    state = device_sets(txns, device_state(txns), 1000)
    assert state.where("ip_addresses IS NULL OR sources IS NULL").count() == 0 and state.agg(F.max(F.size("ip_addresses"))).first()[0] == 1000
    back = decode_state(encode_state(state))
    members = back.select("device_id", F.explode("ip_addresses").alias("ip")).groupBy("device_id").agg(F.count("ip"), F.countDistinct("ip"))
    assert {r[0]: (r[1], r[2]) for r in members.collect()}["big"] == (4960, 4960)
    assert rows_by(back.where("part = 0"), "device_id", "txn_count")["big"] == 4960
    half = F.col("transaction_id") < "t03000"
    sketches = device_set_sketches(txns.where(half)).unionByName(device_set_sketches(txns.where(~half)))
    sizes = rows_by(merged_set_sizes(sketches), "device_id", "ip_count", "source_count")
    assert sizes["big"][0] == pytest.approx(4960, rel=0.05) and sizes["big"][1] == 3


def log_of(make, spark, tmp_path, compact_after, readers=True):
    """Five deliveries, labels one delivery late, compacted after some of them; the log's folder and the plain answer."""
    txns = random_txns(make, 90, 4)
    write(label_events(txns).limit(0), LABEL, f"{tmp_path}/labels")
    for i in range(6):
        part = txns.where(F.floor((F.unix_micros("purchase_time") - int(T0.timestamp() * 1e6)) / 900_000_000) == i)
        write(part, TRANSACTION, f"{tmp_path}/txns")
        run_by_default(spark, tmp_path)
        if i in compact_after:
            job.compact(spark, f"{tmp_path}/out", readers)
        if i < 5:
            write(label_events(part), LABEL, f"{tmp_path}/labels")
    rest = txns.where(F.floor((F.unix_micros("purchase_time") - int(T0.timestamp() * 1e6)) / 900_000_000) >= 5)
    return f"{tmp_path}/out", txns, {r[0] for r in rest.select("transaction_id").collect()}


@pytest.mark.parametrize("compact_after, readers", [((), True), ((2,), True), ((0, 1, 4), True), ((1, 3, 5), False)])
def test_compacted_log_reads_like_a_plain_one(make, spark, tmp_path, compact_after, readers):
    from pathlib import Path

    path, txns, unlabelled = log_of(make, spark, tmp_path, compact_after, readers)
    want = rows_by(txns, "transaction_id", "is_fraud")
    got = job.records(spark, path).select("transaction_id", "true_label").collect()
    assert len(got) == 90 and dict(map(tuple, got)) == {k: None if k in unlabelled else v for k, v in want.items()}
    assert job.results(spark, path).select("transaction_id").distinct().count() == 90
    ordered = [r[0] for r in txns.orderBy("purchase_time", "transaction_id").select("transaction_id").collect()]
    for k in (1, 7, 40, 200):
        assert [r["transaction_id"] for r in job.latest(spark, path, k).collect()] == ordered[-k:]
    for one in (ordered[0], ordered[50], ordered[-1]):
        assert [(r["transaction_id"], r["true_label"]) for r in job.record(spark, path, one).collect()] == [(one, None if one in unlabelled else want[one])]
    assert job.record(spark, path, "none").count() == 0
    held = {p.name for p in Path(path).glob("log/run=*/batch=*")}
    versions = {p.name for p in Path(path).glob("base/version=*")}
    if compact_after and not readers:
        assert not held and versions == {f"version={len(compact_after)}"}
    elif len(compact_after) == 3:
        assert held and "batch=0" not in held and versions == {"version=2", "version=3"}
    assert job.compact(spark, path) == len(compact_after) + (0 if 5 in compact_after else 1)


def test_a_batch_written_again_after_it_was_compacted_stays_covered(make, spark, tmp_path):
    import shutil
    from pathlib import Path

    path, _, _ = log_of(make, spark, tmp_path, ())
    batch = next(Path(path).glob("log/run=*/batch=0"))
    shutil.copytree(batch, tmp_path / "again")
    job.compact(spark, path, readers=False)
    shutil.copytree(tmp_path / "again", batch)
    assert job.records(spark, path).count() == 90 and job.latest(spark, path, 500).count() == 90


def test_latest_reads_few_batches(make, spark, tmp_path, monkeypatch):
    from tallyward.streaming import log

    path, txns, _ = log_of(make, spark, tmp_path, (2,))
    seen = job.latest(spark, path, 3).inputFiles()
    batches = {f.split("/batch=")[1].split("/")[0] for f in seen if "/batch=" in f}
    assert len(batches) == 1 and not any("/base/" in f for f in seen)
    monkeypatch.setattr(log, "RECENT", 10)
    assert job.latest(spark, path, 90).count() == 90
    assert all("/kind=0/" in f or "/recent/" in f for f in seen)


def test_result_event_cuts_fractions(make, spark):
    scored = spark.createDataFrame(
        [("t", 2, True, False, 1.9, 99999.0, 0.75, 3.9, 0.5, 1, 0.7)],
        f"transaction_id string, {', '.join(f + ' ' + ('long' if f == 'txn_count' else 'boolean' if 'consistency' in f else 'double') for f in FEATURES)}, predicted_class int, fraud_probability double",
    )
    assert tuple(result_events(scored).first()) == ("t", 2, 1, 0, 1, 99999, 3, 0.75, 0.5, 1, 0.7)


def test_reads(make, spark):
    df = make([(i, "d", i, 1.0, "web", 5, 0) for i in range(9)])
    assert [r["transaction_id"] for r in recent_results(df, 3).collect()] == ["6", "7", "8"]
    labels = spark.createDataFrame([("3", 0, T0), ("3", 1, T0 + dt.timedelta(1))], "transaction_id string, is_fraud int, arrival_time timestamp")
    assert rows_by(latest_labels(labels), "transaction_id", "true_label") == {"3": 1}
    assert result(df, labels, "3").first()["true_label"] == 1
    assert result(df, labels, "77").count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import tallyward.__main__ as cli

    monkeypatch.setattr(cli, "get_session", lambda: spark)
    rnd = random.Random(6)
    head = "user_id,signup_time,purchase_time,purchase_value,device_id,source,browser,sex,age,ip_address,is_fraud\n"
    rows = [
        f"{i},2015-01-01 00:00:00,{T0 + dt.timedelta(minutes=i):%Y-%m-%d %H:%M:%S},{rnd.randrange(10, 60) + 40 * (i % 3 == 0)},d{i % 9},SEO,Chrome,M,30,{i % 5}.5,{int(i % 3 == 0)}\n"
        for i in range(120)
    ]
    (tmp_path / "p.csv").write_text(head + "".join(rows))
    monkeypatch.setitem(cli.train.__globals__["GRIDS"], "logistic_regression", {"C": [1.0], "max_iter": [10]})
    cli.main(["train", str(tmp_path / "p.csv"), "--resampling", "random_undersampling", "--initial-rows", "100", "--save", str(tmp_path / "m")])
    from tallyward.sources.files import read_purchases

    fresh = read_purchases(spark, str(tmp_path / "p.csv")).where("user_id >= 100")
    write(fresh, TRANSACTION, f"{tmp_path}/txns")
    write(label_events(fresh), LABEL, f"{tmp_path}/labels")
    cli.main(["score", f"{tmp_path}/txns", f"{tmp_path}/labels", "--model", str(tmp_path / "m"), "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/check", "--seeds"])
    recs = job.records(spark, f"{tmp_path}/out")
    assert recs.count() == 20 and recs.where("true_label is null").count() == 0
    assert recs.agg(F.min("txn_count")).first()[0] > 10  # histories continue from the training run
    one = recs.first()["transaction_id"]
    capsys.readouterr()
    cli.main(["recent", f"{tmp_path}/out", "-k", "3"])
    cli.main(["result", f"{tmp_path}/out", one])
    assert one in capsys.readouterr().out


def test_devices_are_handed_over_as_numbers(spark, make, tmp_path, monkeypatch):
    """Time stamps are converted for each device apart, so none is handed to the fold, nor columns that only snapshots have."""

    seen, one = [], make([("1", 1, 0, 5.0, "a", 1.0, 0)])
    one.drop("user_id", "is_fraud").write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(one.drop("user_id", "is_fraud").schema).parquet(f"{tmp_path}/t")
    grouped = type(one.groupBy("device_id"))
    monkeypatch.setattr(grouped, "applyInPandasWithState", lambda self, *args: seen.append(dict(self._df.dtypes)))
    job.stream_features(stream)
    assert "timestamp" not in seen[0].values() and "txn_count" not in seen[0]


class HeldState:
    """A state that a test keeps."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_devices_are_folded_many_at_a_time(spark, make):
    """One call for all devices of a group, the missing one too: as each device by a call of its own."""
    rnd = random.Random(4)
    rows = [(rnd.choice([0, 0, 1]), f"t{i:03d}", rnd.choice(["a", "b", "c", None]), i * 7 % 50, rnd.random(), rnd.choice(["web", "web", None]), rnd.choice([1.0, 1.0, None]), rnd.randrange(2)) for i in range(90)]
    frame = spark.createDataFrame(rows, "kind int, transaction_id string, device_id string, at long, purchase_value double, source string, ip_address double, is_fraud int").withColumn(
        "event_time", F.timestamp_micros(F.col("at") * 1_000_000)
    ).withColumn("signup_time", F.lit(0).cast("long")).toPandas()

    def fold(pick, parts):
        state, out = HeldState(), []
        for part in parts:
            mine = part[pick(part["device_id"])].reset_index(drop=True)
            out += [tuple(None if v != v else v for v in r) for got in job.fold_devices((0,), iter([mine]), state) for r in got.astype(object).itertuples(index=False)]
        return sorted(out, key=str)

    parts = [frame[:40], frame[40:]]
    alone = [fold(lambda d, x=x: d.isna() if x is None else d == x, parts) for x in ("a", "b", "c", None)]
    whole = fold(lambda d: d.notna() | d.isna(), parts)
    assert len(whole) == 90 and whole == sorted(sum(alone, []), key=str)


def test_state_rows_are_groups_of_devices(make, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "DEVICE_GROUPS", 2)
    txns = make([(f"t{i:03d}", f"d{i % 20}", 50 * i, 5.0 + i % 3, "web", 1, i % 2) for i in range(60)])
    write(txns, TRANSACTION, f"{tmp_path}/txns")
    write(label_events(txns), LABEL, f"{tmp_path}/labels")
    stream = job.run_stream(transaction_files(spark, f"{tmp_path}/txns"), label_files(spark, f"{tmp_path}/labels"), SCORER, f"{tmp_path}/out", f"{tmp_path}/check")
    stream.awaitTermination()
    held = [s["numRowsTotal"] for s in stream.lastProgress["stateOperators"] if "dedupe" not in s["operatorName"].lower()]
    assert held == [2]
    got = rows_by(job.results(spark, f"{tmp_path}/out"), "transaction_id", *FEATURES)
    same(got, rows_by(device_features(txns, "online", label_events(txns)), "transaction_id", *FEATURES))


def test_state_is_on_disk_whatever_the_session_says(make, spark, tmp_path):
    """The stream chooses its state store and makes no empty micro-batch; the session's settings stay."""
    txns, store = random_txns(make), "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(store)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    settings = {**job.STORE, **job.NO_EMPTY_BATCH}
    try:
        spark.conf.set(store, plain)
        before = {k: spark.conf.get(k, None) for k in settings}
        for low, high in ((0, 30), (30, 60)):
            write(txns.where(f"transaction_id >= 't{low:03d}' AND transaction_id < 't{high:03d}'"), TRANSACTION, f"{tmp_path}/txns")
            query = job.run_stream(transaction_files(spark, f"{tmp_path}/txns"), None, SCORER, f"{tmp_path}/out", f"{tmp_path}/check")
            query.awaitTermination()
            operators = query.lastProgress["stateOperators"]
            assert len(operators) == 2 and all(any(m.startswith("rocksdb") for m in o["customMetrics"]) for o in operators)
            assert {k: spark.conf.get(k, None) for k in settings} == before
    finally:
        spark.conf.set(store, held)
    assert sorted(p.name for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()) == ["0", "1"]
    want = rows_by(device_features(txns, "online"), "transaction_id", "txn_count")
    assert rows_by(job.results(spark, f"{tmp_path}/out"), "transaction_id", "txn_count") == want
