"""The online scorer as one Structured Streaming query.

Transactions and labels (and, on the first start, device snapshots) are one keyed stream; every
device has a state of constant size, kept with those of its group of devices, and its events are folded in the
order (time, kind, id) within a micro-batch. Results and labels go to the log (``streaming.log``), written once per micro-batch under
its batch id, so a repeated batch replaces itself. The mutable record of a transaction is a view: its
result and its latest label.

How much one group of devices can bring to one task is bounded by the source's per-trigger limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyward.operators.features import NO_PREVIOUS_SECONDS
from tallyward.operators.learn import RiskModel
from tallyward.operators.prep import Preprocessor
from tallyward.operators.scoring import linear_score
from tallyward.session import ROCKSDB
from tallyward.sources.schema import FEATURES
from tallyward.streaming.log import NO_LABEL, OUTPUT, append, compact, latest, record, records, results
from tallyward.streaming.sources import LABELLED, SEED, TXN, tagged_events

__all__ = ["compact", "latest", "record", "records", "results", "run_stream", "stream_features", "linear_scorer", "model_scorer"]

# How long the id of an event is kept to know a repeat by.
REPEATS_WITHIN = "1 day"

# Devices are dealt to this many groups by a hash. A frame to Python costs as much as the events of hundreds of devices, so a group of
# them is folded at once; its state is one value, the devices' states in columns. Fixed for the life of a checkpoint.
DEVICE_GROUPS = 1024

# The ids of all events are state. Spark's default store holds it in the executors' heap and copies it in every micro-batch; this one is on
# disk, and a commit writes what has changed.
_STORE = "spark.sql.streaming.stateStore"
STORE = {f"{_STORE}.providerClass": ROCKSDB, f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true"}
# A stream that ends at what is there needs no empty micro-batch after it, which would only forget old ids.
NO_EMPTY_BATCH = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}

STATE = "devices binary"
_DEVICE_STATE = pa.schema(
    [
        ("device_id", pa.string()), ("txn_count", pa.int64()), ("purchase_sum", pa.float64()), ("met", pa.bool_()), ("last_us", pa.int64()), ("first_us", pa.int64()),
        ("ip", pa.float64()), ("ip_mixed", pa.bool_()), ("source", pa.string()), ("source_mixed", pa.bool_()), ("fraud_count", pa.int64()),
    ]
)
_OF_SEEDS = ("txn_count", "purchase_sum", "last_transaction", "first_seen", "ip_mixed", "source_mixed", "fraud_count")
_NO_TIME = int(np.iinfo("int64").min)
_COLUMNS = [c.split(" ")[0] for c in OUTPUT.split(", ")]
_FEATURE_COLUMNS = _COLUMNS[5:]
_FEATURE_TYPES = [{"bigint": "int64", "boolean": "bool", "double": "float64"}[c.split(" ")[1]] for c in OUTPUT.split(", ")[5:]]


def _numbered(name: str, kind: str) -> Column:
    """Times as microseconds, a missing one as numpy writes it."""
    return F.coalesce(F.unix_micros(name), F.lit(_NO_TIME)).alias(name) if kind == "timestamp" else F.col(name)


def _opened(state: GroupState) -> dict[str, np.ndarray]:
    """The columns of a group's state, to be written to; no rows at first."""
    table = pa.ipc.open_stream(bytes(state.get[0])).read_all() if state.exists else _DEVICE_STATE.empty_table()
    return {n: np.array(c.to_numpy()) for n, c in zip(table.column_names, table.columns)}


def _closed(s: dict[str, np.ndarray]) -> bytes:
    table, sink = pa.table([pa.array(s[f.name], f.type, from_pandas=f.name in ("device_id", "source")) for f in _DEVICE_STATE], schema=_DEVICE_STATE), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DEVICE_STATE) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _placed(s: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The place of each row's device in the state; devices not seen before are added to it, a missing id being one."""
    codes, names = pd.factorize(ids)
    names = np.append(np.asarray(names, dtype=object), None)
    held = {None if pd.isna(d) else d: i for i, d in enumerate(s["device_id"])}
    used = names if (codes < 0).any() else names[:-1]
    fresh = [d for d in used if d not in held]
    held.update(zip(fresh, range(len(held), len(held) + len(fresh))))
    blank = {"device_id": np.array(fresh, dtype=object), "ip": np.full(len(fresh), np.nan), "source": np.full(len(fresh), None, dtype=object)}
    for n, column in s.items():
        s[n] = np.concatenate((column, blank.get(n, np.zeros(len(fresh), dtype=column.dtype))))
    return np.array([held.get(d, -1) for d in names], dtype=np.int64)[codes]


def _in_order(device: np.ndarray, kind: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the rows by device and (snapshots first, time, kind, id), missing times and ids last."""
    known = ~pd.isna(ids)
    order = np.flatnonzero(known)
    order = np.concatenate((order[np.argsort(ids[known], kind="stable")], np.flatnonzero(~known)))
    return order[np.lexsort((kind[order], at[order], at[order] == _NO_TIME, kind[order] != SEED, device[order]))]


def _take_seeds(s: dict[str, np.ndarray], rows: pd.DataFrame, device: np.ndarray, kind: np.ndarray, order: np.ndarray) -> None:
    """Devices without transactions start from the last of their snapshots."""
    seeds = np.flatnonzero(kind == SEED)
    last = seeds[np.append(device[seeds][1:] != device[seeds][:-1], True)]
    last = last[s["txn_count"][device[last]] == 0]
    columns = {n: rows[n].to_numpy() for n in (*_OF_SEEDS, "ip_address", "source")}
    for d, i in zip(device[last], order[last]):
        of = {n: c[i] for n, c in columns.items()}
        s["txn_count"][d], s["purchase_sum"][d] = int(of["txn_count"]), float(of["purchase_sum"])
        s["fraud_count"][d] += int(of["fraud_count"])
        s["met"][d], s["last_us"][d], s["first_us"][d] = True, int(of["last_transaction"]), int(of["first_seen"])
        s["ip"][d], s["ip_mixed"][d] = (np.nan if pd.isna(of["ip_address"]) else of["ip_address"]), bool(of["ip_mixed"])
        s["source"][d], s["source_mixed"][d] = (None if pd.isna(of["source"]) else of["source"]), bool(of["source_mixed"])


def _so_far(values: np.ndarray, starts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Running counts of a flag within each run."""
    counts = np.cumsum(values)
    return counts - np.repeat(counts[starts] - values[starts], runs)


def _agrees(s: dict[str, np.ndarray], name: str, values: np.ndarray, starts: np.ndarray, runs: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Whether all members up to each row are one and the same, a missing value being a member too; the state follows."""
    first = np.where(s["txn_count"][mine] == 0, values[starts], s[name][mine])
    gone, each = np.repeat(pd.isna(first), runs), np.repeat(first, runs)
    same = np.where(gone, pd.isna(values), np.asarray(values == each, dtype=bool))
    same = (_so_far((~same).astype(np.int64), starts, runs) == 0) & ~np.repeat(s[f"{name}_mixed"][mine], runs)
    s[name][mine] = first
    s[f"{name}_mixed"][mine] = ~same[starts + runs - 1]
    return same


def _runs(device: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of each device begin, and how many they are."""
    starts = np.flatnonzero(np.append(True, device[1:] != device[:-1])) if len(device) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.append(starts, len(device)))


def fold_devices(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Features of the new transactions of a group of devices, and the devices' states after all their new events."""
    frames = list(batches)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    s = _opened(state)
    device = _placed(s, rows["device_id"].to_numpy(object))
    kind, ids = rows["kind"].to_numpy(), rows["transaction_id"].to_numpy(object)
    when = rows["event_time"].to_numpy().view("datetime64[us]")
    order = _in_order(device, kind, when.view("int64"), ids)
    device, kind, ids, when = device[order], kind[order], ids[order], when[order]
    if (kind == SEED).any():
        _take_seeds(s, rows, device, kind, order)

    said = rows["is_fraud"].to_numpy(float, na_value=np.nan)[order]
    # a label never precedes itself, so "up to" is "before" for transactions
    starts, runs = _runs(device)
    known = np.repeat(s["fraud_count"][device[starts]], runs) + _so_far(((kind == LABELLED) & (said == 1)).astype(np.int64), starts, runs)
    s["fraud_count"][device[starts]] = known[starts + runs - 1]
    txns, labels = np.flatnonzero(kind == TXN), np.flatnonzero(kind == LABELLED)
    size, blank = len(txns), np.zeros(len(labels))
    made = [np.zeros(0)] * len(_FEATURE_COLUMNS)
    if size:
        starts, runs = _runs(device[txns])
        mine = device[txns][starts]
        at, of, met = when.view("int64")[txns], order[txns], s["met"][mine]
        value = np.nan_to_num(rows["purchase_value"].to_numpy(float, na_value=np.nan)[of], nan=0.0, posinf=np.inf, neginf=-np.inf)
        before = np.arange(size) + np.repeat(s["txn_count"][mine] - starts, runs)
        sums = np.zeros(size + 1)
        for a, b in zip(starts, starts + runs):  # each device's sum starts anew, so it does not depend on the others
            np.cumsum(value[a:b], out=sums[a + 1 : b + 1])
        sums, through = sums[:-1].copy(), sums[starts + runs]
        sums[starts] = 0.0
        sums += np.repeat(s["purchase_sum"][mine], runs)
        previous = np.append(at[:1], at[:-1])
        previous[starts] = np.where(met, s["last_us"][mine], at[starts])
        since = (at - previous) / 1e6
        since[starts[~met]] = NO_PREVIOUS_SECONDS
        s["first_us"][mine] = np.where(met, s["first_us"][mine], at[starts])
        made = {
            "txn_count": before + 1,
            "device_ip_consistency": _agrees(s, "ip", rows["ip_address"].to_numpy(float, na_value=np.nan)[of], starts, runs, mine),
            "device_source_consistency": _agrees(s, "source", rows["source"].to_numpy(object)[of], starts, runs, mine),
            "time_setup_to_txn_seconds": (at - rows["signup_time"].to_numpy()[of]) / 1e6,
            "time_since_last_device_txn": since,
            "purchase_deviation_from_device_mean": np.where(before > 0, np.abs(value - sums / np.maximum(before, 1)), 0.0),
            "device_lifespan": (at - np.repeat(s["first_us"][mine], runs)) / 1e6,
            "device_fraud_rate": known[txns] / (before + 1),
        }
        s["txn_count"][mine] += runs
        s["purchase_sum"][mine] += through
        s["last_us"][mine], s["met"][mine] = at[starts + runs - 1], True
        made = [made[f] for f in _FEATURE_COLUMNS]
    if size or len(labels):
        both = np.concatenate((txns, labels))
        label = np.concatenate((np.full(size, NO_LABEL), np.nan_to_num(said[labels], nan=NO_LABEL)))
        # one frame of the columns of OUTPUT; a label's features are blank
        columns = [kind[both].astype("int32"), ids[both], s["device_id"][device[both]], when[both], label.astype("int32")]
        columns += [np.concatenate((m, blank)).astype(t) for m, t in zip(made, _FEATURE_TYPES)]
        yield pd.DataFrame(dict(zip(_COLUMNS, columns)), copy=False)
    state.update((_closed(s),))


def stream_features(
    txns: DataFrame,
    labels: DataFrame | None = None,
    seeds: DataFrame | None = None,
    delay: str = REPEATS_WITHIN,
) -> DataFrame:
    """Feature rows (kind 0) and label rows (kind 1, features blank) as the stream delivers them.

    An event is folded when it arrives, however late or out of order. One whose (id, kind) has arrived before
    is dropped if that was within ``delay`` by the clock of the trigger. The watermark is on that clock, the
    same for every input and never behind, so no event is too late for it; ids older than it are forgotten.
    """
    events = tagged_events(txns, labels, seeds).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    events = events.dropDuplicatesWithinWatermark(["transaction_id", "kind"]).drop("arrived")
    # a group's frame is made column by column: times go as numbers, and columns of snapshots only where there are some
    events = events.select(*[_numbered(c, t) for c, t in events.dtypes if seeds is not None or c not in _OF_SEEDS])
    events = events.withColumn("device_group", F.pmod(F.xxhash64("device_id"), F.lit(DEVICE_GROUPS)).cast("int"))
    return events.groupBy("device_group").applyInPandasWithState(fold_devices, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: dict[str, float], intercept: float) -> Scorer:
    return lambda df: linear_score(df, weights, intercept)


def model_scorer(prep: Preprocessor, model: RiskModel) -> Scorer:
    """Scale and classify, keeping the raw features next to the score."""
    score = "fraud_margin" if model.model_type == "svc" else "fraud_probability"

    def apply(df: DataFrame) -> DataFrame:
        raw = df.select(F.struct("*").alias("__raw"), *FEATURES)
        ready = Preprocessor(prep.label, ("__raw",), prep.drop_first, prep.numeric, prep.categories, prep.booleans, True)
        out = model.predict(ready.transform(raw))
        return out.select("__raw.*", "predicted_class", F.col(score).alias("fraud_probability"))

    return apply


def _run_of(batch: DataFrame) -> str:
    """The id kept in the stream's checkpoint: the same after a restart, another one for a new checkpoint."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise ValueError("a micro-batch is written by the stream that brought it")
    return run


def write_batch(batch: DataFrame, batch_id: int, path: str, scorer: Scorer) -> None:
    append(scorer(batch), _run_of(batch), batch_id, path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream starts, which takes a copy of them; then as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_stream(
    txns: DataFrame,
    labels: DataFrame | None,
    scorer: Scorer,
    path: str,
    checkpoint: str,
    seeds: DataFrame | None = None,
    delay: str = REPEATS_WITHIN,
    every: str | None = None,
) -> StreamingQuery:
    """Start the scorer; with ``every`` None it takes what is there and stops.

    A restart continues from ``checkpoint``: neither events nor state are applied twice. A new checkpoint
    adds to the log of ``path`` and leaves what older ones wrote. State is kept on disk, whatever the session's
    own state store is; a checkpoint continues with the store that it began with.
    """
    feats = stream_features(txns, labels, seeds, delay)
    writer = feats.writeStream.foreachBatch(lambda b, i: write_batch(b, i, path, scorer)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    with _settings(txns.sparkSession, STORE if every else STORE | NO_EMPTY_BATCH):
        return writer.start()
