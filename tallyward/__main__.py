"""Command line: train offline, score a stream, read results.

    python -m tallyward train PURCHASES.csv --resampling smote --model logistic_regression --save DIR
    python -m tallyward score TXN_DIR LABEL_DIR --model DIR --out DIR --checkpoint DIR [--seeds]
    python -m tallyward recent OUT_DIR -k 20
    python -m tallyward result OUT_DIR TRANSACTION_ID
"""

from __future__ import annotations

import argparse

from tallyward.operators.learn import MODELS, RiskModel, train
from tallyward.operators.prep import Preprocessor
from tallyward.operators.resample import METHODS
from tallyward.session import get_session
from tallyward.sources.files import read_purchases
from tallyward.streaming import job
from tallyward.streaming.sources import file_stream, label_files, transaction_files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyward")
    sub = top.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train")
    t.add_argument("purchases")
    t.add_argument("--resampling", default="smote", choices=METHODS)
    t.add_argument("--model", default="logistic_regression", help=f"one of {', '.join(MODELS)}")
    t.add_argument("--label", default="is_fraud")
    t.add_argument("--initial-rows", type=int, help="train, report and snapshot on the first rows only; without it, on all")
    t.add_argument("--save")
    s = sub.add_parser("score")
    s.add_argument("transactions")
    s.add_argument("labels")
    s.add_argument("--model", required=True, help="folder written by train --save")
    s.add_argument("--out", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--seeds", action="store_true", help="start from the device snapshot of the training run")
    s.add_argument("--every", help="trigger interval; without it, take what is there and stop")
    s.add_argument("--delay", default=job.REPEATS_WITHIN, help="how long after an event a repeat of it is known as one")
    r = sub.add_parser("recent")
    r.add_argument("out")
    r.add_argument("-k", type=int, default=20)
    o = sub.add_parser("result")
    o.add_argument("out")
    o.add_argument("transaction_id")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = get_session()
    if a.command == "train":
        run = train(read_purchases(spark, a.purchases, a.label), a.resampling, a.model, save_to=a.save, initial_rows=a.initial_rows)
        run.report.show(truncate=False)
    elif a.command == "score":
        prep, model = Preprocessor.load(spark, f"{a.model}/preprocessor"), RiskModel.load(spark, f"{a.model}/classifier")
        seeds = None
        if a.seeds:
            path = f"{a.model}/device_state"
            seeds = file_stream(spark, path, spark.read.parquet(path).schema, limit=None)
        txns, labels = transaction_files(spark, a.transactions), label_files(spark, a.labels)
        job.run_stream(txns, labels, job.model_scorer(prep, model), a.out, a.checkpoint, seeds, a.delay, a.every).awaitTermination()
    elif a.command == "recent":
        job.latest(spark, a.out, a.k).show(a.k, truncate=False)
    else:
        job.record(spark, a.out, a.transaction_id).show(truncate=False)


if __name__ == "__main__":
    main()
