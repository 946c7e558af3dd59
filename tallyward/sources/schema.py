"""Column types of the inputs and the mapping from a source's own column names."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"  # exact sums, whatever the order of the additions

TRANSACTION = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("signup_time", T.TimestampType()),
        T.StructField("purchase_time", T.TimestampType()),
        T.StructField("purchase_value", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("ip_address", T.DoubleType()),
    ]
)

LABEL = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("is_fraud", T.IntegerType()),
        T.StructField("arrival_time", T.TimestampType()),
    ]
)

# The file form: no transaction id, and the label is part of the row.
PURCHASE_FILE = T.StructType(
    [f for f in TRANSACTION.fields if f.name != "transaction_id"] + [T.StructField("is_fraud", T.IntegerType())]
)

IP_RANGE = T.StructType(
    [
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("country", T.StringType()),
    ]
)

# The eight features in the order the models take them.
FEATURES = [
    "txn_count",
    "device_ip_consistency",
    "device_source_consistency",
    "time_setup_to_txn_seconds",
    "time_since_last_device_txn",
    "purchase_deviation_from_device_mean",
    "device_lifespan",
    "device_fraud_rate",
]


@dataclass(frozen=True)
class Columns:
    """Names the source uses for the engine's columns; None where it has no such column."""

    transaction_id: str | None = "transaction_id"
    user_id: str | None = "user_id"
    device_id: str | None = "device_id"
    signup_time: str | None = "signup_time"
    purchase_time: str | None = "purchase_time"
    purchase_value: str | None = "purchase_value"
    source: str | None = "source"
    browser: str | None = "browser"
    sex: str | None = "sex"
    age: str | None = "age"
    ip_address: str | None = "ip_address"
    country: str | None = None
    is_fraud: str | None = "is_fraud"

    def apply(self, df: DataFrame) -> DataFrame:
        """Select the mapped columns under the engine's names; an absent id becomes a stable hash."""
        picked = []
        for f in fields(self):
            theirs = getattr(self, f.name)
            if theirs is not None and theirs in df.columns:
                picked.append(F.col(theirs).alias(f.name))
        out = df.select(*picked)
        if "transaction_id" not in out.columns:
            out = out.withColumn("transaction_id", row_id(*[c for c in out.columns if c != "is_fraud"]))
        return out


def row_id(*cols: str):
    """A repeatable identifier made of the row's own values."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in cols])))
