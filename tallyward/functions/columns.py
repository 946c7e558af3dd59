"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Right-closed age classes.
AGE_BINS = [
    (0, 18, "under_18"),
    (18, 25, "18_25"),
    (25, 35, "26_35"),
    (35, 50, "36_50"),
    (50, 65, "51_65"),
    (65, 100, "over_65"),
]


def seconds_between(start: str, end: str) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def ratio(top, bottom) -> Column:
    top = F.col(top) if isinstance(top, str) else top
    bottom = F.col(bottom) if isinstance(bottom, str) else bottom
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def mean_of(c: str) -> Column:
    """Mean through the exact sum: an average of decimals would be cut to six places."""
    return ratio(F.sum(c), F.count(c))


def age_group(c: str = "age") -> Column:
    out = F
    for low, high, name in AGE_BINS:
        out = out.when((F.col(c) > low) & (F.col(c) <= high), F.lit(name))
    return out


def log_or_null(c: str) -> Column:
    return F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))


def flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False)).cast("int")


def equals_flag(c: str, value) -> Column:
    return F.coalesce((F.col(c) == F.lit(value)).cast("int"), F.lit(0))


def to_number(c: str) -> Column:
    """Text to number; what is not a number becomes NULL."""
    return F.col(c).try_cast("double")


def with_time_parts(df: DataFrame, c: str = "purchase_time") -> DataFrame:
    """Month, weekday (Monday is 0) and hour."""
    return df.withColumns(
        {
            "purchase_month": F.month(c).cast("long"),
            "purchase_day": F.weekday(c).cast("long"),
            "purchase_hour": F.hour(c).cast("long"),
        }
    )


def month_cycle(month: str) -> tuple[Column, Column]:
    angle = F.col(month) * F.lit(2 * math.pi / 12)
    return F.sin(angle), F.cos(angle)


def columns_with_prefix(df: DataFrame, prefix: str, but: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c not in but]


def feature_roles(df: DataFrame, label: str = "is_fraud", skip: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Columns by role: boolean, numeric, and everything else categorical."""
    roles: dict[str, list[str]] = {"numeric": [], "categorical": [], "boolean": []}
    for f in df.schema.fields:
        if f.name == label or f.name in skip:
            continue
        if isinstance(f.dataType, T.BooleanType):
            roles["boolean"].append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            roles["numeric"].append(f.name)
        else:
            roles["categorical"].append(f.name)
    return roles


def hash_order(seed: int, c: str) -> Column:
    """A repeatable random order."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(c).cast("string")))


def hash_uniform(seed: int, c: str) -> Column:
    """A repeatable number in [0, 1): the first 13 hex digits of the hash."""
    return F.conv(F.substring(hash_order(seed, c), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
