"""Splits and slices by position in time.

A cut position is turned into the key of the row that stands there; the parts are then filters on
that key, so no row is moved to be ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyward.plans.slices import precedes, row_at

TIME_ORDER = ("purchase_time", "transaction_id")


def time_split(
    df: DataFrame,
    train: float = 0.8,
    order: Sequence[str] = TIME_ORDER,
    initial_rows: int | None = None,
    inclusive_end: bool = False,
    size: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The first ``int(train * rows)`` rows and the rest of the first ``initial_rows``.

    ``inclusive_end`` lets the second part keep the row at position ``initial_rows`` as well.
    """
    total = df.count()
    rows = total if initial_rows is None else initial_rows
    cut = row_at(df, order, int(train * rows), size)
    before = precedes(df, order, cut)
    end = None if initial_rows is None else row_at(df, order, rows, size)
    return df.where(before), df.where(~before & precedes(df, order, end, inclusive_end))


def row_slice(df: DataFrame, order: Sequence[str], start: int, length: int = 100, size: int | None = None) -> DataFrame:
    """Rows at positions [start, start + length) of the order."""
    first, end = row_at(df, order, start, size), row_at(df, order, start + length, size)
    if first is None:
        return df.limit(0)
    return df.where(~precedes(df, order, first) & precedes(df, order, end))
