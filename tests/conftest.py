import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyward.session import GROUP_ROWS, get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4)
    yield s
    s.stop()


@pytest.fixture
def tiny_groups(spark):
    """Every group larger than three rows is cut."""
    spark.conf.set(GROUP_ROWS, "3")
    yield
    spark.conf.unset(GROUP_ROWS)


T0 = dt.datetime(2025, 1, 1, 12)


@pytest.fixture
def make(spark):
    """Transactions from (id, device, seconds, value, source, ip, is_fraud) tuples."""

    def build(rows):
        data = [
            (str(i), f"u{d}", d, T0, T0 + dt.timedelta(seconds=s), float(v), src, None if ip is None else float(ip), int(y))
            for i, d, s, v, src, ip, y in rows
        ]
        schema = (
            "transaction_id string, user_id string, device_id string, signup_time timestamp, purchase_time timestamp, "
            "purchase_value double, source string, ip_address double, is_fraud int"
        )
        return spark.createDataFrame(data, schema)

    return build


def rows_by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}
