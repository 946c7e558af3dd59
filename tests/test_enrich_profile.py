import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from tallyward.functions.columns import age_group, columns_with_prefix, feature_roles, to_number
from tallyward.operators import entities, profile
from tallyward.operators.enrich import (
    add_gdp,
    add_gdp_imputed,
    alias_table,
    country_risk_features,
    ip_to_country,
    overlapping_ranges,
)
from tallyward.session import BROADCAST_ROWS
from tallyward.sources.files import materialize, read_ip_ranges, read_purchases, year_values

RANGES = [(10.0, 19.0, "A"), (20.0, 20.0, "B"), (30.0, 1000.0, "C")]
IPS = [(1, 10.0), (2, 19.0), (3, 19.5), (4, 5.0), (5, 2000.0), (6, None), (7, 20.0), (8, 999.25)]
WANT = {1: "A", 2: "A", 3: None, 4: None, 5: None, 6: None, 7: "B", 8: "C"}


def ranges(spark, rows=RANGES):
    return spark.createDataFrame(rows, "lower double, upper double, country string")


@pytest.mark.parametrize("method", ["auto", "broadcast", "bucketed", "sorted"])
def test_range_join(spark, method):
    txns = spark.createDataFrame(IPS, "transaction_id int, ip_address double")
    assert rows_by(ip_to_country(txns, ranges(spark), method), "transaction_id", "country") == WANT


@pytest.mark.parametrize("method", ["bucketed", "sorted", "auto"])
def test_range_join_cut_and_not_broadcast(spark, tiny_groups, method):
    spark.conf.set(BROADCAST_ROWS, "1")
    try:
        txns = spark.createDataFrame([(i, ip) for i, (_, ip) in enumerate(IPS * 5)], "transaction_id int, ip_address double")
        got = rows_by(ip_to_country(txns, ranges(spark), method), "transaction_id", "country")
    finally:
        spark.conf.unset(BROADCAST_ROWS)
    assert got == {i: WANT[k] for i, (k, _) in enumerate(IPS * 5)}


def test_overlaps_are_reported(spark):
    assert overlapping_ranges(ranges(spark)).count() == 0
    bad = ranges(spark, [*RANGES, (500.0, 600.0, "D"), (1000.0, 1001.0, "E"), (1002.0, 1003.0, "F")])
    assert sorted(r["country"] for r in overlapping_ranges(bad).collect()) == ["D", "E"]


def test_gdp_rules(spark):
    gdp = spark.createDataFrame([("known", 4.0), ("empty", None), ("other", 8.0)], "country string, gdp double")
    txns = spark.createDataFrame([(i, c) for i, c in enumerate(["known", "empty", "aka", "lost", "unknown", None])], "transaction_id int, country string")
    aliases = alias_table(spark, {"aka": "other", "lost": "nowhere"})
    got = rows_by(add_gdp_imputed(txns, gdp, aliases), "transaction_id", "gdp")
    assert got == {0: 4.0, 1: None, 2: 8.0, 3: None, 4: 6.0, 5: 6.0}
    got = rows_by(add_gdp_imputed(txns, gdp, aliases, exclude=("other",)), "transaction_id", "gdp")
    assert got[4] == 4.0
    assert rows_by(add_gdp(txns, gdp), "transaction_id", "gdp")[2] is None


def test_year_sheet(spark):
    sheet = spark.createDataFrame([(2014.0, 1.0, 2.0), (2015.0, 3.0, None)], "year double, `A, Rep.` double, B double")
    assert rows_by(year_values(sheet, 2015), "country", "gdp") == {"A, Rep.": 3.0, "B": None}


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "user_id,signup_time,purchase_time,purchase_value,device_id,source,browser,sex,age,ip_address,class\n"
        "7,2021-01-02 03:04:05,2021-03-04 05:06:07,12,device-a,web,Browser,F,50,1234.5,1\n"
    )
    row = read_purchases(spark, str(tmp_path / "p.csv"), "class").first()
    assert (row["purchase_value"], row["age"], row["is_fraud"], row["ip_address"]) == (12.0, 50, 1, 1234.5)
    assert row["purchase_time"].year == 2021 and len(row["transaction_id"]) == 32
    (tmp_path / "r.csv").write_text("lower_bound_ip_address,upper_bound_ip_address,country\n1,2,X\n")
    assert tuple(read_ip_ranges(spark, str(tmp_path / "r.csv")).first()) == (1.0, 2.0, "X")
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert materialize(spark, str(tmp_path / "t"), build).count() == 3
    assert len(built) == 1


def test_null_keys(spark):
    df = spark.createDataFrame([("A", 1), ("A", 0), (None, 1)], "country string, is_fraud int")
    assert rows_by(profile.risk_table(df, "country"), "country", "transactions", "fraud_rate") == {"A": (2, 0.5)}
    share = profile.value_counts(df, "country", normalize=True, keep_null=True)
    assert rows_by(share, "country", "share") == pytest.approx({"A": 2 / 3, None: 1 / 3})
    txns = df.withColumn("transaction_id", F.monotonically_increasing_id())
    assert {r["is_high_risk_country"] for r in country_risk_features(txns).collect()} == {True, None}


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (4.0, 5.0, 3.0)], "x double, c double, n double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation(df, ["x", "c", "n"]).collect()}
    assert got[("x", "c")] is None and got[("c", "x")] is None
    assert got[("x", "n")] == pytest.approx(1.0)
    pairs = profile.correlated_pairs(profile.correlation(df, ["x", "c", "n"]), ["x", "c", "n"])
    assert [(r["a"], r["b"], r["bin"]) for r in pairs.collect()] == [("x", "n", "0.9-1")]


def test_age_groups(spark):
    df = spark.createDataFrame([(a,) for a in (18, 19, 25, 26, 100, 101, 0)], "age int")
    want = {18: "under_18", 19: "18_25", 25: "18_25", 26: "26_35", 100: "over_65", 101: None, 0: None}
    assert rows_by(df.withColumn("g", age_group()), "age", "g") == want


def test_entity_summary(make):
    df = make([(1, "d", 60, 100.0, "web", 5, 1), (2, "d", 70, 200.0, "web", 6, 0), (3, "e", 5, 7.0, "web", 5, 0)])
    got = rows_by(
        entities.summarize_entity(df, "device_id"), "device_id", "transactions", "frauds", "unique_ips", "mean_purchase_val",
        "purchase_val_std", "median_time_between_signup_and_purchase", "median_time_between_purchase", "fraud_rate",
    )
    assert got["d"] == pytest.approx((2, 1, 2, 150.0, 70.71067811865476, 65.0, 10.0, 0.5))
    assert got["e"] == (1, 0, 1, 7.0, None, 5.0, None, 0.0)
    assert "unique_device_ids" in entities.summarize_entity(df, "ip_address").columns
    with pytest.raises(ValueError):
        entities.summarize_entity(df, "browser")


def test_describe_both_ways(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(1, 10)], "x double, y int")
    exact = {(r["column"], r["statistic"]): r["value"] for r in profile.describe(df).collect()}
    assert exact[("x", "25%")] == 3.0 and exact[("x", "count")] == 9.0 and exact[("y", "max")] == 2.0
    assert len(exact) == 16
    assert len(profile.describe(df, approximate=True).collect()) == 16


def test_small_helpers(spark):
    df = spark.createDataFrame([(True, 1, "12", 0), (None, 2, "x", 1)], "age_ok boolean, age_n int, t string, is_fraud int")
    assert feature_roles(df) == {"numeric": ["age_n"], "categorical": ["t"], "boolean": ["age_ok"]}
    assert columns_with_prefix(df, "age_", ("age_n",)) == ["age_ok"]
    assert [r[0] for r in df.select(to_number("t")).collect()] == [12.0, None]
    with pytest.raises(ValueError):
        profile.sum_by_class(df, "missing")
    assert profile.preview(df, 1).count() == 1
    assert rows_by(profile.schema_table(df), "name", "type")["age_n"] == "int"


def test_nested_and_overlapping_ranges(make, spark, capsys):
    """Every range that holds the address counts; no plan compares each address with each range."""
    rnd = __import__("random").Random(3)
    held = [(float(a := rnd.randrange(60)), float(a + rnd.randrange(12)), f"c{i}") for i in range(40)] + [(5.0, 50.0, "wide"), (20.0, 20.0, "one"), (9.5, 9.25, "empty")]
    r = spark.createDataFrame(held, "lower double, upper double, country string")
    ips = [None if i % 11 == 0 else rnd.choice([20.0, rnd.randrange(80) / 2, -1.0, 75.25]) for i in range(90)]
    txns = make([(i, "d", i, 1.0, "web", ip, 0) for i, ip in enumerate(ips)])
    want = sorted((str(i), c) for i, ip in enumerate(ips) for c in ([c for lo, hi, c in held if ip is not None and lo <= ip <= hi] or [""]))
    for method in ("broadcast", "bucketed"):
        out = ip_to_country(txns, r.where("lower <= upper"), method)
        assert sorted((x["transaction_id"], x["country"] or "") for x in out.collect()) == want
        out.explain()
        assert "NestedLoop" not in capsys.readouterr().out


def test_full_buckets_are_salted(make, spark, tiny_groups):
    from tallyward.session import BROADCAST_ROWS

    spark.conf.set(BROADCAST_ROWS, "2")
    try:
        r = spark.createDataFrame([(10.0 * i, 10.0 * i + 6, f"c{i}") for i in range(8)], "lower double, upper double, country string")
        txns = make([(i, "d", i, 1.0, "web", 33.0 if i % 3 else float(i), 0) for i in range(90)])
        want = {str(i): (lambda ip: f"c{int(ip // 10)}" if ip % 10 <= 6 and ip < 80 else None)(33.0 if i % 3 else float(i)) for i in range(90)}
        assert rows_by(ip_to_country(txns, r, "bucketed"), "transaction_id", "country") == want
    finally:
        spark.conf.unset(BROADCAST_ROWS)
