"""The supplied tables read as transactions, IP ranges, economy sheet and points; the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.sources.schema import MONEY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, the SQL that gives the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def size_of(spark: SparkSession, sf: str, name: str) -> int:
    """Row count from the file footers."""
    return table(spark, sf, name).count()


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Event stream as transactions: a user is a device, the event type the source."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id"),
        F.col("user_id").alias("device_id"),
        F.timestamp_add("DAY", (F.col("user_id") % 30).cast("int"), F.lit("2023-12-01").cast("timestamp")).alias("signup_time"),
        F.col("ts").cast("timestamp").alias("purchase_time"),
        F.col("value").cast(MONEY).alias("purchase_value"),
        F.col("event_type").alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("ip_address"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
    )


E = """e AS (
  SELECT event_id AS transaction_id, user_id, user_id AS device_id,
         TIMESTAMP '2023-12-01' + to_days(CAST(user_id % 30 AS INTEGER)) AS signup_time,
         ts AS purchase_time, CAST(value AS DECIMAL(18,2)) AS purchase_value, event_type AS source,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS ip_address,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud
  FROM events)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions: a customer is a device, with segment, country, age and sex stand-ins."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("device_id"),
        F.col("c_nationkey").alias("n_nationkey"),
        F.col("c_mktsegment").alias("browser"),
        F.floor(F.col("c_acctbal") / 100).cast("long").alias("age"),
    )
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        table(spark, sf, "orders")
        .select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_custkey").alias("device_id"),
            F.col("o_orderdate").cast("timestamp").alias("purchase_time"),
            F.col("o_totalprice").cast(MONEY).alias("purchase_value"),
            F.col("o_orderpriority").alias("source"),
            (F.col("o_custkey") % 97).alias("ip_address"),
            F.when(F.col("o_custkey") % 2 == 0, "M").otherwise("F").alias("sex"),
            (F.col("o_orderstatus") == "F").cast("int").alias("is_fraud"),
        )
        .join(customer, "device_id", "left")
        .join(nation, "n_nationkey", "left")
        .drop("n_nationkey")
    )


O = """o AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_custkey AS device_id,
         o_orderdate AS purchase_time, CAST(o_totalprice AS DECIMAL(18,2)) AS purchase_value,
         o_orderpriority AS source, o_custkey % 97 AS ip_address,
         CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_fraud,
         c_mktsegment AS browser, CAST(floor(c_acctbal / 100) AS BIGINT) AS age, n_name AS country
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def ip_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Three addresses of every four belong to a nation; the fourth to none."""
    low = F.col("n_nationkey") * 4
    return table(spark, sf, "nation").select(
        low.cast("double").alias("lower"), (low + 2).cast("double").alias("upper"), F.col("n_name").alias("country")
    )


RANGES = """ranges AS (
  SELECT CAST(4 * n_nationkey AS DOUBLE) AS lower, CAST(4 * n_nationkey + 2 AS DOUBLE) AS upper, n_name AS country
  FROM nation)"""


def gdp_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier balances by nation as an economy sheet: a row per year, a column per country.

    Every fifth nation is missing. The pivot's columns are the nations that have a supplier.
    """
    nation = table(spark, sf, "nation").where(F.col("n_nationkey") % 5 != 0)
    balance = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    names = [r[0] for r in balance.select("n_name").distinct().orderBy("n_name").limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("a sheet with a column per country holds at most 10,000 countries")
    return (
        balance.select("n_name", F.col("s_acctbal").cast(MONEY).alias("b"), F.explode(F.array(F.lit(2014), F.lit(2015))).alias("year"))
        .withColumn("b", F.when(F.col("year") == 2015, F.col("b")).otherwise(-F.col("b")))
        .groupBy("year")
        .pivot("n_name", names)
        .agg(F.sum("b"))
    )


GDP = """gdp AS (
  SELECT n_name AS country, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS gdp
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0 GROUP BY n_name)"""

# Invented spellings: the first points to a nation of the sheet, the second to one that is not there.
ALIASES = {"NATION_5": "NATION_6", "NATION_10": "NATION_999"}
ALIAS_SQL = "aliases(country, target) AS (VALUES " + ", ".join(f"('{a}', '{t}')" for a, t in ALIASES.items()) + ")"


DIMS = 64
COORDS = [f"x{i}" for i in range(DIMS)]


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings, a column for each dimension; label 0 is the minority class."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMS)],
        (F.col("label") == 0).cast("int").alias("is_fraud"),
    )


POINTS = (
    "p AS (SELECT vec_id AS id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS))
    + ", CASE WHEN label = 0 THEN 1 ELSE 0 END AS is_fraud FROM embeddings)"
)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round for comparison; ``name@8`` sets the places of one column."""
    new = {}
    for c in cols:
        name, _, own = c.partition("@")
        new[name] = F.round(F.col(name).cast("double"), int(own or places))
    return df.withColumns(new)


def r6(*exprs: str) -> str:
    """The same in SQL: select items from ``name``, ``name=expr`` or ``name@places=expr``."""
    out = []
    for x in exprs:
        name, _, expr = x.partition("=")
        name, _, places = name.partition("@")
        out.append(f"round(CAST({expr or name} AS DOUBLE), {places or 6}) AS {name}")
    return ", ".join(out)
