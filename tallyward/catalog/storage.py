"""Queries that write a table in one of the library's forms, read it back and compare with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyward.catalog.bindings import GDP, SQL, E, O, events, gdp_sheet, orders, query, r6, rounded, size_of, table
from tallyward.catalog.history import scored_events
from tallyward.catalog.modelling import _input
from tallyward.operators import enrich, features, prep, profile
from tallyward.session import checkpoint_dir
from tallyward.sources import codecs, files
from tallyward.sources.schema import PURCHASE_FILE


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "purchase_file",
    f"""WITH {E} SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(signup_time) AS signup_us, epoch_us(purchase_time) AS purchase_us,
  {r6('purchase_value')}, source, CAST(ip_address AS DOUBLE) AS ip_address, is_fraud, count(*) AS rows FROM e GROUP BY ALL""",
)
def purchase_file(spark, sf):
    """All events written as a purchase file with a header and read with its types; ids are made from the rows."""
    path, rows = _folder(spark, "purchases"), events(spark, sf)
    kinds = {f.name: f.dataType for f in PURCHASE_FILE.fields}
    text = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c.endswith("_time") else F.col(c).cast(kinds[c]).alias(c) for c in kinds if c in rows.columns]
    rows.select(*text).write.option("header", "true").csv(path)
    back = files.read_purchases(spark, path).where(F.length("transaction_id") == 32)
    keys = ["user_id", F.unix_micros("signup_time").alias("signup_us"), F.unix_micros("purchase_time").alias("purchase_us"), F.round("purchase_value", 6).alias("purchase_value"), "source", "ip_address", "is_fraud"]
    return back.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


@query("parsed_times", f"WITH {E} SELECT transaction_id, epoch_us(signup_time) AS signup_us, epoch_us(purchase_time) AS purchase_us FROM e")
def parsed_times(spark, sf):
    """Times that a file holds as text."""
    path = _folder(spark, "times")
    rows = events(spark, sf)
    rows.select("transaction_id", *[codecs.iso(F.col(c)).alias(c) for c in ("signup_time", "purchase_time")]).write.option("header", "true").csv(path)
    text = spark.read.option("header", "true").schema("transaction_id long, signup_time string, purchase_time string").csv(path)
    out = files.parse_times(text, "signup_time", "purchase_time")
    return out.select("transaction_id", F.unix_micros("signup_time").alias("signup_us"), F.unix_micros("purchase_time").alias("purchase_us"))


@query("cached_enrichment", f"WITH {O}, {GDP} SELECT transaction_id, country, {r6('gdp@2=gdp')} FROM o LEFT JOIN gdp USING (country)")
def cached_enrichment(spark, sf):
    """Worked out once; the second call must find the table and may not build it."""
    path = _folder(spark, "enriched")

    def build():
        sheet = files.year_values(gdp_sheet(spark, sf), 2015)
        return enrich.add_gdp(orders(spark, sf), sheet, size_of(spark, sf, "orders")).select("transaction_id", "country", "gdp")

    def never():
        raise AssertionError("built twice")

    files.materialize(spark, path, build)
    return rounded(files.materialize(spark, path, never), "gdp", places=2)


@query(
    "transaction_messages",
    f"""WITH {E} SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(device_id AS VARCHAR) AS device_id, epoch_us(signup_time) AS signup_us,
  epoch_us(purchase_time) AS purchase_us, {r6('purchase_value')}, source, CAST(ip_address AS DOUBLE) AS ip_address FROM e""",
)
def transaction_messages(spark, sf):
    """Every event as a message with key and JSON value, written as text and decoded."""
    path = _folder(spark, "messages")
    codecs.encode_transactions(events(spark, sf)).write.parquet(path)
    back = codecs.decode_transactions(spark.read.parquet(path), "value")
    return rounded(
        back.select("transaction_id", "device_id", F.unix_micros("signup_time").alias("signup_us"), F.unix_micros("purchase_time").alias("purchase_us"), "purchase_value", "source", "ip_address"),
        "purchase_value",
    )


@query("stored_predictions", SQL["linear_score"].replace("FROM s", ", CAST(NULL AS INTEGER) AS true_label FROM s"))
def stored_predictions(spark, sf):
    """Scores of all events, appended to a table in two writes."""
    path, scored = _folder(spark, "predictions"), scored_events(spark, sf).select("transaction_id", "predicted_class", "fraud_probability")
    for half in (0, 1):
        files.write_predictions(scored.where(F.col("transaction_id") % 2 == half), path)
    return rounded(spark.read.parquet(path), "fraud_probability")


@query(
    "state_messages",
    f"""WITH {E} SELECT device_id, count(*) AS txn_count, CAST(sum(purchase_value) AS DOUBLE) AS purchase_sum, epoch_us(max(purchase_time)) AS last_us,
  epoch_us(min(purchase_time)) AS first_us, count(DISTINCT ip_address) AS ips, CAST(sum(DISTINCT ip_address) AS DOUBLE) AS ip_sum,
  count(DISTINCT source) AS sources, CAST(sum(is_fraud) AS BIGINT) AS fraud_count FROM e GROUP BY device_id""",
)
def state_messages(spark, sf):
    """The state of all devices as text in parts of 20 members, written, read, decoded and put together."""
    path, txns = _folder(spark, "state"), events(spark, sf)
    state = features.device_sets(txns, features.device_state(txns, codecs.label_events(txns)), 20)
    codecs.encode_state(state.withColumn("device_id", F.col("device_id").cast("string"))).write.parquet(path)
    back = codecs.decode_state(spark.read.parquet(path))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return back.groupBy(F.col("device_id").cast("long").alias("device_id")).agg(
        F.max("txn_count").alias("txn_count"),
        F.max("purchase_sum").alias("purchase_sum"),
        F.unix_micros(F.max("last_transaction")).alias("last_us"),
        F.unix_micros(F.max("first_seen")).alias("first_us"),
        F.sum(F.size("ip_addresses")).alias("ips"),
        F.sum(total("ip_addresses")).alias("ip_sum"),
        F.sum(F.size("sources")).alias("sources"),
        F.max("fraud_count").alias("fraud_count"),
    )


@query("saved_preprocessor", SQL["scaled_features"])
def saved_preprocessor(spark, sf):
    """Scaled by a preprocessor that was saved and loaded."""
    path, rows = _folder(spark, "preprocessor"), _input(spark, sf).drop("browser")
    prep.Preprocessor().fit(rows).save(spark, path)
    return rounded(prep.Preprocessor.load(spark, path).transform(rows), "purchase_value", "age", "constant")


@query("preview", f"WITH {O} SELECT transaction_id, country, {r6('purchase_value')} FROM o ORDER BY transaction_id LIMIT 5")
def preview(spark, sf):
    rows = orders(spark, sf).select("transaction_id", "country", "purchase_value")
    return rounded(profile.preview(rows.orderBy("transaction_id")), "purchase_value")


@query(
    "table_schema",
    """SELECT column_name AS name, CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 'time' WHEN column_type = 'VARCHAR' THEN 'string'
  WHEN column_type = 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type FROM (DESCRIBE events)""",
)
def table_schema(spark, sf):
    out = profile.schema_table(table(spark, sf, "events"))
    return out.withColumn("type", F.when(F.col("type").startswith("timestamp"), "time").otherwise(F.col("type")))
