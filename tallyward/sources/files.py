"""Readers and writers of files, and tables computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.sources.schema import IP_RANGE, PURCHASE_FILE, Columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_purchases(spark: SparkSession, path: str, label: str = "is_fraud") -> DataFrame:
    """Purchase file to transactions; the column order is that of the file's header."""
    header = spark.read.option("header", "true").csv(path).columns
    kinds = {f.name: f.dataType for f in PURCHASE_FILE.fields} | {label: T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    return Columns(transaction_id=None, is_fraud=label).apply(read_csv(spark, path, schema))


def read_ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Three columns by position: lower, upper, country."""
    return read_csv(spark, path, IP_RANGE)


def parse_times(df: DataFrame, *cols: str) -> DataFrame:
    """Text to time in the named columns."""
    return df.withColumns({c: F.to_timestamp(c) for c in cols})


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names; no error where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def year_values(sheet: DataFrame, year: int, year_col: str = "year", key: str = "country", value: str = "gdp") -> DataFrame:
    """One year of a sheet with a row per year and a column per country, in long form."""
    countries = [c for c in sheet.columns if c != year_col]
    return (
        sheet.where(F.col(year_col) == year)
        .select(*[F.col(f"`{c}`").cast("double").alias(c) for c in countries])
        .unpivot([], [f"`{c}`" for c in countries], key, value)
    )


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; where there is none, compute it, write it and read it back."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """Batch write of scored transactions, with ``true_label`` where it is already known."""
    out = predictions if "true_label" in predictions.columns else predictions.withColumn("true_label", F.lit(None).cast("int"))
    out.write.mode(mode).parquet(path)
