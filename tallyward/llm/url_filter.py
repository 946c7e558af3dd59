"""URL rules of (action, host, path): host-suffix and path-prefix expressions joined on short hash prefixes.

Each distinct URL is expanded into the expressions that any rule could have: host suffixes of the label counts that occur
in the rules, times path prefixes of the lengths that occur there. Expressions and rules are equi-joined on four bytes of
their SHA-256; the full digest and then precedence (the longest rule, block before allow on a tie) decide.

Null URLs, and those without ``://``, have an empty host and path and get the default. An empty rule table leaves
everything at the default. Repeated rules count once; rows with a null host or action are ignored, a null path is empty.
Repeated URLs are judged once and every row of the input is returned, with its other columns, even if those carry the
names of the result: the result's columns replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import hinted, lower_ascii, spare

ALLOW, BLOCK = "allow", "block"
RESULT = ("host", "path", "rule", "verdict")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (action, host, path) literals."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("action", "host", "path")))
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules))
    return spark.range(1).select(F.inline(rows))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    known = (
        rules.where(F.col("host").isNotNull() & F.col("action").isNotNull())
        .select(F.col("action").alias("act"), lower_ascii(F.col("host")).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"))
        .distinct()
        .withColumn("digest", _digest(F.col("rh"), F.col("rp")))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    # at most one number for each host depth and each path length, however many rules there are
    shape = known.agg(
        F.collect_set(F.size(F.split("rh", r"\."))).alias("depths"), F.collect_set(F.length("rp")).alias("lengths")
    ).first()
    depths, lengths = sorted(shape["depths"]), sorted(shape["lengths"])
    row, cut, best, h, c = spare(pages, "__host", "__cut", "__best", "__h", "__c")
    whole_path = spare(pages, "__path")[0]
    split = pages.withColumns({row: host_of(F.col(url)), whole_path: path_of(F.col(url))})
    split = split.withColumn(cut, F.substring(whole_path, 1, max(lengths, default=0)))
    if lengths:
        expressions = F.expr(
            f"""flatten(transform(filter(array({",".join(map(str, depths))}), d -> d <= size(split(h, '[.]'))),
                d -> transform(filter(array({",".join(map(str, lengths))}), n -> n <= char_length(c)),
                               n -> named_struct('eh', substring_index(h, '.', -d), 'ep', substring(c, 1, n)))))"""
        )
        urls = split.select(F.col(row).alias("h"), F.col(cut).alias("c")).distinct()
        tried = urls.select("h", "c", F.inline(expressions)).withColumn("full", _digest(F.col("eh"), F.col("ep")))
        fits = tried.join(hinted(known), F.substring("full", 1, 8) == F.col("short")).where(F.col("full") == F.col("digest"))
        order = F.struct(
            F.length(F.concat("rh", "rp")).alias("n"),
            F.length("rh").alias("nh"),
            (F.col("act") == BLOCK).alias("b"),
            F.concat("rh", "rp").alias("rule"),
            F.col("act").alias("act"),
        )
        decided = fits.groupBy(F.col("h").alias(h), F.col("c").alias(c)).agg(F.max(order).alias(best))
        split = split.join(decided, (F.col(row) == F.col(h)) & (F.col(cut) == F.col(c)), "left").drop(h, c)
        rule, verdict = F.col(f"{best}.rule"), F.coalesce(F.col(f"{best}.act"), F.lit(default))
    else:
        rule, verdict = F.lit(None).cast("string"), F.lit(default)
    kept = [c for c in pages.columns if c.lower() not in RESULT]
    return split.select(*kept, F.col(row).alias("host"), F.col(whole_path).alias("path"), rule.alias("rule"), verdict.alias("verdict"))
