"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.plans.joins import attach
from tallyward.session import settle

# Pairs that one task of a round may hold: few pairs do not cost a task, and files, for every shuffle partition.
PAIRS_PER_TASK = 50_000


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes``; a component is named by its smallest node.

    ``edges`` has columns a and b, ``nodes`` the column node. Each round is two joins against one row
    per node, with hubs salted, and is settled so that the plan does not grow. A round makes no more pairs than
    it is given, so their number says how many tasks suffice and whether there can be hubs.
    """
    pairs = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    n, before = pairs.count(), None
    while True:
        pairs = settle(_small_star(_large_star(_dense(pairs, n), n), n))
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        n, before = state[0], state
    names = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(names, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _dense(pairs: DataFrame, n: int) -> DataFrame:
    """At most ``n`` pairs in as many tasks as they need, or as they are in, if that is fewer."""
    return pairs.coalesce(max(1, -(-n // PAIRS_PER_TASK)))


def _large_star(pairs: DataFrame, n: int) -> DataFrame:
    """Larger neighbours of a node move to the smallest node near it."""
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = attach(both, least, ["u"], ["v"], size=2 * n).where(F.col("v") > F.col("u"))
    return _dense(_dense(moved.select(F.col("v").alias("a"), F.least("u", "m").alias("b")), n).distinct(), n)


def _small_star(pairs: DataFrame, n: int) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = attach(pairs, least, ["a"], ["b"], size=n).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _dense(_dense(moved.unionByName(least.select("a", F.col("m").alias("b"))), n).distinct(), n)
