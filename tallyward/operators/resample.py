"""Rebalancing of classes before a fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import hash_order, hash_uniform
from tallyward.operators.neighbours import nearest
from tallyward.operators.prep import class_counts
from tallyward.plans.joins import attach
from tallyward.plans.slices import global_rank, precedes, row_at
from tallyward.session import group_rows, settle

METHODS = ("random_undersampling", "enn", "smote", "smoteenn")


def _hash_cut(rows: DataFrame, id_col: str, position: int) -> tuple | None:
    """``row_at`` in hash order. Hashes spread evenly, so their first digits tell the few rows to sort."""
    start = F.substring("__h", 1, 3)
    for held, n in sorted((tuple(r) for r in rows.groupBy(start).count().collect()), key=lambda r: r[0] or ""):  # a missing id has no hash and comes first
        if position < n:
            return row_at(rows.where(start.eqNullSafe(F.lit(held))), ["__h", id_col], position, n)
        position -= n
    return None


def undersample(df: DataFrame, label: str = "is_fraud", id_col: str = "transaction_id", seed: int = 42) -> DataFrame:
    """Every class at the size of the smallest, drawn without replacement in a repeatable hash order.

    The draw is a filter below the key of the first row left out, so nothing is sorted as a whole. Rows without
    a label belong to no class and are left out.
    """
    counts = class_counts(df, label)
    least = min(counts.values())
    marked = df.withColumn("__h", hash_order(seed, id_col))
    keep = F.lit(False)
    for c, n in counts.items():
        mine = F.col(label) == c
        if n > least:
            cut = _hash_cut(marked.where(mine), id_col, least)
            mine = mine & precedes(marked, ["__h", id_col], cut)
        keep = keep | mine
    return marked.where(keep).drop("__h")


def minority_of(counts: dict[int, int]) -> int:
    """The smallest class, the lower label where sizes are equal."""
    return min(sorted(counts), key=counts.get)


def edit_neighbours(df: DataFrame, coords: Sequence[str], k: int = 3, label: str = "is_fraud", id_col: str = "transaction_id") -> DataFrame:
    """Drop rows outside the minority class unless all k nearest rows share their class.

    A row that lacks a coordinate has no neighbours to speak against it and stays; one without a label goes.
    """
    minority = minority_of(class_counts(df, label))
    near = nearest(df, coords, k, id_col, label)
    agree = near.select(id_col, F.transform("neighbours", lambda x: x["label"]).alias("__classes"))
    rows = attach(df, agree, [id_col], [id_col])
    same = F.forall("__classes", lambda c: c.eqNullSafe(F.col(label)))
    alone = F.col("__classes").isNull() & F.col(label).isNotNull()
    return rows.where((F.col(label) == minority) | same | alone).select(*df.columns)


def smote(
    df: DataFrame,
    coords: Sequence[str],
    k: int = 5,
    label: str = "is_fraud",
    id_col: str = "transaction_id",
    seed: int = 42,
) -> DataFrame:
    """Original rows and synthetic minority rows until the two classes are equal in size.

    Synthetic row r starts at minority row r mod n and moves a random part of the way towards one of
    its k nearest minority rows; both choices are hashes of r. Ids become text, "synthetic-r" for new
    rows.
    """
    coords = list(coords)
    counts = class_counts(df, label)
    minority = minority_of(counts)
    small, wanted = counts[minority], max(counts.values()) - counts[minority]
    original = df.select(F.col(id_col).cast("string").alias(id_col), *[F.col(c).cast("double").alias(c) for c in coords], label)
    if wanted == 0:
        return original
    own = df.where(F.col(label) == minority).select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(c) for c in coords])
    near = nearest(own, coords, k, "__id").select("__id", F.transform("neighbours", lambda x: x["id"]).alias("__near"))
    base = global_rank(own, ["__id"], "__rank", size=small).withColumn("__i", F.col("__rank") - 1).where(F.col("__i") < wanted)
    base = base.join(near, "__id")
    copies = F.floor((F.lit(wanted - 1) - F.col("__i")) / small)
    rows = base.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    rows = rows.withColumn("__r", F.col("__i") + F.col("__c") * small)
    pick = F.floor(hash_uniform(seed, "__r") * F.size("__near")).cast("int")
    rows = rows.withColumn("__to", F.get("__near", pick)).withColumn("__gap", hash_uniform(seed + 1, "__r"))
    ends = own.select(F.col("__id").alias("__to"), *[F.col(c).alias(f"__to_{c}") for c in coords])
    rows = rows.drop("__near")
    if wanted > group_rows(df.sparkSession):
        rows = settle(rows)  # sampled for heavy keys, then joined
    rows = attach(rows, ends, ["__to"], ["__r"], size=wanted)
    made = rows.select(
        F.concat(F.lit("synthetic-"), F.col("__r").cast("string")).alias(id_col),
        *[(F.col(c) + F.col("__gap") * (F.col(f"__to_{c}") - F.col(c))).alias(c) for c in coords],
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
    )
    return original.unionByName(made)


def smote_enn(df: DataFrame, coords: Sequence[str], k: int = 5, edit_k: int = 3, label: str = "is_fraud", id_col: str = "transaction_id", seed: int = 42) -> DataFrame:
    """Oversample, then edit. The classes are then equal, so the editing spares the lower label."""
    return edit_neighbours(settle(smote(df, coords, k, label, id_col, seed)), coords, edit_k, label, id_col)


def resample(df: DataFrame, method: str, coords: Sequence[str], label: str = "is_fraud", id_col: str = "transaction_id", seed: int = 42) -> DataFrame:
    if method == "random_undersampling":
        return undersample(df, label, id_col, seed)
    if method == "enn":
        return edit_neighbours(df, coords, 3, label, id_col)
    if method == "smote":
        return smote(df, coords, 5, label, id_col, seed)
    if method == "smoteenn":
        return smote_enn(df, coords, 5, 3, label, id_col, seed)
    raise ValueError(f"no resampling {method!r}: choose one of {METHODS}")
