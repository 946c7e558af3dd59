"""Balanced contiguous shards from a global prefix sum of bytes.

Rows are brought into one order (a hash of the text, then the id), so that equal texts are neighbours. Each partition of
that order sums its bytes; the totals, one small row a partition, give every partition its offset, and a second pass turns
local running sums into global ones. The k-th cut lies at k/shards of all bytes: a row belongs to the shard in which its
middle byte lies, so each shard is within one row of its target. Groups of equal texts that are no larger than the
largest row, and so cost no balance, move as a whole by the middle of the group.

A null text has size ``overhead`` alone. Rows without an id come first within their text. Equal rows stay apart rows.
An empty table gives an empty result. With fewer rows than shards some shards are empty. Input columns other than the
id are not carried, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import settle

ROWS_PER_PARTITION = 1_000_000


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("kin"),
    )
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = settle(rows.repartitionByRange(parts, "kin", "doc_id", "text_crc32", "size").sortWithinPartitions("kin", "doc_id", "text_crc32", "size"))
    numbered = ordered.withColumn("part", F.spark_partition_id())
    # one row a partition: its bytes and rows, and the largest row
    totals = numbered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("most")).collect()
    totals = sorted(totals)
    total, most = sum(r["bytes"] for r in totals), max((r["most"] for r in totals), default=0)
    at_bytes, at_rows, offsets, counts = 0, 0, {}, {}
    for r in totals:
        offsets[r["part"]], counts[r["part"]] = at_bytes, at_rows
        at_bytes, at_rows = at_bytes + r["bytes"], at_rows + r["rows"]
    places = spark.sparkContext.broadcast((offsets, counts))

    def place(batches):
        done_bytes, done_rows, kin, group_at = 0, 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            offset, row = places.value[0][part], places.value[1][part]
            size = batch.column("size").to_numpy()
            start = offset + done_bytes + np.concatenate(([0], np.cumsum(size)[:-1]))
            index = row + done_rows + np.arange(len(size))
            done_bytes, done_rows = done_bytes + int(size.sum()), done_rows + len(size)
            shard = np.minimum(((2 * start + size) * shards) // max(2 * total, 1), shards - 1)
            fields = {"doc_id": batch.column("doc_id"), "size": batch.column("size"), "text_crc32": batch.column("text_crc32"), "kin": batch.column("kin")}
            fields |= {"begin": pa.array(start), "shard": pa.array(shard.astype(np.int32)), "row": pa.array(index)}
            yield pa.RecordBatch.from_pydict(fields)

    kind = dict(rows.dtypes)["doc_id"]
    placed = numbered.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, kin long, begin long, shard int, row long")
    # a group that a cut would part goes to one side if it is no larger than a row can be
    parted = (
        placed.groupBy("kin")
        .agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.min("begin").alias("g"), F.sum("size").alias("n"))
        .where((F.col("lo") < F.col("hi")) & (F.col("n") <= most))
        .select("kin", F.least(F.floor((2 * F.col("g") + F.col("n")).cast("double") * shards / (2.0 * max(total, 1))), F.lit(shards - 1)).cast("int").alias("home"))
    )
    # a cut parts one group, so the table has fewer rows than there are shards
    placed = placed.join(F.broadcast(parted), "kin", "left").withColumn("shard", F.coalesce("home", "shard"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
