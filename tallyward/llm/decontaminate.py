"""Benchmark passages in documents, by a prefix-filtered join.

An item's windows are its runs of ``window`` consecutive words; an item of fewer words is one window. Words are ordered by
rarity, their document frequency in the documents. Containment of a whole window needs every word of it, so its prefix is
one word: the rarest. Prefix words are equi-joined with the words of the documents; the positions of both give an
alignment, kept if one of the word's windows fits inside the document (length and position bounds). Each distinct
alignment is then verified word by word over the windows of the item.

Null and empty texts have no words, no hits and no windows. Repeated rows of documents each get their result; repeated
items count once for each item id. Null ids are allowed on both sides (a null item id is counted, but adds nothing to the
list of ids). An empty document or item table gives no hits. Of the documents only the named columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import alnum_words, hinted, row_keys
from tallyward.session import settle

KEYS = ["k1", "k2"]


def _words(table: DataFrame, id_: str, text: str) -> DataFrame:
    k1, k2 = row_keys(id_, text)
    return table.select(k1.alias("k1"), k2.alias("k2"), F.col(id_).alias("id"), alnum_words(text).alias("words"))


def prefix_words(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(word, i1, i2, p, lo, hi, size, n): the windows lo..hi of an item have the word at p as their rarest.

    ``items`` has i1, i2 and words; ``frequency`` has word and df. Equal rarity is decided by the word, then the place.
    """
    placed = items.withColumn("n", F.size("words")).select("i1", "i2", "n", F.posexplode("words").alias("p", "word"))
    placed = placed.join(hinted(frequency), "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    size = F.least(F.lit(window), F.col("n"))
    in_windows = placed.select(
        "i1", "i2", "n", size.alias("size"), "word", "p", "df",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - size + 1), F.least(F.col("p"), F.col("n") - size))).alias("w"),
    )
    rarest = in_windows.groupBy("i1", "i2", "w", "n", "size").agg(F.min(F.struct("df", "word", "p")).alias("r"))
    return rarest.groupBy("i1", "i2", "n", "size", F.col("r.word").alias("word"), F.col("r.p").alias("p")).agg(
        F.min("w").alias("lo"), F.max("w").alias("hi")
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(k1, k2, item, size, starts): the places in a document at which windows of an item start, by alignment."""
    items = settle(_words(benchmark, item_id, text).where(F.size("words") > 0).select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("id").alias("item"), "words").distinct())
    own = _words(docs, doc_id, text)
    vocabulary = hinted(items.select(F.explode("words").alias("word")).distinct())
    seen = own.select(F.explode(F.array_distinct("words")).alias("word")).join(vocabulary, "word")
    frequency = settle(seen.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    prefixes = settle(prefix_words(items, frequency, window))

    # the size is taken before the words become rows, which then need not carry the array
    places = own.withColumn("m", F.size("words")).select(*KEYS, "m", F.posexplode("words").alias("at", "word"))
    shift = F.col("at") - F.col("p")
    fits = F.greatest(F.col("lo"), -shift) <= F.least(F.col("hi"), F.col("m") - F.col("size") - shift)
    # an alignment found through several prefix words is one row
    aligned = places.join(hinted(prefixes), "word").where((F.col("m") >= F.col("size")) & fits)
    aligned = settle(aligned.select(*KEYS, "i1", "i2", "n", "size", shift.alias("shift")).distinct())

    by_doc = aligned.groupBy(*KEYS).agg(F.collect_list(F.struct("i1", "i2", "n", "size", "shift")).alias("found"))
    texts = own.select(*KEYS, "words").join(hinted(by_doc), KEYS)
    # only the part of the document that the item would cover goes on
    parts = texts.select(
        *KEYS, F.size("words").alias("m"),
        F.inline(F.transform("found", lambda c: F.struct(
            c["i1"].alias("i1"), c["i2"].alias("i2"), c["n"].alias("n"), c["size"].alias("size"), c["shift"].alias("shift"),
            F.slice("words", F.greatest(c["shift"], F.lit(0)) + 1, c["n"] + F.least(c["shift"], F.lit(0))).alias("part"),
        ))),
    )
    begin = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.col("n"), F.col("m") - F.col("shift")) - F.col("size")
    checked = parts.join(hinted(items), ["i1", "i2"]).where(last >= begin).withColumn("begin", begin).withColumn(
        "starts",
        F.filter(F.sequence("begin", last), lambda w: F.slice("words", w + 1, F.col("size")) == F.slice("part", w - F.col("begin") + 1, F.col("size"))),
    )
    return checked.where(F.size("starts") > 0).select(
        *KEYS, "item", "size", F.transform("starts", lambda w: w + F.col("shift")).alias("starts")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each document: words, words hit, items found and whether any was."""
    found = matches(docs, benchmark, window, doc_id, item_id, text)
    hit = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1)))
    by_doc = (
        found.select(*KEYS, "item", hit.alias("hit"))
        .groupBy(*KEYS)
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
            F.size(F.collect_set(F.coalesce(F.concat(F.lit("i"), F.col("item").cast("string")), F.lit("-")))).cast("long").alias("n_items"),
            F.concat_ws(",", F.array_sort(F.collect_set(F.col("item").cast("string")))).alias("ids"),
        )
    )
    own = _words(docs, doc_id, text).select(*KEYS, F.col("id").alias("doc_id"), F.size("words").cast("long").alias("n_words"))
    return own.join(by_doc, KEYS, "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of any item."""
    k1, k2 = row_keys(doc_id, text)
    dirty = settle(matches(docs, benchmark, window, doc_id, item_id, text).select(*KEYS).distinct())
    return docs.join(hinted(dirty), (k1 == dirty["k1"]) & (k2 == dirty["k2"]), "left_anti")
