"""Near-duplicate groups: fast similarity sketches, banding, exact verification, and connected groups.

Sets are the distinct word shingles of whole texts, as 64-bit hashes. Equal sets form a class, and only the class's
smallest (id, text) goes on, with a hash in place of the text. A sketch of bands x rows coordinates gives each class a key for each band; classes that share a key
are candidates. At the threshold of 0.8 and 36 bands of 5 rows a linked pair shares no key with probability 6e-7.

Links decide groups, not the list of all pairs, so a large group of copies is not expanded:

* A shingle that no other candidate has cannot be shared. With c shared-at-all shingles of n, two sets can only be linked
  if min(c, c') reaches the needed overlap; this exact bound removes most pairs that fall short.
* In each key's bucket all members are compared with the smallest id; exact links are then joined to groups.
* Members that are not in the group of their bucket's smallest id are compared with all members of other groups there
  that pass the bound, made sharper by what both share with the smallest id. So every pair of a bucket is linked, in one
  group already, ruled out by a bound, or compared exactly.

Null and empty texts have an empty set and are linked with nothing. A text of fewer words than a shingle has its whole
sequence as its one shingle. Rows that repeat an id count as one document if their sets are equal; otherwise each
is judged by its own set, whatever the order of the rows, and the groups of its sets are one group. Rows without an id form no links and stay on their own.
An empty table gives an empty result. Of other columns none is read, except by ``one_of_each``, which returns them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.llm.common import hinted, spaced_words
from tallyward.llm.sketching import band_keys, sketch
from tallyward.plans.components import connected_components
from tallyward.plans.joins import attach
from tallyward.session import settle

BANDS, ROWS = 36, 5
# Elements that are sketched at a time: what a worker holds for them is some 80 bytes each.
BLOCK = 250_000


def shingles(text: str, words: int) -> Column:
    """The distinct shingles of a text as hashes."""

    def of(w: Column) -> Column:
        return (
            F.when(F.size(w) == 0, F.array().cast("array<long>"))
            .when(F.size(w) < words, F.array(F.xxhash64(w)))
            .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(F.slice(w, i, words))))
        )

    return F.array_distinct(F.transform(F.array(spaced_words(text)), of)[0])


def _bands(array: pa.Array) -> pa.Array:
    offsets, values = array.offsets.to_numpy().astype(np.int64), array.values.to_numpy(zero_copy_only=False)
    keys, a = np.empty((len(array), BANDS), dtype=np.int64), 0
    while a < len(array):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        part = sketch(values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]), BANDS * ROWS)
        keys[a:b] = band_keys(part, BANDS, ROWS)
        a = b
    return pa.ListArray.from_arrays(pa.array(np.arange(len(array) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))


def _node(doc_id: str, text: str) -> Column:
    """What names a row: its id, and a hash of its text, as ids may repeat."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("t"))


def sketched(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(node, n, s1, s2, bands): name, size, 96-bit hash and band keys of each row's set."""
    kind = dict(docs.dtypes)[doc_id]
    sets = docs.select(_node(doc_id, text).alias("node"), shingles(text, words).alias("set"))
    sets = sets.select("node", F.size("set").cast("long").alias("n"), F.expr("xxhash64(sort_array(set))").alias("s1"), F.expr("hash(sort_array(set))").alias("s2"), "set")

    def work(batches):
        for batch in batches:
            keep = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*keep, _bands(batch.column(4))], ["node", "n", "s1", "s2", "bands"])

    return sets.mapInArrow(work, f"node struct<id: {kind}, t: long>, n long, s1 long, s2 int, bands array<long>")


def _may_link(na: str, nb: str, ca: str, cb: str, percent: int) -> Column:
    """Whether two sets can overlap enough: 100 i >= percent (na + nb - i), with i at most the lesser c."""
    return (F.col(na) + F.col(nb)) * percent <= F.least(ca, cb) * (100 + percent)


def _compared(pairs: DataFrame, docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(a, b, na, nb, shared): sizes and overlap of the full sets of each pair."""
    texts = docs.select(_node(doc_id, text).alias("t"), F.col(text).alias("text"))
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    texts = texts.join(hinted(ends), "t", "left_semi").dropDuplicates(["t"])
    left = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("t").alias("b"), F.col("text").alias("tb")), "b")
    sets = both.select("a", "b", shingles("ta", words).alias("sa"), shingles("tb", words).alias("sb"))
    return settle(sets.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared")))


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(F.col("shared") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _through_ids(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of ids that have several."""
    apart = [F.min(c) != F.max(c) for c in ("s1", "s2", "n")]
    several = settle(named.select("node.id", "s1", "s2", "n").groupBy("id").agg((apart[0] | apart[1] | apart[2]).alias("several")).where("several").select("id"))
    twins = named.select("node.id", "s1", "s2", "n").join(hinted(several), "id").distinct()
    twins = settle(twins.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("id", "rep"))
    return attach(twins, twins.groupBy("id").agg(F.min("rep").alias("hub")), ["id"], ["rep"]).select(F.col("hub").alias("a"), F.col("rep").alias("b"))


def groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component) of every row."""
    rows = settle(sketched(docs, words, doc_id, text))
    named = rows.where((F.col("n") > 0) & F.col("node.id").isNotNull())
    classes = named.groupBy("s1", "s2", "n").agg(F.min("node").alias("rep"), F.first("bands").alias("bands"))
    classes = settle(classes)
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lead")).where("m > 1").drop("m")
    members = settle(keys.join(shared, "key"))

    # shingles, cut to 32 bits, that only one candidate has: a collision can only weaken the bound
    candidates = settle(members.select("rep").distinct())
    texts = docs.select(_node(doc_id, text).alias("rep"), F.col(text).alias("text"))
    short = F.transform(shingles("text", words), lambda s: (s % 2147483647).cast("int"))
    seen = texts.join(hinted(candidates), "rep", "left_semi").dropDuplicates(["rep"]).select("rep", F.explode(short).alias("s"))
    lonely = seen.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep")).where("k = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("u"))
    members = members.join(lonely, "rep", "left").withColumn("c", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
    members = settle(members.where(F.col("c") * 100 >= F.col("n") * percent))

    leads = members.where(F.col("rep") == F.col("lead")).select("key", F.col("n").alias("na"), F.col("c").alias("ca"))
    stars = members.where(F.col("rep") != F.col("lead")).join(leads, "key").where(_may_link("na", "n", "ca", "c", percent))
    stars = settle(stars.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    compared = _compared(stars, docs, words, doc_id, text)
    same_id = settle(_through_ids(named, classes))
    links = _linked(compared, percent).unionByName(same_id)

    nodes = members.select(F.col("rep").alias("node")).unionByName(same_id.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    home = connected_components(links, nodes)
    with_lead = compared.select(F.col("a").alias("lead"), F.col("b").alias("rep"), "shared")
    placed = members.join(home.select(F.col("node").alias("rep"), F.col("component").alias("home")), "rep").join(with_lead, ["lead", "rep"], "left")
    placed = settle(placed.withColumn("shared", F.when(F.col("rep") == F.col("lead"), F.col("n")).otherwise(F.col("shared"))))
    lead_home = placed.where(F.col("rep") == F.col("lead")).select("key", F.col("home").alias("lead_home"))
    placed = placed.join(lead_home, "key", "left")
    mixed = placed.where(~F.col("home").eqNullSafe(F.col("lead_home"))).select("key").distinct()
    pool = settle(placed.join(mixed, "key"))
    # the same bound among the members that have met one lead
    met = settle(pool.select("lead", "rep").distinct())
    seen = texts.join(hinted(met.select("rep").distinct()), "rep", "left_semi").dropDuplicates(["rep"]).select("rep", short.alias("all"))
    seen = seen.join(met, "rep").select("lead", "rep", F.explode("all").alias("s"))
    lonely = seen.groupBy("lead", "s").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("rep")).where("k = 1").groupBy("lead", "rep").agg(F.count(F.lit(1)).alias("u"))
    pool = pool.join(lonely, ["lead", "rep"], "left").withColumn("c", F.least(F.col("c"), F.col("n") - F.coalesce("u", F.lit(0)))).drop("u")
    # the keys before this one that a member has here: at most one for each band
    pool = settle(pool.withColumn("before", F.collect_list("key").over(W.partitionBy("rep").orderBy("key").rowsBetween(W.unboundedPreceding, -1))))
    side = lambda x, rest: pool.select("key", F.col("rep").alias(x), *(F.col(c).alias(c[0] + x) for c in ("n", "c", "home", "shared", "before")), *rest)
    apart = side("a", ["lead_home"]).where(~F.col("ha").eqNullSafe(F.col("lead_home")))
    others = side("b", ["lead"]).where(F.col("b") != F.col("lead"))  # each member has met the lead
    # what two sets share lies in the lead's set or outside of it; what only one candidate has is not shared
    within = F.coalesce(F.least("sa", "sb") + F.least(F.col("ca") - F.col("sa"), F.col("cb") - F.col("sb")), F.least("ca", "cb"))
    enough = (F.col("na") + F.col("nb")) * percent <= F.least(within, "ca", "cb") * (100 + percent)
    once = F.col("hb").eqNullSafe(F.col("lead_home")) | (F.col("a") < F.col("b"))
    # a pair counts in the first key that it shares
    first = ~F.arrays_overlap("ba", "bb")
    more = apart.join(others, "key").where((F.col("ha") != F.col("hb")) & once & enough & first)
    more = settle(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = links.unionByName(_linked(_compared(more, docs, words, doc_id, text), percent))

    merged = connected_components(links, nodes).where(F.col("node") != F.col("component")).select(F.col("node").alias("rep"), "component")
    # a row's class, then the class's group; only classes of several rows and groups of several classes are joined
    many = named.groupBy("s1", "s2", "n").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    placed = rows.select("node", "n", "s1", "s2").join(hinted(many), ["s1", "s2", "n"], "left")
    placed = placed.withColumn("rep", F.when((F.col("n") > 0) & F.col("node.id").isNotNull(), F.coalesce("rep", "node")))
    return placed.join(hinted(merged), "rep", "left").select("node.id", "n", F.coalesce("component.id", "rep.id", "node.id").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return groups(docs, words, percent, doc_id, text).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each group, all columns."""
    gone = groups(docs, words, percent, doc_id, text).where(F.col("id") != F.col("component")).select(F.col("id").alias("gone")).distinct()
    gone = settle(gone)
    return docs.join(hinted(gone), docs[doc_id] == gone["gone"], "left_anti")
