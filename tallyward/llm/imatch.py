"""I-Match fingerprints: the terms of a document inside a band of inverse document frequency, hashed over random lexicons.

The band keeps terms found in at least one of ``rare`` and at most one of ``common`` texts; copies of a text count once, so a
large group of them moves no term out of the band. Digits of a term's digest draw the random lexicons: each of 64 has a 64th
of the band's terms, each of 32 a 1,024th, each of 16 a 16,384th, so short and very long documents alike have lexicons in
which they hold a term or two. A document's signature in a lexicon is a hash of its sorted distinct terms there; the
fingerprint lists all signatures. 64 more lexicons divide the terms outside of the band, for documents with few or none inside.

Likeness is the share of equal signatures among the band's lexicons in which either document has a term; where these are fewer
than ``FEW``, the lexicons outside of the band count too. So near copies made of very common or very rare words are alike.

Terms found in at least one of ``rare`` texts are listed in a table: at most ``rare`` times the mean number of distinct terms of a
text, whatever the size of the corpus. Its size is measured before it is broadcast. All other terms lie outside of the band.

Equal texts have equal fingerprints. A text without any word is named by a hash of itself, and is like another only if they
are equal. Null texts are empty. Rows of equal id follow each other in the order of their texts; rows without id come first.
Ids may be numbers, text, dates or times. A single document is its own next. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.llm.common import alnum_words, hinted, row_keys, whole
from tallyward.session import settle

# Lexicons of each kind, numbered in this order, and the lexicons of the band that are too few.
DENSE, SPARSE, SPARSER, OUTSIDE = 64, 32, 16, 64
BAND = DENSE + SPARSE + SPARSER
LEXICONS = BAND + OUTSIDE
FEW = 16
NONE = "-"  # no term in a lexicon
HEX = "0123456789abcdef"

# Bytes of text that lie in one range of ids, and that one task orders; ranges before the even cuts.
RANGE_BYTES, TASK_BYTES, MOST_TASKS = 4 << 20, 16 << 20, 20_000
COARSE_CUTS = 64


def _digit(digest: Column, place: int) -> Column:
    return F.instr(F.lit(HEX), F.substring(digest, place, 1)) - 1


def _quarter(digest: Column, place: int) -> Column:
    """A number below 64 from two hexadecimal digits."""
    return F.floor((_digit(digest, place) * 16 + _digit(digest, place + 1)) / 4).cast("int")


def _mark(number: Column) -> Column:
    return F.lpad(number.cast("string"), 3, "0")


def _outside(digest: Column) -> Column:
    return _mark(_quarter(digest, 1) + BAND)


def _inside(digest: Column) -> Column:
    """The marks of the band's lexicons that have the term of this digest."""
    sparse = F.substring(digest, 3, 1) == "0"
    sparser = F.substring(digest, 6, 2) == "00"
    drawn = F.array(
        _quarter(digest, 1),
        F.when(sparse & (_digit(digest, 4) < SPARSE // 4), _quarter(digest, 4) + DENSE),
        F.when(sparser & (_digit(digest, 8) < SPARSER // 4), _quarter(digest, 8) + DENSE + SPARSE),
    )
    return F.transform(F.array_compact(drawn), _mark)


def distinct_texts(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """Each text once, and their number; only texts that repeat are moved."""
    rows = docs.select(whole(text).alias("text")).withColumn("digest", F.md5("text"))
    repeated = settle(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    listed = hinted(repeated.select("digest"))
    first = rows.join(listed, "digest").groupBy("digest").agg(F.first("text").alias("text"))
    return rows.join(listed, "digest", "left_anti").select("text").unionByName(first.select("text")), docs.count() - again


def lexicon(docs: DataFrame, text: str, rare: int = 1000, common: int = 10) -> DataFrame:
    """(term, mark): the lexicons of every term that is in the band, or more common; one row for each."""
    texts, total = distinct_texts(docs, text)
    terms = texts.select(F.explode(F.array_distinct(alnum_words("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    listed = terms.where(F.col("df") * rare >= total).withColumn("digest", F.md5("term"))
    marks = F.when(F.col("df") * common <= total, _inside(F.col("digest"))).otherwise(F.array(_outside(F.col("digest"))))
    return listed.select("term", F.explode(marks).alias("mark"))


def _signatures(entries: str) -> Column:
    """The signature of each lexicon, from an array of marks with a term behind each.

    Sorted among the bare marks, the entries are written as one line for each lexicon.
    """
    bare = F.transform(F.sequence(F.lit(0), F.lit(LEXICONS - 1)), _mark)
    ordered = F.sort_array(F.concat(F.array_distinct(entries), bare))
    lines = F.concat_ws(" ", F.transform(ordered, lambda e: F.when(F.length(e) == 3, F.lit("\n")).otherwise(F.substr(e, F.lit(4)))))
    return F.transform(F.slice(F.split(lines, "\n"), 2, LEXICONS), lambda x: F.when(F.trim(x) == "", F.lit(NONE)).otherwise(F.substring(F.md5(F.trim(x)), 1, 6)))


def likeness(a: str, b: str) -> Column:
    """Share of equal signatures among the lexicons in which a or b has terms; of texts without words, equality."""

    def pairs(start: int, length: int) -> Column:
        both = F.zip_with(F.slice(F.split(a, ","), start, length), F.slice(F.split(b, ","), start, length), lambda x, y: F.when((x != NONE) | (y != NONE), x == y))
        return F.filter(both, lambda e: e.isNotNull())

    def share(of: Column) -> Column:
        return F.try_divide(F.size(F.filter(of, lambda e: e)).cast("double"), F.size(of))

    inside = pairs(1, BAND)
    counted = F.when(F.size(inside) < FEW, F.concat(inside, pairs(BAND + 1, OUTSIDE))).otherwise(inside)
    bare = F.col(a).startswith("text:") | F.col(b).startswith("text:")
    value = F.transform(F.array(counted), share)[0]
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(bare, F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def _position(rows: DataFrame, name: str) -> Column:
    """A number that never falls as the id grows; of text, seven bytes behind what all ids begin with."""
    kind = dict(rows.dtypes)[name]
    if kind == "date":
        return F.unix_date(name).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if kind in ("string", "binary") or kind.startswith(("char", "varchar")):
        raw = F.col(name).cast("binary")
        lo, hi = rows.agg(F.min(raw), F.max(raw)).first()
        same = len(os.path.commonprefix([bytes(lo), bytes(hi)])) if lo is not None else 0
        return F.conv(F.rpad(F.hex(F.substring(raw, same + 1, 7)), 14, "0"), 16, 10).cast("double")
    return F.col(name).cast("double")


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(range, guest, id, text, place, next): every document beside the one of the next higher id; the last meets the first.

    Ids are cut into ranges of about RANGE_BYTES of text: coarse cuts by percentiles, each divided evenly. A range is ordered
    on its own, and also gets the first document of the range that follows (a guest). One row for each range passes
    through one task.
    """
    rows = docs.select(F.col(doc_id).alias("id"), *(k.alias(n) for k, n in zip(row_keys(doc_id, text), ("k1", "k2"))), whole(text).alias("text"))
    rows = rows.withColumn("at", _position(rows, "id"))
    shape = rows.agg(
        F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("bytes"), F.min("at").alias("lo"), F.max("at").alias("hi"),
        F.percentile_approx("at", [i / COARSE_CUTS for i in range(1, COARSE_CUTS)], 10_000).alias("cuts"),
    ).first()
    edges = sorted({shape["lo"], *(shape["cuts"] or []), shape["hi"]}) if shape["lo"] is not None else []
    fine = max(1, -(-shape["bytes"] // (RANGE_BYTES * COARSE_CUTS)))
    place = F.lit(-1).cast("long")
    for i, (a, b) in enumerate(zip(edges, [*edges[1:], None])):
        inside = F.floor((F.col("at") - a) * fine / (b - a)).cast("long") if b is not None else F.lit(0).cast("long")
        place = F.when(F.col("at") >= a, F.least(inside, F.lit(fine - 1)) + i * fine).otherwise(place)
    rows = rows.withColumn("range", place).drop("at")
    firsts = settle(rows.groupBy("range").agg(F.min("id").alias("first")))
    before = firsts.select(F.col("range").alias("r"), F.col("first").alias("f"), F.lag("range").over(W.orderBy("range")).alias("b"), F.max("range").over(W.partitionBy()).alias("top"))
    before = hinted(before.select("r", "f", F.coalesce("b", "top").alias("before")))
    guests = rows.join(before, (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("f"))).select(
        F.col("before").alias("range"), F.lit(1).alias("guest"), "id", "k1", "k2", "text"
    )
    every = rows.select("range", F.lit(0).alias("guest"), "id", "k1", "k2", "text").unionByName(guests)
    every = every.repartition(min(MOST_TASKS, max(1, -(-shape["bytes"] // TASK_BYTES))), "range")
    order = W.partitionBy("range").orderBy("guest", F.col("id").asc_nulls_first(), "k1", "k2", "text")
    return every.select("range", "guest", "id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = 1000, common: int = 10) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose second half is the start of the next document's."""
    lex = hinted(settle(lexicon(docs, text, rare, common)))
    n = F.length("text")
    pairs = with_next(docs, doc_id, text).withColumn("n_chars", n.cast("long")).withColumn("head", F.substring("text", F.lit(1), F.ceil(n / 2).cast("int")))
    pairs = pairs.withColumn("edited", F.concat("head", F.coalesce(F.substring("next", F.lit(1), F.floor(n / 2).cast("int")), F.lit(""))))
    # both texts agree up to the word that the cut may go through, so the words before it are found once
    cut = F.length(F.regexp_extract(F.reverse("head"), r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0))
    pairs = pairs.withColumn("same", F.length("head") - cut)
    pairs = pairs.select(
        "range", "place", "guest", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.md5("text").alias("own_md5"), F.md5("edited").alias("edited_md5"),
        F.substring("text", F.lit(1), F.col("same")).alias("t0"), F.substr("text", F.col("same") + 1).alias("t1"), F.substr("edited", F.col("same") + 1).alias("t2"),
    )

    # what belongs to the document goes with an empty term, so that the rows of terms stay short
    about = F.struct("guest", "id", "n_chars", "edited_sha256", "own_md5", "edited_md5")
    kind = pairs.select(about.alias("about")).schema["about"].dataType
    itself = F.array(F.struct(F.lit(-1).alias("side"), F.lit("").alias("term"), about.alias("about")))

    def tagged(side: int) -> Column:
        none = F.lit(None).cast(kind)
        return F.transform(F.array_distinct(alnum_words(f"t{side}")), lambda t: F.struct(F.lit(side).alias("side"), t.alias("term"), none.alias("about")))

    terms = pairs.select("range", "place", F.inline(F.concat(itself, tagged(0), tagged(1), tagged(2)))).join(lex, "term", "left")
    entry = F.concat(F.coalesce("mark", _outside(F.md5("term"))), "term")
    # the rows of a range already lie together, so neither the grouping nor the look at the next row moves them
    sets = terms.groupBy("range", "place").agg(
        F.first("about", ignorenulls=True).alias("about"),
        F.collect_list(F.when(F.col("side").isin(0, 1), entry)).alias("own"),
        F.collect_list(F.when(F.col("side").isin(0, 2), entry)).alias("new"),
    )

    def named(entries: str, raw: str) -> Column:
        return F.when(F.size(entries) == 0, F.concat(F.lit("text:"), F.col(raw))).otherwise(F.concat_ws(",", _signatures(entries)))

    keys = [F.col(f"about.{k}").alias(k) for k in ("guest", "id", "n_chars", "edited_sha256")]
    prints = sets.select("range", "place", *keys, named("own", "about.own_md5").alias("fingerprint"), named("new", "about.edited_md5").alias("edited_fingerprint"))
    beside = prints.withColumn("after", F.lead("fingerprint").over(W.partitionBy("range").orderBy("place"))).where(F.col("guest") == 0)
    return beside.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "after").alias("near_next"),
    )
