"""Text, key and size helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes a side may have, measured, to be sent to every executor.
BROADCAST_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` where all is ASCII (``translate`` takes microseconds a character)."""
    each = text
    for a, b in zip(UPPER, LOWER):
        each = F.replace(each, F.lit(a), F.lit(b))
    return F.when(F.lower(text) == text, text).when(_is_ascii(text), F.lower(text)).otherwise(each)


def whole(text: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def words_between(text: Column, separators: str) -> Column:
    """Words in lower case (A-Z only) between runs of the separators, a regular-expression class."""
    mixed = F.transform(F.split(text, separators), lower_ascii)
    return F.array_remove(F.when(_is_ascii(text), F.split(F.lower(text), separators)).otherwise(mixed), "")


def alnum_words(text: str) -> Column:
    """Words of ASCII letters, ASCII digits and any other non-ASCII characters."""
    return words_between(whole(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def spaced_words(text: str) -> Column:
    """Words between ASCII white space."""
    return words_between(whole(text), r"[\x20\x09-\x0D]+")


def row_keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """96 bits that name a (doc_id, text) pair and are never null, whatever the id is; equal rows share them."""
    return F.xxhash64(F.col(doc_id), F.col(text)), F.hash(F.col(text), F.col(doc_id))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, measured as text plus 16 bytes a column, fit the broadcast limit."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind.startswith("array"):
            per = 40 if "string" in kind or "struct" in kind else 8
            size = size + F.greatest(F.size(F.col(name)), F.lit(0)) * per
        elif kind.startswith("struct"):
            size = size + 32 + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit


def hinted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, to be broadcast where its measured size allows it; else the join shuffles."""
    return F.broadcast(df) if is_small(df, limit) else df


def spare(df: DataFrame, *names: str) -> list[str]:
    """Working names that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        fresh = name
        while fresh.lower() in taken:
            fresh = f"_{fresh}"
        taken.add(fresh.lower())
        out.append(fresh)
    return out
