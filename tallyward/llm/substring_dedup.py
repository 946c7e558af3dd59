"""Repeated passages found by content-defined chunks of a gear rolling hash, each match grown to what one earlier document has.

A gear hash rolls over the words: it is shifted to the left and the next word's random number is added, so that words more
than ``min_words`` / 5 back have left it. A chunk ends at every word whose hash is the least of some run of neighbours
(the last of equals). Cuts so depend on the words around them only, and an insertion moves none of the cuts behind it.
Two windows of neighbours fit into ``min_words`` words, side by side, so two documents that share as many words in a row cut
a chunk out of them at the same two places, wherever the words stand. Chunks are named by a digest of their words and of
the words that decided the cut before them, and those that one document alone has are ruled out.

A shared chunk is grown to both sides: every run of ``min_words`` words (a gram) whose chunk it is, is compared by a digest of
its bytes, blanks between the words included and those behind the last left out. The document with the smallest
id keeps a gram; in all others each word of it is taken out with the blanks that follow. So a word goes only as part of
``min_words`` or more in a row that one earlier document has in the same order, and every passage of that length goes
whole, wherever it stands. Shorter repeats, such as a shared line, stay, and so do repeats inside one document.

Null texts are left as they are; empty ones have no grams. Rows of the same id count as one document. Rows without an id
lose to any other. A text without spaces is one word. All rows and columns are returned, with the text shortened; a
document that is repeated altogether keeps an empty text. ``min_words`` is 2 or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyward.llm.common import spare
from tallyward.llm.segments import slices

SLICE_BYTES = 1 << 20
BLOCK = 1 << 16
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\v\f", dtype=np.uint8))
# One random number for each byte value, and the odd multipliers of the positions of bytes and of words in a gram.
BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
STEP, UNSTEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LEAP = np.uint64(0xD1342543DE82EF95)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = powers(STEP, BLOCK), powers(UNSTEP, BLOCK)


def mixed(h: np.ndarray) -> np.ndarray:
    """The values spread over all 64 bits (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the bytes from each start up to its end, for each array of ends; the last array reaches furthest."""
    out, i = [np.zeros(len(starts), dtype=np.uint64) for _ in ends], 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends[-1], base + BLOCK, side="right")))
        n = int(ends[-1][j - 1]) - base
        up, down = (UP, DOWN) if n <= BLOCK else (powers(STEP, n), powers(UNSTEP, n))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[data[base : base + n]] * up[:n], dtype=np.uint64)))
        at = starts[i:j] - base
        for hashes, to in zip(out, ends):
            hashes[i:j] = mixed((total[to[i:j] - base] - total[at]) * down[at] + (to[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def runs(units: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words: all but the last with the blanks behind them."""
    n = len(words) - k + 1
    total = words[k - 1 :].copy()
    for j in range(k - 2, -1, -1):
        total = total * LEAP + units[j : j + n]
    return mixed(total)


def reach(k: int) -> tuple[int, int]:
    """Words that the gear hash remembers, and neighbours of which a cut has the least hash: two such windows fit into k words."""
    memory = max(1, k // 5)
    return memory, max(1, (k - memory) // 2)


def gear(units: np.ndarray, memory: int) -> np.ndarray:
    """The rolling hash at each word from the ``memory``-th on."""
    shift, n = np.uint64(64 // memory), len(units) - memory + 1
    total = units[:n].copy()
    for j in range(1, memory):
        total = (total << shift) + units[j : j + n]
    return total


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` consecutive values stands, the last of equals."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at, span = np.where(values[b] <= values[a], b, a), span + step
    return at


def chunks(units: np.ndarray, k: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks in the runs of k words from the words ``first``: opening word (of the hash that cut), last word, chunk of each run."""
    memory, width = reach(k)
    cuts = least(gear(units, memory), width)
    opening, of = np.unique(cuts[first], return_inverse=True)
    return opening, cuts[opening + 1] + memory - 1, of


def grams(texts: pa.Array, k: int):
    """Of some texts at a time: (place of the first, bytes, ends of texts, starts of words, first word of each gram, its text, digest of the chunk in it, digest)."""
    texts = pc.fill_null(texts, "")
    for a, b in slices(texts, SLICE_BYTES):
        raw = "".join(texts.slice(a, b - a).to_pylist()).encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        edges = np.concatenate(([0], np.cumsum(pc.binary_length(texts.slice(a, b - a)).to_numpy(zero_copy_only=False).astype(np.int64))))
        blank = SPACES[data]
        opens, closes = np.ones(len(data) + 1, dtype=bool), np.ones(len(data) + 1, dtype=bool)
        opens[1:-1] = closes[1:-1] = blank[1:] != blank[:-1]
        opens[edges] = closes[edges] = True
        starts = np.flatnonzero(opens[:-1] & ~blank)
        ends = np.flatnonzero(closes[1:] & ~blank) + 1
        nexts = np.append(starts[1:], len(data))[: len(starts)]
        owner = np.searchsorted(edges, starts, side="right") - 1
        if len(starts) < k:
            none = np.zeros(0, dtype=np.int64)
            yield a, raw, edges, starts, none, none, none, none
            continue
        words, units = range_hashes(data, starts, ends, nexts)
        first = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
        opening, last, of = chunks(units, k, first)
        chunk = range_hashes(data, starts[opening], ends[last])[0][of]
        yield a, raw, edges, starts, first, owner[first], chunk.view(np.int64), runs(units, words, k)[first].view(np.int64)


def _in_several(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys several documents have, and the smallest id that has them (``first``); rows are moved once."""
    rows = rows.where(F.col(keys[0]).isNotNull()).repartition(*keys)
    found = rows.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id").isNull()).alias("nameless"))
    found = found.where((F.col("first") != F.col("last")) | ((F.col("nameless") > 0) & F.col("first").isNotNull()))
    return rows.join(found.select(*keys, "first"), list(keys))


def duplicates(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """(id, marks): the digests of a document's grams that an earlier document has."""
    if min_words < 2:
        raise ValueError("a passage has two words at least")
    kind, of, wanted = dict(docs.dtypes)[doc_id], docs.columns.index(doc_id), docs.columns.index(text)
    key, shared = spare(docs, "id", "chunks")

    def chunked(batches):
        for batch in batches:
            for a, _, _, _, _, owner, named, _ in grams(batch.column("text"), min_words):
                fresh = np.ones(len(named), dtype=bool)
                fresh[1:] = (named[1:] != named[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(a + owner[fresh])), pa.array(named[fresh])], ["id", "chunk"])

    def listed(batches):
        for batch in batches:
            marks = batch.column(batch.num_columns - 1)
            for a, _, edges, _, _, owner, named, digests in grams(batch.column(wanted), min_words):
                cuts, hit = np.searchsorted(owner, np.arange(len(edges))), np.zeros(len(owner), dtype=bool)
                for i in range(len(edges) - 1):
                    own = slice(cuts[i], cuts[i + 1])
                    hit[own] = np.isin(named[own], marks[a + i].values.to_numpy(zero_copy_only=False))
                ids = batch.column(of).take(pa.array(a + owner[hit]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(digests[hit]), pa.array(named[hit].astype(np.int32))], ["id", "digest", "more"])

    cut = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(chunked, f"id {kind}, chunk long")
    hits = _in_several(cut, "chunk").groupBy("id").agg(F.collect_set("chunk").alias(shared)).withColumnRenamed("id", key)
    # all columns go along, so that the texts moved for this join serve for the last one too
    found = docs.join(hits, docs[doc_id].eqNullSafe(hits[key])).drop(key)
    # half of the chunk's digest goes with that of the gram, 96 bits that tell two grams apart
    rows = found.mapInArrow(listed, f"id {kind}, digest long, more int")
    later = _in_several(rows, "digest", "more").where(~F.col("id").eqNullSafe(F.col("first")))
    return later.groupBy("id").agg(F.collect_set("digest").alias("marks"))


def spans(first: np.ndarray, k: int, starts: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Byte ranges, in the text from lo to hi, of the words in the grams that start at the words ``first``, in their order."""
    breaks = np.flatnonzero(np.diff(first) > k) + 1
    out = []
    for group in np.split(first, breaks):
        a, after = int(group[0]), int(group[-1]) + k
        begin = int(starts[a]) if a and starts[a - 1] >= lo else lo
        out.append((begin, min(hi, int(starts[after])) if after < len(starts) else hi))
    return out


def remove_repeats(docs: DataFrame, min_words: int = 20, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` without their repeated passages; ``count`` names a column for the number of passages taken out."""
    key, marks = spare(docs, "id", "marks")
    found = duplicates(docs, min_words, doc_id, text).select(F.col("id").alias(key), F.col("marks").alias(marks))
    joined = docs.join(found, docs[doc_id].eqNullSafe(found[key]), "left").drop(key)
    schema = StructType(list(docs.schema.fields))
    if count:
        schema = schema.add(count, "long")
    names, place = [f.name for f in schema.fields], docs.columns.index(text)

    def shorten(batches):
        for batch in batches:
            texts, wanted = batch.column(place), batch.column(batch.num_columns - 1)
            hit = np.flatnonzero(wanted.is_valid().to_numpy(zero_copy_only=False))
            new, counts = {}, np.zeros(len(batch), dtype=np.int64)
            for a, raw, edges, starts, first, owner, _, digests in grams(texts.take(pa.array(hit)), min_words):
                cuts = np.searchsorted(owner, np.arange(len(edges)))
                for j in range(len(edges) - 1):
                    i, own = int(hit[a + j]), slice(cuts[j], cuts[j + 1])
                    marked = first[own][np.isin(digests[own], wanted[i].values.to_numpy(zero_copy_only=False))]
                    if not len(marked):
                        continue
                    at, kept = int(edges[j]), []
                    for lo, hi in spans(marked, min_words, starts, int(edges[j]), int(edges[j + 1])):
                        kept.append(raw[at:lo])
                        at, counts[i] = hi, counts[i] + 1
                    new[i] = (b"".join(kept) + raw[at : edges[j + 1]]).decode()
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            if new:
                values = texts.to_pylist()
                for i, value in new.items():
                    values[i] = value
                columns[place] = pa.array(values, texts.type)
            if count:
                columns.append(pa.array(counts))
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(shorten, schema)
