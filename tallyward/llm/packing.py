"""Packing of token sequences by non-negative least squares over a histogram of lengths.

Every document is tokenised, an end id is added, and it is cut at multiples of the window; only its last piece is shorter.
The histogram of piece lengths has at most ``window`` bars, whatever the corpus, and is all that reaches the driver. There
the combinations of at most three lengths that fill the window exactly are listed, non-negative least squares finds how
often each is to be used, the counts are rounded down to what the histogram holds, and the rest is packed longest first
into the smallest space that fits. The plan is turned into slots of each length; the n-th piece of a length, numbered by
(chunk, place in the chunk), takes the n-th slot. Chunks are hashes of the piece and hold a bounded number of rows, so a
length that a third of all pieces have is numbered in many tasks.

Null texts are empty and give one piece, the end id. Rows without an id and repeated rows are packed like any other. Very
long texts are tokenised whole. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.llm.segments import coded_words, slices
from tallyward.session import settle

CHUNK_ROWS = 200_000
# Words encoded at a time, and bytes of text worked on at a time: they bound a worker's memory.
BLOCK_WORDS = 8192
SLICE_BYTES = 16 << 20
# Words, and bytes of them, whose ids a worker remembers.
KNOWN_WORDS, KNOWN_BYTES = 1 << 18, 8 << 20
# White space around a space: there a word's ids can depend on its neighbours.
BLANKS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = f"[{BLANKS}]"
SAFE = re.compile(f"(?<=[^{BLANKS}])(?= [^{BLANKS}])")


class WordIds:
    """Ids of texts by a byte-level tokenizer, encoding the distinct words of a slice together.

    Words without white space are encoded many in one string: each begins with the space before it, where no token crosses. The ids
    of a string are dealt to its words by the bytes that they stand for; a string whose tokens do cross is encoded word by word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = self.tokenizer.get_vocab()  # a character for each byte
        self.bytes_of = np.zeros(max(shown.values(), default=0) + 1, dtype=np.int64)
        self.bytes_of[list(shown.values())] = [len(t) for t in shown]
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.begin, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def remembered(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each word begin and how many they are; only words not known are encoded, and those that come ``often`` become known."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        ids, n = self.together(fresh)
        begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(n) - n))
        flat, sizes = np.concatenate([self.flat, *ids]), np.concatenate((self.sizes, n))
        at[new] = len(self.words) + np.arange(len(new))
        kept = np.flatnonzero(often[new])
        added = fresh.take(pa.array(kept))
        if len(kept) and len(self.words) + len(added) <= KNOWN_WORDS and self.words.nbytes + added.nbytes <= KNOWN_BYTES:
            n, first = n[kept], begin[len(self.words) + kept]
            places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(n) - n))
            self.flat, self.sizes = np.concatenate((self.flat, flat[places])), np.concatenate((self.sizes, n))
            self.words = pa.concat_arrays([self.words.cast(words.type), added])
        return flat, begin[at], sizes[at]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(texts), BLOCK_WORDS):
            block = self.tokenizer.encode_batch_fast(texts[a : a + BLOCK_WORDS], add_special_tokens=False)
            out += [np.array(e.ids, dtype=np.uint32) for e in block]
        return out

    def together(self, words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of words of letters and signs, each with a space before it, end to end; and how many each has."""
        flat, sizes = [], []
        for a in range(0, len(words), BLOCK_WORDS):
            block = words.slice(a, BLOCK_WORDS)
            ends = np.cumsum(pc.binary_length(block).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            text = " " + " ".join(block.to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            reached = np.concatenate(([0], np.cumsum(self.bytes_of[ids])))
            at = np.searchsorted(reached, ends)
            if at[-1] < len(reached) and (reached[at] == ends).all() and reached[-1] == ends[-1]:
                flat.append(ids)
                sizes.append(np.diff(at, prepend=0))
            else:
                own = self.encode([" " + w for w in block.to_pylist()])
                flat += own
                sizes.append(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
        return flat, np.concatenate([np.zeros(0, np.int64), *sizes])

    def batch(self, texts: pa.Array):
        """The ids of each text, in order. Words are cut before single spaces, where tokens never cross."""
        for a, b in slices(texts, SLICE_BYTES):
            part = texts.slice(a, b - a)
            offsets, codes, words = coded_words(part)
            starts = offsets[:-1]
            first, place = np.unique(codes[starts], return_inverse=True)
            codes[starts] = len(words) + place
            plain = pc.invert(pc.or_(pc.match_substring_regex(words, BLANK), pc.equal(pc.binary_length(words), 0))).to_numpy(zero_copy_only=False)
            often = np.bincount(codes, minlength=len(words))[: len(words)] > 1
            flat, starts, counts = self.remembered(words.filter(pa.array(plain)), often[plain])
            own = self.encode([" " + w for w in words.filter(pa.array(~plain)).to_pylist()] + words.take(pa.array(first)).to_pylist())
            n = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            # plain words, then others and the first words of texts
            order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain), len(words) + np.arange(len(first))))
            sizes, begin = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            sizes[order], begin[order] = np.concatenate((counts, n)), np.concatenate((starts, len(flat) + np.cumsum(n) - n))
            flat = np.concatenate([flat, *own, np.zeros(0, np.uint32)])
            odd = pc.match_substring_regex(part, f"{BLANK} | {BLANK}").to_numpy(zero_copy_only=False)
            for i in range(len(part)):
                if odd[i]:
                    yield np.concatenate(self.encode(SAFE.split(part[i].as_py())))
                    continue
                own = codes[offsets[i] : offsets[i + 1]]
                n = sizes[own]
                ends = np.cumsum(n)
                yield flat[np.repeat(begin[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_encoders: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, window: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    kind = dict(docs.dtypes)[doc_id]

    def cut(batches):
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        encoder = _encoders[path]
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.batch(pc.fill_null(batch.column("text"), ""))):
                ids = np.concatenate((ids, end)).astype("<u4")
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    row.append(i), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), total.append(len(ids))
            kept = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, largest first, that sum to the window; 0 fills up shorter combinations."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    found = [(window, 0, 0)] if have[window] else []
    for a in lengths[lengths < window][::-1]:
        b = np.arange(1, min(a, window - a) + 1)
        c = window - a - b
        b, c = b[ok := have[b] & (b >= c) & ((c == 0) | have[c])], c[ok]
        found += zip(np.full(len(b), a).tolist(), b.tolist(), c.tolist())
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def least_squares(combos: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that brings the lengths used by x combinations near ``wanted``: accelerated projected gradient."""
    n = len(wanted)
    used = lambda x: np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=n)[:n] * (np.arange(n) > 0)
    back = lambda r: np.where(np.arange(n) > 0, r, 0)[combos].sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue
        v = back(used(v))
        v /= (norm := np.linalg.norm(v)) or 1
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(used(y) - wanted) / (norm * 1.01), 0)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use the histogram up exactly."""
    left = np.zeros(window + 1, dtype=np.int64)
    for n, count in histogram.items():
        left[n] = count
    total, out = left.sum(), []
    if not total:
        return out
    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        x = least_squares(combos, left / total) * total
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            parts = Counter(int(n) for n in combos[i] if n)
            times = min(int(round(x[i])), *(int(left[n]) // k for n, k in parts.items()))
            if times > 0:
                out.append((tuple(parts.elements()), times))
                for n, k in parts.items():
                    left[n] -= k * times
    # the rest: longest first, into the smallest space that takes it
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(window, 0, -1):
        count = int(left[n])
        while count:
            space = next((s for s in range(n, window) if open_.get(s)), None)
            if space is None:
                per = window // n
                for k, bins in ((per, count // per), (count % per, 1)):
                    if k and bins:
                        open_.setdefault(window - k * n, []).append(((n,) * k, bins))
                break
            held, bins = open_[space].pop()
            take = min(bins, count)
            if take < bins:
                open_[space].append((held, bins - take))
            open_.setdefault(space - n, []).append(((*held, n), take))
            count -= take
    return out + [group for groups in open_.values() for group in groups]


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with the sequence and the offset that it takes there."""
    cut = settle(pieces(docs, path, window, end_id, doc_id, text))
    histogram = {int(r["length"]): r["count"] for r in cut.groupBy("length").count().collect()}  # one row for each length
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = Counter(), 0
    for parts, times in plan(histogram, window):
        at = 0
        for n in parts:
            slots.setdefault(n, []).append((taken[n], sequence, at))
            taken[n] += times
            at += n
        sequence += times
    blocks = docs.sparkSession.sparkContext.broadcast({n: np.array(b, dtype=np.int64) for n, b in slots.items()})

    chunks = max(1, -(-sum(histogram.values()) // CHUNK_ROWS))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    rows = cut.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    # pieces of a length before the chunk: one small row for each chunk and length
    before = rows.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")
    )
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("chunk", "length").orderBy(*order)) - 1)
    ranked = ranked.join(before.drop("n"), ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("chunk", "before")

    def seat(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                block = blocks.value[int(n)]
                at = np.searchsorted(block[:, 0], rank[own], side="right") - 1
                sequence[own], offset[own] = block[at, 1] + rank[own] - block[at, 0], block[at, 2]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = dict(docs.dtypes)[doc_id]
    return ranked.mapInArrow(seat, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
