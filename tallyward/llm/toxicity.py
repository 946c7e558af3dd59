"""Toxicity by a convolutional classifier over hashed word embeddings, trained in numpy.

Each word is hashed twice, whole and by its first letters, and its embedding is the sum of the two hashed rows. Filters of
widths one, two and three run over the whole text, the maximum over all places is kept for each, and a logistic layer
gives a probability. Words that the training rows lack share one row. One dimension of the embeddings starts from the
log-odds of the word's bucket, the others from noise; the log-odds come from other rows than those the network learns from.

The model is fitted on all labelled rows. They are dealt by a hash of the id over shards of about ``SHARD_ROWS``; within a shard, in the
order of the ids, six rows of ten are counted for the log-odds, two train the network and two are held back. Counts are added up over
the shards. In each round every shard takes the network through its own rows once, and the new network is the mean of those of the
shards (a row of a table: of the shards that changed it). The rows held back give, for each language, the probability that best parts
the classes, from counts in ``BINS`` bins; scores are bent so that this probability becomes 0.7. The driver gets counts, bins and the
network, whose sizes do not depend on the number of rows. The language is guessed from the commonest words of the text itself.

Null and empty texts have no words and get the model's score of an empty text, below 0.7. Labels with null values or
without a document are not used; a document with several labels is toxic if one says so. Without any toxic or any clean
training row every score is the share of toxic rows (0 for none at all). Repeated rows get equal scores. An empty table
gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.llm.common import hinted
from tallyward.session import settle

SHARD_ROWS = 12_000
BINS = 1 << 16
BUCKETS = 1 << 20
PREFIX = 4
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.05
CUT = 0.7
# Words that are judged at a time: what a worker holds for them is some hundred bytes each.
PART = 125_000
# Common words by which the language of a text is told; fixed values.
COMMON = {
    "en": "the of and to that is with for was",
    "de": "der die und das zu von mit den ist",
    "fr": "le et les des du une dans qui pour",
    "es": "el y los las que del por con una",
}


def hashed(text: str) -> Column:
    """(whole, prefix): the two bucket numbers of each word."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.struct(
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")).alias("whole"),
        F.transform(words, lambda w: F.pmod(F.xxhash64(F.substring(w, 1, PREFIX), F.lit("prefix")), F.lit(BUCKETS)).cast("int")).alias("prefix"),
    )


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list array."""
    offsets = array.offsets.to_numpy().astype(np.int64)
    return array.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Model:
    """Tables of the buckets seen in training, filters and the logistic layer."""

    def __init__(self, seen_whole: np.ndarray, seen_prefix: np.ndarray, common: dict[int, int], languages: int):
        rng = np.random.default_rng(3)
        self.place = [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]  # row 0: not seen
        self.tables = []
        for place, seen in zip(self.place, (seen_whole, seen_prefix)):
            place[seen] = np.arange(1, len(seen) + 1)
            self.tables.append((rng.normal(0, 0.05, (len(seen) + 1, DIM))).astype(np.float32))
        self.filters = [rng.normal(0, 0.2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0::DIM, : FILTERS // 2] = 1.0  # half of the filters begin by adding up log-odds
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out[: FILTERS // 2] = 0.3
        self.base = np.float32(-2.0)
        self.language = np.full(BUCKETS, -1, np.int8)
        for bucket, lang in common.items():
            self.language[bucket] = lang
        self.languages, self.cuts = languages, np.full(languages, 0.5)

    def pooled(self, rows: tuple[np.ndarray, np.ndarray], offsets: np.ndarray):
        """Pooled responses of each text, the places they come from, and the embeddings."""
        n = len(offsets) - 1
        x = self.tables[0][rows[0]] + self.tables[1][rows[1]]
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        values, places = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1, np.int64)
        if not len(full):
            return values, places, x
        starts = offsets[:-1][full]
        text = np.repeat(np.arange(len(full)), sizes[full])
        for j, w in enumerate(WIDTHS):
            r = np.zeros((len(x), FILTERS), np.float32)
            for k in range(w):  # words beyond the end of a text count as nothing
                part = x[k:] @ self.filters[j][k * DIM : (k + 1) * DIM]
                if k:
                    part[text[k:] != text[: len(text) - k]] = 0
                r[: len(x) - k] += part
            r += self.bias[j]
            top = np.maximum.reduceat(r, starts, axis=0)
            values[full, j * FILTERS : (j + 1) * FILTERS] = np.maximum(top, 0)
            yield_places = places[:, j * FILTERS : (j + 1) * FILTERS]
            if self.training:
                for f in range(FILTERS):
                    at = np.flatnonzero(r[:, f] == top[text, f])
                    first = at[np.unique(text[at], return_index=True)[1]]
                    yield_places[full, f] = np.where(top[:, f] > 0, first, -1)
        return values, places, x

    training = False

    def rows(self, whole: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.place[0][whole], self.place[1][prefix]

    def probability(self, whole: np.ndarray, prefix: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        values, _, _ = self.pooled(self.rows(whole, prefix), offsets)
        return 1 / (1 + np.exp(-np.clip(values @ self.out + self.base, -30, 30)))

    def guess(self, whole: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The language whose common words are most frequent in each text."""
        told, n = self.language[whole], len(offsets) - 1
        counts = np.zeros((n, self.languages), np.int64)
        at = np.flatnonzero(told >= 0)
        np.add.at(counts, (np.searchsorted(offsets, at, side="right") - 1, told[at]), 1)
        return counts.argmax(axis=1) if self.languages else np.zeros(n, np.int64)

    def score(self, whole: np.ndarray, prefix: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities, bent so that the language's cut is at CUT."""
        p = self.probability(whole, prefix, offsets).astype(np.float64)
        cut = self.cuts[self.guess(whole, offsets)]
        return np.clip(np.where(p < cut, p / cut * CUT, CUT + (p - cut) / (1 - cut) * (1 - CUT)), 0, 1)

    def to_train(self, memory: list[np.ndarray], whole: np.ndarray, prefix: np.ndarray) -> tuple[Model, list[np.ndarray], list, list]:
        """A network of its own to train on some words and what it remembers: the tables hold those words' rows only. Also the words' rows in them, and which rows these are."""
        own, kept, rows = copy.copy(self), [], []
        for r in self.rows(whole, prefix):  # the row of unseen words stays the first
            ids, at = np.unique(np.append(np.int32(0), r), return_inverse=True)
            kept.append(ids), rows.append(at[1:].astype(np.int32))
        own.tables = [t[ids] for t, ids in zip(self.tables, kept)]
        own.filters, own.bias, own.out = copy.deepcopy((self.filters, self.bias, self.out))
        held = [m.reshape(-1, DIM)[ids] for m, ids in zip(memory, kept)] + [m.copy() for m in memory[len(kept) :]]
        return own, held, rows, kept

    def parameters(self) -> list[np.ndarray]:
        """Everything that is trained, as views of rows of DIM numbers."""
        return [a.reshape(-1, DIM) for a in (*self.tables, *self.filters, *self.bias, self.out)]

    def fit(self, rows, offsets, labels, memory: list[np.ndarray], turn: int) -> list[np.ndarray]:
        """Take the network through the rows for the ``turn``-th time; returns the rows of the tables that have changed."""
        self.training, rng = True, np.random.default_rng(5)
        for _ in range(turn):
            rng.permutation(len(labels))
        memory = [m.reshape(v.shape) for m, v in zip(memory, (*self.tables, *self.filters, *self.bias, self.out))]
        changed = [np.zeros(len(t), bool) for t in self.tables]

        def move(value, m, grad, at=slice(None)):
            m[at] += grad * grad
            value[at] -= RATE * grad / np.sqrt(m[at])

        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            span = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in own])
            ends = np.concatenate(([0], np.cumsum(offsets[own + 1] - offsets[own])))
            r = (rows[0][span], rows[1][span])
            values, places, x = self.pooled(r, ends)
            p = 1 / (1 + np.exp(-np.clip(values @ self.out + self.base, -30, 30)))
            error = ((p - labels[own]) / len(own)).astype(np.float32)
            back = error[:, None] * self.out[None, :]
            move(self.out, memory[-1], values.T @ error)
            self.base -= RATE * error.sum()
            grad_x = np.zeros_like(x)
            last = np.repeat(ends[1:], np.diff(ends))
            for j, w in enumerate(WIDTHS):
                kernel, step = np.zeros_like(self.filters[j]), np.zeros(FILTERS, np.float32)
                for f in range(FILTERS):
                    c = j * FILTERS + f
                    got = np.flatnonzero(places[:, c] >= 0)
                    at, g = places[got, c], back[got, c]
                    step[f] = g.sum()
                    for k in range(w):
                        ok = at + k < last[at] if len(at) else np.zeros(0, bool)
                        kernel[k * DIM : (k + 1) * DIM, f] = x[at[ok] + k].T @ g[ok]
                        np.add.at(grad_x, at[ok] + k, g[ok, None] * self.filters[j][k * DIM : (k + 1) * DIM, f])
                move(self.filters[j], memory[2 + j], kernel)
                move(self.bias[j], memory[2 + len(WIDTHS) + j], step)
            hit = np.flatnonzero(grad_x.any(axis=1))
            for t in range(2):
                ids, inverse = np.unique(r[t][hit], return_inverse=True)
                g = np.zeros((len(ids), DIM), np.float32)
                np.add.at(g, inverse, grad_x[hit])
                g[ids == 0] = 0  # the row of unseen words stays
                move(self.tables[t], memory[t], g, ids)
                changed[t][ids] = True
        self.training = False
        return changed


def log_odds(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed log-odds of each seen bucket, by documents that have it."""
    # a bucket that few documents have stays near 0 or below
    out = np.log((toxic + 0.2) / max(n1, 1)) - np.log((clean + 2) / max(n0, 1))
    out[toxic < 3] = np.minimum(out[toxic < 3], 0)
    return np.clip(np.concatenate(([0], out)).astype(np.float32), -1, 6)


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, where: Column | None, shard_rows: int) -> DataFrame:
    """(id, toxic, shard, tenth, k, whole, prefix) of every document with a label; ``k`` tells rows of one id apart."""
    known = labels.select(F.col(doc_id).alias("id"), F.col("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    if where is not None:
        known = known.where(where)
    own = docs.select(F.col(doc_id).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    known = settle(known.join(own, "id"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).first()
    known = known.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size["n"] // shard_rows)))).cast("int"))
    # a shard's rows here are ids and labels only, and of bounded number
    known = settle(known.withColumn("place", F.sum("copies").over(W.partitionBy("shard").orderBy("id")) - F.col("copies")))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(hinted(known), "id")
    if (size["most"] or 1) > 1:  # rows of one id take places one after the other
        copy = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("text"))) - 1
        rows = rows.where("copies = 1").unionByName(rows.where("copies > 1").withColumn("place", F.col("place") + copy))
    rows = rows.withColumn("tenth", (F.col("place") % 10).cast("int"))
    return rows.select("id", "toxic", "shard", "tenth", F.xxhash64("text").alias("k"), hashed("text").alias("h")).select("*", "h.*").drop("h")


def _counted(rows: DataFrame) -> pa.Table:
    """(side, bucket, toxic, clean): the documents of six tenths by bucket, for every bucket that occurs; bucket -1 of side 0 is in all."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.concat(F.array_distinct("whole"), F.array(F.lit(-1))).alias("buckets")),
        F.struct(F.lit(1).alias("side"), F.array_distinct("prefix").alias("buckets")),
    )
    each = rows.select("toxic", (F.col("tenth") < 6).cast("int").alias("own"), F.explode(sides).alias("s"))
    each = each.select("toxic", "own", "s.side", F.explode("s.buckets").alias("bucket"))
    counts = each.groupBy("side", "bucket").agg(F.sum(F.col("own") * F.col("toxic")).alias("toxic"), F.sum(F.col("own") * (1 - F.col("toxic"))).alias("clean"))
    return counts.toArrow().combine_chunks().sort_by([("side", "ascending"), ("bucket", "ascending")])


_NUMBERS = [f"v{i}" for i in range(DIM)] + [f"m{i}" for i in range(DIM)]


def _round(rows: DataFrame, model: Model, memory: list[np.ndarray], turn: int) -> None:
    """Every shard trains from the same network; the means of what they end at become the network."""
    shared = rows.sparkSession.sparkContext.broadcast((model, memory))

    def train_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("k", "ascending")]).combine_chunks()
        (whole, offsets), (prefix, _) = (flat(table[c].chunk(0)) for c in ("whole", "prefix"))
        own, held, places, kept = shared.value[0].to_train(shared.value[1], whole, prefix)
        changed = own.fit(places, offsets, table["toxic"].to_numpy().astype(np.float64), held, turn)
        parts, at, numbers = [], [], []
        for i, (value, m) in enumerate(zip(own.parameters(), held)):
            ids = np.flatnonzero(changed[i]) if i < len(changed) else np.arange(len(value))
            named = kept[i][ids].astype(np.int64) if i < len(changed) else ids
            parts.append(np.full(len(ids), i, np.int32)), at.append(named), numbers.append(np.hstack((value[ids], m.reshape(-1, DIM)[ids])))
        base = np.zeros((1, 2 * DIM), np.float32)
        base[0, 0] = own.base
        parts.append(np.full(1, len(held), np.int32)), at.append(np.zeros(1, np.int64)), numbers.append(base)
        numbers = np.concatenate(numbers)
        return pa.table({"part": np.concatenate(parts), "row": np.concatenate(at), **{c: np.ascontiguousarray(numbers[:, i]) for i, c in enumerate(_NUMBERS)}})

    out = rows.groupBy("shard").applyInArrow(train_shard, "part int, row long, " + ", ".join(f"{c} float" for c in _NUMBERS))
    table = out.groupBy("part", "row").agg(*[F.avg(c).cast("float").alias(c) for c in _NUMBERS]).toArrow()
    shared.destroy()  # its file too, which the driver keeps otherwise
    part, row = table["part"].to_numpy(), table["row"].to_numpy()
    numbers = np.stack([table[c].to_numpy() for c in _NUMBERS], axis=1)
    for i, (value, m) in enumerate(zip(model.parameters(), memory)):
        own = part == i
        value[row[own]], m.reshape(-1, DIM)[row[own]] = numbers[own, :DIM], numbers[own, DIM:]
    for b in numbers[part == len(memory), 0]:  # none where no row trains
        model.base = b


def _binned(rows: DataFrame, model: Model) -> pa.Table:
    """(lang, bin, low, high, toxic, clean): the probabilities of the rows held back, counted in bins."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            whole, prefix = batch.column("whole"), batch.column("prefix")
            (words, offsets), (firsts, _) = flat(whole), flat(prefix)
            lang = shared.value.guess(words, offsets).astype(np.int32)
            p = in_parts(lambda w, f, o: shared.value.probability(w, f, o), words, firsts, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(p), batch.column("toxic")], ["lang", "p", "toxic"])

    told = rows.select("whole", "prefix", "toxic").mapInArrow(judge, "lang int, p double, toxic int")
    told = told.groupBy("lang", F.floor(F.col("p") * BINS).cast("int").alias("bin"))
    told = told.agg(F.min("p").alias("low"), F.max("p").alias("high"), F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    out = told.toArrow().combine_chunks()
    shared.destroy()
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS, where: Column | None = None) -> Model | float:
    """The fitted model, or a constant score if one class is missing. ``where`` keeps label rows, by the column ``id``."""
    rows = labelled(docs, labels, doc_id, text, where, shard_rows)
    y = rows.select(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not y["n"] or y["toxic"] in (0, y["n"]):
        return float(y["toxic"] / y["n"]) if y["n"] else 0.0
    spark = docs.sparkSession
    common = spark.range(1).select(*(F.array(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(BUCKETS)).cast("int") for w in COMMON[k].split())).alias(k) for k in COMMON)).first()
    counts = _counted(rows)
    side, bucket, toxic, clean = (counts[c].to_numpy() for c in ("side", "bucket", "toxic", "clean"))
    every = bucket < 0
    n1, n0 = int(toxic[every].sum()), int(clean[every].sum())
    seen = [(side == s) & ~every for s in (0, 1)]
    model = Model(bucket[seen[0]], bucket[seen[1]], {b: i for i, k in enumerate(COMMON) for b in common[k]}, len(COMMON))
    for own, table in zip(seen, model.tables):
        table[:, 0] = log_odds(toxic[own], clean[own], n1, n0) / 2
    kept = settle(rows.where("tenth >= 6"))
    memory = [np.full(v.shape, 1e-3, np.float32) for v in model.parameters()]
    for turn in range(EPOCHS):
        _round(kept.where("tenth < 8"), model, memory, turn)
    bins = _binned(kept.where("tenth >= 8"), model)
    lang, low, high, toxic, clean = (bins[c].to_numpy() for c in ("lang", "low", "high", "toxic", "clean"))
    overall = best_cut(low, high, toxic, clean)
    for k in range(len(COMMON)):
        own = lang == k
        enough = min(toxic[own].sum(), clean[own].sum()) >= 5
        model.cuts[k] = best_cut(low[own], high[own], toxic[own], clean[own]) if enough else overall
    return model


def best_cut(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the gap between bins at which fewest rows of a held-back part are judged wrongly."""
    order = np.lexsort((high, low))
    low, high, toxic, clean = low[order], high[order], toxic[order], clean[order]
    wrong = np.concatenate(([0], np.cumsum(toxic))) + np.concatenate((np.cumsum(clean[::-1])[::-1], [0]))
    below, above = np.concatenate(([0.0], high)), np.concatenate((low, [1.0]))
    ties = np.flatnonzero(wrong == wrong.min())
    k = ties[np.argmax(above[ties] - below[ties])]
    return float(np.clip((below[k] + above[k]) / 2, 0.05, 0.95))


def in_parts(judge, whole: np.ndarray, prefix: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What ``judge`` says of each row, for a bounded number of words at a time."""
    out, a = np.empty(len(offsets) - 1), 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, side="right")) - 1)
        w = slice(offsets[a], offsets[b])
        out[a:b] = judge(whole[w], prefix[w], offsets[a : b + 1] - offsets[a])
        a = b
    return out


def scores(model: Model, whole: pa.Array, prefix: pa.Array) -> np.ndarray:
    """The score of each row of a batch."""
    (whole, offsets), (prefix, _) = flat(whole), flat(prefix)
    return in_parts(model.score, whole, prefix, offsets)


def score(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    if not isinstance(model, Model):
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(float(model)).alias("score"))
    kind, shared = dict(docs.dtypes)[doc_id], docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            out = scores(shared.value, batch.column("whole"), batch.column("prefix"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), hashed(text).alias("h")).select("doc_id", "h.*")
    return rows.mapInArrow(work, f"doc_id {kind}, score double")


def third(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of held-out rows are not learned from."""
    model = train(docs, labels, doc_id, text, where=third("id") != held_out)
    return score(docs, model, doc_id, text).select(
        "doc_id", F.coalesce(third("doc_id") == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not judged toxic."""
    model = train(docs, labels, doc_id, text)
    if not isinstance(model, Model):
        return docs if model < CUT else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # the rows stay with Spark, only bucket numbers go to Python
    def is_clean(h: pa.Array) -> pa.Array:
        return pa.array(scores(shared.value, h.field("whole"), h.field("prefix")) < CUT)

    return docs.where(F.arrow_udf(is_clean, "boolean")(hashed(text)))
