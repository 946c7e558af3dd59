"""Exact token counts of a byte-pair vocabulary by a deterministic transducer whose transitions carry counts.

How a text is cut into pieces by merging the best pair again and again can be found from left to right: the last piece of
every prefix is the one suffix piece that may follow the last piece of what stands before it, and two pieces may follow
each other if merging their joined text gives just these two. So a state need only hold, for each suffix that may still
grow into a piece, the last piece before it and its count relative to here. A transition on a character leads to the next
state and carries the change of the count. States are made when they are first reached, and kept for the whole worker.

No piece has a space after another character (checked when the vocabulary is loaded), so the map of a chunk that begins
with such a space is constant: every state leads to the same state and count. Texts are therefore cut there; each distinct
chunk of a batch runs once, and its counts are added up over the texts by prefix sums. Chunks longer than ``CHUNK``
characters are cut into parts. The map of each part is built by itself, at the states in which the characters before it leave
machines that started nearby (states merge fast, so one of them is nearly always the true one), and the maps are composed
by a scan over neighbours. Where the true state is another one, the part's map is extended by it, so counts are exact.

Null texts are empty and have no tokens. Equal texts have equal counts. Very long texts are never cut short. An empty table
gives an empty result. Only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.segments import distinct_words, slices, sums

SPACE = "▁"
CHUNK = 4096
# Characters before a part, from which its live states are found.
NEARBY = (32, 64)
# States and chunks that a worker keeps; beyond, it starts anew, which costs time only.
MOST_STATES = 200_000
MOST_CHUNKS = 400_000


class Transducer:
    """Counts of a sentencepiece byte-pair model with byte fallback, without special pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score) or not any(model.is_byte(i) for i in ids):
            raise ValueError("the vocabulary has pieces across words, or no byte fallback")
        self.grows = {p[:n] for p in self.score for n in range(1, len(p))}
        self.chars = {c for p in self.score for c in p}
        # the order of merging: characters before any merge, then the pieces by score
        self.rank = {p: i for i, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]), 1)} | dict.fromkeys(self.chars, 0)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.sound = {p for p in self.score if len(p) == 1 or self.merged(p, keep=True) == [p]}
        self.clear()

    def clear(self) -> None:
        # state 0: nothing before that could matter
        start = ("", (0,), (None,), (0,))  # suffix; offsets of its growing ends; last pieces and counts there
        self.ids, self.states, self.moves = {start: 0}, [start], [{}]
        self.known: dict[str, int] = {}

    def merged(self, text: str, keep: bool = False) -> list[str]:
        """The pieces of a short text, by merging; ``keep`` notes of which two the last one was made."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == -np.inf:
                break
            if keep and len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether merging the joined text keeps the two apart.

        The merges that made the two are undone from the latest back. Nothing may join the parts that touch, unless it
        would have come later than the merge undone last (or at the same rank, further right).
        """
        pair = (left, right)
        if (ok := self.pairs.get(pair)) is None:
            a, b, rank, bound, on_left = left, right, self.rank, np.inf, False
            while True:
                across = rank.get(a + b)
                if across is not None and (across < bound or across == bound and not on_left):
                    ok = False
                    break
                if len(a) == 1 and len(b) == 1:
                    ok = True
                    break
                # equal ranks: the left one was merged first, so the right one is undone first
                on_left = rank[a] > rank[b]
                bound = rank[a] if on_left else rank[b]
                if on_left:
                    a = self.halves[a][1]
                else:
                    b = self.halves[b][0]
            self.pairs[pair] = ok
        return ok

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Make the transition of a state on a character: the next state and the change of the count."""
        if char not in self.chars:
            move = (0, len(char.encode("utf-8", "surrogatepass")))
        else:
            suffix, offsets, lasts, counts = self.states[state]
            grown, n, sound = suffix + char, len(suffix), self.sound
            for j in range(len(offsets) - 1, -1, -1):
                piece = grown[n - offsets[j] :]
                if piece in sound and (lasts[j] is None or self.follows(lasts[j], piece)):
                    break
            else:
                raise ValueError(f"no piece ends at {char!r}")
            change, grows = counts[j] + 1, self.grows
            kept = [i for i, d in enumerate(offsets) if grown[n - d :] in grows]
            key = (
                grown[n - offsets[kept[-1]] :] if kept else "",
                (0, *[offsets[i] + 1 for i in kept]), (piece, *[lasts[i] for i in kept]), (0, *[counts[i] - change for i in kept]),
            )
            if (to := self.ids.get(key)) is None:
                to = self.ids[key] = len(self.states)
                self.states.append(key)
                self.moves.append({})
            move = (to, change)
        self.moves[state][char] = move
        return move

    def run(self, state: int, chunk: str) -> tuple[int, int]:
        """The map of a chunk at one state: where it leads and how many tokens it adds."""
        total, moves = 0, self.moves
        for char in chunk:
            state, change = moves[state].get(char) or self.step(state, char)
            total += change
        return state, total

    def count(self, chunk: str) -> int:
        """Tokens of a chunk that begins with a space or stands at the start."""
        if (n := self.known.get(chunk)) is None:
            if len(self.states) > MOST_STATES or len(self.known) > MOST_CHUNKS:
                self.clear()
            if len(chunk) > CHUNK:
                return self.scan([chunk[at : at + CHUNK] for at in range(0, len(chunk), CHUNK)])
            n = self.known[chunk] = self.run(0, chunk)[1]
        return n

    def through(self, state: tuple, part: str) -> tuple[tuple, int]:
        """The map of a part at one state. States are given by what they are, so that they outlive a new start."""
        if len(self.states) > MOST_STATES:
            self.clear()
        if (at := self.ids.get(state)) is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        to, n = self.run(at, part)
        return self.states[to], n

    def scan(self, parts: list[str]) -> int:
        """Tokens of consecutive parts, from the start: their maps, composed two neighbours at a time."""
        start, spans = self.states[0], []
        for before, part in zip(["", *parts], parts):
            spans.append(Span(self, part))
            for live in {self.through(start, before[-n:])[0] for n in NEARBY}:
                spans[-1].at(live)
        while len(spans) > 1:
            paired = [Span(self, halves=(a, b)) for a, b in zip(spans[::2], spans[1::2])]
            spans = paired + spans[2 * len(paired) :]
        return spans[0].at(start)[1]


class Span:
    """The map of a part, or of two neighbours composed: where its live states lead, and how many tokens they add."""

    def __init__(self, machine: Transducer, part: str = "", halves: tuple[Span, Span] | None = None):
        self.machine, self.part, self.halves, self.known = machine, part, halves, {}
        for live in list(halves[0].known) if halves else ():
            self.at(live)

    def at(self, state: tuple) -> tuple[tuple, int]:
        if state not in self.known:
            if self.halves:
                middle, n = self.halves[0].at(state)
                end, more = self.halves[1].at(middle)
                self.known[state] = (end, n + more)
            else:
                self.known[state] = self.machine.through(state, self.part)
        return self.known[state]


_loaded: dict[str, Transducer] = {}


def count_texts(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    machine, out = _loaded[path], np.zeros(len(texts), dtype=np.int64)
    texts = pc.fill_null(texts, "")
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        offsets, codes, words = distinct_words(part)
        counts = np.fromiter((machine.count(SPACE + w) for w in words), dtype=np.int64, count=len(words))
        out[a:b] = sums(counts[codes], offsets)
        # runs of spaces, and spaces at the start, belong to one chunk
        odd = pc.or_(pc.or_(pc.match_substring(part, "  "), pc.match_substring(part, SPACE)), pc.starts_with(part, " "))
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            marked = SPACE + part[int(i)].as_py().replace(" ", SPACE)
            out[a + i] = sum(map(machine.count, re.findall(f"{SPACE}+[^{SPACE}]*", marked)))
        out[a:b][pc.equal(part, "").to_numpy(zero_copy_only=False)] = 0
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    kind = dict(docs.dtypes)[doc_id]

    def work(batches):
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(count_texts(texts, path))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    counted = rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
