"""Cheapest repair of conversations by block tables (the method of the Four Russians).

A turn becomes one of nine symbols: its role's initial (system, user, assistant, other), in capitals where the text breaks off, or
'-' where it must go. The cost of repairing the rest of a conversation is a vector over four states: nothing yet, after system, after
user, after assistant. Less its minimum there are only some dozens of such vectors, so the step over every block of BLOCK symbols is
computed once for each of them and a conversation is a chain of lookups, from its end. To trace, a block is expanded backward from the vector
at its end, and then walked forward with the smallest letter among the edits that keep to the cheapest cost: ties are settled exactly.

A conversation may hold a third of all rows. It is cut into slices of SLICE turns; a slice is a map of vectors and, once these are
known, a map of four states. Both are chained in order of the slices, a stream of short rows, before all slices are traced at
once. Equal turns are counted before any shuffle and travel as one row.

Nulls in role and text are one space. Turns come in order of turn (nulls first), role, text. A null conversation id is a conversation of
its own. Conversations without turns give no row. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.plans.joins import attach
from tallyward.plans.slices import Over, running
from tallyward.session import settle

# What an edit costs, and what a turn that breaks off adds where it stays.
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
# Symbols of turns, and for each state the role that is due, the state after it, and the cost of ending there.
SYMBOLS = "suaxSUAX-"
DUE, AFTER, AT_END = "uuau", (2, 2, 3, 2), (0, 2 * INSERT, INSERT, 0)
BLOCK = 3
SLICE = 8192
BLANK = " \t\n\x0b\x0c\r"


def _kept(state: int, initial: str) -> int | None:
    """State after a turn that keeps its role, None where it may not."""
    if initial == "s":
        return 1 if state == 0 else None
    return AFTER[state] if initial == DUE[state] else None


def _edits(symbol: str, state: int) -> list[tuple[str, int, int, str]]:
    """(letter, cost, state after, role's initial) of the edits that use the symbol up."""
    out = [("D", DELETE, state, "")]
    if symbol != "-":
        stays = BROKEN if symbol.isupper() else 0
        if (to := _kept(state, symbol.lower())) is not None:
            out.append(("K", stays, to, symbol.lower()))
        out.append(("R", REROLE + stays, AFTER[state], DUE[state]))
    return out


def _closed(costs: list[int]) -> tuple[int, ...]:
    for _ in range(2):  # two insertions reach the end from anywhere
        costs = [min(c, INSERT + costs[AFTER[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _before(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    return _closed([min(cost + after[to] for _, cost, to, _ in _edits(symbol, s)) for s in range(4)])


@dataclass(frozen=True)
class Tables:
    """Vectors by number; over each symbol and each block the vector before it and what was taken off; traces by symbol."""

    vectors: list[tuple[int, ...]]
    step: np.ndarray
    block: np.ndarray
    traces: list[list[list[tuple[str, str, int, int]]]]

    def chain(self, codes: np.ndarray, last: int) -> list[int]:
        """Number of the vector at every block border, from the end of the symbols to their start."""
        lead = len(codes) % BLOCK
        blocks = codes[lead:].reshape(-1, BLOCK) @ (len(SYMBOLS) ** np.arange(BLOCK)[::-1])
        at = [last]
        for b in blocks[::-1]:
            at.append(int(self.block[at[-1], b]))
        return at

    def map_of(self, codes: np.ndarray) -> np.ndarray:
        """For every vector at the end of the symbols, the one at their start."""
        lead = len(codes) % BLOCK
        at = np.arange(len(self.vectors))
        for b in (codes[lead:].reshape(-1, BLOCK) @ (len(SYMBOLS) ** np.arange(BLOCK)[::-1]))[::-1]:
            at = self.block[at, b]
        for c in codes[:lead][::-1]:
            at = self.step[at, c]
        return at

    def trace(self, codes: np.ndarray, last: int, state: int) -> tuple[list[tuple[str, str, int]], int]:
        """(letters, initials of roles, cost) for every symbol, and the state at the end."""
        borders, out = self.chain(codes, last), []
        lead = len(codes) % BLOCK
        spans = ([(0, lead, borders[-1])] if lead else []) + [(lead + BLOCK * i, lead + BLOCK * (i + 1), borders[-2 - i]) for i in range(len(borders) - 1)]
        for a, b, at in spans:
            inside = []
            for c in codes[a:b][::-1]:  # the block, backward from the vector at its end
                inside.append((c, at))
                at = int(self.step[at, c])
            for c, after in reversed(inside):
                letters, roles, cost, state = self.traces[after][c][state]
                out.append((letters, roles, cost))
        return out, state


@cache
def tables() -> Tables:
    vectors, number, steps = [AT_END], {AT_END: 0}, []
    for v in vectors:  # grows until no new vector comes up
        steps.append([])
        for symbol in SYMBOLS:
            u = _before(symbol, v)
            u = tuple(c - min(u) for c in u)
            if u not in number:
                number[u] = len(vectors)
                vectors.append(u)
            steps[-1].append(number[u])
    step = np.array(steps)
    block = np.stack([_through(step, codes) for codes in product(range(len(SYMBOLS)), repeat=BLOCK)], axis=1)
    traces = [[[_walk(symbol, v, s) for s in range(4)] for symbol in SYMBOLS] for v in vectors]
    return Tables(vectors, step, block, traces)


def _through(step: np.ndarray, codes: tuple[int, ...]) -> np.ndarray:
    at = np.arange(len(step))
    for c in reversed(codes):
        at = step[at, c]
    return at


def _walk(symbol: str, after: tuple[int, ...], state: int) -> tuple[str, str, int, int]:
    """The smallest letters that use the symbol up at the cheapest cost, the roles they leave, their cost and the state then."""
    before, letters, roles, spent = _before(symbol, after), "", "", 0
    while True:
        options = [(letter, cost, to, role, after[to]) for letter, cost, to, role in _edits(symbol, state)]
        options.append(("I", INSERT, AFTER[state], DUE[state], before[AFTER[state]]))
        letter, cost, to, role, _ = min(o for o in options if o[1] + o[4] == before[state])
        letters, roles, spent, state = letters + letter, roles + (role or "-"), spent + cost, to
        if letter != "I":
            return letters, roles, spent, state


def _at_end(state: int) -> tuple[str, str, int]:
    """Insertions after the last turn."""
    letters, roles, cost = "", "", 0
    while AT_END[state]:
        letters, roles, cost, state = letters + "I", roles + DUE[state], cost + INSERT, AFTER[state]
    return letters, roles, cost


def _codes(symbols: str) -> np.ndarray:
    return np.array([SYMBOLS.index(c) for c in symbols], dtype=np.int64)


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every different turn once with its text; and, without texts, its number of ``copies``, its place, its fault and its symbol.

    Both have ``said`` (conversation, role and text) and ``turn`` to meet by. ``fault`` is that of the first copy: blank, duplicate,
    truncated or null; the other copies of a turn that is not blank are duplicates.
    """
    space = F.lit(" ")
    slim = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    conv_text = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    said = F.concat_ws(":", F.col("conv_id").isNull().cast("string"), F.length(conv_text), F.length("role"), conv_text, "role", "text")
    texts = settle(slim.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("said", F.unhex(F.md5(said))))

    shown = F.rtrim(F.col("text"), F.lit(BLANK))
    ends = F.when(shown == "", "blank").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated")
    values = [
        Over("place", "count", F.lit(1), "before"),
        Over("before", "last", F.col("initial"), "before"),
        Over("turn_before", "last", F.col("turn"), "before"),
        Over("places", "count", F.lit(1), "group"),
    ]
    placed = running(texts.withColumn("initial", F.substring("role", 1, 1)).withColumn("fault", ends), ["conv_id"], ["turn", "role", "text"], values)
    placed = settle(placed.drop("role", "text"))
    placed = attach(placed, placed.groupBy("said").agg(F.min("place").alias("first")), ["said"], ["place"])
    fault = F.when(F.coalesce(F.col("fault") != "blank", F.lit(True)) & (F.col("first") < F.col("place")), "duplicate").otherwise(F.col("fault"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    placed = placed.withColumn("fault", fault).withColumn("symbol", symbol).withColumn("slice", F.floor(F.col("place") / SLICE).cast("long")).drop("first")
    return texts.select("said", "turn", "role", "text"), placed


def _same_slice(a: DataFrame, b: DataFrame):
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a["slice"] == b["slice"])


def _streamed(rows: DataFrame, order: Column, start: int, follow, name: str) -> DataFrame:
    """Chain the ``map`` column over each conversation's slices in order; ``name`` is the value that comes into each slice."""

    def chain(batches):
        conv, at, first = None, start, True
        for b in batches:
            came = []
            for c, values in zip(b.column("conv_id").to_pylist(), b.column("map").to_pylist()):
                if first or c != conv:
                    conv, at, first = c, start, False
                came.append(at)
                at = follow(values, at)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("slice"), pa.array(came, pa.int32())], ["conv_id", "slice", name])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(chain, f"conv_id {kind}, slice long, {name} int")


def edits(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns in their places (see ``turns``) with role, text, ``edits``, ``roles`` and ``cost``.

    ``edits`` holds K(eep), R(erole), D(elete) and I(nsert) in order, insertions before the turn they precede, those at the end with the last
    turn; deletions of further copies are included. ``roles`` has for each edit the initial of the role it leaves, '-' for none.
    """
    texts, all_turns = turns(rows, conv, turn, role, text)
    kind = all_turns.schema["conv_id"].dataType.simpleString()
    in_order = F.array_sort(F.collect_list(F.struct("place", "symbol")))
    slices = all_turns.groupBy("conv_id", "slice").agg(F.array_join(F.transform(in_order, lambda x: x["symbol"]), "").alias("symbols"), (F.first("places") > (F.col("slice") + 1) * SLICE).alias("goes_on"))
    if (all_turns.agg(F.max("slice")).first()[0] or 0) == 0:
        placed = slices.withColumn("last", F.lit(0)).withColumn("state", F.lit(0))
    else:
        placed = _placed(settle(slices), kind)

    def trace(batches):
        known = tables()
        for b in batches:
            letters, roles, costs = [], [], []
            for symbols, last, state, goes_on in zip(*(b.column(c).to_pylist() for c in ("symbols", "last", "state", "goes_on"))):
                done, state = known.trace(_codes(symbols), last, state)
                if not goes_on:
                    done[-1] = tuple(x + y for x, y in zip(done[-1], _at_end(state)))
                letters.append([d[0] for d in done])
                roles.append([d[1] for d in done])
                costs.append([d[2] for d in done])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("slice"), pa.array(letters, pa.list_(pa.string())), pa.array(roles, pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64()))],
                ["conv_id", "slice", "letters", "left", "costs"],
            )

    traced = placed.mapInArrow(trace, f"conv_id {kind}, slice long, letters array<string>, left array<string>, costs array<long>")
    at = (F.col("place") % SLICE).cast("int")
    more = F.when(F.col("places") == F.col("place") + 1, F.length(F.regexp_extract(F.get("letters", at), "[KRD](I*)$", 1))).otherwise(0)
    copies = (F.col("copies") - 1).cast("int")

    def with_copies(col: str, mark: str) -> Column:
        own = F.get(col, at)
        size = F.length(own) - more
        return F.concat(F.substr(own, F.lit(1), size), F.repeat(F.lit(mark), copies), F.substr(own, size + 1, more))

    joined = all_turns.join(traced, _same_slice(all_turns, traced)).drop(traced["conv_id"]).drop(traced["slice"])
    joined = joined.select(*all_turns.columns, with_copies("letters", "D").alias("edits"), with_copies("left", "-").alias("roles"), (F.get("costs", at) + DELETE * copies).alias("cost"))
    back = (joined["said"] == texts["said"]) & joined["turn"].eqNullSafe(texts["turn"])
    return joined.join(texts, back).drop(texts["said"]).drop(texts["turn"]).drop("said", "slice", "symbol")


def _placed(slices: DataFrame, kind: str) -> DataFrame:
    """Slices with ``last``, the vector at their end, and ``state``, the state at their start: two scans over maps."""

    def maps(batches):
        known = tables()
        for b in batches:
            found = [known.map_of(_codes(s)).tolist() for s in b.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("slice"), pa.array(found, pa.list_(pa.int32()))], ["conv_id", "slice", "map"])

    def exits(batches):
        known = tables()
        for b in batches:
            found = [[known.trace(_codes(s), last, state)[1] for state in range(4)] for s, last in zip(b.column("symbols").to_pylist(), b.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("slice"), pa.array(found, pa.list_(pa.int32()))], ["conv_id", "slice", "map"])

    shape, follow = f"conv_id {kind}, slice long, map array<int>", lambda values, at: values[at]

    def with_value(df: DataFrame, values: DataFrame) -> DataFrame:
        return df.join(values, _same_slice(df, values)).drop(values["conv_id"]).drop(values["slice"])

    lasts = settle(_streamed(slices.mapInArrow(maps, shape), F.desc("slice"), 0, follow, "last"))
    slices = settle(with_value(slices, lasts))
    states = settle(_streamed(slices.mapInArrow(exits, shape), F.asc("slice"), 0, follow, "state"))
    return with_value(slices, states)


def repaired(edited: DataFrame) -> DataFrame:
    """conv_id, place, step, edit, role, text of every turn that a repair (see ``edits``) leaves, in order of place and step."""
    steps = edited.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("edits")), lambda i: F.struct(F.substr(F.col("edits"), i, F.lit(1)).alias("edit"), F.substr(F.col("roles"), i, F.lit(1)).alias("left")))).alias("step", "made")).where(F.col("made.edit") != "D")
    role = F.when(F.col("made.edit") == "K", F.col("role")).when(F.col("made.left") == "u", "user").otherwise("assistant")
    return steps.select("conv_id", "place", "step", F.col("made.edit").alias("edit"), role.alias("role"), F.when(F.col("made.edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(edited: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each id of ``conversations``: counts of faults, cost, the edits in order and the digest of the repaired turns.

    A digest is a chain over a conversation's text, so each conversation is streamed through one task in order, of which only
    the state of the digest, sums and the edits' letters are held.
    """
    kind = edited.schema["conv_id"].dataType.simpleString()
    copies, other = F.col("copies"), F.col("copies") - 1
    fault = F.coalesce("fault", F.lit(""))
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    facts = edited.select(
        "conv_id",
        "place",
        "edits",
        "roles",
        "role",
        "text",
        "cost",
        F.col("turn").cast("long").alias("turn"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("turn_before"), F.lit(False))).cast("long").alias("new_turn"),
        F.when(fault == "blank", copies).otherwise(0).alias("blank"),
        F.when(fault == "blank", 0).when(fault == "duplicate", copies).otherwise(other).alias("duplicate"),
        (fault == "truncated").cast("long").alias("truncated"),
        (other + F.when(F.col("before").isNotNull() & ~legal, 1).otherwise(0)).alias("illegal"),
    )
    ids = conversations.select(F.col(conv).alias("conv_id")).distinct().withColumn("place", F.lit(-1).cast("long"))
    every = facts.unionByName(ids, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["gaps", *sums, "audit", "repaired_sha256"]
    shape = pa.schema([("conv_id", edited.limit(0).toArrow().schema.field("conv_id").type), *[(n, pa.int64()) for n in names[:6]], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def stream(batches):
        one = None
        for b in batches:
            out, cols = [], b.to_pydict()
            for i, (c, place) in enumerate(zip(cols["conv_id"], cols["place"])):
                if one is None or c != one.conv:
                    if one is not None:
                        out.append(one.row())
                    one = _Digest(c)
                if place >= 0:
                    one.add({k: v[i] for k, v in cols.items()}, sums)
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)
        if one is not None:
            yield pa.RecordBatch.from_pylist([one.row()], shape)

    return every.mapInArrow(stream, f"conv_id {kind}, gaps long, {', '.join(f'{n} long' for n in sums)}, audit string, repaired_sha256 string")


class _Digest:
    def __init__(self, conv):
        self.conv, self.sums, self.turns, self.low, self.high = conv, {}, 0, None, None
        self.audit, self.hash, self.begun = [], hashlib.sha256(), False

    def add(self, turn: dict, sums: list[str]) -> None:
        for n in sums:
            self.sums[n] = self.sums.get(n, 0) + turn[n]
        self.turns += turn["new_turn"]
        if turn["turn"] is not None:
            self.low, self.high = (turn["turn"] if self.low is None else self.low), turn["turn"]
        self.audit.append(turn["edits"])
        for edit, left in zip(turn["edits"], turn["roles"]):
            if edit != "D":
                role = turn["role"] if edit == "K" else {"u": "user", "a": "assistant"}[left]
                line = f"{role}:{'' if edit == 'I' else turn['text']}"
                self.hash.update(("\n" * self.begun + line).encode())
                self.begun = True

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        empty = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        return {"conv_id": self.conv, "gaps": gaps, **(empty | self.sums), "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}
