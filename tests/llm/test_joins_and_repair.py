"""Conversation repair, hard negatives and top-k search against plain versions, and their corner cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import catalog, conversation_repair as repair, hard_negatives, topk_join, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- conversations


def plain_repair(turns):
    """(cost, edits, lines) by dynamic programming over all edits, the smallest string among the cheapest."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def offer(to, cost, edits, lines):
        if to not in states or (cost, edits) < states[to][:2]:
            states[to] = (cost, edits, lines)

    def insertions():
        for _ in range(3):
            for s, (cost, edits, lines) in list(states.items()):
                for r in "ua":
                    if (s, r) in after:
                        offer(after[s, r], cost + 5, edits + "I", (*lines, f"{name[r]}:"))

    for role, text, fault in turns:
        insertions()
        held, states = states, {}
        for s, (cost, edits, lines) in held.items():
            offer(s, cost + 2, edits + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (s, role[:1]) in after:
                offer(after[s, role[:1]], cost + more, edits + "K", (*lines, f"{role}:{text}"))
            for r in "ua":
                if (s, r) in after:
                    offer(after[s, r], cost + more + 1, edits + "R", (*lines, f"{name[r]}:{text}"))
    insertions()
    return min(states[s] for s in ("", "a") if s in states)


def plain_digests(conversations, damage=True):
    out, by = {}, {}
    for conv, turn, role, text in conversations:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20 if damage else 9
        if how == 0:
            continue
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        by[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, judged = set(), []
        for _, role, text in turns:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t[0] for t in turns if t[0] is not None]
        cost, edits, lines = plain_repair(judged)
        count = {f: sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = count | {"conv_id": conv, "gaps": gaps, "illegal": illegal, "cost": cost, "audit": edits, "repaired_sha256": digest}
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def talk(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "u", "Assistant", None]
    texts = ["Yes.", "No", "", " \n", "Why? ", "x ", "so\n.", None, "\x0bwell!\t", "ö"]
    return [(r.choice([None, *range(n)]), r.choice(roles[: 3 + seed % 6]), r.choice(texts) if r.random() < 0.6 else f"t{r.randrange(n)}.") for _ in range(n)]


@pytest.fixture(scope="module")
def talks():
    rows = [(conv, *t) for conv in range(150) for t in talk(conv, conv % 13 + 1)]
    rows += [(None, *t) for t in talk(3, 9)] + [(900, 1, "user", "a. " * 30_000), (900, 2, "assistant", "b" * 50_000)] + [(901, None, None, None)] * 3
    return rows + rows[:20]


def test_repair_equals_a_plain_version(spark, talks):
    given = spark.createDataFrame(talks, CONVERSATIONS).selectExpr("*", "'x' AS place", "1 AS edits", "2 AS fault")
    found = {r["conv_id"]: r for r in rows(repair.digests(repair.edits(catalog.damaged(given)), given))}
    assert found == plain_digests(talks)
    found = {r["conv_id"]: r for r in rows(repair.digests(repair.edits(given), given))}
    assert found == plain_digests(talks, damage=False)


def test_repair_of_empty_tables_and_dropped_conversations(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.digests(repair.edits(none), none).count() == 0
    one = spark.createDataFrame([(7, 1, "user", "a")], CONVERSATIONS)
    out = rows(repair.digests(repair.edits(none), one))
    assert [(r["conv_id"], r["gaps"], r["cost"], r["audit"]) for r in out] == [(7, 0, 0, "")] and out[0]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repaired_turns_follow_the_edits(spark):
    given = spark.createDataFrame([(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello!"), (1, 3, "assistant", "cut"), (1, 4, "user", "Bye."), (1, 4, "user", "Bye.")], CONVERSATIONS)
    edited = repair.edits(given)
    left = [(r["role"], r["text"]) for r in sorted(rows(repair.repaired(edited)), key=lambda r: (r["place"], r["step"]))]
    cost, edits, lines = plain_repair([("system", "Be kind.", None), ("assistant", "Hello!", None), ("assistant", "cut", "truncated"), ("user", "Bye.", None), ("user", "Bye.", "duplicate")])
    assert [f"{a}:{b}" for a, b in left] == list(lines)
    assert "".join(r["edits"] for r in sorted(rows(edited), key=lambda r: r["place"])) == edits and sum(r["cost"] for r in rows(edited)) == cost


@pytest.mark.parametrize("size", [1, 4, 5])
def test_repair_of_sliced_conversations(spark, tiny_groups, monkeypatch, size, talks):
    """A conversation longer than a slice is chained over maps of slices, with the same result."""
    monkeypatch.setattr(repair, "SLICE", size)
    long = [(5000, i, *talk(i, 4)[i % 4][1:]) for i in range(120)] + [t for t in talks if t[0] is None or t[0] < 40]
    given = spark.createDataFrame(long, CONVERSATIONS)
    found = {r["conv_id"]: r for r in rows(repair.digests(repair.edits(given), given))}
    assert found == plain_digests(long, damage=False)


def test_block_tables_equal_steps():
    known, r = repair.tables(), random.Random(2)
    for n in (0, 1, 2, 3, 7, 30):
        codes = np.array([r.randrange(len(repair.SYMBOLS)) for _ in range(n)], dtype=np.int64)
        at = list(range(len(known.vectors)))
        for c in codes[::-1]:
            at = [int(known.step[a, c]) for a in at]
        assert known.map_of(codes).tolist() == at


# ---- vectors


def cloud(n, dims=12, seed=4, copies=0):
    r = np.random.default_rng(seed)
    data = [(i, [float(x) for x in v], int(i % 4)) for i, v in enumerate(r.normal(0, 0.3, (n, dims)).astype(np.float32))]
    return data + [(n + i, data[7][1], int(i % 2)) for i in range(copies)]


ODD = [(10_000, None, 1), (10_001, [None, 1.0], 1), (10_020, [float("nan")] * 12, 0), (10_040, [float("inf"), 0.0], 2), (None, [1.0] * 12, 0), (10_100, [], 1), (10_060, [0.5, -0.25], 2), (10_080, [1.0] * 12, None)]


def usable(data):
    seen = {}
    for i, v, label in data:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            seen[i, tuple(v), label] = None
    return list(seen)


def scaled(v, scale, dims=12):
    return np.pad(np.floor(np.array(v, dtype=float) * scale), (0, dims - len(v)))


def plain_top(data, k):
    held, out = usable(data), []
    grid = np.array([scaled(v, 64) for _, v, _ in held])
    for i, (own, _, _) in enumerate(held):
        if own % 20 == 0:
            scores = grid @ grid[i]
            order = [j for j in sorted(range(len(held)), key=lambda j: (-scores[j], held[j][0])) if j != i][:k]
            out += [(own, n + 1, held[j][0], int(scores[j])) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("size", [{}, {"query_rows": 3, "data_rows": 40, "pivots": 9}, {"pivots": 1}])
def test_top_k_equals_brute_force(spark, size):
    data = cloud(300, copies=60) + ODD + cloud(40)[:40]
    df = spark.createDataFrame(data, VECTORS).selectExpr("*", "1 AS score", "'x' AS cell", "2 AS key").repartition(5)
    found = topk_join.top_k(df, F.col("vec_id") % 20 == 0, k=6, **size)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(found)) == plain_top(data, 6)


def test_top_k_rules_cells_out(spark):
    """Tight, far clusters: a group of queries asks for few of the cells, and the result is still exact."""
    r = np.random.default_rng(8)
    centres = r.normal(0, 1, (12, 12))
    data = [(i, [float(x) for x in (centres[i % 12] / np.linalg.norm(centres[i % 12]) + r.normal(0, 0.004, 12)).astype(np.float32)], 0) for i in range(600)]
    asked = []
    plain = topk_join._visits

    def watched(*args):
        groups, visits = plain(*args)
        asked.append((len({g[1] for g in groups}), len(visits), len(args[2])))
        return groups, visits

    topk_join._visits, found = watched, None
    try:
        found = topk_join.top_k(spark.createDataFrame(data, VECTORS), F.col("vec_id") % 20 == 0, k=3, query_rows=4)
        assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in rows(found)) == plain_top(data, 3)
    finally:
        topk_join._visits = plain
    groups, visits, cells = asked[0]
    assert visits < 0.6 * groups * cells


def test_top_k_of_small_and_empty_tables(spark):
    few = spark.createDataFrame([(20, [1.0, 2.0], 0), (3, [1.0, 0.0], 0)], VECTORS)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk_join.top_k(few, F.col("vec_id") % 20 == 0))] == [(20, 1, 3, 4096)]
    assert topk_join.top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk_join.top_k(few.limit(1).where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(20, [3e38, 1.0], 0), (1, [3e38, 1.0], 0), (2, [-3e38, 0.0], 0)], VECTORS)
    assert [(r["vec_id"], r["score"]) for r in rows(topk_join.top_k(huge, F.col("vec_id") % 20 == 0))] == [(1, vectors.LONG), (2, -vectors.LONG)]


def plain_negatives(data, anchor, k=5, n=10):
    held, out = [h for h in usable(data) if h[2] is not None], []
    grid = np.array([scaled(v, 256) for _, v, _ in held])
    for i, (own, _, label) in enumerate(held):
        if own % anchor:
            continue
        scores = grid @ grid[i]
        order = sorted(range(len(held)), key=lambda j: (-scores[j], held[j][0]))
        for p in [j for j in order if j != i and held[j][2] == label][:k]:
            fits = [j for j in order if held[j][2] != label and 30 * scores[p] <= 100 * scores[j] <= 90 * scores[p]][:n]
            out += [(own, held[p][0], m + 1, held[j][0], int(scores[p]), int(scores[j])) for m, j in enumerate(fits)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("size", [{}, {"anchor_rows": 4, "data_rows": 50}])
@pytest.mark.parametrize("sample", [hard_negatives.SAMPLE, 12])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, size, sample):
    """With a sample of a few rows, first thresholds are poor and several rounds are run."""
    monkeypatch.setattr(hard_negatives, "SAMPLE", sample)
    data = cloud(400, copies=60) + ODD + [(600 + i, [float(i == j) for j in range(12)], 9) for i in range(3)] + cloud(40)[:40]
    df = spark.createDataFrame(data, VECTORS).selectExpr("*", "1 AS key", "'x' AS low", "3 AS steps").repartition(5)
    found = hard_negatives.mine(df, F.col("vec_id") % 25 == 0, **size)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows(found)) == plain_negatives(data, 25)


def test_hard_negatives_of_empty_tables(spark):
    df = spark.createDataFrame(cloud(60), VECTORS)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
    assert hard_negatives.mine(df.withColumn("label", F.lit(1)), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df.withColumn("label", F.col("vec_id").cast("int")), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("threshold", [-np.inf, -50.0, 0.0, 40.0, 200.0, 1e6])
def test_an_index_loses_no_row_that_reaches_the_threshold(threshold):
    r = np.random.default_rng(5)
    data = np.floor(r.normal(0, 6, (500, 20)) * (r.random((500, 1)) < 0.8) * r.random((500, 1)))
    anchors = np.floor(r.normal(0, 6, (20, 20)))
    index = hard_negatives.Index.of(data, vectors.norms(anchors).max(), threshold)
    for q in anchors:
        assert set(np.nonzero(data @ q >= threshold)[0]) <= set(index.reaching(q, threshold).tolist())
    if threshold == 200.0:
        assert (index.postings != 0).sum() < 0.9 * (data != 0).sum() and len(index.reaching(anchors[0], threshold)) < 250
