"""The training-data operators against plain versions, and the corner cases that their docstrings name."""

import contextlib
import hashlib
import io
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyward.llm import catalog, decontaminate, imatch, near_dups, packing, segments, sharding, sketching, substring_dedup, token_counts, toxicity, url_filter, warc

DOCS = "doc_id long, text string"
WORDS = "amber basin cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north oasis pinto quarry ridge shoal tarn".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


CORNERS = [(1, None), (2, ""), (3, "one"), (4, "Ä Öl\n x  y "), (None, "no id at all here"), (5, "a " * 40_000), (6, "same text"), (7, "same text"), (7, "same text")]


@pytest.fixture(scope="module")
def corners(spark):
    return spark.createDataFrame(CORNERS, DOCS).selectExpr("*", "'x' AS id", "'y' AS marks", "7 AS shard", "1 AS verdict")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_url_filter(spark):
    urls = ["http://Example.com/en/1", "https://www.example.com/en/a?q=/x", "http://a.net/es/", "http://net/fr/x#y", "http://b.org/z", "no host", None, "http://xexample.com/en/", "http://example.com", "http://example.com/de/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS h")
    rules = url_filter.rule_table(spark, catalog.URL_RULES)
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter.judge(pages, rules))}
    assert out[0] == ("example.com", "/en/1", "example.com/en/", "block")
    assert out[1][2:] == ("www.example.com/en/", "allow")
    assert [out[i][2:] for i in (2, 3, 4, 5, 6)] == [("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert out[7][2:] == ("com/", "allow") and out[8] == ("example.com", "", None, "allow") and out[9][2] == "com/"
    assert url_filter.judge(pages, rules).count() == 11
    assert {r["verdict"] for r in rows(url_filter.judge(pages, rules.limit(0)))} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_sharding(spark, corners, nothing):
    docs = spark.createDataFrame([(i, prose(i, i % 90)) for i in range(400)] + [(1000 + i, "copy") for i in range(150)], DOCS)
    out = rows(sharding.shard_by_bytes(docs, 8))
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert len(out) == 550 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    text = dict((i, prose(i, i % 90)) for i in range(400))
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in out if r["doc_id"] < 400)
    assert len(rows(sharding.shard_by_bytes(corners, 40))) == len(CORNERS) and sharding.shard_by_bytes(nothing, 3).count() == 0


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", "", None, "ü" * 70_000, "<p>b</p>"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(pages, folder, file_bytes=100)
    back = {int(r["id"]): r for r in rows(warc.read_archives(files, folder))}
    assert len(back) == 6 and bytes(back[4]["payload"]).decode() == html[4] and back[0]["type"] == "revisit" and back[0]["refers"] == "1"
    out = {r["page_id"]: r for r in rows(warc.round_trip(pages, f"file://{tmp_path}/v"))}
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert out[i]["payload_bytes"] == len(data) and out[i]["payload_digest"] == warc.base32(hashlib.sha1(data).hexdigest())
    assert [out[i]["record_type"] for i in range(6)] == ["revisit", "response", "revisit", "response", "response", "response"]
    assert out[2]["refers_to"] == 3 and out[1]["refers_to"] is None
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/e").count() == 0
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, None, b"x", warc.base32("00" * 20), "response", None))


def test_warc_of_odd_ids(spark, tmp_path):
    ids = ["a\r\nWARC-Type: response", "", None, "100% >ä", "b", "b", "last"]
    pages = spark.createDataFrame([(i, "http://x/", h) for i, h in zip(ids, ["x", "y", "x", "z", "z", "z", None])], "page_id string, url string, html string")
    pages = pages.selectExpr("*", "1 AS id", "'q' AS digest", "'r' AS type")
    out = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(pages, f"file://{tmp_path}/o")))
    assert out == sorted([(ids[0], "response", None), ("", "response", None), ("None", "revisit", ids[0]), ("100% >ä", "revisit", "b"), ("b", "response", None), ("b", "response", None), ("last", "response", None)])
    schema = "id string, type string, url string, refers string, digest string, bytes long"
    kept = [("1", "response", None, None, "D", 3), ("2", "revisit", None, "1", "D", 3)]
    warc.check_revisits(spark.createDataFrame(kept, schema))
    for wrong in (("2", "revisit", None, "1", "D", 4), ("2", "revisit", None, "1", "E", 3), ("2", "revisit", None, "2", "D", 3)):
        with pytest.raises(ValueError):
            warc.check_revisits(spark.createDataFrame([kept[0], wrong], schema))


def test_warc_dictionary_of_many_payloads(spark):
    """The sample stays small where one payload holds a third of the rows."""
    many = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot payload' ELSE concat('<p>payload of page ', id, '</p>', repeat('common part ', 20)) END AS html")
    assert 0 < len(warc.train_dictionary(many, "html")) <= warc.DICTIONARY_BYTES


def test_token_counts(spark, corners, nothing):
    import sentencepiece

    path = catalog._tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    texts = ["".join(r.choice(["a", " ", "  ", "the", "ing", "\n", "▁", "é", "日", "😀", "<s>", "7", ".", "Th"]) for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += [prose(1, 300), "z" * 9000, "", "x" * 5000 + " y"]
    assert token_counts.count_texts(pa.array(texts), path).tolist() == [len(x) for x in model.encode(texts)]
    out = rows(token_counts.token_counts(corners, path))
    assert sorted(x["n_tokens"] for x in out) == sorted(len(model.encode(t or "")) for _, t in CORNERS)
    assert token_counts.token_counts(nothing, path).count() == 0


def test_token_counts_of_composed_parts(monkeypatch):
    import sentencepiece

    path = catalog._tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    texts = ["z" * 901, "x" * 333 + "yz" * 200, "日本語" * 90, "".join(r.choice("aeinorst") for _ in range(3000)), "".join(r.choice("theing日é😀") for _ in range(2000))]
    texts += ["-" * 777, "=" * 64 + "a" + "=" * 500]
    wanted = [len(x) for x in model.encode(texts)]
    machine = token_counts.Transducer(path)
    for chunk in (1, 7, 64, 100):
        for most in (token_counts.MOST_STATES, 20):
            monkeypatch.setattr(token_counts, "CHUNK", chunk)
            monkeypatch.setattr(token_counts, "MOST_STATES", most)
            assert [machine.count("▁" + t) for t in texts] == wanted
            machine.clear()
    # composing the maps of two parts equals running through both
    left, right = token_counts.Span(machine, "internat"), token_counts.Span(machine, "ional")
    both = token_counts.Span(machine, halves=(left, right))
    for state in [machine.states[0], machine.through(machine.states[0], "an")[0]]:
        assert both.at(state) == machine.through(state, "international")


def test_packing(spark, corners, nothing):
    from tokenizers import Tokenizer

    path = catalog._tokenizer("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = {i: prose(i, i * 7 % 500) for i in range(300)} | {900: "a <|endoftext|> b", 901: " lead", 902: "x\n \ny  z ", 903: None, 904: "  q   r"}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    out = sorted(rows(packing.pack(docs, path, window=256)), key=lambda r: (r["doc_id"], r["start"]))
    for i, text in texts.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = [r for r in out if r["doc_id"] == i]
        assert [(r["start"], r["length"]) for r in own] == [(s, min(256, len(ids) - s)) for s in range(0, len(ids), 256)]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert sum(r["length"] for r in out) / (256 * len(by)) > 0.95
    assert packing.pack(corners, path).select("doc_id").count() >= len(CORNERS) and packing.pack(nothing, path).count() == 0


def test_toxicity(spark, corners, nothing):
    data = [(i, prose(i, 60) + (" vile7 rotten9" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([d[:2] for d in data], DOCS)
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in rows(toxicity.judged(docs, labels))}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert {i for i, r in out.items() if r["held_out"]} == {d[0] for d in held}
    assert np.mean([out[d[0]]["predicted"] == d[2] for d in held]) > 0.95
    kept = {r["doc_id"] for r in rows(toxicity.clean_documents(docs, labels))}
    assert np.mean([(d[0] in kept) == (d[2] == 0) for d in data]) > 0.95
    model = toxicity.train(docs, labels)
    out = rows(toxicity.score(corners, model))
    assert len(out) == len(CORNERS) and all(0 <= r["score"] < 1 for r in out)
    # the stage keeps the very rows that score below the cut, nulls, repeats and clashing columns included
    mixed = docs.unionByName(spark.createDataFrame(CORNERS + CORNERS[:2], DOCS)).selectExpr("*", "1 AS h", "doc_id AS whole", "'p' AS Prefix")
    below = sorted(str(r["doc_id"]) for r in rows(toxicity.score(mixed, toxicity.train(mixed, labels))) if r["score"] < toxicity.CUT)
    stage = toxicity.clean_documents(mixed, labels)
    assert stage.columns == mixed.columns and sorted(str(r["doc_id"]) for r in rows(stage)) == below
    assert all(r["whole"] == r["doc_id"] and r["h"] == 1 for r in rows(stage))
    assert toxicity.clean_documents(nothing, labels).count() == 0
    assert toxicity.judged(nothing, labels).count() == 0 and toxicity.judged(docs, labels.limit(0)).count() == 1200


def test_toxicity_leaves_no_network_of_a_round(spark):
    """The driver keeps a file for each network it has sent until that is destroyed."""
    data = [(i, prose(i, 60) + (" vile7 rotten9" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame([d[:2] for d in data], DOCS), spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, toxic int")
    held = spark.sparkContext._temp_dir
    before = set(os.listdir(held))
    model = toxicity.train(docs, labels)
    left = sum(os.path.getsize(os.path.join(held, f)) for f in set(os.listdir(held)) - before)
    assert isinstance(model, toxicity.Model) and left < sum(v.nbytes for v in model.parameters())
    # the stage hands bucket numbers to Python, not the rows
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        toxicity.clean_documents(docs, labels).explain()
    assert "ArrowEvalPython" in plan.getvalue() and "MapInArrow" not in plan.getvalue()


def peak_of(work):
    tracemalloc.start()
    out, peak = work(), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_a_worker_holds_little_for_a_batch():
    """A batch of 2,000,000 shingles, and of 500,000 words: some MB at a time, and what it is worth row by row."""
    sizes = np.full(5000, 400)
    values = np.random.default_rng(1).integers(-(2**62), 2**62, sizes.sum())
    batch = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
    bands, peak = peak_of(lambda: near_dups._bands(batch))
    assert peak < 60e6
    some = near_dups._bands(batch.slice(4000, 3))
    assert bands.slice(4000, 3).to_pylist() == some.to_pylist()

    model = toxicity.Model(np.arange(0, 3000), np.arange(0, 3000), {}, 0)
    words, offsets = (values[:500_000] % 4000).astype(np.int32), np.arange(0, 500_001, 250)
    p, peak = peak_of(lambda: toxicity.in_parts(model.probability, words, words, offsets))
    assert peak < 40e6
    # a shard's training holds the rows of its own words, and moves those as if it held all
    whole, ends, y = words[:2000] % 90, np.arange(0, 2001, 20), (np.arange(100) % 3 == 0).astype(float)
    memory = [np.full(v.shape, 1e-3, np.float32) for v in model.parameters()]
    own, held, places, kept = model.to_train(memory, whole, whole)
    assert [len(t) for t in own.tables] == [91, 91] and [len(m) for m in held[:2]] == [91, 91]
    changed = own.fit(places, ends, y, held, 1)
    assert len(model.tables[0]) == 3001 and changed[0].any()
    model.fit(model.rows(whole, whole), ends, y, memory, 1)
    assert all(np.array_equal(t[ids], o) for t, ids, o in zip(model.tables, kept, own.tables)) and np.array_equal(model.out, own.out)
    assert all(np.array_equal(m[ids], h) for m, ids, h in zip(memory, kept, held))


def test_pipeline_takes_small_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for held, wanted in (("10000", "2000"), ("0", "2000"), ("300", "300")):
            spark.conf.set(name, held)
            corpus_pipeline.small_batches(spark)
            assert spark.conf.get(name) == wanted
    finally:
        spark.conf.unset(name)


def test_parts_are_judged_as_the_whole():
    model = toxicity.Model(np.arange(0, 3000), np.arange(0, 3000), {}, 0)
    words, offsets = np.random.default_rng(2).integers(0, 4000, 500_000).astype(np.int32), np.arange(0, 500_001, 250)
    p = toxicity.in_parts(model.probability, words, words, offsets)
    assert np.allclose(p[1500:1504], model.probability(words[375_000:376_000], words[375_000:376_000], offsets[:5]), atol=1e-6)



def plain_groups(texts, k):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    home = {i: i for i in sets}

    def top(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                home[y] = x
    return {i: top(i) for i in sets}


def test_near_duplicates(spark, corners, nothing):
    texts = {}
    for i in range(40):
        texts[i] = prose(i, 80)
    for i in range(40, 160):  # copies of a few texts with one to six words changed, many at the edge of the threshold
        words, r = texts[i % 4].split(), random.Random(i)
        for _ in range(r.randrange(7)):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {200: None, 201: "", 202: "Hi", 203: "hi"}
    for k in (2, 5):
        out = {r["doc_id"]: r["component_id"] for r in rows(near_dups.near_duplicates(spark.createDataFrame(list(texts.items()), DOCS), words=k))}
        assert out == plain_groups(texts, k)
    kept = rows(near_dups.one_of_each(corners, words=2))
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "2", "3", "4", "None", "5", "6"]) and set(kept[0]) == set(corners.columns)
    assert near_dups.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_an_id_with_two_texts(spark):
    def changed(i, at):
        words = prose(i, 120).split()
        words[at] = f"new{at}"
        return " ".join(words)

    # document 1 has a near copy of each of its two texts, and a third text that stands alone
    texts = [(1, prose(1, 120)), (1, prose(2, 120)), (1, prose(3, 120)), (2, changed(1, 60)), (3, changed(2, 60)), (4, prose(4, 120)), (5, None), (5, changed(4, 9))]
    for order in (texts, texts[::-1]):
        out = rows(near_dups.near_duplicates(spark.createDataFrame(order, DOCS), words=2))
        assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 4), (5, 4), (5, 5)]
    named = spark.createDataFrame([(str(i), t) for i, t in texts], "doc_id string, text string")
    assert sorted(r["component_id"] for r in rows(near_dups.near_duplicates(named, words=2))) == ["1"] * 5 + ["4", "4", "5"]


def test_sketch_agreement():
    r = np.random.default_rng(1)
    pool = r.integers(-(2**62), 2**62, 300)
    a, b = pool[:260], pool[40:]
    s = sketching.sketch(np.concatenate((a, b, pool[:1], pool[:0])), [260, 260, 1, 0], 2048)
    assert abs((s[0] == s[1]).mean() - 220 / 300) < 0.05 and (s[2] != s[3]).all()


def test_substring_dedup(spark, corners, nothing):
    passage = prose(99, 60)
    texts = [(i, f"{prose(i, 40)} {passage} {prose(1000 + i, 30)}") for i in range(1, 5)] + [(9, prose(9, 200)), (10, f"{prose(9, 200)} tail"), (11, f"{prose(11, 50)} {prose(99, 12)} end")]
    out = {r["doc_id"]: r for r in rows(substring_dedup.remove_repeats(spark.createDataFrame(texts, DOCS).selectExpr("*", "1 AS marks"), count="cut"))}
    given = dict(texts)
    assert out[1]["text"] == given[1] and out[9]["text"] == given[9] and out[11]["text"] == given[11] and out[11]["cut"] == 0
    for i in (2, 3, 4):
        left = out[i]["text"]
        assert sum(w in left.split() for w in set(passage.split())) < 45
        assert out[i]["cut"] == 1 and len(left) < len(given[i]) - 150
        assert prose(i, 40) in left and prose(1000 + i, 30)[20:] in left
    assert len(out[10]["text"]) < 80
    assert substring_dedup.remove_repeats(corners).count() == len(CORNERS) and substring_dedup.remove_repeats(nothing).count() == 0


def plain_repeats(texts, k):
    """(id, text) rows without the words that are in k words in a row of a text with a smaller id."""
    def cut(text):
        return [m.span() for m in re.finditer(r"[^ \t\n\r\v\f]+", text or "")]

    first = {}
    for i, text in texts:
        at = cut(text)
        for j in range(len(at) - k + 1):
            gram = text[at[j][0] : at[j + k - 1][1]]
            first[gram] = min(first.get(gram, (i is None, i)), (i is None, i), key=lambda x: (x[0], x[1] or 0))
    out = []
    for i, text in texts:
        at, gone = cut(text), set()
        for j in range(len(at) - k + 1):
            if first[text[at[j][0] : at[j + k - 1][1]]] != (i is None, i):
                gone |= set(range(j, j + k))
        if gone:
            opens = [0 if j == 0 and 0 in gone else a for j, (a, _) in enumerate(at)] + [len(text)]
            text = text[: opens[0]] + "".join(text[opens[j] : opens[j + 1]] for j in range(len(at)) if j not in gone)
        out.append((i, text))
    return out


def test_gear_chunks():
    def cut(text, k=20):
        for _, raw, _, starts, first, _, named, _ in substring_dedup.grams(pa.array([text]), k):
            return raw, starts, first, named

    def chunks(text):
        return set(cut(text)[3].tolist())

    # runs of 20 words have the same chunk wherever they stand, and no word of it lies outside them
    passage = prose(81, 20)
    seen = {cut(f"{prose(900 + i, i)} {passage} {prose(950 + i, 30 - i)}".strip())[3][i] for i in range(30)}
    assert len(seen) == 1
    # an insertion changes the chunks around it only
    words = prose(82, 5000).split()
    before, after = chunks(" ".join(words)), chunks(" ".join(words[:2500] + ["new"] + words[2500:]))
    assert len(before) > 900 and len(before - after) < 8
    # the hash rolls: shift, add the next word; a cut is the last least of some window
    units = np.random.default_rng(3).integers(0, 1 << 64, 400, dtype=np.uint64)
    memory, width = substring_dedup.reach(20)
    rolled, hashes = 0, []
    for u in units.tolist():
        rolled = ((rolled << 64 // memory) + u) % (1 << 64)
        hashes.append(rolled)
    hashes = hashes[memory - 1 :]
    assert substring_dedup.gear(units, memory).tolist() == hashes
    few = np.random.default_rng(4).integers(0, 5, 300)
    for values in (np.array(hashes, dtype=np.uint64), few):
        for w in (1, 2, 5, 8, 13):
            plain = [max(range(i, i + w), key=lambda j: (-int(values[j]), j)) for i in range(len(values) - w + 1)]
            assert substring_dedup.least(values, w).tolist() == plain
    with pytest.raises(ValueError):
        substring_dedup.duplicates(None, 1, "doc_id", "text")


def test_substring_dedup_keeps_what_no_one_document_has_in_a_row(spark):
    # every small piece of 50 to 52 stands in some earlier document, never 20 words of them in one
    long = prose(7, 300).split()
    texts = [(i, " ".join(prose(2000 + 100 * i + j, 15) + " " + " ".join(long[s : s + 12]) for j, s in enumerate(range(6 * i, 288, 30)))) for i in range(5)]
    texts += [(50, " ".join(long)), (8, "go " * 19), (51, "go " * 300), (9, "\n\t" + "lä  la\n" * 400), (52, "x " + "lä  la\n" * 390 + "y")]
    texts += [(60, prose(60, 80)), (61, prose(61, 20) + " " + " ".join(prose(60, 80).split()[:19]) + " " + prose(62, 9)), (62, prose(60, 80).replace(" ", "  "))]
    texts += [(7, None), (None, prose(60, 30)), (None, prose(63, 40)), (5, " " + prose(63, 40) + " "), (5, prose(63, 40) + " z")]
    out = [(r["doc_id"], r["text"]) for r in rows(substring_dedup.remove_repeats(spark.createDataFrame(texts, DOCS)))]
    by = dict(out)
    assert by[50] == " ".join(long) and by[51] == "go " * 300 and by[62] == dict(texts)[62]
    assert sorted(out, key=str) == sorted(plain_repeats(texts, 20), key=str)


def test_substring_dedup_takes_whole_passages(spark):
    passages = [prose(5000 + n, 20 + n % 40) for n in range(300)]
    texts = [(2 * n + side, f"{prose(6000 + 2 * n + side, 15)} open{side} {p} shut{side} {prose(7000 + 2 * n + side, 12)}") for n, p in enumerate(passages) for side in (0, 1)]
    out = {r["doc_id"]: r for r in rows(substring_dedup.remove_repeats(spark.createDataFrame(texts, DOCS), count="cut"))}
    for n in range(300):
        assert (out[2 * n]["text"], out[2 * n]["cut"]) == (texts[2 * n][1], 0)
        assert out[2 * n + 1]["text"] == f"{prose(6001 + 2 * n, 15)} open1 shut1 {prose(7001 + 2 * n, 12)}" and out[2 * n + 1]["cut"] == 1


def test_decontamination(spark, corners, nothing):
    item = prose(5, 25).split()
    docs = spark.createDataFrame([(1, prose(1, 50) + " " + " ".join(item[3:14]).upper() + " " + prose(2, 9)), (2, prose(3, 60)), (3, "short item here"), (4, " ".join(item))], DOCS)
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "Short, item"), (12, None), (13, "")], "item_id long, text string")
    out = {r["doc_id"]: r for r in rows(decontaminate.contamination(docs, bench))}
    assert (out[1]["n_hit"], out[1]["n_items"], out[2]["contaminated"], out[3]["n_hit"], out[4]["n_hit"]) == (11, 1, False, 2, 25)
    assert out[1]["items_sha256"] == hashlib.sha256(b"10").hexdigest() and out[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["doc_id"] for r in rows(decontaminate.clean_documents(docs, bench))] == [2]
    assert decontaminate.contamination(corners, bench).count() == len(CORNERS) and decontaminate.contamination(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in rows(decontaminate.contamination(docs, bench.limit(0))))


def test_imatch(spark, corners, nothing):
    texts = [(i, prose(i, 80)) for i in range(60)] + [(60, prose(3, 80))]
    out = {r["doc_id"]: r for r in rows(imatch.fingerprints(spark.createDataFrame(texts, DOCS)))}
    assert len(out) == 61 and out[3]["fingerprint"] == out[60]["fingerprint"] != out[4]["fingerprint"]
    for i, text in texts:
        after, half = texts[(i + 1) % 61][1], len(text) // 2
        assert out[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= out[i]["near_next"] <= 1 and 0 <= out[i]["near_edited"] <= 1
    assert np.mean([r["near_edited"] for r in out.values()]) > np.mean([r["near_next"] for r in out.values()])
    assert imatch.fingerprints(corners).count() == len(CORNERS) and imatch.fingerprints(nothing).count() == 0


def plain_imatch(texts, rare=1000, common=10):
    """Fingerprint and words of each text, from the stated rule."""
    words = lambda t: {w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)}
    df, n = {}, len(set(texts))
    for t in set(texts):
        for w in words(t):
            df[w] = df.get(w, 0) + 1

    def prints(t):
        held = {}
        for w in words(t):
            h = hashlib.md5(w.encode()).hexdigest()
            if df.get(w, 0) * rare >= n and df[w] * common <= n:
                held.setdefault(int(h[:2], 16) // 4, set()).add(w)
                if int(h[2:5], 16) < 128:
                    held.setdefault(64 + int(h[2:5], 16) // 4, set()).add(w)
                if int(h[5:9], 16) < 64:
                    held.setdefault(96 + int(h[5:9], 16) // 4, set()).add(w)
            else:
                held.setdefault(112 + int(h[:2], 16) // 4, set()).add(w)
        signs = [hashlib.md5(b" ".join(sorted(w.encode() for w in held[k]))).hexdigest()[:6] if k in held else "-" for k in range(176)]
        return ",".join(signs) if held else "text:" + hashlib.md5(t.encode()).hexdigest()

    return prints


def plain_likeness(a, b):
    if a == b or "text:" in a + b:
        return float(a == b)
    both = [(x == y) if x != "-" or y != "-" else None for x, y in zip(a.split(","), b.split(","))]
    inside = [e for e in both[:112] if e is not None]
    counted = inside if len(inside) >= 16 else inside + [e for e in both[112:] if e is not None]
    return sum(counted) / len(counted)


def test_imatch_equals_a_plain_version(spark):
    r = random.Random(5)
    texts = [prose(i, r.choice([1, 5, 60, 300])) for i in range(120)] + ["", "?!", "Ä ö Ünter-Weg Z9", "x" * 5000, prose(3, 60), prose(3, 60)]
    prints = plain_imatch(texts)
    for ids in (list(range(len(texts))), [f"id-{i:04d}\n" for i in range(len(texts))]):
        kind = "long" if ids[0] == 0 else "string"
        got = {r["doc_id"]: r for r in rows(imatch.fingerprints(spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")))}
        for k, (i, t) in enumerate(zip(ids, texts)):
            after, half = texts[(k + 1) % len(texts)], len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (prints(t), prints(edited)), k
            assert got[i]["near_edited"] == pytest.approx(plain_likeness(prints(t), prints(edited)))
            assert got[i]["near_next"] == pytest.approx(plain_likeness(prints(t), prints(after)))


def test_imatch_in_a_hot_group(spark):
    """Near copies that make up over a tenth of all texts have no term in the band, and are alike all the same."""
    base = prose(99, 150).split()
    near = [(i, " ".join(base[:i % 150] + [f"new{i}"] + base[i % 150 + 1 :])) for i in range(100)]
    copies = [(i, "one text many times over") for i in range(100, 200)]
    out = {r["doc_id"]: r for r in rows(imatch.fingerprints(spark.createDataFrame(near + copies + [(i, prose(i, 100)) for i in range(200, 450)], DOCS)))}
    assert min(out[i]["near_next"] for i in range(99)) > 0.9 and max(out[i]["near_next"] for i in range(199, 449)) < 0.3
    assert all(out[i]["near_next"] == 1.0 for i in range(100, 199)) and len({out[i]["fingerprint"] for i in range(100)}) == 100


def test_words_of_a_batch():
    offsets, codes, words = segments.distinct_words(pa.array(["a b a", "", "b"]))
    assert [[words[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [["a", "b", "a"], [""], ["b"]]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < given.count()
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_toxicity_learns_from_every_label(spark):
    """Several shards train one network; words of every labelled row are counted, and the scores tell the classes apart."""
    data = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(20)) + (f" vile{i % 3} word" if i % 4 == 0 else f" only{i}"), int(i % 4 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    shards = toxicity.labelled(docs, labels, "doc_id", "text", None, 60).groupBy("shard").count().collect()
    assert len(shards) == 15 and sum(r["count"] for r in shards) == 900
    model = toxicity.train(docs, labels, shard_rows=60)
    words = {r["b"] for r in docs.select(toxicity.hashed("text").alias("h")).selectExpr("explode(h.whole) AS b").distinct().collect()}
    assert len(model.tables[0]) == len(words) + 1 > 700
    found = {r["doc_id"]: r["score"] >= toxicity.CUT for r in toxicity.score(docs, model).collect()}
    assert sum(found[i] == bool(y) for i, _, y in data) >= 890
    again = toxicity.train(docs.repartition(7), labels.repartition(3), shard_rows=60)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(model.tables, again.tables))


def test_packing_remembers_words(monkeypatch):
    """A word that an earlier slice had is not encoded again, and the ids are those of the whole text, also when no more can be known."""
    import public_tokenizers

    encoder = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    sent, together = [], encoder.together
    monkeypatch.setattr(encoder, "together", lambda words: sent.append(len(words)) or together(words))
    texts = ["one two three two", "", "two fouré  x one", "three two one two", "odd\tword two"]
    whole = lambda t: encoder.tokenizer.encode(t, add_special_tokens=False).ids
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.batch(pa.array(texts))] == [whole(t) for t in texts]
    assert sent[0] > sent[1] and encoder.words.to_pylist()
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    for part in (texts, [" ".join(f"n{i} two" for i in range(9))], texts):
        assert [ids.tolist() for ids in encoder.batch(pa.array(part))] == [whole(t) for t in part]


def test_near_duplicates_store_no_bands_by_bucket(spark, monkeypatch):
    """Rows of a bucket do not carry the keys of all bands, which a hot group would multiply by its buckets; links stay those of all pairs."""
    kept, settle = [], near_dups.settle
    monkeypatch.setattr(near_dups, "settle", lambda df: kept.append(df.columns) or settle(df))
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base[:k] + [f"x{i}{k}"] + base[k + 1 :]) for i in range(3) for k in range(0, 40, 4)] + ["other words here", "none at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, 2, 80).collect()}
    assert not [c for c in kept if "key" in c and "bands" in c]
    assert set(list(got.values())[:30]) == {0} and got[30] == 30 and got[31] == 31
