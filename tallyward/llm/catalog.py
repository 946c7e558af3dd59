"""The thirteen operators on their whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import conversation_repair, decontaminate, hard_negatives, imatch, near_dups, packing, sharding, substring_dedup, token_counts, topk_join, toxicity, url_filter, warc
from tallyward.llm.common import LOWER, UPPER, read

# Fixed values of the URL query: action, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SHARDS = 40
WINDOW = 10

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)


@query(
    "op1_url_filter",
    f"""
WITH rules(action, rh, rp) AS (VALUES {_RULES}),
p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
d AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, first(rh || rp ORDER BY length(rh || rp) DESC, action DESC) AS rule,
         first(action ORDER BY length(rh || rp) DESC, action DESC) AS verdict
  FROM d JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
""",
)
def op1_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).drop("url")


@query("op6_sharding")
def op6_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), SHARDS)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(UPPER, LOWER)


@query(
    "op9_benchmark_decontamination",
    rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
n AS (SELECT item_id, w, least({WINDOW}, len(w)) AS size FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM n)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS g
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, s, size FROM grams JOIN win USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), WINDOW)


# A number below 64 from two hexadecimal digits of a term's digest.
def _quarter(place: int) -> str:
    return f"((instr('{imatch.HEX}', substring(h, {place}, 1)) - 1) * 16 + instr('{imatch.HEX}', substring(h, {place + 1}, 1)) - 1) // 4"


_DENSE, _SPARSE = imatch.DENSE, imatch.DENSE + imatch.SPARSE
_INSIDE = (
    f"[{_quarter(1)}, CASE WHEN substring(h, 3, 1) = '0' AND substring(h, 4, 1) < '8' THEN {_DENSE} + {_quarter(4)} END, "
    f"CASE WHEN substring(h, 6, 2) = '00' AND substring(h, 8, 1) < '4' THEN {_SPARSE} + {_quarter(8)} END]"
)


def _likeness(a: str, b: str) -> str:
    def pairs(start: int, end: int) -> str:
        return f"list_filter(list_zip(string_split({a}, ',')[{start}:{end}], string_split({b}, ',')[{start}:{end}]), lambda p: p[1] <> '-' OR p[2] <> '-')"

    inside = pairs(1, imatch.BAND)
    counted = f"CASE WHEN len({inside}) < {imatch.FEW} THEN list_concat({inside}, {pairs(imatch.BAND + 1, imatch.LEXICONS)}) ELSE {inside} END"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN starts_with({a}, 'text:') OR starts_with({b}, 'text:') THEN 0.0::DOUBLE "
        f"ELSE coalesce(len(list_filter({counted}, lambda p: p[1] = p[2]))::DOUBLE / len({counted}), 0) END"
    )


@query(
    "op10_imatch",
    rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents),
e AS (SELECT doc_id, n, text AS own, substring(text, 1, n - n // 2) || substring(nxt, 1, n // 2) AS edited FROM docs),
sides AS (SELECT doc_id, 0 AS side, own AS text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
terms AS (SELECT doc_id, side, unnest(list_distinct({_WORDS})) AS term FROM sides),
texts AS (SELECT DISTINCT own AS text FROM e),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_WORDS})) AS term FROM texts) GROUP BY term),
every AS (SELECT term, md5(term) AS h, coalesce(df, 0) AS df, (SELECT count(*) FROM texts) AS n FROM (SELECT DISTINCT term FROM terms) LEFT JOIN df USING (term)),
lex AS (SELECT term, unnest(CASE WHEN df * 1000 >= n AND df * 10 <= n THEN {_INSIDE} ELSE [{imatch.BAND} + {_quarter(1)}] END) AS l FROM every),
sig AS (SELECT doc_id, side, l, substring(md5(string_agg(term, ' ' ORDER BY encode(term))), 1, 6) AS s
        FROM terms JOIN lex USING (term) WHERE l IS NOT NULL GROUP BY doc_id, side, l),
prints AS (SELECT doc_id, side, array_to_string(list_transform(range({imatch.LEXICONS}), lambda i: coalesce(ss[list_position(ls, i)], '-')), ',') AS fp
           FROM (SELECT doc_id, side, list(l ORDER BY l) AS ls, list(s ORDER BY l) AS ss FROM sig GROUP BY doc_id, side)),
named AS (
  SELECT s.doc_id, s.side, coalesce(fp, 'text:' || md5(s.text)) AS fp
  FROM sides s LEFT JOIN prints p ON s.doc_id = p.doc_id AND s.side = p.side),
j AS (
  SELECT e.doc_id, e.n, e.edited, a.fp AS fa, b.fp AS fb,
         coalesce(lead(a.fp) OVER (ORDER BY e.doc_id), first_value(a.fp) OVER (ORDER BY e.doc_id)) AS fn
  FROM e JOIN named a ON a.doc_id = e.doc_id AND a.side = 0 JOIN named b ON b.doc_id = e.doc_id AND b.side = 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       {_likeness("fa", "fb")} AS near_edited, {_likeness("fa", "fn")} AS near_next FROM j
""",
)
def op10_imatch(spark, sf_dir):
    return imatch.fingerprints(read(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs):
    return packing.pack(docs, _tokenizer("byte_bpe_50k.json"))


@query("op2_packing")
def op2_packing(spark, sf_dir):
    return packed(read(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op4_near_duplicates",
    rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * i >= 80 * (na + nb - i)),
edges AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""",
)
def op4_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


@query("op5_warc")
def op5_warc(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"), warc.archive_folder(spark))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    """Every document with its shortened text and the number of passages taken out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, count="n_removed")


_CRC = (
    "xor(list_reduce(list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT), lambda crc, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda a, z: xor(a >> 1, (a & 1) * 3988292384), xor(crc, x)), 4294967295), 4294967295)"
)
_NEVER = 1_000_000_000


def _edit(state: str, letter: str, cost: str, line: str | None) -> str:
    said = f"list_append(({state}).t, {line})" if line else f"({state}).t"
    return f"{{'c': ({state}).c + {cost}, 'a': ({state}).a || '{letter}', 't': {said}}}"


def _inserted(state: str, role: str) -> str:
    return _edit(state, "I", "5", f"'{role}:'")


_CLOSED = f"""s0 AS e0, s1 AS e1,
  list_min([s2, {", ".join(_inserted(s, "user") for s in ("s0", "s1", "s3"))}]) AS e2,
  list_min([s3, {_inserted("s2", "assistant")}, {", ".join(_inserted(_inserted(s, "user"), "assistant") for s in ("s0", "s1"))}]) AS e3"""


def _used(state: int) -> str:
    def keep(e: str, initial: str) -> str:
        return _edit(e, "K", f"CASE WHEN must OR initial <> '{initial}' THEN {_NEVER} WHEN truncated THEN 5 ELSE 0 END", "role || ':' || text")

    def rerole(e: str, role: str) -> str:
        return _edit(e, "R", f"CASE WHEN must THEN {_NEVER} WHEN truncated THEN 6 ELSE 1 END", f"'{role}:' || text")

    ways = [_edit(f"e{state}", "D", "2", None)]
    ways += {1: [keep("e0", "s")], 2: [w for e in ("e0", "e1", "e3") for w in (keep(e, "u"), rerole(e, "user"))], 3: [keep("e2", "a"), rerole("e2", "assistant")]}.get(state, [])
    return f"list_min([{', '.join(ways)}]) AS s{state}"


def _state(cost: int) -> str:
    return f"{{'c': CAST({cost} AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}}"


def damaged(conversations):
    """The rows of ``conversations`` as the contract of op11 damages them."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("how")).where(F.col("how") != 0)
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


@query(
    "op11_conversation_repair",
    rf"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how FROM conversations),
r AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE how <> 0),
o AS (
  SELECT *, row_number() OVER w AS rn, lag(role[1]) OVER w AS before, role[1] AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, blank OR again AS must, cut AND NOT (blank OR again) AS truncated FROM o),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS rn, {_state(0)} AS s0, {_state(_NEVER)} AS s1, {_state(_NEVER)} AS s2, {_state(_NEVER)} AS s3 FROM r GROUP BY conv_id
  UNION ALL
  SELECT e.conv_id, e.rn, {", ".join(_used(s) for s in range(4))}
  FROM (SELECT f.*, {_CLOSED} FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.rn = dp.rn + 1) e),
ends AS (
  SELECT conv_id, list_min([e0, e3]) AS e FROM (
    SELECT conv_id, {_CLOSED} FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1)),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit,
       sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM i.conv_id
""",
)
def op11_conversation_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.digests(conversation_repair.edits(damaged(conversations)), conversations)


def _vectors(scale: int, label: str = "") -> str:
    return f"""SELECT DISTINCT vec_id{label}, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query(
    "op12_hard_negatives",
    f"""
WITH v AS ({_vectors(256, ", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
)
def op12_hard_negatives(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query(
    "op13_topk",
    f"""
WITH v AS ({_vectors(64)})
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
       c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 20
""",
)
def op13_topk(spark, sf_dir):
    return topk_join.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
