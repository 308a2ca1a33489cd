"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import ann, chat, decontaminate, interactions, jaccard, minhash, packing, pii, quality, repair, training_order, urls, warc
from spindrift.llm.common import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, score_all=False)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"'\\### Assistant: </turn> ok'"
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, {said} AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.render_conversations(turns))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    index = warc.write(table(spark, sf_dir, "pages"), path)
    return warc.fetch(index, path).drop("url")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).scores


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "training-order")
    training_order.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return training_order.read_spans(spark, path)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.report(repair.repair(damaged, dropped="dropped"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(interactions.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_nearest": op1_nearest,
    "op2_url_filter": op2_url_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat_format": op4_chat_format,
    "op5_pack": op5_pack,
    "op6_jaccard": op6_jaccard,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_training_order": op9_training_order,
    "op10_pii": op10_pii,
    "op11_repair": op11_repair,
    "op12_minhash": op12_minhash,
    "op13_filter_audit": op13_filter_audit,
}

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"regexp_extract_all(translate(text, {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
bm AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS run FROM bm, unnest(range(1, len(ws) - m + 2)) AS u(i)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, i AS start, m, array_to_string(ws[i:i + m - 1], ' ') AS run FROM d, lens, unnest(range(1, len(ws) - m + 2)) AS u(i)),
hit AS (SELECT DISTINCT doc_id, start, m, item_id FROM dw JOIN win USING (m, run)),
pos AS (SELECT doc_id, count(DISTINCT start + k) AS n_hit FROM hit, unnest(range(0, m)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ESCAPED = r"replace(replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), '<|', '\<|')"
OP4_SQL = rf"""
WITH own AS (SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '\### Assistant: </turn> ok' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM own)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || replace({ESCAPED.format('role')}, ':', '\:') || ':' || chr(10) || {ESCAPED.format('text')} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

SPACES = r"[^\x20\x09-\x0D]"
OP11_SQL = rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(str_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS bytes FROM conversations),
hurt AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
  lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS code FROM given),
times AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t FROM hurt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '({SPACES})[\x20\x09-\x0D]*$', 1) AS ending FROM times),
faulty AS (SELECT *, CASE WHEN ending = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
gap(state, nxt, ins) AS (VALUES ('-', 's', 0), ('-', 'u', 0), ('-', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'a', 0), ('u', 'u', 1), ('a', 'u', 0), ('a', 'a', 1)),
way AS (SELECT conv_id, pos, g.state, 'D' AS edit, g.state AS nxt, 2 AS price, CAST([] AS VARCHAR[]) AS wrote FROM faulty, (VALUES ('-'), ('s'), ('u'), ('a')) AS g(state)
  UNION ALL
  SELECT conv_id, pos, g.state, repeat('I', ins) || CASE WHEN left(role, 1) = nxt THEN 'K' ELSE 'R' END, nxt, 5 * ins + CASE WHEN left(role, 1) = nxt THEN 0 ELSE 1 END + CASE fault WHEN 3 THEN 5 ELSE 0 END,
    list_concat(CASE WHEN ins = 1 THEN [CASE nxt WHEN 'a' THEN 'user:' ELSE 'assistant:' END] ELSE [] END,
      [CASE WHEN left(role, 1) = nxt THEN role WHEN nxt = 'a' THEN 'assistant' ELSE 'user' END || ':' || text])
  FROM faulty, gap AS g WHERE fault NOT IN (1, 2) AND (left(role, 1) = nxt OR nxt <> 's')),
plan AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '-' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT conv_id, pos, state, cost, audit, lines FROM (
    SELECT p.conv_id, w.pos, w.nxt AS state, p.cost + w.price AS cost, p.audit || w.edit AS audit, list_concat(p.lines, w.wrote) AS lines
    FROM plan AS p JOIN way AS w ON w.conv_id = p.conv_id AND w.pos = p.pos + 1 AND w.state = p.state
    QUALIFY row_number() OVER (PARTITION BY p.conv_id, w.nxt ORDER BY p.cost + w.price, p.audit || w.edit) = 1)),
ended AS (SELECT conv_id, cost + CASE state WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END AS cost, audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
    list_concat(lines, CASE state WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END) AS lines
  FROM plan SEMI JOIN (SELECT conv_id, max(pos) AS pos FROM plan GROUP BY conv_id) AS last USING (conv_id, pos)),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
pairs AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faulty),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM best LEFT JOIN counted USING (conv_id)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS earliest FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > earliest THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM j GROUP BY part, fails),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS x, left(filter_order, step - 1) AS earlier FROM orders, range(1, 6) AS r(step)),
told AS (SELECT *, contains(fails, x) AS failed, translate(fails, earlier, '') = fails AS reached FROM counted, steps),
out AS (SELECT part, filter_order, step, x,
  CAST(coalesce(sum(n) FILTER (reached AND NOT failed), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (reached AND failed), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (failed AND NOT reached), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = x), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (reached AND failed), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (reached AND failed), 0) AS BIGINT) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM out
"""



def jaccard_sql(n: int, percent: int, *more: str) -> str:
    """Components of the links between sets of n-word shingles, from all pairs that share one."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {UPPER_LOWER}), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS token FROM d, unnest(range(1, greatest(len(ws) - {n - 1}, least(len(ws), 1)) + 1)) AS u(i)),
sizes AS (SELECT doc_id, count(*) AS m FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY a, b),
links AS (SELECT a, b FROM met JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.m + y.m - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(m, 0) AS n_shingles, component_id{''.join(f', {x}' for x in more)} FROM found LEFT JOIN sizes USING (doc_id)
"""


OP6_SQL, OP12_SQL = jaccard_sql(4, 85), jaccard_sql(5, 85, "doc_id = component_id AS kept")
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op4_chat_format": OP4_SQL, "op6_jaccard": OP6_SQL, "op7_warc": OP7_SQL, "op11_repair": OP11_SQL, "op12_minhash": OP12_SQL, "op13_filter_audit": OP13_SQL}
