"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import byte_bpe, chat_snapshots, positional_index, rule_quality, simhash, sphere_cells, suffix_dedup, url_filter, warc, wrapper_html
from cellforge.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.render(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH c AS (
  SELECT conv_id, list(struct_pack(turn := coalesce(turn, -4611686018427387904), role := role, text := text) ORDER BY coalesce(turn, -4611686018427387904), role NULLS FIRST, text NULLS FIRST) AS ts,
  FROM conversations GROUP BY conv_id
),
s AS (SELECT conv_id, [struct_pack(role := x.role, text := x.text) FOR x IN ts] AS said FROM c),
p AS (SELECT DISTINCT said[1 : n] AS said FROM (SELECT said, unnest(range(1, len(said))) AS n FROM s)),
k AS (SELECT min(conv_id) AS conv_id FROM s WHERE said NOT IN (SELECT said FROM p) GROUP BY said)
SELECT conv_id, CAST(len(ts) AS BIGINT) AS n_turns,
       array_to_string(['<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10) FOR x IN ts], '') AS rendered
FROM c WHERE conv_id IN (SELECT conv_id FROM k)
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (j // 4), 5) AS INT) >> (15 - 5 * (j % 4))) & 31), 1) FOR j IN range(0, 32)], '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN top END AS refers_to
FROM h
"""


#: A text is kept as good from this score on.
GOOD = 0.7


def op5_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_quality.fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(rule_quality.fold() == rule_quality.HELD_OUT, F.lit(False))
    return rule_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op6_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_html.extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Words that an item's two rarest words may be apart to be near.
NEAR = 10


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=NEAR).drop("hit_ranges")


OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
w AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS len, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS words
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)
),
g AS (
  SELECT n, s, l.len, array_to_string(ws[s : s + l.len - 1], ' ') AS words
  FROM (SELECT n, ws, unnest(range(1, len(ws) + 1)) AS s FROM d), (SELECT DISTINCT len FROM w) l
  WHERE s + l.len - 1 <= len(ws)
),
m AS (SELECT n, s, len, item_id FROM g JOIN w USING (len, words)),
h AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(s, s + len)) AS p FROM m) GROUP BY n),
t AS (SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY n),
tf AS (SELECT word, count(*) AS tf FROM (SELECT unnest(ws) AS word FROM d) GROUP BY word),
r AS (
  SELECT item_id, ws, word, row_number() OVER (PARTITION BY item_id, ws ORDER BY tf, word) AS k
  FROM (SELECT DISTINCT item_id, ws, word FROM (SELECT item_id, ws, unnest(ws) AS word FROM i)) JOIN tf USING (word)
),
o AS (SELECT n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
x AS (
  SELECT a.n, count(DISTINCT r.item_id) AS n_near
  FROM r JOIN r q ON r.item_id = q.item_id AND r.ws = q.ws AND r.k = 1 AND q.k = 2 JOIN o a ON a.word = r.word JOIN o b ON b.n = a.n AND b.word = q.word AND abs(a.pos - b.pos) <= {NEAR}
  GROUP BY a.n
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (n) LEFT JOIN t USING (n) LEFT JOIN x USING (n)
"""


def op10_sphere_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sphere_cells.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Small tables only: SQL compares all pairs.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN CAST(embedding AS DOUBLE[])]) AND list_bool_or([coalesce(x, 0) <> 0 FOR x IN CAST(embedding AS DOUBLE[])]), false) AS ok
  FROM embeddings
),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(first, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(first, vec_id)) AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) c ON c.x = vec_id LEFT JOIN (SELECT x, min(y) AS first FROM r GROUP BY x) f ON f.x = vec_id
"""


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "action string, host string, path string"))


OP9_SQL = f"""
WITH rules(action, host, path) AS (VALUES {", ".join(map(str, URL_RULES))}),
urls AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
fit AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM urls LEFT JOIN fit USING (n)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_byte_bpe": op2_byte_bpe, "op3_chat_snapshots": op3_chat_snapshots, "op4_warc": op4_warc, "op5_rule_quality": op5_rule_quality, "op6_wrapper_html": op6_wrapper_html, "op7_simhash": op7_simhash, "op8_positional_index": op8_positional_index, "op9_url_filter": op9_url_filter, "op10_sphere_cells": op10_sphere_cells}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_snapshots": OP3_SQL, "op4_warc": OP4_SQL, "op8_positional_index": OP8_SQL, "op9_url_filter": OP9_SQL, "op10_sphere_cells": OP10_SQL}
