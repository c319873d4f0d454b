"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, chat, kneser_ney, langid, media, mixing, simhash, token_files, topk, url_rules
from .common import new_path, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_shards(spark, manifest)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


#: The curated list of op7: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(more)))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_columns(table(spark, sf_dir, "documents")))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4, what SQL can express: sizes and targets."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5, what SQL can express: the digest of what the ids decode to."""
    return op5_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10, what SQL can express: the payload that is read back."""
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_topk": op6_topk,
    "op7_urls": op7_urls,
    "op8_language": op8_language,
    "op9_chat": op9_chat,
    "op10_media": op10_media,
    "mixing_targets": mixing_targets,
    "bpe_decoded": bpe_decoded,
    "media_payloads": media_payloads,
}

#: A control string's first character with its backslashes, and the rest of it.
_CONTROL = r"([<\[]\\*)(\||/?s>|/?INST\])"

ORACLE_SQL: dict[str, str] = {
    "mixing_targets": r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
c AS (SELECT *, 2 * source_size / CAST(w AS DOUBLE) AS stop, coalesce(source, chr(1114111)) AS name FROM w),
l AS (SELECT stop, name, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER b, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM c WINDOW b AS (ORDER BY stop, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT coalesce(arg_min(level, stop), 0) AS level FROM l WHERE level <= stop)
SELECT doc_id, size, source_size, round(least(2 * source_size, w * level), 6) AS target FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source, t""",
    "bpe_decoded": "SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "media_payloads": """
WITH b AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(greatest(1, (octet_length(b) + 63) // 64) * 64 AS BIGINT) AS payload_bytes FROM b)
SELECT doc_id, n_bytes, payload_bytes, sha256(b || unhex(repeat('00', payload_bytes - n_bytes))) AS payload_sha256 FROM n""",
    "op9_chat": rf"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS kind FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant'),
s AS (
  SELECT *, '<|turn|>' || regexp_replace(role, '{_CONTROL}', '\1\\\2', 'g') || '<|body|>' || regexp_replace(text, '{_CONTROL}', '\1\\\2', 'g') || '<|end|>' || chr(10) AS segment FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN kind = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN kind = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, segment), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
    "op6_topk": """
WITH v AS (
  SELECT row_number() OVER () AS i, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.i, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.i <> q.i AND len(q.e) = len(d.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_urls": """
WITH u AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN instr(url, '://') > 0 THEN split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS bare FROM pages),
p AS (SELECT page_id, translate(split_part(bare, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(bare, length(split_part(bare, '/', 1)) + 1) AS path FROM u),
n AS (SELECT host, string_split(host, '.') AS l, len(string_split(host, '.')) AS c FROM (SELECT DISTINCT host FROM p)),
hosts AS (SELECT host, l[c] AS suffix, CASE WHEN c > 1 THEN l[c - 1] || '.' || l[c] ELSE host END AS domain FROM n),
k AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hn AS (SELECT suffix, domain, host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k FROM p JOIN k ON k.doc_id = p.page_id JOIN hosts USING (host) WHERE host <> '' GROUP BY ALL),
dn AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hn GROUP BY ALL),
sn AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM dn GROUP BY ALL),
w AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM sn),
s1 AS (SELECT sn.*, m FROM sn, w),
s2 AS (SELECT 1 / least(0.5, greatest(0.01, coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) - 1 AS a FROM s1),
s3 AS (SELECT suffix, (a * m + k) / (a + n) AS mean, a + n AS t FROM s1, s2),
d1 AS (SELECT dn.*, mean AS m FROM dn JOIN s3 USING (suffix)),
d2 AS (SELECT 1 / least(0.5, greatest(0.01, coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) - 1 AS a FROM d1),
d3 AS (SELECT suffix, domain, (a * m + k) / (a + n) AS mean, a + n AS t FROM d1, d2),
h1 AS (SELECT hn.*, mean AS m FROM hn JOIN d3 USING (suffix, domain)),
h2 AS (SELECT 1 / least(0.5, greatest(0.01, coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5))) - 1 AS a FROM h1),
h3 AS (SELECT host, (a * m + k) / (a + n) AS mean, a + n AS t FROM h1, h2),
b AS (
  SELECT hosts.host, coalesce(h3.mean - 1.645 * sqrt(h3.mean * (1 - h3.mean) / (h3.t + 1)), d3.mean - 1.645 * sqrt(d3.mean * (1 - d3.mean) / (d3.t + 1)), s3.mean - 1.645 * sqrt(s3.mean * (1 - s3.mean) / (s3.t + 1)), 0) > 0.5 AS blocked
  FROM hosts LEFT JOIN h3 USING (host) LEFT JOIN d3 USING (suffix, domain) LEFT JOIN s3 USING (suffix)),
r(rule, h, pre, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
f AS (SELECT p.*, list(struct_pack(n := length(rule), rule := rule, verdict := r.verdict) ORDER BY length(rule) DESC) FILTER (rule IS NOT NULL) AS l
  FROM (SELECT row_number() OVER () AS i, * FROM p) p LEFT JOIN r ON (p.host = h OR p.host LIKE '%.' || h) AND starts_with(p.path, pre) GROUP BY ALL)
SELECT page_id, host, path, l[1].rule AS rule, coalesce(l[1].verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM f JOIN b USING (host)""",
}
