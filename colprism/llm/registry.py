"""Registered queries of the operators for training data, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.llm import annsearch, audit, decontam, hmm, langid, mixing, packing, pii, secrets, simhash, suffixdedup, trie, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, archived, normalised and read back."""
    found = warc.archived(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, folder, "documents"))


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Where documents hold a benchmark text, with few edits."""
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), least=1)


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that passages of 200 bytes repeat."""
    return suffixdedup.summary(suffixdedup.remove_repeats(table(spark, folder, "documents")))


@query
def op5_hmm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Likelihood of every document under the hidden Markov model and under word counts."""
    return hmm.score(table(spark, folder, "documents"))


@query
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: counts, digest and spans."""
    return secrets.summary(secrets.find_secrets(table(spark, folder, "documents")))


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the mix of sources takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query
def op8_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with personal data replaced."""
    docs = table(spark, folder, "documents")
    return pii.replace_entities(docs).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest embeddings of every 50th."""
    return annsearch.nearest(table(spark, folder, "embeddings"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every shared beginning of the rebuilt conversations."""
    return trie.prefix_trie(table(spark, folder, "conversations"))


SQL["op11_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS source, xor(list_reduce(
      list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))),
      4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT convs.conv_id, 0 AS lane, pos, role, text FROM convs JOIN turns ON turns.conv_id = source AND pos < h
  UNION ALL
  SELECT conv_id, 1, pos, role, text FROM convs JOIN turns USING (conv_id) WHERE pos >= h
), paths AS (
  SELECT conv_id, coalesce(list({r: role, t: text} ORDER BY lane, pos) FILTER (lane IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), steps AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths
), nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth) AS ends
  FROM steps GROUP BY 1, 2
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), valued AS (
  SELECT *, coalesce(n_children, 0) AS children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].t, '[^ 	-]+')) END AS saves
  FROM nodes LEFT JOIN children USING (node)
), above AS (
  SELECT saves, children, node, unnest(range(depth + 1)) AS up FROM valued
), below AS (
  SELECT node[1:up] AS node, sum(saves) AS saved_tokens, sum((children = 0)::INT) AS n_leaves FROM above GROUP BY 1
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.children AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN below USING (node)
LEFT JOIN nodes p ON v.depth > 0 AND p.node = v.node[1:v.depth - 1]
"""


@query
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"))


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes, in every order, for each language."""
    return audit.audit(audit.failure_masks(table(spark, folder, "documents"), table(spark, folder, "labels")))


SQL["op13_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), marked AS (
  SELECT doc_id, part,
    (len(words) < 200)::INT
    + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM texts
), given AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM marked LEFT JOIN given USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), places AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::BIGINT AS earlier
  FROM places
), counted AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (mask & (own + coalesce(earlier, 0)) = 0) AS kept,
    sum(n) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) = 0) AS removed,
    sum(n) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) > 0) AS redundant,
    sum(n) FILTER (mask = own) AS unique_fails,
    sum(good) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) = 0) AS good_lost,
    sum(bad) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0) = 0) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step,
  coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""
