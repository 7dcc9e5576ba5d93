"""The registered query of each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagraph.llm import bpe, chat, decontam, linededup, lm, minhash, quality, runs, sharding, tokencount, trie, urlfilter, warc
from mediagraph.llm.common import saved, spread, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=0.8)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.digests(chat.format_conversations(given.unionByName(tricky)))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url_key"), bad.alias("bad"))
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(saved(trie.turn_arrays(table(spark, sf_dir, "conversations")), "turns"))).drop("key")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find_runs(table(spark, sf_dir, "documents"), exponent=4, least=6, change=runs.planted))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_minhash": op3_minhash,
    "op4_warc": op4_warc,
    "op5_attention_lm": op5_attention_lm,
    "op6_chat": op6_chat,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_quality": op8_quality,
    "op9_section_tokens": op9_section_tokens,
    "op10_url_tree": op10_url_tree,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_word_runs": op13_word_runs,
}

OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (SELECT DISTINCT a AS doc_id, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN m ON m.doc_id = s.doc_id
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d
"""

OP6_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), o AS (
  SELECT *, row_number() OVER w AS pos, coalesce(role <> lag(role) OVER w, TRUE) AS first,
    regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS er, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS et
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + CASE WHEN first THEN 24 + length(er) ELSE 7 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""

OP11_SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id
"""

#: CRC-32 by its table of 256 entries; subtrees by the prefixes of each node's smallest member.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS v, 0 AS step FROM range(256) AS r(i)
  UNION ALL SELECT i, xor(v >> 1, 3988292384 * (v & 1)), step + 1 FROM bits WHERE step < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 4 AS h FROM own, crc
), c AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS path FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20
), m AS (SELECT conv_id, len(path) AS n, d, path[1:d] AS key FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM c)),
k AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM m GROUP BY d, key),
p AS (SELECT k.*, a.conv_id AS parent FROM k LEFT JOIN k a ON k.d = a.d + 1 AND k.key[1:k.d - 1] = a.key),
f AS (SELECT m.d, m.key, count(*) FILTER (p.leaf) AS leaves, count(*) FILTER (p.d = m.d + 1) AS children,
    sum(CASE WHEN p.d = 0 THEN 0 ELSE (p.n_convs - 1) * len(regexp_extract_all(p.key[p.d].t, '[^\x20\x09-\x0D]+')) END) AS saved
  FROM p JOIN m ON m.conv_id = p.conv_id AND m.d <= p.d GROUP BY m.d, m.key)
SELECT p.conv_id, CAST(p.d AS BIGINT) AS depth, p.parent AS parent_conv_id, p.n_convs, f.children AS n_children, f.leaves AS n_leaves, CAST(f.saved AS BIGINT) AS saved_tokens, p.ends AS ends_sha256
FROM p JOIN f ON f.d = p.d AND f.key = p.key
"""

ORACLES: dict[str, str] = {
    "op3_minhash": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_chat": OP6_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
