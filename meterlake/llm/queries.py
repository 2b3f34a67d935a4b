"""Queries of this subpackage over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.bpe import encode
from meterlake.llm.fill_in_middle import fill_in_middle
from meterlake.llm.labelled import held_out
from meterlake.llm.language_id import identify_languages
from meterlake.llm.packing import pack_documents
from meterlake.llm.prefix_trie import conversation_trie
from meterlake.llm.quality_classifier import score_quality
from meterlake.llm.quality_rules import judge_quality
from meterlake.llm.secret_scan import joined, scan_secrets
from meterlake.llm.simhash_dedup import near_duplicates
from meterlake.llm.suffix_dedup import repeated_spans
from meterlake.llm.token_counts import count_tokens
from meterlake.llm.topk_search import top_k
from meterlake.llm.url_filters import judge_urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return identify_languages(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scanned = scan_secrets(_read(spark, sf_dir, "documents"))
    return scanned.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode(_read(spark, sf_dir, "documents"), path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_spans(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_packing, op4_language_id, op5_secret_scan, op6_quality_classifier, op7_topk_search, op8_quality_rules, op9_simhash_dedup, op10_bpe, op11_prefix_trie, op12_suffix_array_dedup, op13_fill_in_middle)}


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH u AS (
  SELECT page_id, html, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         CASE WHEN url LIKE '%://%' THEN substr(url, 1, strpos(url, '://') - 1) ELSE '' END AS scheme FROM pages
), p AS (
  SELECT page_id, html, scheme, regexp_extract(rest, '^([^/?#]*)', 1) AS bare,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^#]*?(\?[^#]*)', 1) AS query FROM u
), rules(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""

#: CRC-32 bit by bit: eight shifts for each character of the id.
OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), g AS (
  SELECT c.conv_id, t.i AS pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
), m AS (
  SELECT c.conv_id, c.h, count(g.pos) AS n FROM c LEFT JOIN g USING (conv_id) GROUP BY ALL
), r AS (
  SELECT * FROM g UNION ALL SELECT t.conv_id, t.i - m.h + m.n, t.role, t.text FROM t JOIN m USING (conv_id) WHERE t.i > m.h
), p AS (
  SELECT conv_id, pos AS depth, strlen(text) AS n_bytes,
         sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS node
  FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c
), q AS (
  SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(n_bytes) AS n_bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM q GROUP BY node
), k AS (
  SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY ALL) AS x USING (node)
), s AS (
  SELECT q.node, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.n_bytes) AS saved_tokens
  FROM k JOIN q ON q.conv_id = k.conv_id AND q.depth <= k.depth GROUP BY q.node
)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (node) LEFT JOIN n AS u ON u.node = k.parent
"""

OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), s AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS f FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op7_topk_search": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
