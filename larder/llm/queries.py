"""The registered queries of the operators in this package, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.htmlmain import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from larder.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.embdedup import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from larder.llm.tokenfiles import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256)


def op7_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.mixing import label_domains, mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), weights={"good": 0.8, "poor": 0.2})


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.annsearch import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.prefixtrie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.personal import personal_report

    return personal_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_html_main_text": op2_html_main_text,
    "op3_secret_scan": op3_secret_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_mixing_rates": op7_mixing_rates,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_whitening": op12_whitening,
    "op13_personal_data": op13_personal_data,
}

_OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_reached AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least_reached ON a = d.doc_id
"""

#: The prefix of a sequence is the list of its turns itself; CRC-32 bit by bit.
_OP11_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS digits, 0 AS i, 4294967295::BIGINT AS r FROM turns
  UNION ALL
  SELECT conv_id, digits, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)
  FROM (SELECT conv_id, digits, i, xor(r, CASE WHEN i % 8 = 0 THEN ascii(substr(digits, i // 8 + 1, 1))::BIGINT ELSE 0::BIGINT END) AS x FROM bits WHERE i < 8 * length(digits))
), heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(r, 4294967295::BIGINT) % 4 AS h FROM bits WHERE i = 8 * length(digits)
), joined AS (
  SELECT k.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads k JOIN turns t ON t.conv_id = k.base AND t.pos <= k.h
  UNION ALL SELECT k.conv_id, 1, t.pos, t.role, t.text FROM heads k JOIN turns t ON t.conv_id = k.conv_id AND t.pos > k.h
), lists AS (
  SELECT k.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS ts
  FROM heads k LEFT JOIN joined USING (conv_id) GROUP BY k.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, to_json(ts[1:d])::VARCHAR AS node, CASE WHEN d > 0 THEN to_json(ts[1:d - 1])::VARCHAR END AS parent, d = len(ts) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(ts[d].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS words
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM lists)
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node
), children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
up AS (
  SELECT node AS top, node FROM nodes
  UNION ALL SELECT n.parent, up.node FROM up JOIN nodes n ON n.node = up.top WHERE n.parent IS NOT NULL
), sums AS (
  SELECT top AS node, count(*) FILTER (c.n IS NULL) AS leaves, sum(saved) AS saved FROM up JOIN nodes USING (node) LEFT JOIN children c ON c.node = up.node GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node
"""

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": _OP1_SQL,
    "op11_conversation_trie": _OP11_SQL,
}
