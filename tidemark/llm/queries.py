"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.automaton import bpe_digests
from tidemark.llm.exactdedup import exact_dedup
from tidemark.llm.linededup import line_dedup, page_line_dedup
from tidemark.llm.middle import fill_in_middle
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.outliers import quality_outliers
from tidemark.llm.packing import pack_documents
from tidemark.llm.pieces import piece_digests, token_counts
from tidemark.llm.sharding import assign_shards
from tidemark.llm.substring import substring_dedup
from tidemark.llm.toxicity import toxicity
from tidemark.llm.whitening import whiten

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).toDF("doc_id", "text", "n_sentences", "n_removed")


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"))


def op3_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host."""
    return page_line_dedup(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents")).drop("pieces")


def line_dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents, which have no address: their source is the site."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs, F.col("source")).toDF("doc_id", "source", "text", "n_lines", "n_dropped")


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_virtual_slots, op3_mcd_outliers, op4_token_counts, op5_exact_dedup, op6_toxicity, op7_pieces, op8_near_dedup, op9_packing, op10_line_dedup, op11_whitening, op12_bpe_automaton, op13_fill_in_middle, line_dedup_by_source)
}

LINE_DEDUP_SQL = """
WITH pages AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(source, chr(1)) AS site,
         string_split(text, chr(10)) AS all_lines FROM {docs}
), lines AS (
  SELECT r, doc_id, site, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS i FROM pages
), counts AS (
  SELECT site, line, count(DISTINCT r) AS n FROM lines
  WHERE length(trim(line, ' ' || chr(9) || chr(13))) > 0 GROUP BY ALL
), drops AS (
  SELECT site, line FROM counts JOIN (SELECT site, count(*) AS pages FROM pages GROUP BY site) USING (site)
  WHERE n >= 5 AND n > 0.1 * pages
), kept AS (
  SELECT r, count(*) AS n_lines, count(d.line) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE d.line IS NULL), '') AS text
  FROM lines l LEFT JOIN drops d USING (site, line) GROUP BY r
)
"""

PAGE_LINES_SQL = r"""(
  SELECT page_id AS doc_id, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS source,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:html|head|title|body|p|div|h[1-6]|ul|ol|li|dl|dt|dd|br|hr|pre|table|tr|td|th|nav|header|footer|section|article|aside|main|form|blockquote)(?:[\x20\x09-\x0D/][^>]*)?>', chr(10), 'g'),
           '</?[a-zA-Z][^>]*>|<![^>]*>', '', 'g') AS text
  FROM pages
)"""

SQL = {
    "op5_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
""",
    "line_dedup_by_source": LINE_DEDUP_SQL.format(docs="documents")
    + """SELECT p.doc_id, p.source, CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM pages p LEFT JOIN kept k USING (r)
""",
    "op10_line_dedup": LINE_DEDUP_SQL.replace("WITH pages AS", "WITH sited AS").replace("FROM pages", "FROM sited").format(docs=PAGE_LINES_SQL)
    + """SELECT p.doc_id AS page_id, p.source AS host, CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM sited p LEFT JOIN kept k USING (r)
""",
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
""",
}
