"""The pN_ queries of this subpackage, with the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import leaks, packing, pages, repeats, residue, scans, sentences, spam, splitting
from folioflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 1: noise of scanned pages


@query
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return scans.noise(table(spark, base, "docs"), table(spark, base, "ocr_results"))


@query
def p1_pages(spark: SparkSession, base: str) -> DataFrame:
    return scans.paragraphs(table(spark, base, "docs"), table(spark, base, "ocr_results"))


# 3: lines repeated across one site's documents


@query
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, base, "articles"))


@query
def p3_clean(spark: SparkSession, base: str) -> DataFrame:
    return repeats.without_repeats(table(spark, base, "articles"))


@query
def p3_blocks(spark: SparkSession, base: str) -> DataFrame:
    return repeats.repeated_blocks(table(spark, base, "articles"))


_P3 = r"""
WITH l AS (
  SELECT article_id, coalesce(domain, '') AS domain, unnest(string_split(coalesce(markdown, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(markdown, ''), chr(10)), 1) AS line_no
  FROM articles),
k AS (SELECT article_id, domain, line, line_no, lower(regexp_replace(line, '\P{L}+', '', 'g')) AS x FROM l),
f AS (SELECT domain, x, count(DISTINCT article_id) AS docs FROM k WHERE x <> '' GROUP BY ALL),
s AS (SELECT coalesce(domain, '') AS domain, count(*) AS n FROM articles GROUP BY ALL),
hit AS (SELECT domain, x FROM f JOIN s USING (domain) WHERE docs >= 5 AND docs >= 0.1 * n)
"""
ORACLE["p3_found"] = _P3 + "SELECT article_id, line_no::INTEGER AS line_no FROM k JOIN hit USING (domain, x)"
ORACLE["p3_clean"] = _P3 + (
    "SELECT article_id, coalesce(string_agg(CASE WHEN hit.x IS NULL THEN line END, chr(10) ORDER BY line_no), '') AS text, "
    "count(hit.x)::INTEGER AS n_removed FROM k LEFT JOIN hit USING (domain, x) GROUP BY article_id"
)


# 4: sentences across languages


@query
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences.section_sentences(table(spark, base, "sections")).select("doc_id", "section_id", "para_idx", "char_start")


@query
def p4_docs(spark: SparkSession, base: str) -> DataFrame:
    return sentences.document_sentences(table(spark, base, "docs").dropDuplicates(["id", "markdown"]))


# 5: the main body of web pages


@query
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return pages.label_blocks(table(spark, base, "articles")).filter("NOT body").select("article_id", "line_no")


@query
def p5_body(spark: SparkSession, base: str) -> DataFrame:
    return pages.main_text(table(spark, base, "articles"))


# 6: oversized items


def _pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_reading_items(table(spark, base, "tts_chunks"), table(spark, base, "sections"), table(spark, base, "size_limits"))


@query
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return _pieces(spark, base).select("item_table", "doc_id", "outer_no", "inner_no").distinct()


@query
def p6_pieces(spark: SparkSession, base: str) -> DataFrame:
    return _pieces(spark, base)


ORACLE["p6_found"] = """
WITH lim AS (SELECT target, max_size FROM size_limits WHERE unit = 'characters'),
c AS (
  SELECT DISTINCT 'tts_chunks' AS item_table, doc_id, chunk_idx AS outer_no, 0 AS inner_no, text FROM tts_chunks
  UNION ALL
  SELECT 'sections', doc_id, id, (generate_subscripts(chunks, 1) - 1)::INTEGER, unnest(chunks) FROM sections)
SELECT DISTINCT item_table, doc_id, outer_no, inner_no FROM c JOIN lim ON target = item_table WHERE length(text) > max_size
"""


# 7: template residue and error pages


def _flags(spark: SparkSession, base: str) -> DataFrame:
    return residue.flag_records(table(spark, base, "articles"), table(spark, base, "ocr_results"))


@query
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _flags(spark, base).filter("is_residue").select("record_table", "record_key")


@query
def p7_scores(spark: SparkSession, base: str) -> DataFrame:
    return _flags(spark, base)


# 8: containers of fixed capacity


def _capacity(spark: SparkSession, base: str) -> int:
    """The documents row of size_limits, a table of three rows."""
    return table(spark, base, "size_limits").filter("target = 'documents' AND unit = 'tokens'").agg(F.max("max_size")).first()[0]


@query
def p8_pack(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(table(spark, base, "documents"), _capacity(spark, base))


@query
def p8_bounds(spark: SparkSession, base: str) -> DataFrame:
    return packing.partition_bounds(table(spark, base, "documents"), _capacity(spark, base))


# 9: leaked test passages


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaked(table(spark, base, "documents"), table(spark, base, "eval_items"))


@query
def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).filter(F.col("run") >= leaks.MIN_WORDS).select("doc_id", "item_id")


@query
def p9_overlaps(spark: SparkSession, base: str) -> DataFrame:
    """All overlaps, those with substituted words too."""
    return _leaks(spark, base)


@query
def p9_items(spark: SparkSession, base: str) -> DataFrame:
    """Per test item, the documents that hold it and its longest leaked run."""
    return _leaks(spark, base).filter(F.col("run") >= leaks.MIN_WORDS).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("run").alias("longest"))


_P9 = r"""
WITH w AS (
  SELECT doc_id AS k, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM documents),
v AS (
  SELECT item_id AS k, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM eval_items),
d AS (SELECT k, unnest(list_transform(range(1, len(a) - 10), lambda i: array_to_string(a[i:i + 11], ' '))) AS g FROM w),
e AS (SELECT k, unnest(list_transform(range(1, len(a) - 10), lambda i: array_to_string(a[i:i + 11], ' '))) AS g FROM v)
"""
ORACLE["p9_items"] = r"""
WITH w AS (
  SELECT doc_id AS k, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM documents),
v AS (
  SELECT item_id AS k, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM eval_items),
d AS (SELECT k, unnest(range(1, len(a) - 10)) AS p, unnest(list_transform(range(1, len(a) - 10), lambda i: array_to_string(a[i:i + 11], ' '))) AS g FROM w),
e AS (SELECT k, unnest(range(1, len(a) - 10)) AS p, unnest(list_transform(range(1, len(a) - 10), lambda i: array_to_string(a[i:i + 11], ' '))) AS g FROM v),
m AS (SELECT d.k AS doc_id, e.k AS item_id, d.p, d.p - e.p AS diagonal FROM d JOIN e USING (g)),
r AS (SELECT doc_id, item_id, diagonal, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM m),
n AS (SELECT doc_id, item_id, count(*) + 11 AS run FROM r GROUP BY doc_id, item_id, diagonal, island)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(run)::INTEGER AS longest FROM n GROUP BY 1
"""
ORACLE["p9_found"] = _P9 + "SELECT DISTINCT d.k AS doc_id, e.k AS item_id FROM d JOIN e USING (g)"


# 10: keyword-stuffed and link-list pages


@query
def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return spam.score_documents(table(spark, base, "documents")).filter("is_spam").select("doc_id").distinct()


@query
def p10_scores(spark: SparkSession, base: str) -> DataFrame:
    return spam.score_documents(table(spark, base, "documents"))
