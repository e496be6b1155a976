"""What operators that SQL can't express must keep, for queries whose results it can't give: letters, counts, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import markdown as M
from folioflow.plans.registry import query
from folioflow.sources.tables import table

_LETTERS = r"md5(regexp_replace(lower({}), '[^\p{{L}}]+', '', 'g'))"


def _letters(text: Column) -> Column:
    return F.md5(F.regexp_replace(F.lower(text), r"[^\p{L}]+", "").cast("binary"))


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "markdown", "raw_pages").distinct()


_LINES = r"""l AS (SELECT id, unnest(string_split(markdown, chr(10))) AS s, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM (SELECT DISTINCT id, markdown FROM docs WHERE raw_pages IS NULL)),
f AS (SELECT id, n, s, starts_with(ltrim(s), '```') AS fence, sum(starts_with(ltrim(s), '```')::INTEGER) OVER (PARTITION BY id ORDER BY n) AS k FROM l)"""


@query(rf"""WITH {_LINES} SELECT id, count(*) FILTER (WHERE NOT fence AND k % 2 = 0 AND regexp_matches(trim(s), '^#{{1,6}}\s+.+$'))::INTEGER AS headings, ceil(max(k) / 2.0)::INTEGER AS code,
count(*) FILTER (WHERE NOT fence AND k % 2 = 0 AND starts_with(ltrim(s), '|'))::INTEGER AS table_lines FROM f GROUP BY 1""")
def d07_block_counts(spark: SparkSession, base: str) -> DataFrame:
    """Headings, code blocks and table lines that the block splitter finds in each document."""
    s = _docs(spark, base).filter("raw_pages IS NULL").select("id", F.flatten(F.transform(M.parse_sections(F.col("markdown")), lambda s: s["blocks"])).alias("b"))
    of = lambda kind: F.filter("b", lambda b: b["kind"] == kind)
    lines = F.aggregate(of("table"), F.lit(0), lambda n, b: n + F.size(F.split(b["raw"], "\n", -1)))
    return s.select("id", F.size(of("heading")).alias("headings"), F.size(of("code")).alias("code"), lines.alias("table_lines"))


@query(f"SELECT DISTINCT id, {_LETTERS.format('markdown')} AS letters FROM docs")
def d20_reflow_keeps(spark: SparkSession, base: str) -> DataFrame:
    """Reflow loses no letter and moves none."""
    return _docs(spark, base).select("id", _letters(M.reflow(F.col("markdown"))).alias("letters"))


@query("SELECT DISTINCT id, md5(lower(markdown)) AS same FROM docs")
def d21_capitals_keep(spark: SparkSession, base: str) -> DataFrame:
    """Calming capitals changes nothing but case."""
    return _docs(spark, base).select("id", F.md5(F.lower(M.normalise_capitals(F.col("markdown"))).cast("binary")).alias("same"))


@query(f"WITH d AS (SELECT DISTINCT id, raw_pages FROM docs WHERE raw_pages IS NOT NULL) SELECT id, {_LETTERS.format('array_to_string(raw_pages, chr(10))')} AS letters FROM d")
def d25_join_keeps(spark: SparkSession, base: str) -> DataFrame:
    """Joined pages, less their markers, hold every letter of every page in its order."""
    p = _docs(spark, base).filter("raw_pages IS NOT NULL")
    return p.select("id", _letters(F.regexp_replace(M.join_pages(F.col("raw_pages"))["markdown"], r"(?m)^Page \d+\.$", "")).alias("letters"))


@query(rf"WITH c AS (SELECT doc_id, id AS section_id, unnest(chunks) AS t, generate_subscripts(chunks, 1)::INTEGER - 1 AS pos FROM sections) SELECT doc_id, section_id, pos, {_LETTERS.format('t')} AS letters, true AS short FROM c")
def d30_pieces_keep(spark: SparkSession, base: str) -> DataFrame:
    """Pieces of at most 220 characters hold every letter of their text."""
    c = table(spark, base, "sections").select("doc_id", F.col("id").alias("section_id"), F.posexplode("chunks").alias("pos", "t")).withColumn("p", X.pack_pieces(F.col("t")))
    return c.select("doc_id", "section_id", "pos", _letters(F.array_join("p", "")).alias("letters"), F.forall("p", lambda x: (F.length(x) <= 220) | ~x.contains(" ")).alias("short"))


@query(r"""WITH d AS (SELECT DISTINCT id, markdown FROM docs) SELECT id, 0 AS notes, len(regexp_extract_all(markdown, '(?i)<!--\s*page\s*break\s*-->'))::INTEGER AS breaks FROM d""")
def d17_notes_left(spark: SparkSession, base: str) -> DataFrame:
    """No comment is left but page breaks, of which none is lost; every document gets a comment and a break to lose or keep."""
    md = F.concat("markdown", F.lit("\n\n<!-- image: a cat -->\n\nOther\n\n<!-- note -->\n"))
    left = M.strip_image_notes(md)
    count = lambda p: F.size(F.regexp_extract_all(left, F.lit(p), F.lit(0)))
    return _docs(spark, base).select("id", count(r"(?is)<!--(?!\s*page\s*break\s*-->).*?-->").alias("notes"), count(r"(?i)<!--\s*page\s*break\s*-->").alias("breaks"))


@query("WITH d AS (SELECT DISTINCT id, raw_pages FROM docs WHERE raw_pages IS NOT NULL) SELECT id, range(2, len(raw_pages) + 1)::INTEGER[] AS pages FROM d")
def d24_marked_pages(spark: SparkSession, base: str) -> DataFrame:
    """The pages that have a marker in the joined text, in its order: all but the first."""
    p = _docs(spark, base).filter("raw_pages IS NOT NULL")
    found = F.regexp_extract_all(M.join_pages(F.col("raw_pages"))["markdown"], F.lit(r"(?m)^Page (\d+)\.$"), F.lit(1))
    return p.select("id", F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x > 1).alias("pages"))
