"""Queries over documents as they are created, renamed, edited and read, and over settings and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import editing as E
from folioflow.operators import library as L
from folioflow.operators import sequences as S
from folioflow.operators import settings
from folioflow.operators.common import ranked
from folioflow.plans.library import ITEMS, SENTENCES
from folioflow.plans.registry import query
from folioflow.plans.texts import SLUG
from folioflow.sources.tables import table

DOCS = "d AS (SELECT DISTINCT id, title, slug, markdown, raw_pages FROM docs)"


def _docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "title", "slug", "markdown", "raw_pages").distinct()


@query(f"""WITH {DOCS}, n AS (SELECT doc_id AS id, count(*) AS n_sections, list(heading ORDER BY sections.id) AS headings FROM sections GROUP BY 1)
SELECT id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, {SLUG.format(c="coalesce(nullif(trim(title), ''), 'Untitled')")} AS slug, n_sections::INTEGER AS n_sections, headings FROM d JOIN n USING (id) WHERE raw_pages IS NULL""")
def b03_create_from_markdown(spark: SparkSession, base: str) -> DataFrame:
    """Documents made of their Markdown, against the sections that are stored for them."""
    known = table(spark, base, "sections").select(F.col("doc_id").alias("id")).distinct()
    made = E.create(_docs(spark, base).filter("raw_pages IS NULL").join(known, "id", "left_semi"))
    return made.select("id", "title", "slug", F.size("sections").alias("n_sections"), F.transform("sections", lambda s: s["heading"]).alias("headings"))


@query(f"""WITH {DOCS}, e AS (SELECT id, CASE WHEN length(markdown) % 4 = 0 THEN 'Page 3.' || chr(10) || 'One line.' || chr(10) || 'Page 4.' || chr(10) || 'Two lines.' END AS edited, raw_pages, markdown FROM d)
SELECT id, CASE WHEN edited IS NOT NULL THEN 'edited' WHEN raw_pages IS NOT NULL THEN 'pages' ELSE 'stored' END AS source, CASE WHEN edited IS NULL THEN len(raw_pages) END::INTEGER AS n_pages,
CASE WHEN edited IS NOT NULL THEN 'One line.' || chr(10) || 'Two lines.' WHEN raw_pages IS NULL THEN markdown END AS raw_markdown FROM e""")
def b06_render_again(spark: SparkSession, base: str) -> DataFrame:
    """Documents rendered again, a quarter of them edited."""
    edits = F.when(F.length("markdown") % 4 == 0, F.lit("Page 3.\nOne line.\nPage 4.\nTwo lines."))
    out = E.render_again(_docs(spark, base).withColumn("edited", edits))
    return out.select("id", "source", F.size("raw_pages").alias("n_pages"), "raw_markdown").withColumn("n_pages", F.when(F.col("n_pages") >= 0, F.col("n_pages")))


@query()
def b06_rendered(spark: SparkSession, base: str) -> DataFrame:
    """The texts that rendering again gives, nothing edited."""
    return E.render_again(_docs(spark, base).withColumn("edited", F.lit(None).cast("string"))).select("id", "source", "markdown")


@query(f"""WITH {DOCS}, k AS (SELECT min(id) AS a, max(id) AS b FROM d), t AS (SELECT title AS t FROM d, k WHERE id = b), s AS (SELECT slug FROM d, k WHERE id <> a),
n AS (SELECT {SLUG.format(c="coalesce(nullif(trim(t), ''), (SELECT title FROM d, k WHERE id = a))")} AS base FROM t)
SELECT id, CASE WHEN id = a AND trim((SELECT t FROM t)) <> '' THEN trim((SELECT t FROM t)) ELSE title END AS title,
CASE WHEN id <> a THEN slug WHEN base NOT IN (SELECT slug FROM s) THEN base ELSE base || '-' || (SELECT min(i) FROM range(2, 100000) r(i) WHERE base || '-' || i NOT IN (SELECT slug FROM s)) END AS slug FROM d, k, n""")
def b07_rename(spark: SparkSession, base: str) -> DataFrame:
    """The first document renamed to the last one's title, whose slug is taken."""
    docs = _docs(spark, base).select("id", "title", "slug")
    ends = docs.agg(F.min("id").alias("id"), F.max(F.struct("id", "title")).alias("last"))
    return E.rename(docs, ends.select("id", F.col("last.title").alias("title")))


@query(f"""WITH {DOCS}, e AS (SELECT id, CASE WHEN slug LIKE '%-2' THEN '# New' || chr(10) || 'A line.' END AS x, markdown FROM d) SELECT id, coalesce(x, markdown) AS markdown, x IS NOT NULL AS changed FROM e""")
def b07_update_markdown(spark: SparkSession, base: str) -> DataFrame:
    docs = _docs(spark, base)
    edits = docs.filter(F.col("slug").endswith("-2")).select("id", F.lit("# New\nA line.").alias("markdown"))
    return E.update_markdown(docs.select("id", "markdown"), edits).select("id", "markdown", "changed")


@query(f"""WITH {DOCS}, s AS (SELECT doc_id AS id, bool_or(sections.id = 0 AND paragraphs IS NOT NULL) AS p FROM sections GROUP BY 1)
SELECT id, CASE WHEN length(markdown) % 3 = 0 THEN 'draft' WHEN p THEN 'stored' WHEN p IS NOT NULL THEN 'saved' ELSE 'draft' END AS source FROM d LEFT JOIN s USING (id)""")
def c11_section_source(spark: SparkSession, base: str) -> DataFrame:
    """Which sections the reader shows; every third document has a draft that differs from what is saved."""
    stored = table(spark, base, "sections").groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), "paragraphs"))).alias("stored"))
    docs = _docs(spark, base).join(stored, "id", "left")
    draft = F.when(F.length("markdown") % 3 == 0, F.concat("markdown", F.lit("\nMore."))).otherwise(F.col("markdown"))
    return docs.select("id", E.section_source(draft, F.col("markdown"), F.col("stored")).alias("source"))


@query("""WITH d AS (SELECT DISTINCT id, raw_pages FROM docs WHERE raw_pages IS NOT NULL), m AS (SELECT id, unnest(raw_pages) AS t, generate_subscripts(raw_pages, 1)::INTEGER AS page FROM d)
SELECT id, list({'page': page, 'n_chars': length(t)::INTEGER} ORDER BY page) AS page_map FROM m GROUP BY 1""")
def g08_page_map(spark: SparkSession, base: str) -> DataFrame:
    """Page maps, stored in reverse, in the order of their pages."""
    p = table(spark, base, "docs").filter("raw_pages IS NOT NULL").select("id", "raw_pages").distinct()
    stored = F.reverse(F.transform("raw_pages", lambda t, i: F.struct((i + 1).alias("page"), F.length(t).alias("n_chars"))))
    return p.select("id", F.array_sort(stored).alias("page_map"))


@query(f"""WITH {ITEMS},{SENTENCES} SELECT it.id, it.doc_id, it.progress::BIGINT AS g, (coalesce(sum(length(sentence)) FILTER (WHERE se.g >= it.progress), 0) + greatest(count(*) FILTER (WHERE se.g >= it.progress) - 1, 0))::BIGINT AS remaining_chars
FROM it LEFT JOIN se USING (doc_id) GROUP BY 1, 2, 3""")
def h05_remaining_chars(spark: SparkSession, base: str) -> DataFrame:
    """Characters left of an item's document from its progress on, sought among running sums."""
    ends = S.with_ends(L.sentences(table(spark, base, "sections")).select("doc_id", "g", F.length("sentence").alias("n")), "doc_id", "g", F.col("n"))
    places = L.distinct_items(table(spark, base, "playlist_items")).select("id", "doc_id", F.col("progress").cast("bigint").alias("g"))
    return E.remaining(ends, places).select("id", "doc_id", "g", "remaining_chars")


_SHAPE = """CASE lang WHEN 'en' THEN '{"architecture":{"input_modalities":["text","image"]}}' WHEN 'de' THEN '{"capabilities":{"vision":false}}' WHEN 'fr' THEN '{"capabilities":["chat","multimodal"]}' WHEN 'es' THEN '{"modalities":["text"]}' ELSE '{"capabilities":["chat"]}' END"""
_SEES = "CASE WHEN lang IN ('en', 'fr') THEN true WHEN lang IN ('de', 'es') THEN false END"


@query(f"SELECT domain AS id, {_SEES} AS vision, row_number() OVER (ORDER BY lower(domain)) AS place FROM sites")
def a23_model_list(spark: SparkSession, base: str) -> DataFrame:
    """Models as servers describe them, in four shapes or none, in the order of their ids."""
    m = table(spark, base, "sites").select(F.col("domain").alias("id"), F.parse_json(F.expr(_SHAPE)).alias("v"))
    return ranked(m.select("id", settings.sees_images(F.col("v")).alias("vision")), "place", F.lower("id"))


@query(f"SELECT domain AS id, coalesce({_SEES}, true) AS offered, CASE {_SEES} WHEN true THEN 'vision' WHEN false THEN 'text only' ELSE 'vision unverified' END AS label FROM sites")
def c05_vision_models(spark: SparkSession, base: str) -> DataFrame:
    """Models that may be offered for reading pages: all but those that say they see no images."""
    v = settings.sees_images(F.parse_json(F.expr(_SHAPE)))
    return table(spark, base, "sites").select(F.col("domain").alias("id"), v.alias("v")).select("id", F.coalesce("v", F.lit(True)).alias("offered"), F.when(F.col("v").isNull(), "vision unverified").when(F.col("v"), "vision").otherwise("text only").alias("label"))


@query("""WITH s AS (SELECT article_id, CASE WHEN author IS NULL THEN '' WHEN site IS NULL THEN NULL ELSE url || '//' END AS e_url, CASE WHEN excerpt IS NULL THEN NULL ELSE 'http://env.example/' END AS v_url,
  CASE WHEN title IS NULL THEN NULL WHEN length(title) % 3 = 0 THEN ' Yes ' WHEN length(title) % 3 = 1 THEN 'off' ELSE 'TRUE' END AS v_think, CASE WHEN length(domain) % 3 = 0 THEN ' 4 ' WHEN length(domain) % 3 = 1 THEN 'many' END AS v_many, CASE WHEN site IS NULL THEN 3 END AS e_many FROM articles)
SELECT article_id, rtrim(coalesce(nullif(e_url, ''), v_url, 'http://localhost:8080'), '/') AS base_url, CASE WHEN v_think IS NULL THEN false ELSE lower(trim(v_think)) IN ('1', 'true', 'yes', 'on') END AS thinking, coalesce(e_many, try_cast(trim(v_many) AS INTEGER), 2) AS concurrency FROM s""")
def d69_config(spark: SparkSession, base: str) -> DataFrame:
    """Settings given, from the environment and by default, of fields made from the articles'."""
    n = F.length("title") % 3
    s = table(spark, base, "articles").select(
        "article_id", F.when(F.col("author").isNull(), "").when(F.col("site").isNotNull(), F.concat("url", F.lit("//"))).alias("e_url"), F.when(F.col("excerpt").isNotNull(), "http://env.example/").alias("v_url"),
        F.when(n == 0, " Yes ").when(n == 1, "off").when(n == 2, "TRUE").alias("v_think"), F.when(F.length("domain") % 3 == 0, " 4 ").when(F.length("domain") % 3 == 1, "many").alias("v_many"), F.when(F.col("site").isNull(), "3").alias("e_many"),
    )
    return s.select(
        "article_id", settings.base_url(F.col("e_url"), F.col("v_url"), "http://localhost:8080").alias("base_url"), settings.truth(F.col("v_think"), False).alias("thinking"), settings.whole(F.coalesce("e_many", "v_many"), 2).alias("concurrency")
    )
