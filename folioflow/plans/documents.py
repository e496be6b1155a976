"""Queries over document structure, readers and streams."""

from __future__ import annotations

import html
import io
import json
import struct
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import library as L
from folioflow.operators import markdown as M
from folioflow.plans.registry import query
from folioflow.plans.sequences import PACE
from folioflow.sources import readers
from folioflow.sources.tables import table
from folioflow.streaming import pace


def _clean_docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").filter("raw_pages IS NULL").select("id", "markdown").distinct()


@query("SELECT s.doc_id, s.id, s.heading FROM sections s SEMI JOIN docs d ON d.id = s.doc_id AND d.raw_pages IS NULL")
def d08_sections(spark: SparkSession, base: str) -> DataFrame:
    s = _clean_docs(spark, base).select(F.col("id").alias("doc_id"), F.explode(M.parse_sections(F.col("markdown"))).alias("s"))
    known = table(spark, base, "sections").select("doc_id").distinct()
    return s.join(known, "doc_id", "left_semi").select("doc_id", F.col("s.id").alias("id"), F.col("s.heading").alias("heading"))


@query()
def d07_blocks(spark: SparkSession, base: str) -> DataFrame:
    s = _clean_docs(spark, base).select(F.col("id").alias("doc_id"), F.explode(M.parse_sections(F.col("markdown"))).alias("s"))
    return s.select("doc_id", F.col("s.id").alias("section_id"), F.posexplode("s.blocks").alias("n", "b")).select("doc_id", "section_id", "n", "b.kind", "b.para_idx", "b.level", "b.ordered")


@query()
def d17_image_notes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "markdown").distinct().select("id", M.strip_image_notes(F.col("markdown")).alias("markdown"))


@query()
def d20_reflow(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "markdown").distinct().select("id", M.reflow(F.col("markdown")).alias("markdown"))


@query()
def d21_capitals(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "markdown").distinct().select("id", M.normalise_capitals(F.col("markdown")).alias("markdown"))


@query()
def d25_join_pages(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "docs").filter("raw_pages IS NOT NULL").select("id", "raw_pages").distinct()
    return p.withColumn("j", M.join_pages(F.col("raw_pages"))).select("id", "j.markdown", "j.pages")


@query()
def d33_code_comments(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "sections").select("doc_id", "id", F.explode("blocks").alias("b")).filter("b.kind = 'code'")
    return b.select("doc_id", "id", M.extract_comments(F.col("b.raw")).alias("comments"))


@query()
def e04_speakable_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Sections to chunks that are read aloud: prose by sentences, tables as records, comments of code."""
    b = table(spark, base, "sections").select("doc_id", F.col("id").alias("section_id"), "paragraphs", F.posexplode("blocks").alias("n", "b"))
    none = F.array().cast("array<string>")
    said = F.when(F.col("b.para_idx").isNotNull(), F.try_element_at("paragraphs", F.col("b.para_idx") + 1)).otherwise(none)
    prose = F.flatten(F.transform(said, lambda s: X.pack_pieces(X.speakable(s))))
    rows = b.withColumn("pieces", F.when(F.col("b.kind") == "table", M.table_records(F.col("b.raw"))).when(F.col("b.kind") == "code", M.extract_comments(F.col("b.raw"))).otherwise(prose))
    return rows.select("doc_id", "section_id", "n", F.posexplode(F.coalesce("pieces", none)).alias("k", "text")).filter("text <> ''")


_HTML = "'<html><head><title>' || coalesce(title, 'none') || '</title><meta property=\"og:site_name\" content=\"' || coalesce(site, '') || '\"></head><body><nav>Menu</nav><h1>Head</h1><p>One <b>bold</b> word.</p><script>x()</script></body></html>'"


def _html_pages(spark: SparkSession, base: str) -> DataFrame:
    """Web pages made from the articles' fields."""
    parts = [F.lit("<html><head><title>"), F.coalesce("title", F.lit("none")), F.lit('</title><meta property="og:site_name" content="'), F.coalesce("site", F.lit("")), F.lit('"></head><body><nav>Menu</nav><h1>Head</h1><p>One <b>bold</b> word.</p><script>x()</script></body></html>')]
    return table(spark, base, "articles").select("article_id", F.concat(*parts).alias("html"))


@query("SELECT article_id, coalesce(nullif(trim(regexp_replace(coalesce(title, 'none'), '\\s+', ' ', 'g')), ''), NULL) AS title, nullif(trim(coalesce(site, '')), '') AS site FROM articles")
def d60_page_meta(spark: SparkSession, base: str) -> DataFrame:
    return _html_pages(spark, base).withColumn("m", readers.page_meta(F.col("html"))).select("article_id", "m.title", "m.site")


@query("SELECT article_id, '# Head' || chr(10) || chr(10) || 'One **bold** word.' AS markdown FROM articles")
def d58_html_markdown(spark: SparkSession, base: str) -> DataFrame:
    return _html_pages(spark, base).select("article_id", readers.page_markdown(F.col("html")).alias("markdown"))


@query(f"SELECT article_id, regexp_replace({_HTML}, '(?is)<(head|script|style)[^>]*>.*?</(head|script|style)>', '', 'g') AS html FROM articles")
def d59_strip_scripts(spark: SparkSession, base: str) -> DataFrame:
    return _html_pages(spark, base).select("article_id", F.regexp_replace("html", r"(?is)<(head|script|style)[^>]*>.*?</(head|script|style)>", "").alias("html"))


def _article_pages(spark: SparkSession, base: str) -> DataFrame:
    """Web pages made from the articles' fields and their own text, a heading, list item or paragraph per line."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def element(line):
        level = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)).cast("string")
        heading = F.concat(F.lit("<h"), level, F.lit(">"), F.regexp_replace(line, r"^#+\s+", ""), F.lit("</h"), level, F.lit(">"))
        item = F.concat(F.lit("<li>"), F.regexp_replace(line, r"^[*-]\s+", ""), F.lit("</li>"))
        return F.when(level != "0", heading).when(line.rlike(r"^[*-]\s"), item).otherwise(F.concat(F.lit("<p>"), line, F.lit("</p>")))

    text = F.filter(F.split(safe(F.coalesce("markdown", F.lit(""))), "\n", -1), lambda x: F.trim(x) != "")
    meta = [F.concat(F.lit(f'<meta name="{k}" content="'), safe(F.coalesce(c, F.lit(""))), F.lit('">')) for k, c in (("author", "author"), ("og:site_name", "site"), ("date", "date"))]
    head = [F.lit("<html><head><title>"), safe(F.coalesce("title", F.lit(""))), F.lit("</title>"), *meta, F.lit("</head><body><nav>Menu</nav>")]
    body = F.array_join(F.transform(text, element), "\n")
    return table(spark, base, "articles").select("article_id", F.concat(*head, body, F.lit("<script>x()</script></body></html>")).alias("html"))


@query()
def d58_article_markdown(spark: SparkSession, base: str) -> DataFrame:
    """As d58_html_markdown, over each article's own text."""
    return _article_pages(spark, base).select("article_id", readers.page_markdown(F.col("html")).alias("markdown"))


@query()
def d59_article_scripts(spark: SparkSession, base: str) -> DataFrame:
    """As d59_strip_scripts, over each article's own text."""
    return _article_pages(spark, base).select("article_id", F.regexp_replace("html", r"(?is)<(head|script|style)[^>]*>.*?</(head|script|style)>", "").alias("html"))


@query()
def d60_article_meta(spark: SparkSession, base: str) -> DataFrame:
    """As d60_page_meta, with author and date."""
    return _article_pages(spark, base).withColumn("m", readers.page_meta(F.col("html"))).select("article_id", "m.title", "m.author", "m.site", "m.date")


_UPLOADS = (
    (".pdf", b"x", "pdf"), ("", b"%PDF-1.7", "pdf"), (".bin", b"\x89PNG\r\n\x1a\n0000", "image/png"), ("", b"\xff\xd8\xff\xe0", "image/jpeg"), (".epub", b"PK", "epub"),
    (".x", b"PK\x03\x04....mimetypeapplication/epub+zip", "epub"), (".zip", b"PK\x03\x04....word/document.xml", "text"), (".y", b"GIF89a", "image/gif"), ("", b"RIFF\x10\x00\x00\x00WEBPVP8 ", "image/webp"), (".txt", b"", "text"),
)


@query("SELECT DISTINCT id AS path, CASE length(markdown) % 10 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, _, kind) in enumerate(_UPLOADS)) + " END AS kind FROM docs")
def a04_upload_kind(spark: SparkSession, base: str) -> DataFrame:
    """Uploads made of each document: its text behind the first bytes of ten kinds of file, some with telling names."""
    docs = table(spark, base, "docs").select("id", "markdown").distinct()
    k = F.length("markdown") % 10
    pick = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in _UPLOADS]), (k + 1).cast("int"))
    files = docs.select("id", F.concat("id", pick(0)).alias("path"), F.concat(pick(1), F.encode("markdown", "UTF-8")).alias("content"))
    return files.select(F.col("id").alias("path"), readers.upload_kind(F.col("path"), F.col("content")).alias("kind"))


@query("WITH " + PACE.format(cap=1_200))
def k01_running_pace(spark: SparkSession, base: str) -> DataFrame:
    """The running pace from a stream over the events, drained: state per voice, halved past the cap."""
    schema = table(spark, base, "events").schema
    events = pace.read_log(spark, base, schema, "parquet", pathGlobFilter="events.parquet")
    shaped = events.select(F.col("event_type").alias("engine"), F.col("user_id").cast("string").alias("voice"), F.col("event_id").alias("seq"), (F.lit(100) + F.col("user_id") % 7).cast("double").alias("chars"), F.col("value").alias("seconds"))
    out = L.latest(pace.drain(pace.running_pace(shaped, cap=1_200.0), f"pace_{uuid.uuid4().hex}", "update").withColumn("k", F.struct("engine", "voice")), "k", "batch").drop("k")
    return out.select("engine", "voice", "chars", "seconds")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def k02_windowed_log(spark: SparkSession, base: str) -> DataFrame:
    """Event-time windows over the event log, drained (an extension)."""
    events = pace.read_log(spark, base, table(spark, base, "events").schema, "parquet", pathGlobFilter="events.parquet")
    out = pace.drain(pace.windowed_counts(events, "ts"), f"log_{uuid.uuid4().hex}")
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def _book(title: str | None, key: str, size: int) -> bytes:
    """An e-book of three chapters, one with a label, one with a heading, one with neither, and a picture; or a bad one."""
    if size % 10 == 1:
        return b"PK\x03\x04 broken"
    out = io.BytesIO()
    page = "<html xmlns='http://www.w3.org/1999/xhtml'><body>{}</body></html>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        if size % 10 == 2:
            z.writestr("META-INF/encryption.xml", "<encryption/>")
        z.writestr("META-INF/container.xml", '<c:container xmlns:c="urn:x"><c:rootfiles><c:rootfile full-path="OEBPS/b.opf"/></c:rootfiles></c:container>')
        items = "".join(f'<item id="{i}" href="{h}" media-type="{m}"/>' for i, h, m in (
            ("a", "text/first.xhtml", "application/xhtml+xml"), ("b", "text/second.xhtml", "application/xhtml+xml"), ("c", "text/the_last-part.xhtml", "application/xhtml+xml"), ("n", "toc.ncx", "application/x-dtbncx+xml"), ("p", "img/pic.png", "image/png"),
        ))
        z.writestr("OEBPS/b.opf", f'<package xmlns:dc="urn:dc"><metadata><dc:title>Book of {key}</dc:title><dc:creator>Ann Moor</dc:creator></metadata><manifest>{items}</manifest><spine><itemref idref="c"/><itemref idref="a"/><itemref idref="gone"/><itemref idref="p"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/toc.ncx", f'<ncx><navMap><navPoint><navLabel><text>Label  {key}</text></navLabel><content src="text/first.xhtml#s"/></navPoint><navPoint><navLabel><text>Later</text></navLabel><content src="text/first.xhtml"/></navPoint></navMap></ncx>')
        z.writestr("OEBPS/text/first.xhtml", page.format("<p>See <img src='../img/pic.png' alt='p'/>.</p><p>Not <img src='none.png'/>.</p>"))
        z.writestr("OEBPS/text/second.xhtml", page.format(f"<h1>{html.escape(title or '')}</h1><p>One <i>word</i>.</p>"))
        z.writestr("OEBPS/text/the_last-part.xhtml", page.format("<p>End.</p>"))
        z.writestr("OEBPS/img/pic.png", b"\x89PNG" + key.encode())
    return out.getvalue()


def _books(spark: SparkSession, base: str) -> DataFrame:
    """(path, content): a book made of each document."""

    @F.pandas_udf("binary")
    def book(titles: pd.Series, keys: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_book(*x) for x in zip(titles, keys, sizes, strict=True)], dtype=object)

    docs = table(spark, base, "docs").select("id", "title", F.length("markdown").alias("n")).distinct()
    return docs.select(F.col("id").alias("path"), book("title", "id", "n").alias("content"))


_BOOK = "bk AS (SELECT DISTINCT id, title, length(markdown) % 10 AS k FROM docs)"


@query(rf"""WITH {_BOOK}, g AS (SELECT * FROM bk WHERE k NOT IN (1, 2))
SELECT id AS path, 0 AS chapter, 'The Last Part' AS title, 'End.' AS markdown, 'Book of ' || id AS book_title, 'Ann Moor' AS author, NULL AS error FROM g
UNION ALL SELECT id, 1, 'Label ' || id, 'See ![p](OEBPS/img/pic.png).' || chr(10) || chr(10) || 'Not .', 'Book of ' || id, 'Ann Moor', NULL FROM g
UNION ALL SELECT id, 2, coalesce(nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), ''), 'Second'), 'One *word*.', 'Book of ' || id, 'Ann Moor', NULL FROM g
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, CASE k WHEN 1 THEN 'not an ePub' ELSE 'protected' END FROM bk WHERE k IN (1, 2)""")
def a07_epub_chapters(spark: SparkSession, base: str) -> DataFrame:
    """Books made of the documents, read back: chapters in the spine's order, their titles from labels, headings and file names, and what is wrong with a bad one."""
    return readers.epub_chapters(_books(spark, base))


@query(rf"WITH {_BOOK} SELECT id AS path, 'OEBPS/img/pic.png' AS name, base64('\x89PNG'::BLOB || encode(id)) AS data FROM bk WHERE k NOT IN (1, 2)")
def b25_epub_images(spark: SparkSession, base: str) -> DataFrame:
    """The pictures of books made of the documents, in base64."""
    return readers.epub_images(_books(spark, base)).select("path", "name", F.base64("content").alias("data"))


_HEADS = (("speaker.weight",), ("kv.cache", "kv.offset"), ("other",), ("emb", "more"), None)


@query("""SELECT DISTINCT id AS path, CASE length(markdown) % 5 WHEN 0 THEN 'phonon' WHEN 1 THEN 'pocket' WHEN 3 THEN 'phonon' ELSE 'unknown' END AS kind FROM docs""")
def a16_voice_files(spark: SparkSession, base: str) -> DataFrame:
    """Voice files told by their headers, a file made of each document."""
    head = lambda keys: (lambda j: struct.pack("<Q", len(j)) + j)(json.dumps(dict.fromkeys(keys, {})).encode()) if keys else b"xx"
    k = F.length("markdown") % 5
    made = F.when(k == 0, F.lit(head(_HEADS[0]))).when(k == 1, F.lit(head(_HEADS[1]))).when(k == 2, F.lit(head(_HEADS[2]))).when(k == 3, F.lit(head(_HEADS[3]))).otherwise(F.lit(head(_HEADS[4])))
    files = table(spark, base, "docs").select("id", k.alias("k"), F.when(k == 4, made).otherwise(F.concat(made, F.encode("markdown", "UTF-8"))).alias("content"), "markdown").distinct()
    return files.select(F.col("id").alias("path"), readers.voice_file_kind(F.col("content")).alias("kind")).distinct()


@query()
def d24_page_markers(spark: SparkSession, base: str) -> DataFrame:
    """Pages joined with their markers, and the sentence that each marker leads."""
    p = table(spark, base, "docs").filter("raw_pages IS NOT NULL").select("id", "raw_pages").distinct()
    md = p.select("id", M.join_pages(F.col("raw_pages"))["markdown"].alias("m"))
    parts = md.select("id", F.posexplode(F.split("m", r"(?m)^(?=Page \d+\.$)", -1)).alias("k", "t"))
    page = F.regexp_extract("t", r"^Page (\d+)\.", 1)
    return parts.filter(page != "").select("id", page.cast("int").alias("page"), F.try_element_at(X.split_sentences(F.regexp_replace("t", r"^Page \d+\.\s*", "")), F.lit(1)).alias("leads"))
