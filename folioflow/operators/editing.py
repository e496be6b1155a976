"""A document's life after import: creation, renaming, edits, rendering again, and the reader's place in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions import text as X
from folioflow.operators import markdown as M

PAGE_MARKER = r"(?m)^[ \t]*Page \d+\.[ \t]*\n?"


def create(rows: DataFrame) -> DataFrame:
    """(id, title, slug, markdown, sections) of rows with id, title and markdown; a blank title is Untitled."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    return rows.select("id", title.alias("title"), X.slug(title).alias("slug"), "markdown", M.parse_sections(F.col("markdown")).alias("sections"))


def rename(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, title, slug): ``docs`` (id, title, slug) with the titles that ``requests`` (id, title) ask for, one for each id.

    A blank title keeps the old one. A renamed document's slug is made anew: the title's, or, where another
    document has that already, the first of -2, -3 … that none has. Documents not asked for keep theirs.
    Of several renamed to one slug in the same call, the first by id takes the first that is free.
    """
    asked = requests.groupBy("id").agg(F.max("title").alias("_new"))
    both = docs.join(asked, "id", "left").withColumn("_asked", F.col("_new").isNotNull())
    both = both.withColumn("title", F.when(F.col("_asked"), F.coalesce(F.nullif(F.trim("_new"), F.lit("")), "title")).otherwise(F.col("title")))
    both = both.withColumn("_base", F.when(F.col("_asked"), X.slug(F.col("title"))))
    # the numbers that other documents' slugs take up, by the slug they stand on; one that ends in a number may be either
    kept = both.filter(~F.col("_asked")).select("slug").distinct()
    number = F.regexp_extract("slug", r"-(\d{1,9})\z", 1)
    taken = kept.select(F.col("slug").alias("_base"), F.lit(1).alias("_n")).unionByName(
        kept.filter(number != "").select(F.regexp_replace("slug", r"-\d{1,9}\z", "").alias("_base"), number.cast("int").alias("_n")).filter((F.col("_n") > 1) & ~F.col("_base").endswith("-"))
    )
    asked_for = both.filter("_asked").select("_base").distinct()
    held = taken.join(asked_for, "_base", "left_semi").groupBy("_base").agg(F.sort_array(F.collect_set("_n")).alias("_held"))
    wanted = both.filter("_asked").withColumn("_k", F.row_number().over(W.partitionBy("_base").orderBy("id"))).join(held, "_base", "left")
    free = F.array_except(F.sequence(F.lit(1), F.col("_k") + F.coalesce(F.size("_held"), F.lit(0))), F.coalesce("_held", F.array().cast("array<int>")))
    pick = F.element_at(free, F.col("_k"))
    slug = F.when(pick == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", pick.cast("string")))
    return wanted.select("id", "title", slug.alias("slug")).unionByName(both.filter(~F.col("_asked")).select("id", "title", "slug"))


def update_markdown(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, markdown, sections, changed): ``docs`` with the texts of ``edits`` (id, markdown), parsed again."""
    new = edits.groupBy("id").agg(F.max("markdown").alias("_new"))
    text = F.coalesce("_new", "markdown")
    return docs.join(new, "id", "left").select("id", text.alias("markdown"), M.parse_sections(text).alias("sections"), F.col("_new").isNotNull().alias("changed"))


def render_again(docs: DataFrame) -> DataFrame:
    """(id, source, markdown, raw_pages, raw_markdown) of docs with id, markdown, raw_pages and edited.

    Edits, less their page markers, become a new source without pages; else the stored pages are joined
    again; else the text itself serves and is kept as the source.
    """
    clean = F.regexp_replace("edited", PAGE_MARKER, "")
    joined = M.join_pages(F.transform("raw_pages", lambda x: X.dehyphenate(F.coalesce(x, F.lit("")))))["markdown"]
    by_edit, by_pages = F.col("edited").isNotNull(), F.col("raw_pages").isNotNull()
    source = F.when(by_edit, "edited").when(by_pages, "pages").otherwise("stored")
    text = F.when(by_edit, X.dehyphenate(clean)).when(by_pages, joined).otherwise(X.dehyphenate(F.col("markdown")))
    return docs.select(
        "id", source.alias("source"), M.reflow(text).alias("markdown"), F.when(~by_edit & by_pages, F.col("raw_pages")).alias("raw_pages"),
        F.when(by_edit, clean).when(~by_pages, F.col("markdown")).alias("raw_markdown"),
    )


def section_source(draft: Column, saved: Column, stored: Column) -> Column:
    """Where the reader's sections come from: the draft where it differs from what is saved, the stored sections
    where they have paragraphs, the saved text where they lack them, else the draft."""
    some = F.coalesce(F.size(stored) > 0, F.lit(False))
    return (
        F.when(saved.isNotNull() & (draft != saved), "draft")
        .when(some & F.element_at(stored, 1)["paragraphs"].isNotNull(), "stored")
        .when(some, "saved")
        .otherwise("draft")
    )


def remaining(ends: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (doc_id, g and more) with total_chars and remaining_chars: those of the document, and those left from
    sentence ``g`` on, joined by one space. A document without sentences has none.

    ``ends`` has doc_id, g, n and end: sentence lengths and their running sum. Places and sentences meet by
    (document, sentence), so a document that is open in many places costs one row for each.
    """
    total = ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("chars"))
    before = ends.select("doc_id", (F.col("g") + 1).alias("at"), F.col("end").alias("read"))
    held = places.join(total, "doc_id", "left").withColumn("at", F.least(F.greatest("g", F.lit(0)), F.coalesce("count", F.lit(0))).cast("bigint"))
    out = held.join(before, ["doc_id", "at"], "left")
    chars, count = F.coalesce("chars", F.lit(0)), F.coalesce("count", F.lit(0))
    left = chars - F.coalesce("read", F.lit(0)) + F.greatest(count - F.col("at") - 1, F.lit(0))
    return out.withColumn("total_chars", chars + F.greatest(count - 1, F.lit(0))).withColumn("remaining_chars", left).drop("at", "read", "count", "chars")
