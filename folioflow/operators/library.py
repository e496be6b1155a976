"""Relational operators over the reading library: playlists, items, documents, voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions import text as X
from folioflow.operators.common import ranked
from folioflow.operators.editing import remaining
from folioflow.operators.sequences import with_ends


def distinct_items(items: DataFrame) -> DataFrame:
    """Items once each: exact repeats dropped, of several states of an id the latest kept."""
    w = W.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("progress").desc(), F.col("title"))
    return items.dropDuplicates(["id", "playlist_id", "title", "doc_id", "progress", "total_sentences", "created_at", "updated_at"]).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def playlists(items: DataFrame) -> DataFrame:
    """(playlist_id, item_ids, created_at, updated_at, last_listened_at): playlists with their order of items."""
    entry = F.struct("created_at", "id")
    return items.groupBy("playlist_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["id"]).alias("item_ids"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.max(F.when(F.col("progress") > 0, F.col("updated_at"))).alias("last_listened_at"),
    )


def ordered_items(lists: DataFrame, items: DataFrame) -> DataFrame:
    """(playlist_id, pos, id, ...): items by their list's order; ids without a row dropped, rows missing from the order last."""
    order = lists.select("playlist_id", F.posexplode("item_ids").alias("pos", "id"))
    joined = items.join(order, ["playlist_id", "id"], "left")
    w = W.partitionBy("playlist_id").orderBy(F.col("pos").asc_nulls_last(), "id")
    return joined.withColumn("pos", F.row_number().over(w) - 1)


def sentences(sections: DataFrame) -> DataFrame:
    """(doc_id, g, section_id, pos, sentence): the global sentence list; g counts from 0 in section and chunk order."""
    rows = sections.select("doc_id", F.col("id").alias("section_id"), F.posexplode("chunks").alias("pos", "sentence"))
    return rows.withColumn("g", F.row_number().over(W.partitionBy("doc_id").orderBy("section_id", "pos")) - 1)


def sentence_paragraphs(sections: DataFrame) -> DataFrame:
    """(doc_id, g, section_id, para_idx, is_heading, sentence): the render model of each section."""
    paras = F.when(F.size("paragraphs") > 0, F.col("paragraphs")).when(F.size("chunks") > 0, F.array("chunks")).otherwise(F.array().cast("array<array<string>>"))
    rows = sections.select("doc_id", F.col("id").alias("section_id"), "heading", F.posexplode(paras).alias("para_idx", "pieces"))
    rows = rows.select("doc_id", "section_id", "para_idx", ((F.col("para_idx") == 0) & F.col("heading").isNotNull()).alias("is_heading"), F.posexplode("pieces").alias("pos", "sentence"))
    return rows.withColumn("g", F.row_number().over(W.partitionBy("doc_id").orderBy("section_id", "para_idx", "pos")) - 1).drop("pos")


def document_sizes(sections: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_chars): sentences and their characters, joined by one space."""
    one = sections.select("doc_id", F.size("chunks").alias("n"), F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("c"))
    return one.groupBy("doc_id").agg(F.sum("n").alias("n_sentences"), (F.sum("c") + F.greatest(F.sum("n") - 1, F.lit(0))).alias("n_chars"))


def item_stats(items: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, playlist_id, done, total, total_chars, remaining_chars) of every item; a missing document counts nothing.

    Lengths are summed once per document; an item meets one sentence of it, where its progress stands.
    """
    ends = with_ends(sentences(sections).select("doc_id", "g", F.length("sentence").alias("n")), "doc_id", "g", F.col("n"))
    total = F.greatest(F.coalesce("total_sentences", F.lit(0)), F.lit(0))
    done = F.least(F.greatest(F.coalesce("progress", F.lit(0)), F.lit(0)), total)
    places = items.select("id", "playlist_id", "doc_id", done.alias("done"), total.alias("total")).withColumn("g", F.col("done").cast("bigint"))
    return remaining(ends, places).select("id", "playlist_id", "done", "total", "total_chars", "remaining_chars")


def playlist_stats(stats: DataFrame, chars_per_second: float = 15.0) -> DataFrame:
    """(playlist_id, n_items, done, total, percent, remaining_chars, remaining): totals with the time they take."""
    out = stats.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("done").alias("done"), F.sum("total").alias("total"), F.sum("remaining_chars").alias("remaining_chars"))
    return out.withColumn("percent", X.percent(F.col("done"), F.col("total"))).withColumn("remaining", X.clock(F.col("remaining_chars") / F.lit(chars_per_second)))


def overview(items: DataFrame, sections: DataFrame) -> DataFrame:
    """The library's first page: every playlist with its totals, time left and place in the order of listening."""
    once = distinct_items(items)
    lists = playlists(once).select("playlist_id", "updated_at", "last_listened_at")
    return by_listening(playlist_stats(item_stats(once, sections)).join(lists, "playlist_id"))


def by_listening(lists: DataFrame) -> DataFrame:
    """Playlists with their place: last listened first, never listened last, then last changed."""
    return ranked(lists, "place", F.coalesce("last_listened_at", F.lit(-1)).desc(), F.col("updated_at").desc(), F.col("playlist_id"))


def unassigned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that no item refers to."""
    return docs.dropDuplicates(["id"]).join(items.select(F.col("doc_id").alias("id")), "id", "left_anti")


def search_index(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, key, label, detail): playlists, items and unassigned documents as one list."""
    once = distinct_items(items)
    lists = once.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("playlist").alias("kind"), F.col("playlist_id").alias("key"), F.col("playlist_id").alias("label"), F.concat(F.col("n").cast("string"), F.lit(" items")).alias("detail"))
    rows = once.select(F.lit("item").alias("kind"), F.col("id").alias("key"), F.col("title").alias("label"), X.source_label(F.col("source")).alias("detail"))
    free = unassigned(docs, items).select(F.lit("doc").alias("kind"), F.col("id").alias("key"), F.col("title").alias("label"), F.lit("Unassigned").alias("detail"))
    return lists.unionByName(rows).unionByName(free)


def search(index: DataFrame, words: str, top: int = 12) -> DataFrame:
    """The first ``top`` entries whose label holds ``words``, in the order kind, key."""
    rank = F.when(F.col("kind") == "playlist", 0).when(F.col("kind") == "item", 1).otherwise(2)
    return index.filter(F.contains(F.lower("label"), F.lower(F.trim(F.lit(words))))).orderBy(rank, "key").limit(top)


def merge_page_readings(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, page, text, replaced): each stored page, replaced by its latest good reading unless that is blank."""
    pages = docs.dropDuplicates(["id"]).filter(F.col("raw_pages").isNotNull()).select(F.col("id").alias("doc_id"), F.posexplode("raw_pages").alias("page", "raw")).withColumn("page", F.col("page") + 1)
    good = ocr.filter(~F.col("failed")).groupBy("doc_id", "page").agg(F.max_by("markdown", F.struct("finished_at", "markdown")).alias("again"))
    blank = F.coalesce(F.trim("again"), F.lit("")) == ""
    return pages.join(good, ["doc_id", "page"], "left").select("doc_id", "page", F.when(blank, F.col("raw")).otherwise(F.col("again")).alias("text"), (~blank).alias("replaced"))


def resolve_voices(requests: DataFrame, voices: DataFrame, fallback: str) -> DataFrame:
    """(engine, request, name): each request resolved by exact name, then key, then name without case; else the fallback."""
    v = voices.select("engine", "name")
    tries = [
        requests.join(v.withColumn("request", F.col("name")), ["engine", "request"]).withColumn("rank", F.lit(1)),
        requests.withColumn("k", X.voice_key(F.col("request"))).join(v.withColumn("k", X.voice_key(F.col("name"))), ["engine", "k"]).drop("k").withColumn("rank", F.lit(2)),
        requests.withColumn("k", F.lower("request")).join(v.withColumn("k", F.lower("name")), ["engine", "k"]).drop("k").withColumn("rank", F.lit(3)),
    ]
    hits = tries[0].unionByName(tries[1]).unionByName(tries[2])
    best = hits.groupBy("engine", "request").agg(F.min(F.struct("rank", "name")).alias("b"))
    return requests.distinct().join(best, ["engine", "request"], "left").select("engine", "request", F.coalesce("b.name", F.lit(fallback)).alias("name"))


def described_voices(catalogue: DataFrame, voices: DataFrame) -> DataFrame:
    """(engine, name, language, dialect, fallback): ``catalogue`` (engine, name) with metadata by normalised name;
    an engine that the catalogue lacks whole is described by its metadata alone."""
    meta = voices.groupBy("engine", X.voice_key(F.col("name")).alias("k")).agg(F.min("name").alias("_name"), F.min("language").alias("language"), F.min("dialect").alias("dialect"))
    shown = (F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("dialect", F.lit("")).alias("dialect"))
    known = catalogue.withColumn("k", X.voice_key(F.col("name"))).join(meta, ["engine", "k"], "left").select("engine", "name", *shown, F.lit(False).alias("fallback"))
    alone = meta.join(catalogue.select("engine").distinct(), "engine", "left_anti").select("engine", F.col("_name").alias("name"), *shown, F.lit(True).alias("fallback"))
    return known.unionByName(alone)


def described_engines(engines: DataFrame, voices: DataFrame) -> DataFrame:
    """``engines`` with available, n_voices and voices: those of each by name; one without a voice is not available."""
    has = voices.groupBy("engine").agg(F.sort_array(F.collect_list("name")).alias("voices"), F.count(F.lit(1)).alias("n_voices"))
    out = engines.join(has, "engine", "left")
    return out.select(*engines.columns, F.col("voices").isNotNull().alias("available"), F.coalesce("n_voices", F.lit(0)).alias("n_voices"), F.coalesce("voices", F.array().cast("array<string>")).alias("voices"))


def grouped_voices(voices: DataFrame) -> DataFrame:
    """(label, place, names): voices in labelled groups, groups and names in order."""
    rows = voices.withColumn("label", X.group_label(F.col("language"), F.col("dialect"), F.col("gender")))
    groups = rows.groupBy("language", "dialect", "gender", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct(X.natural_key(F.col("name")).alias("k"), "name"))), lambda x: x["name"]).alias("names"))
    order = (X.language_rank(F.col("language")), F.lower("language"), X.dialect_rank(F.col("dialect")), F.lower(F.coalesce("dialect", F.lit(""))), X.gender_rank(F.col("gender")), F.col("label"))
    return ranked(groups, "place", *order).select("label", "place", "names")


def latest(rows: DataFrame, key: str, at: str, *ties: Column | str) -> DataFrame:
    """Upsert by key: of each key's rows the one with the greatest ``at``."""
    w = W.partitionBy(key).orderBy(F.col(at).desc(), *ties)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def delete_documents(gone: DataFrame, docs: DataFrame, items: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table once the documents ``gone`` (doc_id) and all that hangs on them are deleted, and the playlists they touched."""
    rest = lambda df: df.join(gone, "doc_id", "left_anti")
    return {"docs": docs.join(gone.withColumnRenamed("doc_id", "id"), "id", "left_anti"), "items": rest(items), "chunks": rest(chunks), "affected": items.join(gone, "doc_id", "left_semi").select("playlist_id").distinct()}


def move_item(order: Column, item: Column, to: Column) -> Column:
    """``order`` with ``item`` moved to place ``to`` (from 0), held within what remains; unknown items change nothing."""
    rest = F.array_remove(order, item)
    at = F.least(F.greatest(to, F.lit(0)), F.size(rest))
    return F.when(F.array_contains(order, item), F.array_insert(rest, (at + 1).cast("int"), item)).otherwise(order)
