"""Queries over playlists, items, documents and voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions import text as X
from folioflow.operators import library as L
from folioflow.operators.common import ranked
from folioflow.plans.registry import query
from folioflow.sources.tables import table

ITEMS = """
it AS (SELECT * EXCLUDE rn FROM (SELECT DISTINCT id, playlist_id, title, source, doc_id, progress, total_sentences, created_at, updated_at,
         row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, progress DESC, title) AS rn FROM playlist_items) WHERE rn = 1)"""
SENTENCES = """
s0 AS (SELECT doc_id, id AS section_id, generate_subscripts(chunks, 1) - 1 AS pos, unnest(chunks) AS sentence FROM sections),
se AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, pos) - 1 AS g FROM s0)"""
CLOCK = "CASE WHEN {s} >= 3600 THEN format('{{}}:{{:02d}}:{{:02d}}', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE format('{{}}:{{:02d}}', {s} // 60, {s} % 60) END"
STATS = f"""
st AS (SELECT it.id, it.playlist_id, least(greatest(it.progress, 0), greatest(it.total_sentences, 0)) AS done, greatest(it.total_sentences, 0) AS total,
         coalesce(sum(length(sentence)), 0) + greatest(count(g) - 1, 0) AS total_chars,
         coalesce(sum(length(sentence)) FILTER (WHERE g >= least(greatest(it.progress, 0), greatest(it.total_sentences, 0))), 0)
           + greatest(count(g) FILTER (WHERE g >= least(greatest(it.progress, 0), greatest(it.total_sentences, 0))) - 1, 0) AS remaining_chars
       FROM it LEFT JOIN se USING (doc_id) GROUP BY ALL)"""
PLAYLISTS = """
pl AS (SELECT playlist_id, list(id ORDER BY created_at, id) AS item_ids, min(created_at) AS created_at, max(updated_at) AS updated_at,
         max(updated_at) FILTER (WHERE progress > 0) AS last_listened_at FROM it GROUP BY playlist_id)"""
TOTALS = f"""
pt AS (SELECT playlist_id, count(*) AS n_items, sum(done)::BIGINT AS done, sum(total)::BIGINT AS total, sum(remaining_chars)::BIGINT AS remaining_chars FROM st GROUP BY 1),
ps AS (SELECT *, (CASE WHEN total > 0 THEN floor(done::DOUBLE / total * 100 + 0.5) ELSE 0 END)::BIGINT AS percent,
         {CLOCK.format(s="floor(remaining_chars / 15.0 + 0.5)::BIGINT")} AS remaining FROM pt)"""


def _items(spark: SparkSession, base: str) -> DataFrame:
    return L.distinct_items(table(spark, base, "playlist_items"))


@query(f"WITH {ITEMS},{SENTENCES},{STATS},{PLAYLISTS},{TOTALS} SELECT ps.*, updated_at, last_listened_at, row_number() OVER (ORDER BY coalesce(last_listened_at, -1) DESC, updated_at DESC, playlist_id)::BIGINT AS place FROM ps JOIN pl USING (playlist_id)")
def library_overview(spark: SparkSession, base: str) -> DataFrame:
    return L.overview(table(spark, base, "playlist_items"), table(spark, base, "sections"))


@query(f"WITH {ITEMS} SELECT * FROM it WHERE playlist_id = (SELECT min(playlist_id) FROM it)")
def a17_point_lookup(spark: SparkSession, base: str) -> DataFrame:
    items = _items(spark, base)
    return items.join(items.agg(F.min("playlist_id").alias("playlist_id")), "playlist_id").select(items.columns)


@query("SELECT DISTINCT id, title, slug FROM docs WHERE slug = (SELECT max(slug) FROM docs) OR id = (SELECT min(id) FROM docs)")
def a18_id_or_slug(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "docs")
    keys = docs.agg(F.max("slug").alias("s"), F.min("id").alias("i"))
    return docs.join(keys, (F.col("slug") == F.col("s")) | (F.col("id") == F.col("i"))).select("id", "title", "slug").distinct()


@query("SELECT DISTINCT id, left(coalesce(nullif(trim(title), ''), regexp_replace(trim(regexp_extract(markdown, '[^\\n]*\\S[^\\n]*')), '^#+\\s*', '')), 80) AS title FROM docs")
def a22_import_title(spark: SparkSession, base: str) -> DataFrame:
    first = F.regexp_replace(F.trim(F.regexp_extract("markdown", r"[^\n]*\S[^\n]*", 0)), r"^#+\s*", "")
    return table(spark, base, "docs").select("id", F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), first), 1, 80).alias("title")).distinct()


_ENGINES = "en AS (SELECT * FROM (VALUES ('phonon', 'Phonon', false), ('pocket', 'Pocket', true), ('quiet', 'Quiet', false)) t(engine, label, cloning))"


@query(f"WITH {_ENGINES}, v AS (SELECT engine, list(name ORDER BY name) AS voices, count(*) AS n_voices FROM voices GROUP BY 1) SELECT engine, label, cloning, v.engine IS NOT NULL AS available, coalesce(n_voices, 0) AS n_voices, coalesce(voices, []) AS voices FROM en LEFT JOIN v USING (engine)")
def a24_engines(spark: SparkSession, base: str) -> DataFrame:
    """The engines known, one of them without any voice here, each with what it can do and the voices it has."""
    known = spark.createDataFrame([("phonon", "Phonon", False), ("pocket", "Pocket", True), ("quiet", "Quiet", False)], "engine string, label string, cloning boolean")
    return L.described_engines(known, table(spark, base, "voices"))


@query("SELECT DISTINCT * EXCLUDE rn FROM (SELECT id, title, updated_at, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) rn FROM docs) WHERE rn = 1")
def b01_upsert_latest(spark: SparkSession, base: str) -> DataFrame:
    return L.latest(table(spark, base, "docs").select("id", "title", "updated_at"), "id", "updated_at")


@query("WITH k AS (SELECT min(doc_id) AS d FROM playlist_items) SELECT DISTINCT playlist_id FROM playlist_items, k WHERE doc_id = d")
def b13_affected_playlists(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "playlist_items")
    gone = items.agg(F.min("doc_id").alias("doc_id"))
    return L.delete_documents(gone, table(spark, base, "docs"), items, table(spark, base, "tts_chunks"))["affected"]


@query("WITH k AS (SELECT min(doc_id) AS d FROM playlist_items) SELECT doc_id, count(*) AS n FROM playlist_items, k WHERE doc_id <> d GROUP BY 1")
def b08_cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "playlist_items")
    gone = items.agg(F.min("doc_id").alias("doc_id"))
    return L.delete_documents(gone, table(spark, base, "docs"), items, table(spark, base, "tts_chunks"))["items"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH k AS (SELECT min(playlist_id) AS p FROM playlist_items) SELECT id, playlist_id FROM playlist_items, k WHERE playlist_id <> p")
def b10_delete_playlist(spark: SparkSession, base: str) -> DataFrame:
    items = table(spark, base, "playlist_items")
    return items.join(items.agg(F.min("playlist_id").alias("playlist_id")), "playlist_id", "left_anti").select("id", "playlist_id")


@query(f"WITH {ITEMS},{PLAYLISTS} SELECT playlist_id, list_append(item_ids, 'new') AS item_ids FROM pl")
def b11_append_item(spark: SparkSession, base: str) -> DataFrame:
    return L.playlists(_items(spark, base)).select("playlist_id", F.array_append("item_ids", F.lit("new")).alias("item_ids"))


@query(f"WITH {ITEMS},{PLAYLISTS} SELECT playlist_id, list_filter(item_ids, lambda x: x <> item_ids[1]) AS item_ids FROM pl")
def b12_remove_item(spark: SparkSession, base: str) -> DataFrame:
    return L.playlists(_items(spark, base)).select("playlist_id", F.array_remove("item_ids", F.element_at("item_ids", 1)).alias("item_ids"))


@query(f"""WITH {ITEMS},{PLAYLISTS}, m AS (SELECT playlist_id, item_ids[1] AS x, item_ids[2:] AS rest FROM pl)
SELECT playlist_id, list_concat(list_append(rest[1:least(2, len(rest))], x), rest[least(2, len(rest)) + 1:]) AS item_ids FROM m""")
def b14_move_item(spark: SparkSession, base: str) -> DataFrame:
    return L.playlists(_items(spark, base)).select("playlist_id", L.move_item(F.col("item_ids"), F.element_at("item_ids", 1), F.lit(2)).alias("item_ids"))


@query(f"WITH {ITEMS} SELECT id, coalesce(nullif(trim(CASE WHEN progress = 0 THEN '  ' ELSE title || '!' END), ''), title) AS title FROM it")
def b15_rename_item(spark: SparkSession, base: str) -> DataFrame:
    new = F.when(F.col("progress") == 0, "  ").otherwise(F.concat("title", F.lit("!")))
    return _items(spark, base).select("id", F.coalesce(F.nullif(F.trim(new), F.lit("")), "title").alias("title"))


@query(f"WITH {ITEMS} SELECT id, greatest(0, progress - 3) AS progress FROM it")
def b16_progress(spark: SparkSession, base: str) -> DataFrame:
    return _items(spark, base).select("id", F.greatest(F.lit(0), F.col("progress") - 3).alias("progress"))


@query("SELECT to_json({doc_id: doc_id, page: page, failed: failed}) AS line FROM ocr_results")
def b18_log_lines(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "ocr_results").select(F.to_json(F.struct("doc_id", "page", "failed")).alias("line"))


@query("SELECT DISTINCT id, coalesce(nullif(regexp_extract(title, '([^/\\\\]+?)(\\.[A-Za-z0-9]{1,5})?$', 1), ''), 'output') || '.wav' AS name FROM docs")
def b22_download_name(spark: SparkSession, base: str) -> DataFrame:
    stem = F.regexp_extract("title", r"([^/\\]+?)(\.[A-Za-z0-9]{1,5})?\z", 1)
    return table(spark, base, "docs").select("id", F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("output")), F.lit(".wav")).alias("name")).distinct()


@query("SELECT DISTINCT id, 'upload-' || left(sha256(markdown), 12) AS voice_name, base64(encode(title)) AS b64 FROM docs")
def b26_content_name(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", F.concat(F.lit("upload-"), F.left(F.sha2("markdown", 256), F.lit(12))).alias("voice_name"), F.regexp_replace(F.base64(F.encode("title", "UTF-8")), r"\s", "").alias("b64")).distinct()


INDEX = f"""
un AS (SELECT DISTINCT id, title FROM docs WHERE id NOT IN (SELECT doc_id FROM playlist_items WHERE doc_id IS NOT NULL)),
ix AS (SELECT 'playlist' AS kind, playlist_id AS key, playlist_id AS label, count(*) || ' items' AS detail FROM it GROUP BY playlist_id
  UNION ALL SELECT 'item', id, title, CASE WHEN source.kind LIKE '%url' THEN coalesce(nullif(source.domain, ''), 'Web') WHEN source.kind LIKE 'pdf%' THEN 'PDF' WHEN source.kind LIKE 'epub%' THEN 'ePub' WHEN source.kind LIKE 'markdown%' THEN 'Markdown' ELSE 'Document' END FROM it
  UNION ALL SELECT 'doc', id, title, 'Unassigned' FROM un)"""


@query(f"WITH {ITEMS},{INDEX} SELECT * FROM ix WHERE contains(lower(label), 'mill') ORDER BY CASE kind WHEN 'playlist' THEN 0 WHEN 'item' THEN 1 ELSE 2 END, key LIMIT 12")
def c03_title_search(spark: SparkSession, base: str) -> DataFrame:
    return L.search(L.search_index(table(spark, base, "playlist_items"), table(spark, base, "docs")), " Mill ")


@query(f"WITH {ITEMS},{INDEX} SELECT * FROM ix")
def c04_search_index(spark: SparkSession, base: str) -> DataFrame:
    return L.search_index(table(spark, base, "playlist_items"), table(spark, base, "docs"))


@query("SELECT engine, name, gender IS NULL OR gender <> 'male' AS usable FROM voices")
def c06_usable_voices(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "voices").select("engine", "name", F.coalesce(F.col("gender") != "male", F.lit(True)).alias("usable"))


@query("SELECT DISTINCT v.engine, v.name FROM voices v SEMI JOIN tts_chunks t ON lower(trim(t.voice)) = lower(trim(v.name))")
def c12_name_collision(spark: SparkSession, base: str) -> DataFrame:
    used = table(spark, base, "tts_chunks").select(F.lower(F.trim("voice")).alias("k")).distinct()
    return table(spark, base, "voices").withColumn("k", F.lower(F.trim("name"))).join(used, "k", "left_semi").select("engine", "name").distinct()


@query("SELECT DISTINCT id, EXISTS (SELECT 1 FROM tts_chunks t WHERE t.doc_id = docs.id) AS has_audio, EXISTS (SELECT 1 FROM ocr_results o WHERE o.doc_id = docs.id) AS has_readings FROM docs")
def c17_has_assets(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "docs").select("id").distinct()
    audio = table(spark, base, "tts_chunks").select(F.col("doc_id").alias("id")).distinct().withColumn("a", F.lit(True))
    read = table(spark, base, "ocr_results").select(F.col("doc_id").alias("id")).distinct().withColumn("r", F.lit(True))
    return docs.join(audio, "id", "left").join(read, "id", "left").select("id", F.coalesce("a", F.lit(False)).alias("has_audio"), F.coalesce("r", F.lit(False)).alias("has_readings"))


@query("SELECT DISTINCT t.engine, t.voice, v.name IS NOT NULL AS valid FROM tts_chunks t LEFT JOIN voices v ON v.engine = t.engine AND v.name = t.voice")
def c18_voice_valid(spark: SparkSession, base: str) -> DataFrame:
    used = table(spark, base, "tts_chunks").select("engine", "voice").distinct()
    v = table(spark, base, "voices").select("engine", F.col("name").alias("voice")).distinct().withColumn("ok", F.lit(True))
    return used.join(v, ["engine", "voice"], "left").select("engine", "voice", F.coalesce("ok", F.lit(False)).alias("valid"))


@query("SELECT engine, min(name) AS default_voice FROM voices GROUP BY 1")
def c19_default_voice(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "voices").groupBy("engine").agg(F.min("name").alias("default_voice"))


@query("SELECT DISTINCT id, CASE WHEN raw_pages IS NOT NULL THEN 'pdf' WHEN EXISTS (SELECT 1 FROM sections s WHERE s.doc_id = docs.id) THEN 'epub' ELSE 'markdown' END AS kind FROM docs")
def c21_import_kind(spark: SparkSession, base: str) -> DataFrame:
    has = table(spark, base, "sections").select(F.col("doc_id").alias("id")).distinct().withColumn("s", F.lit(True))
    docs = table(spark, base, "docs").select("id", F.col("raw_pages").isNotNull().alias("pdf")).distinct()
    return docs.join(has, "id", "left").select("id", F.when(F.col("pdf"), "pdf").when(F.col("s"), "epub").otherwise("markdown").alias("kind"))


@query(f"WITH {ITEMS},{PLAYLISTS}, o AS (SELECT playlist_id, unnest(item_ids) AS id, generate_subscripts(item_ids, 1) AS p FROM pl) SELECT playlist_id, id, (row_number() OVER (PARTITION BY playlist_id ORDER BY p NULLS LAST, id) - 1)::INTEGER AS pos FROM it LEFT JOIN o USING (playlist_id, id)")
def f01_ordered_items(spark: SparkSession, base: str) -> DataFrame:
    items = _items(spark, base)
    return L.ordered_items(L.playlists(items), items).select("playlist_id", "id", "pos")


@query(f"WITH {ITEMS},{SENTENCES},{STATS} SELECT * FROM st")
def f02_item_stats(spark: SparkSession, base: str) -> DataFrame:
    return L.item_stats(_items(spark, base), table(spark, base, "sections"))


@query("SELECT DISTINCT id, title FROM docs WHERE id NOT IN (SELECT doc_id FROM playlist_items WHERE doc_id IS NOT NULL)")
def f03_unassigned(spark: SparkSession, base: str) -> DataFrame:
    return L.unassigned(table(spark, base, "docs").select("id", "title"), table(spark, base, "playlist_items"))


# a hash stands for a text, so SQL compares the texts themselves
_AUDIO = f"""ck AS (SELECT DISTINCT doc_id, engine, voice, chunk_idx, text, len(sentence_indices) > 0 AS speaks FROM tts_chunks),
au AS (SELECT doc_id, engine, voice, coalesce(string_agg(text, ' ' ORDER BY chunk_idx, text) FILTER (WHERE speaks), '') AS said FROM ck GROUP BY 1, 2, 3),
sx AS (SELECT doc_id, id, array_to_string(chunks, ' ') AS t FROM sections), nw AS (SELECT doc_id, string_agg(t, ' ' ORDER BY id, t) FILTER (WHERE t <> '') AS now FROM sx GROUP BY 1),
st AS (SELECT au.doc_id, engine, voice, said <> coalesce(now, '') AS stale FROM au LEFT JOIN nw USING (doc_id))"""


def _joined(rows: Column, field: str) -> Column:
    """The hash of texts joined by spaces, in the order of the structs ``rows``."""
    return X.text_hash(F.array_join(F.transform(F.array_sort(rows), lambda r: r[field]), " "))


def _stale_audio(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, engine, voice, text_hash, current_hash): what each recording speaks and what its document says now."""
    chunks = table(spark, base, "tts_chunks").select("doc_id", "engine", "voice", "chunk_idx", "text", (F.size("sentence_indices") > 0).alias("speaks")).distinct()
    audio = chunks.groupBy("doc_id", "engine", "voice").agg(_joined(F.collect_list(F.when(F.col("speaks"), F.struct("chunk_idx", "text"))), "text").alias("text_hash"))
    said = table(spark, base, "sections").select("doc_id", F.struct("id", F.array_join("chunks", " ").alias("text")).alias("s")).filter("s.text <> ''")
    now = said.groupBy("doc_id").agg(_joined(F.collect_list("s"), "text").alias("current_hash"))
    return audio.join(now, "doc_id", "left").withColumn("current_hash", F.coalesce("current_hash", X.text_hash(F.lit(""))))


@query(f"WITH {_AUDIO} SELECT * FROM st")
def c10_stale_audio(spark: SparkSession, base: str) -> DataFrame:
    """Recordings by document, engine and voice, stale where the hash of their text is not that of the current one."""
    return _stale_audio(spark, base).select("doc_id", "engine", "voice", (F.col("text_hash") != F.col("current_hash")).alias("stale"))


@query()
def c10_audio_hashes(spark: SparkSession, base: str) -> DataFrame:
    """The hashes that c10_stale_audio compares."""
    return _stale_audio(spark, base)


@query(f"WITH {ITEMS}, {_AUDIO} SELECT it.id, it.playlist_id, it.doc_id, engine, voice, CASE WHEN stale IS NULL THEN 'none' WHEN stale THEN 'stale' ELSE 'fresh' END AS state FROM it LEFT JOIN st USING (doc_id)")
def f04_item_audio(spark: SparkSession, base: str) -> DataFrame:
    """Playlist items with the state of each recording of their document."""
    items = _items(spark, base).select("id", "playlist_id", "doc_id")
    state = F.when(F.col("text_hash").isNull(), "none").when(F.col("text_hash") != F.col("current_hash"), "stale").otherwise("fresh")
    return items.join(_stale_audio(spark, base), "doc_id", "left").select("id", "playlist_id", "doc_id", "engine", "voice", state.alias("state"))


KEY = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH c AS (SELECT DISTINCT engine, CASE WHEN length(voice) % 2 = 0 THEN upper(voice) ELSE voice || '-' END AS name FROM tts_chunks WHERE engine <> 'pocket'),
m AS (SELECT engine, {KEY.format(c='name')} AS k, min(name) AS name, min(language) AS language, min(dialect) AS dialect FROM voices GROUP BY 1, 2)
SELECT c.engine, c.name, coalesce(language, 'unknown') AS language, coalesce(dialect, '') AS dialect, false AS fallback FROM c LEFT JOIN m ON m.engine = c.engine AND m.k = {KEY.format(c='c.name')}
UNION ALL SELECT engine, name, coalesce(language, 'unknown'), coalesce(dialect, ''), true FROM m WHERE engine NOT IN (SELECT engine FROM c)""")
def f05_voice_metadata(spark: SparkSession, base: str) -> DataFrame:
    """A catalogue of voices with their metadata by normalised name; an engine without a catalogue has its metadata only.

    The catalogue is the names in use, oddly written, and lacks one engine.
    """
    name = F.when(F.length("voice") % 2 == 0, F.upper("voice")).otherwise(F.concat("voice", F.lit("-")))
    catalogue = table(spark, base, "tts_chunks").filter("engine <> 'pocket'").select("engine", name.alias("name")).distinct()
    return L.described_voices(catalogue, table(spark, base, "voices"))


@query(f"""WITH q AS (SELECT DISTINCT engine, CASE WHEN hash % 3 = 0 THEN voice WHEN hash % 3 = 1 THEN upper(voice) ELSE voice || ' x' END AS request FROM (SELECT engine, voice, length(voice) AS hash FROM tts_chunks)),
h AS (SELECT q.engine, request, 1 AS rank, name FROM q JOIN voices v ON v.engine = q.engine AND v.name = request
  UNION ALL SELECT q.engine, request, 2, name FROM q JOIN voices v ON v.engine = q.engine AND {KEY.format(c='v.name')} = {KEY.format(c='request')}
  UNION ALL SELECT q.engine, request, 3, name FROM q JOIN voices v ON v.engine = q.engine AND lower(v.name) = lower(request))
SELECT engine, request, coalesce(first(name ORDER BY rank, name), 'default') AS name FROM q LEFT JOIN h USING (engine, request) GROUP BY 1, 2""")
def f06_resolve_voice(spark: SparkSession, base: str) -> DataFrame:
    n = F.length("voice") % 3
    asked = table(spark, base, "tts_chunks").select("engine", F.when(n == 0, F.col("voice")).when(n == 1, F.upper("voice")).otherwise(F.concat("voice", F.lit(" x"))).alias("request")).distinct()
    return L.resolve_voices(asked, table(spark, base, "voices"), "default")


@query("""WITH p AS (SELECT DISTINCT id AS doc_id, unnest(raw_pages) AS raw, generate_subscripts(raw_pages, 1)::INTEGER AS page FROM docs WHERE raw_pages IS NOT NULL),
g AS (SELECT doc_id, page, max_by(markdown, (finished_at, markdown)) AS again FROM ocr_results WHERE NOT failed GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN coalesce(trim(again), '') = '' THEN raw ELSE again END AS text, coalesce(trim(again), '') <> '' AS replaced FROM p LEFT JOIN g USING (doc_id, page)""")
def f07_merge_readings(spark: SparkSession, base: str) -> DataFrame:
    return L.merge_page_readings(table(spark, base, "docs"), table(spark, base, "ocr_results"))


@query(f"WITH {ITEMS} SELECT playlist_id, doc_id, count(*) AS n FROM it WHERE doc_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def f14_duplicate_docs(spark: SparkSession, base: str) -> DataFrame:
    return _items(spark, base).filter(F.col("doc_id").isNotNull()).groupBy("playlist_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"WITH {ITEMS} SELECT id, lead(id) OVER (PARTITION BY playlist_id ORDER BY created_at, id) AS next_id FROM it")
def f15_next_item(spark: SparkSession, base: str) -> DataFrame:
    return _items(spark, base).select("id", F.lead("id").over(W.partitionBy("playlist_id").orderBy("created_at", "id")).alias("next_id"))


@query(f"WITH {ITEMS},{PLAYLISTS} SELECT playlist_id, row_number() OVER (ORDER BY coalesce(last_listened_at, -1) DESC, updated_at DESC, playlist_id) AS place FROM pl")
def g01_sort_playlists(spark: SparkSession, base: str) -> DataFrame:
    return L.by_listening(L.playlists(_items(spark, base))).select("playlist_id", "place")


@query("SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM (SELECT DISTINCT id, updated_at FROM docs)")
def g03_recent_docs(spark: SparkSession, base: str) -> DataFrame:
    return ranked(table(spark, base, "docs").select("id", "updated_at").distinct(), "place", F.col("updated_at").desc(), F.col("id"))


RANKS = """list_position(['english','german','french','spanish','japanese'], lower(coalesce(language,''))) AS lr, list_position(['american','british','australian','indian'], lower(coalesce(dialect,''))) AS dr, list_position(['female','male'], lower(coalesce(gender,''))) AS gr"""
LABEL = "coalesce(nullif(concat_ws(' · ', nullif(language,''), nullif(dialect,''), nullif(upper(gender[1]) || lower(gender[2:]), '')), ''), 'Voices')"
NATURAL = r"regexp_replace(regexp_replace(lower(name), '(\d+)', '0000000000\1', 'g'), '0*(\d{10})(\D|$)', '\1\2', 'g')"


@query(f"""WITH v AS (SELECT name, language, dialect, gender, {LABEL} AS label, {RANKS} FROM voices),
g AS (SELECT language, dialect, gender, label, any_value(coalesce(nullif(lr, 0) - 1, 5)) AS a, any_value(coalesce(nullif(dr, 0) - 1, 4)) AS b, any_value(coalesce(nullif(gr, 0) - 1, 2)) AS c, list(name ORDER BY {NATURAL}, name) AS names FROM v GROUP BY 1, 2, 3, 4)
SELECT label, row_number() OVER (ORDER BY a, lower(language) NULLS FIRST, b, lower(coalesce(dialect, '')), c, label)::BIGINT AS place, names FROM g""")
def h08_voice_groups(spark: SparkSession, base: str) -> DataFrame:
    return L.grouped_voices(table(spark, base, "voices"))


@query(f"SELECT name, engine, row_number() OVER (ORDER BY {NATURAL}, name, engine)::BIGINT AS place FROM voices")
def g04_natural_order(spark: SparkSession, base: str) -> DataFrame:
    return ranked(table(spark, base, "voices").select("name", "engine"), "place", X.natural_key(F.col("name")), F.col("name"), F.col("engine"))


@query("SELECT name, engine, row_number() OVER (ORDER BY lower(strip_accents(name)), name, engine)::BIGINT AS place FROM voices")
def g05_sort_names(spark: SparkSession, base: str) -> DataFrame:
    return ranked(table(spark, base, "voices").select("name", "engine"), "place", F.lower(F.translate("name", "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")), F.col("name"), F.col("engine"))


@query("SELECT doc_id, list(DISTINCT page ORDER BY page) AS pages FROM ocr_results WHERE failed GROUP BY 1")
def g07_failed_pages(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "ocr_results").filter("failed").groupBy("doc_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))


@query(f"WITH {ITEMS} SELECT playlist_id, first(id ORDER BY updated_at DESC, id) AS resume FROM it WHERE progress > 0 GROUP BY 1")
def g10_resume_target(spark: SparkSession, base: str) -> DataFrame:
    w = W.partitionBy("playlist_id").orderBy(F.col("updated_at").desc(), "id")
    return _items(spark, base).filter("progress > 0").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("playlist_id", F.col("id").alias("resume"))


@query(f"WITH {ITEMS} SELECT playlist_id, sum(greatest(total_sentences, 0))::BIGINT AS total, sum(least(greatest(progress, 0), greatest(total_sentences, 0)))::BIGINT AS done FROM it GROUP BY 1")
def h02_playlist_totals(spark: SparkSession, base: str) -> DataFrame:
    total = F.greatest("total_sentences", F.lit(0))
    return _items(spark, base).groupBy("playlist_id").agg(F.sum(total).alias("total"), F.sum(F.least(F.greatest("progress", F.lit(0)), total)).alias("done"))


@query(f"WITH {ITEMS},{SENTENCES},{STATS},{TOTALS} SELECT * FROM ps")
def h03_library_stats(spark: SparkSession, base: str) -> DataFrame:
    return L.playlist_stats(L.item_stats(_items(spark, base), table(spark, base, "sections")))


@query("SELECT id, title FROM (SELECT DISTINCT id, title FROM docs) WHERE id NOT IN (SELECT DISTINCT doc_id FROM sections)")
def j02_except(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "title").distinct().join(table(spark, base, "sections").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("SELECT id FROM docs INTERSECT SELECT doc_id FROM tts_chunks")
def j03_intersect(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id").intersect(table(spark, base, "tts_chunks").select("doc_id"))


@query("SELECT DISTINCT slug FROM docs")
def j04_distinct_slugs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("slug").distinct()


@query("SELECT id FROM (SELECT doc_id AS id FROM sections UNION ALL SELECT doc_id FROM ocr_results UNION ALL SELECT doc_id FROM tts_chunks)")
def j01_union(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sections").select(F.col("doc_id").alias("id")).unionByName(table(spark, base, "ocr_results").select(F.col("doc_id").alias("id"))).unionByName(table(spark, base, "tts_chunks").select(F.col("doc_id").alias("id")))
