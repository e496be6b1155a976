"""Queries over catalogues, settings, imports and single records."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions import text as X
from folioflow.operators import library as L
from folioflow.operators import markdown as M
from folioflow.operators import sequences as S
from folioflow.operators.common import ensure_checkpoint_dir, passing
from folioflow.plans.library import ITEMS, KEY, NATURAL, RANKS, LABEL
from folioflow.plans.registry import query
from folioflow.plans.texts import SLUG
from folioflow.sources import readers
from folioflow.sources.tables import table


ENGINES = ("phonon", "pocket")


@query(f"WITH v AS (SELECT name, engine, language, row_number() OVER (PARTITION BY engine, {KEY.format(c='name')} ORDER BY name DESC) AS r FROM voices) SELECT engine, name, language FROM v WHERE r = 1")
def a01_voice_catalogue(spark: SparkSession, base: str) -> DataFrame:
    """A catalogue file per engine, read back and keyed by the normalised name, the last of a key kept."""
    doc = table(spark, base, "voices").groupBy("engine").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("name", "language"))).alias("voices"))).alias("value"))
    at = passing(spark, f"{ensure_checkpoint_dir(spark)}/voices_{uuid.uuid4().hex}")
    doc.write.partitionBy("engine").text(at)
    parts = [readers.voice_catalog(spark, f"{at}/engine={e}").select(F.lit(e).alias("engine"), "name", "language") for e in ENGINES]
    return reduce(DataFrame.unionByName, parts)


@query("WITH v AS (SELECT name, engine, lower(substr(language, 1, 2)) AS language, row_number() OVER (PARTITION BY name ORDER BY engine) AS r FROM voices WHERE lower(substr(language, 1, 2)) = 'en') SELECT name, engine AS filename FROM v WHERE r = 1")
def a03_jsonl_catalogue(spark: SparkSession, base: str) -> DataFrame:
    """A file with a JSON line per voice, read back: blank and broken lines skipped, one language kept, the first of a name."""
    v = table(spark, base, "voices").select(F.to_json(F.struct("name", F.col("engine").alias("filename"), F.lower(F.substring("language", 1, 2)).alias("language"))).alias("value"), "engine", "name")
    bad = spark.range(1).select(F.explode(F.array(F.lit(""), F.lit("{bad"), F.lit("[1"))).alias("value"), F.lit("").alias("engine"), F.lit("").alias("name"))
    at = passing(spark, f"{ensure_checkpoint_dir(spark)}/lines_{uuid.uuid4().hex}")
    v.unionByName(bad).coalesce(1).sortWithinPartitions("engine", "name").select("value").write.text(at)
    return readers.voice_lines(spark, at).select("name", "filename")


@query(f"WITH {ITEMS}, n AS (SELECT playlist_id, count(*) AS n_items FROM it GROUP BY 1) SELECT it.playlist_id, id, n_items FROM it JOIN n USING (playlist_id)")
def a19_playlist_items(spark: SparkSession, base: str) -> DataFrame:
    items = L.distinct_items(table(spark, base, "playlist_items"))
    return items.join(items.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n_items")), "playlist_id").select("playlist_id", "id", "n_items")


@query("SELECT DISTINCT id, title FROM docs WHERE id NOT IN (SELECT doc_id FROM playlist_items WHERE doc_id IS NOT NULL)")
def a21_legacy_import(spark: SparkSession, base: str) -> DataFrame:
    """A library kept as one JSON map is taken over, ids that are there already skipped."""
    d = table(spark, base, "docs").select("id", "title").distinct()
    kept = d.select(F.to_json(F.map_from_arrays(F.array("id"), F.array("title"))).alias("j"))
    rows = kept.select(F.explode(F.from_json("j", "map<string,string>")).alias("id", "title"))
    return rows.join(table(spark, base, "playlist_items").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("SELECT key, markdown, finished_at FROM (SELECT doc_id || '::' || page AS key, markdown, finished_at, row_number() OVER (PARTITION BY doc_id, page ORDER BY finished_at DESC, markdown DESC) AS r FROM ocr_results WHERE NOT failed) WHERE r = 1")
def b02_upsert_asset(spark: SparkSession, base: str) -> DataFrame:
    """Readings put under their document and page, the one that came last."""
    good = table(spark, base, "ocr_results").filter("NOT failed").select(F.concat_ws("::", "doc_id", F.col("page").cast("string")).alias("key"), "markdown", "finished_at")
    return L.latest(good, "key", "finished_at", F.col("markdown").desc())


@query()
def b04_create_from_pages(spark: SparkSession, base: str) -> DataFrame:
    """Stored pages to a document: repaired, joined with markers, parsed into sections."""
    p = table(spark, base, "docs").filter("raw_pages IS NOT NULL").select("id", "raw_pages").distinct()
    clean = p.withColumn("pages", F.transform("raw_pages", lambda x: X.dehyphenate(F.coalesce(x, F.lit("")))))
    joined = clean.withColumn("j", M.join_pages(F.col("pages"))).select("id", M.reflow(F.col("j.markdown")).alias("markdown"), F.size("j.pages").alias("n_pages"))
    return joined.select("id", "markdown", "n_pages", F.size(M.parse_sections(F.col("markdown"))).alias("n_sections"))


@query(f"SELECT DISTINCT id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, {SLUG.format(c='title')} AS slug FROM docs")
def b05_build_doc(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"), X.slug(F.col("title")).alias("slug")).distinct()


@query("WITH m AS (SELECT max(name) AS x FROM voices) SELECT engine, name FROM voices, m WHERE name <> x")
def b09_delete_one(spark: SparkSession, base: str) -> DataFrame:
    v = table(spark, base, "voices")
    return v.join(v.agg(F.max("name").alias("name")), "name", "left_anti").select("engine", "name")


@query("SELECT vec_id, list_transform(embedding, lambda x: trunc(greatest(-1.0, least(1.0, x::DOUBLE)) * 32767)::INTEGER) AS pcm FROM embeddings")
def b19_pcm16(spark: SparkSession, base: str) -> DataFrame:
    one = lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int")
    return table(spark, base, "embeddings").select("vec_id", F.transform("embedding", one).alias("pcm"))


@query("SELECT DISTINCT id, slug, page_count, created_at FROM docs")
def c02_metadata(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "slug", "page_count", "created_at").distinct()


#: Blocks of IPv4 addresses that are private, local, reserved or for examples: first octets and length. Fixed values.
BLOCKED = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: Addresses of the same kinds in IPv6, as they are written. Fixed values.
BLOCKED6 = r"^(?:::1?|::ffff:.*|f[cd].*|fe[89ab].*|ff.*|2001:db8:.*|100::.*)$"


def admissible(url: Column) -> Column:
    """Whether a URL may be fetched: http(s), at most 2048 characters, a host that is neither local nor a private address.

    A host of figures and stops alone must be a sound IPv4 address. Names are not resolved here.
    """
    bracketed = F.lower(F.regexp_extract(url, r"^[^/?#]*//(?:[^/?#@]*@)?\[([^\]]*)\]", 1))
    host = X.host(url)
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    as_number = lambda ip: sum(int(x) << s for x, s in zip(ip.split("."), (24, 16, 8, 0), strict=True))
    blocked = reduce(lambda a, b: a | b, [value.between(as_number(ip), as_number(ip) + (1 << (32 - n)) - 1) for ip, n in BLOCKED])
    figures = host.rlike(r"^[\d.]+$")
    sound = (F.size(octets) == 4) & host.rlike(r"^(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}$") & F.forall(octets, lambda x: x <= 255)
    name_ok = (host != "") & ~host.rlike(r"^localhost\.?$|\.(?:local|localhost|internal)\.?$")
    public = F.when(bracketed != "", ~bracketed.rlike(BLOCKED6)).when(figures, sound & ~F.coalesce(blocked, F.lit(True))).otherwise(name_ok)
    return F.coalesce(url.rlike(r"^(?i)https?://") & (F.length(url) <= 2048) & public, F.lit(False))


@query("""SELECT * FROM (VALUES ('https://a.example/x', true), ('ftp://a.example', false), ('http://127.0.0.1/', false), ('http://10.1.2.3/x', false), ('http://localhost', false), ('http://8.8.8.8/', true), ('', false), ('http://169.254.0.1', false)) t(url, ok)""")
def c08_url_admission(spark: SparkSession, base: str) -> DataFrame:
    urls = ["https://a.example/x", "ftp://a.example", "http://127.0.0.1/", "http://10.1.2.3/x", "http://localhost", "http://8.8.8.8/", "", "http://169.254.0.1"]
    return spark.createDataFrame([(u,) for u in urls], "url string").select("url", admissible(F.col("url")).alias("ok"))


@query(r"""WITH u AS (SELECT 'articles' AS record_table, article_id::VARCHAR AS record_key, url FROM articles UNION SELECT 'playlist_items', id, source.url FROM playlist_items),
h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)) AS host FROM u)
SELECT record_table, record_key, url, coalesce(regexp_matches(url, '^(?i)https?://') AND length(url) <= 2048 AND host <> '' AND NOT regexp_matches(host, '^localhost$|\.(local|localhost|internal)$|^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^\['), false) AS ok FROM h""")
def c08_url_admission_all(spark: SparkSession, base: str) -> DataFrame:
    """Every URL of articles and playlist items, where c08_url_admission has literals; a missing one is not admitted."""
    articles = table(spark, base, "articles").select(F.lit("articles").alias("record_table"), F.col("article_id").cast("string").alias("record_key"), "url")
    items = table(spark, base, "playlist_items").select(F.lit("playlist_items"), "id", "source.url")
    return articles.union(items).distinct().withColumn("ok", admissible(F.col("url")))


@query("SELECT DISTINCT i.id, CASE WHEN source.url IS NULL THEN 'upload' WHEN ends_with(lower(split_part(split_part(source.url, '?', 1), '#', 1)), '.pdf') THEN 'pdf' WHEN ends_with(lower(split_part(split_part(source.url, '?', 1), '#', 1)), '.epub') THEN 'epub' ELSE 'article' END AS route FROM playlist_items i")
def c09_route_import(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "playlist_items").select("id", F.when(F.col("source.url").isNull(), "upload").otherwise(X.url_kind(F.col("source.url"))).alias("route")).distinct()


@query(r"""WITH d AS (SELECT DISTINCT id, raw_pages FROM docs WHERE raw_pages IS NOT NULL), m AS (SELECT id, len(raw_pages) AS n, array_to_string(list_transform(raw_pages, lambda x, i: 'Page ' || i || '.' || chr(10) || x), chr(10)) AS md FROM d),
t AS (SELECT id, n, list_max(list_transform(regexp_extract_all(md, '(?m)^Page ([0-9]+)\.$', 1), lambda x: x::INTEGER)) AS top FROM m) SELECT id, top AS last_marker, top = n AS matches FROM t""")
def h11_last_marker(spark: SparkSession, base: str) -> DataFrame:
    """The greatest page marker in a joined document, against the pages it should have."""
    p = table(spark, base, "docs").filter("raw_pages IS NOT NULL").select("id", "raw_pages").distinct()
    md = F.array_join(F.transform("raw_pages", lambda x, i: F.concat(F.lit("Page "), (i + 1).cast("string"), F.lit(".\n"), x)), "\n")
    top = F.array_max(F.transform(F.regexp_extract_all(md, F.lit(r"(?m)^Page (\d+)\.$"), 1), lambda x: x.cast("int")))
    return p.select("id", top.alias("last_marker"), (top == F.size("raw_pages")).alias("matches"))


@query("SELECT doc_id, id FROM sections WHERE trim(coalesce(chunks[1], '')) <> '' AND level IN (1, 2)")
def c15_guards(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sections").filter((F.trim(F.coalesce(F.try_element_at("chunks", F.lit(1)), F.lit(""))) != "") & F.col("level").isin(1, 2)).select("doc_id", "id")


@query(f"WITH {ITEMS}, o AS (SELECT playlist_id, list(id) FILTER (WHERE progress > 0) AS chosen, list(id) AS live FROM it GROUP BY 1) SELECT playlist_id, len(list_intersect(coalesce(chosen, []), live))::INTEGER AS n FROM o")
def c16_selection(spark: SparkSession, base: str) -> DataFrame:
    o = L.distinct_items(table(spark, base, "playlist_items")).groupBy("playlist_id").agg(F.collect_list(F.when(F.col("progress") > 0, F.col("id"))).alias("chosen"), F.collect_list("id").alias("live"))
    return o.select("playlist_id", F.size(F.array_intersect("chosen", "live")).alias("n"))


@query("WITH u AS (SELECT doc_id, max(voice) FILTER (WHERE engine = 'pocket') AS p, max(voice) AS v FROM tts_chunks GROUP BY 1) SELECT doc_id, coalesce(p, v, 'default') AS voice FROM u")
def c20_offline_voice(spark: SparkSession, base: str) -> DataFrame:
    u = table(spark, base, "tts_chunks").groupBy("doc_id").agg(F.max(F.when(F.col("engine") == "pocket", F.col("voice"))).alias("p"), F.max("voice").alias("v"))
    return u.select("doc_id", F.coalesce("p", "v", F.lit("default")).alias("voice"))


_BREAKS = r"""WITH d AS (SELECT DISTINCT id, markdown FROM docs), l AS (SELECT id, unnest(string_split(markdown, chr(10))) AS s, generate_subscripts(string_split(markdown, chr(10)), 1)::INTEGER AS n FROM d)"""


@query(_BREAKS + r""" SELECT id, n, CASE WHEN regexp_matches(s, '^(\t| {4})') AND trim(s) <> '' AND coalesce(trim(lag(s) OVER w) = '', true) AND coalesce(trim(lead(s) OVER w) = '', true) THEN ltrim(s, chr(9) || ' ') ELSE s END AS line FROM l WINDOW w AS (PARTITION BY id ORDER BY n)""")
def d06_dedent_lines(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "docs").select("id", "markdown").distinct().select("id", F.posexplode(F.split("markdown", "\n", -1)).alias("p", "s"))
    w = W.partitionBy("id").orderBy("p")
    alone = F.coalesce(F.trim(F.lag("s").over(w)) == "", F.lit(True)) & F.coalesce(F.trim(F.lead("s").over(w)) == "", F.lit(True))
    return lines.select("id", (F.col("p") + 1).alias("n"), F.when(F.col("s").rlike(r"^(\t| {4})") & (F.trim("s") != "") & alone, F.regexp_replace("s", r"^[\t ]+", "")).otherwise(F.col("s")).alias("line"))


@query("WITH d AS (SELECT DISTINCT id, page_count AS n FROM docs WHERE page_count IS NOT NULL) SELECT id, list_transform(range(1, n + 1), lambda p: (CASE WHEN p = 3 THEN 40 ELSE greatest(7, 1) + p - 1 END)::INTEGER) AS logical FROM d")
def d15_page_overrides(spark: SparkSession, base: str) -> DataFrame:
    over = F.map_filter(F.create_map(F.lit(3), F.lit(40), F.lit(-1), F.lit(5)), lambda k, v: (k >= 1) & (v >= 1))
    d = table(spark, base, "docs").filter("page_count IS NOT NULL").select("id", "page_count").distinct()
    return d.select("id", F.transform(F.sequence(F.lit(1), "page_count"), lambda p: F.coalesce(F.try_element_at(over, p), F.greatest(F.lit(7), F.lit(1)) + p - 1)).alias("logical"))


@query("""WITH d AS (SELECT DISTINCT id, string_split(markdown, chr(10)) AS l, page_count AS n FROM docs WHERE page_count > 0), s AS (SELECT id, l, n, greatest(1, ceil(len(l)::DOUBLE / n)::INTEGER) AS per FROM d)
SELECT id, p::INTEGER AS page, (1 + (p - 1) * per)::INTEGER AS start_line, least(len(l), p * per)::INTEGER AS end_line FROM s, LATERAL (SELECT unnest(range(1, n + 1)) AS p)""")
def d26_equal_line_map(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "docs").filter("page_count > 0").select("id", F.size(F.split("markdown", "\n", -1)).alias("l"), F.col("page_count").alias("n")).distinct()
    per = F.greatest(F.lit(1), F.ceil(F.col("l") / F.col("n"))).cast("int")
    return d.withColumn("per", per).select("id", F.explode(F.sequence(F.lit(1), "n")).alias("page"), "l", "per").select("id", "page", (F.lit(1) + (F.col("page") - 1) * F.col("per")).alias("start_line"), F.least("l", F.col("page") * F.col("per")).alias("end_line"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('**' || title || '**', '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '\*\*|__|~~', '', 'g'), '\s+', ' ', 'g')) AS cell FROM documents""")
def d34_clean_cell(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", M.clean_cell(F.concat(F.lit("**"), "title", F.lit("**"))).alias("cell"))


@query("""SELECT doc_id, page, (finished_at IS NOT NULL AND NOT failed) AS ok, page AS n FROM ocr_results""")
def d40_settings_parse(spark: SparkSession, base: str) -> DataFrame:
    """JSON settings, all or nothing: of the right types, or null."""
    j = F.to_json(F.struct((F.col("finished_at").isNotNull() & ~F.col("failed")).alias("ok"), F.col("page").alias("n")))
    v = F.parse_json(j)
    good = (F.schema_of_variant(v).like("%ok: BOOLEAN%")) & (F.schema_of_variant(v).like("%n: BIGINT%"))
    return table(spark, base, "ocr_results").select("doc_id", "page", F.when(good, F.try_variant_get(v, "$.ok", "boolean")).alias("ok"), F.when(good, F.try_variant_get(v, "$.n", "int")).alias("n"))


@query(f"SELECT name, engine, coalesce(nullif(lr, 0) - 1, 5)::BIGINT AS lang_rank, coalesce(nullif(dr, 0) - 1, 4)::BIGINT AS dialect_rank, coalesce(nullif(gr, 0) - 1, 2)::BIGINT AS gender_rank, {LABEL} AS label FROM (SELECT *, {RANKS} FROM voices)")
def d44_ranks_and_labels(spark: SparkSession, base: str) -> DataFrame:
    v = table(spark, base, "voices")
    return v.select("name", "engine", X.language_rank(F.col("language")).alias("lang_rank"), X.dialect_rank(F.col("dialect")).alias("dialect_rank"), X.gender_rank(F.col("gender")).alias("gender_rank"), X.group_label(F.col("language"), F.col("dialect"), F.col("gender")).alias("label"))


@query(f"SELECT name, engine, {SLUG.format(c='name')} AS param, engine IN ('pocket', 'phonon') AS server FROM voices")
def d46_voice_param(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "voices").select("name", "engine", X.slug(F.col("name")).alias("param"), F.col("engine").isin("pocket", "phonon").alias("server"))


@query(f"WITH {ITEMS}, p AS (SELECT playlist_id, count(*) AS n, sum(greatest(total_sentences, 0)) AS t, sum(least(greatest(progress, 0), greatest(total_sentences, 0))) AS d FROM it GROUP BY 1) SELECT playlist_id, n || ' items · ' || (CASE WHEN t > 0 THEN floor(d::DOUBLE / t * 100 + 0.5) ELSE 0 END)::BIGINT || '%' AS card FROM p")
def d71_card_text(spark: SparkSession, base: str) -> DataFrame:
    t = F.greatest("total_sentences", F.lit(0))
    p = L.distinct_items(table(spark, base, "playlist_items")).groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("t"), F.sum(F.least(F.greatest("progress", F.lit(0)), t)).alias("d"))
    return p.select("playlist_id", F.concat(F.col("n").cast("string"), F.lit(" items · "), X.percent(F.col("d"), F.col("t")).cast("string"), F.lit("%")).alias("card"))


@query("SELECT v.engine, v.name, coalesce(v.language, s.language, 'unknown') AS language FROM voices v LEFT JOIN (SELECT engine, max(language) AS language FROM voices GROUP BY 1) s USING (engine)")
def d73_voice_rows(spark: SparkSession, base: str) -> DataFrame:
    v = table(spark, base, "voices")
    s = v.groupBy("engine").agg(F.max("language").alias("s"))
    return v.join(s, "engine").select("engine", "name", F.coalesce("language", "s", F.lit("unknown")).alias("language"))


@query("WITH s AS (SELECT doc_id, id, unnest(titles) AS title, generate_subscripts(titles, 1) AS n FROM sections), m AS (SELECT doc_id, min(id) AS id FROM s GROUP BY 1) SELECT s.doc_id, s.id, title, n::INTEGER AS n FROM s JOIN m USING (doc_id, id)")
def f16_ordered_inner(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "sections").select("doc_id", "id", F.posexplode("titles").alias("n", "title"))
    return s.join(s.groupBy("doc_id").agg(F.min("id").alias("id")), ["doc_id", "id"]).select("doc_id", "id", "title", (F.col("n") + 1).alias("n"))


@query("SELECT doc_id, list(page ORDER BY page)[1:12] AS first_pages, greatest(0, count(*) - 12) AS more FROM (SELECT DISTINCT doc_id, page FROM ocr_results) GROUP BY 1")
def g06_first_pages(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "ocr_results").select("doc_id", "page").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("p"))
    return p.select("doc_id", F.slice("p", 1, 12).alias("first_pages"), F.greatest(F.lit(0), F.size("p") - 12).cast("bigint").alias("more"))


@query("SELECT article_id, coalesce(nullif(title, ''), nullif(site, ''), domain) AS shown FROM articles")
def h12_first_value(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "articles").select("article_id", F.coalesce(F.nullif("title", F.lit("")), F.nullif("site", F.lit("")), "domain").alias("shown"))


@query("WITH s AS (SELECT doc_id, id, list_sum(list_transform(chunks, lambda x: length(x)))::BIGINT AS n FROM sections) SELECT doc_id, id, n, (sum(n) OVER (PARTITION BY doc_id ORDER BY id) - n)::BIGINT AS start FROM s WHERE n IS NOT NULL")
def i04_section_offsets(spark: SparkSession, base: str) -> DataFrame:
    n = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    s = table(spark, base, "sections").filter(F.size("chunks") > 0).select("doc_id", "id", n.alias("n"))
    return s.withColumn("start", F.sum("n").over(S.running("doc_id", "id")) - F.col("n"))


@query(f"SELECT DISTINCT name, {NATURAL} AS key FROM voices")
def g04_natural_key(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "voices").select("name", X.natural_key(F.col("name")).alias("key")).distinct()


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us FROM events) SELECT user_id, event_id, round(us / 1e6 / done * (total - done), 3) AS eta FROM e")
def k04_running_eta(spark: SparkSession, base: str) -> DataFrame:
    u = W.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, base, "events").select("user_id", "event_id", F.row_number().over(u.orderBy("ts", "event_id")).alias("done"), F.count(F.lit(1)).over(u).alias("total"), (us - F.min(us).over(u)).alias("us"))
    return e.select("user_id", "event_id", F.round(F.col("us") / 1e6 / F.col("done") * (F.col("total") - F.col("done")), 3).alias("eta"))
