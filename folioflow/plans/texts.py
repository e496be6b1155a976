"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.plans.library import CLOCK
from folioflow.plans.registry import query
from folioflow.sources.tables import table

_STRICT = r"""([.!?]["'')\]]*)\s+([A-Z0-9"'']|[(\[][A-Z0-9"''])"""


def _duck_split(t: str) -> str:
    clean = "list_filter(list_transform(string_split({x}, chr(1)), lambda p: trim(p)), lambda p: p <> '')"
    strict = clean.format(x=f"regexp_replace({t}, '{_STRICT}', '\\1' || chr(1) || '\\2', 'g')")
    loose = clean.format(x=f"regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g')")
    return f"CASE WHEN len({strict}) > 1 THEN {strict} ELSE {loose} END"


@query(f"SELECT doc_id, {_duck_split('text')} AS sentences FROM documents")
def d03_sentences(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", X.split_sentences(F.col("text")).alias("sentences"))


@query(f"""WITH s AS (SELECT doc_id, {_duck_split('text')} AS s FROM documents), n AS (SELECT doc_id, len(s) AS n, list_sum(list_transform(s, lambda x: length(x))) + greatest(len(s) - 1, 0) AS chars FROM s),
t AS (SELECT *, floor(chars / 15.0 + 0.5)::BIGINT AS sec FROM n)
SELECT doc_id, n::INTEGER AS n_sentences, chars::BIGINT AS chars, {CLOCK.format(s='sec')} AS duration FROM t""")
def d55_sentence_stats(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "documents").select("doc_id", X.split_sentences(F.col("text")).alias("s"))
    chars = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)) + F.greatest(F.size("s") - 1, F.lit(0))
    return s.select("doc_id", F.size("s").alias("n_sentences"), chars.alias("chars"), X.clock(chars / F.lit(15.0)).alias("duration"))


@query()
def d01_strip_markdown(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", X.strip_markdown(F.col("markdown")).alias("spoken")).distinct()


BARE = r"""length(trim(l)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(l), '[.!?…]["'')\]]*$') AND NOT regexp_matches(trim(l), '[,;:—–-]$') AND NOT regexp_matches(l, '^(#{1,6}\s|\s*[-*+•]\s|\s*[0-9]{1,3}[.)]\s|\s*>|\s*\|)') AND NOT regexp_matches(trim(l), '(^|\s)[("'']*[A-Za-z]{1,4}[)\]"'':;,.!?]*$')"""


@query(f"WITH x AS (SELECT DISTINCT id, markdown FROM docs), y AS (SELECT id, unnest(string_split(markdown, chr(10))) AS l, generate_subscripts(string_split(markdown, chr(10)), 1)::INTEGER AS line_no FROM x) SELECT id, line_no FROM y WHERE {BARE}")
def d04_bare_item_lines(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "docs").select("id", "markdown").distinct().select("id", F.posexplode(F.split("markdown", "\n", -1)).alias("p", "l"))
    t = F.trim("l")
    bare = (
        F.length(t).between(1, 60) & ~t.rlike(r"[.!?…][\"')\]]*\z") & ~t.rlike(r"[,;:—–-]\z") & ~F.col("l").rlike(r"^(#{1,6}\s|\s*[-*+•]\s|\s*[0-9]{1,3}[.)]\s|\s*>|\s*\|)")
        & ~t.rlike(r"(^|\s)[(\"']*[A-Za-z]{1,4}[)\]\"':;,.!?]*\z")
    )
    return lines.filter(bare).select("id", (F.col("p") + 1).alias("line_no"))


@query(r"SELECT doc_id, id, length(regexp_replace(coalesce(heading,''), '[^A-Za-z]', '', 'g')) >= 4 AND regexp_replace(coalesce(heading,''), '[^A-Za-z]', '', 'g') = upper(regexp_replace(coalesce(heading,''), '[^A-Za-z]', '', 'g')) AS is_chapter FROM sections")
def d10_chapter_flag(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sections").select("doc_id", "id", X.is_chapter(F.coalesce("heading", F.lit(""))).alias("is_chapter"))


@query(r"""WITH t AS (SELECT article_id, regexp_replace(regexp_replace(upper(replace(coalesce(title, ''), 'ß', 'SS')) || '..', '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\.+$', '') AS c FROM articles)
SELECT article_id, CASE WHEN length(regexp_replace(c, '[^A-Za-z]', '', 'g')) >= 4 AND regexp_replace(c, '[^a-z]', '', 'g') = '' THEN
 array_to_string(list_transform(regexp_extract_all(lower(c), '[a-z0-9]+|[^a-z0-9]+'), lambda w: CASE WHEN w[1] BETWEEN 'a' AND 'z' AND ascii(w[1]) < 128 THEN upper(w[1]) || w[2:] ELSE w END), '') ELSE c END AS shown FROM t""")
def d11_display_title(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "articles").select("article_id", X.display_title(F.concat(F.upper(F.coalesce("title", F.lit(""))), F.lit(".."))).alias("shown"))


@query("SELECT doc_id, id, array_to_string(titles, ' > ') AS path FROM sections")
def d12_breadcrumbs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sections").select("doc_id", "id", F.array_join("titles", " > ").alias("path"))


@query("SELECT DISTINCT id, (CASE WHEN total_sentences > 0 THEN floor(progress::DOUBLE / total_sentences * 100 + 0.5) ELSE 0 END)::BIGINT AS pct FROM playlist_items")
def d13_progress_percent(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "playlist_items").select("id", X.percent(F.col("progress"), F.col("total_sentences")).alias("pct")).distinct()


@query("""WITH d AS (SELECT DISTINCT id, page_count AS n FROM docs WHERE page_count IS NOT NULL), m AS (SELECT id, n, list_transform(range(1, n + 1), lambda p: CASE WHEN p = 2 THEN 9 ELSE 5 + p - 1 END) AS pm FROM d)
SELECT id, coalesce(nullif(list_position(pm, 7), 0), greatest(1, least(7, n)))::INTEGER AS physical, pm[1]::INTEGER AS first_logical FROM m""")
def d14_page_mapping(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "docs").filter("page_count IS NOT NULL").select("id", F.col("page_count").alias("n")).distinct()
    over = F.create_map(F.lit(2), F.lit(9))
    d = d.withColumn("pm", F.transform(F.sequence(F.lit(1), "n"), lambda p: F.coalesce(F.try_element_at(over, p), F.lit(5) + p - 1)))
    at = F.array_position("pm", F.lit(7)).cast("int")
    return d.select("id", F.when(at > 0, at).otherwise(F.greatest(F.lit(1), F.least(F.lit(7), "n"))).alias("physical"), F.element_at("pm", 1).alias("first_logical"))


@query(r"""WITH d AS (SELECT DISTINCT id, markdown FROM docs), p AS (SELECT id, string_split(markdown, '```') AS a FROM d)
SELECT id, array_to_string(list_transform(a, lambda x, i: CASE WHEN i % 2 = 1 THEN regexp_replace(regexp_replace(x, '\x{AD}\s*', '', 'g'), '(\p{L})-\s+(\p{Ll})', '\1\2', 'g') ELSE x END), '```') AS text FROM p""")
def d16_dehyphenate(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "docs").select("id", "markdown").distinct().select("id", X.dehyphenate(F.col("markdown")).alias("text"))


@query(r"""WITH d AS (SELECT DISTINCT id, markdown FROM docs), p AS (SELECT id, unnest(string_split(markdown, chr(10) || chr(10))) AS b, generate_subscripts(string_split(markdown, chr(10) || chr(10)), 1)::INTEGER AS n FROM d)
SELECT id, n, regexp_matches(b, '^(#|>|[-*+] |[0-9]+[.)] |```|\|)') AS special, regexp_matches(trim(b), '[.!?]["'')\]]*$') AS terminal, len(list_filter(string_split(b, chr(10)), lambda l: NOT starts_with(trim(l), '|'))) = 0 AS is_table FROM p""")
def d18_block_tests(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "docs").select("id", "markdown").distinct().select("id", F.posexplode(F.split("markdown", "\n\n", -1)).alias("n", "b"))
    return p.select(
        "id", (F.col("n") + 1).alias("n"), F.col("b").rlike(r"^(#|>|[-*+] |[0-9]+[.)] |```|\|)").alias("special"), F.trim("b").rlike(r"[.!?][\"')\]]*\z").alias("terminal"),
        F.forall(F.split("b", "\n", -1), lambda x: F.startswith(F.trim(x), F.lit("|"))).alias("is_table"),
    )


SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"


@query(f"WITH d AS (SELECT DISTINCT id, title FROM docs), s AS (SELECT id, {SLUG.format(c='title')} AS b FROM d), r AS (SELECT id, b, row_number() OVER (PARTITION BY b ORDER BY id) AS n FROM s) SELECT id, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS slug FROM r")
def d19_unique_slugs(spark: SparkSession, base: str) -> DataFrame:
    from pyspark.sql import Window as W

    d = table(spark, base, "docs").select("id", "title").distinct().withColumn("b", X.slug(F.col("title")))
    n = F.row_number().over(W.partitionBy("b").orderBy("id"))
    return d.withColumn("n", n).select("id", F.when(F.col("n") == 1, F.col("b")).otherwise(F.concat_ws("-", "b", F.col("n").cast("string"))).alias("slug"))


@query(r"""WITH d AS (SELECT DISTINCT id, array_to_string(raw_pages, chr(10) || '<!-- page break -->' || chr(10)) AS m FROM docs WHERE raw_pages IS NOT NULL)
SELECT id, regexp_matches(m, '(?i)<!--\s*page\s*break\s*-->') AS has_breaks, len(regexp_split_to_array(m, '(?i)<!--\s*page\s*break\s*-->'))::INTEGER AS n_pages FROM d""")
def d22_page_breaks(spark: SparkSession, base: str) -> DataFrame:
    m = F.array_join("raw_pages", "\n<!-- page break -->\n")
    p = r"(?i)<!--\s*page\s*break\s*-->"
    return table(spark, base, "docs").filter("raw_pages IS NOT NULL").select("id", m.rlike(p).alias("has_breaks"), F.size(F.split(m, p, -1)).alias("n_pages")).distinct()


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[.!?]["'')\]]*(\s|$)') THEN length(regexp_extract(text, '^((?s:.*?)[.!?]["'')\]]*)(\s|$)', 1)) ELSE -1 END::INTEGER AS first_end FROM documents""")
def d23_first_sentence_end(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("text")
    return table(spark, base, "documents").select("doc_id", F.when(t.rlike(r"[.!?][\"')\]]*(\s|\z)"), F.length(F.regexp_extract(t, r"^((?s:.*?)[.!?][\"')\]]*)(\s|\z)", 1))).otherwise(-1).alias("first_end"))


@query("SELECT doc_id, page, run, CASE WHEN lower(trim(markdown)) = '<no text found>' THEN '' ELSE markdown END AS markdown FROM ocr_results")
def d28_blank_pages(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "ocr_results").select("doc_id", "page", "run", X.blank_page(F.col("markdown")).alias("markdown"))


SPEAK = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(translate({t}, '“”‘’', '""'''''), '…', '...'), '[—–|]', ', ', 'g'), '(?i)\bhttps?://(?:www\.)?([^\s)>\]"/:?#]+)[^\s)>\]"]*', '\1', 'g'), '(?i)\bwww\.([^\s)>\]"/:?#]+)[^\s)>\]"]*', '\1', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, {SPEAK.format(t='text')} AS spoken FROM documents")
def d29_speakable(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", X.speakable(F.col("text")).alias("spoken"))


@query()
def d30_pack_pieces(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sections").select("doc_id", F.col("id").alias("section_id"), F.posexplode("chunks").alias("pos", "t")).select("doc_id", "section_id", "pos", X.pack_pieces(F.col("t")).alias("pieces"))


@query("""WITH n AS (SELECT n_nationkey, ['key: ' || n_nationkey, 'name: ' || n_name, 'region: ' || n_regionkey] AS cells, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS c FROM nation)
SELECT n_nationkey, 'Row ' || i || ' of ' || c || ': ' || array_to_string(cells, ', ') || '.' AS spoken FROM n""")
def d35_table_records(spark: SparkSession, base: str) -> DataFrame:
    from folioflow.operators.markdown import table_records

    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n_nationkey").cast("string"), F.concat(F.lit("**"), "n_name", F.lit("**")), F.col("n_regionkey").cast("string")), F.lit(" |"))
    rows = table(spark, base, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"), F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    md = F.concat(F.lit("| key | name | region |\n| --- | :-: | --- |\n"), "b")
    return rows.select("k", F.posexplode(table_records(md)).alias("i", "spoken")).select(F.element_at("k", F.col("i") + 1).alias("n_nationkey"), "spoken")


# code points beyond the first plane are two units of UTF-16
@query("""WITH c AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT) AS p FROM documents),
u AS (SELECT doc_id, flatten(list_transform(p, lambda c: CASE WHEN c < 65536 THEN [c] ELSE [55232 + c // 1024, 56320 + c % 1024] END)) AS u FROM c)
SELECT doc_id, lower(to_base(list_reduce(list_prepend(5381::BIGINT, u), lambda h, c: (h * 33 + c) % 4294967296), 36)) AS hash FROM u""")
def d36_text_hash(spark: SparkSession, base: str) -> DataFrame:
    """The hash of every document's whole text."""
    return table(spark, base, "documents").select("doc_id", X.text_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, id, array_to_string(chunks, ' ') AS joined FROM sections")
def d37_join_texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sections").select("doc_id", "id", F.array_join("chunks", " ").alias("joined"))


@query("SELECT id, greatest(0.5, least(2.0, coalesce(try_cast(regexp_extract(slug, '[0-9]+') AS DOUBLE), 1.0))) AS rate FROM (SELECT DISTINCT id, slug FROM docs)")
def d38_parse_rate(spark: SparkSession, base: str) -> DataFrame:
    r = F.coalesce(F.nullif(F.regexp_extract("slug", "[0-9]+", 0), F.lit("")).try_cast("double"), F.lit(1.0))
    return table(spark, base, "docs").select("id", "slug").distinct().select("id", F.greatest(F.lit(0.5), F.least(F.lit(2.0), r)).alias("rate"))


@query("SELECT article_id, coalesce(nullif(trim(title), ''), nullif(trim(site), ''), 'Untitled') AS shown FROM articles")
def d39_precedence(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "articles").select("article_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("site"), F.lit("")), F.lit("Untitled")).alias("shown"))


@query("""SELECT article_id, '{' || concat_ws(',', '"domain":' || to_json(domain), CASE WHEN trim(coalesce(author, '')) <> '' THEN '"author":' || to_json(trim(author)) END) || '}' AS payload FROM articles""")
def d41_sparse_payload(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "articles").select("article_id", F.to_json(F.struct("domain", F.nullif(F.trim("author"), F.lit("")).alias("author"))).alias("payload"))


@query("WITH m AS (SELECT doc_id, engine, max(voice) AS v FROM tts_chunks GROUP BY 1, 2) SELECT doc_id, coalesce(max(v) FILTER (WHERE engine = 'pocket'), 'default') AS pocket_voice, count(*) AS engines FROM m GROUP BY 1")
def d42_engine_map(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "tts_chunks").groupBy("doc_id", "engine").agg(F.max("voice").alias("v")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("engine", "v"))).alias("m"))
    return m.select("doc_id", F.coalesce(F.try_element_at("m", F.lit("pocket")), F.lit("default")).alias("pocket_voice"), F.size("m").cast("bigint").alias("engines"))


@query("SELECT domain, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'ja' THEN 'Japanese' ELSE lang END AS language FROM sites")
def d43_locale_map(spark: SparkSession, base: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German", "fr", "French", "es", "Spanish", "ja", "Japanese")])
    return table(spark, base, "sites").select("domain", F.coalesce(F.try_element_at(names, F.col("lang")), "lang").alias("language"))


@query("SELECT DISTINCT doc_id || '::' || engine || '::' || voice AS key FROM tts_chunks")
def d48_composite_key(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "tts_chunks").select(F.concat_ws("::", "doc_id", "engine", "voice").alias("key")).distinct()


@query("SELECT name, engine, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM voices")
def d49_voice_key(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "voices").select("name", "engine", X.voice_key(F.col("name")).alias("key"))


@query(r"SELECT article_id, lower(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)) AS host, CASE WHEN ends_with(trim(split_part(split_part(lower(url), '?', 1), '#', 1)), '.pdf') THEN 'pdf' WHEN ends_with(trim(split_part(split_part(lower(url), '?', 1), '#', 1)), '.epub') THEN 'epub' ELSE 'article' END AS kind FROM articles")
def d50_host_and_kind(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "articles").select("article_id", X.host(F.col("url")).alias("host"), X.url_kind(F.col("url")).alias("kind"))


@query("SELECT DISTINCT id, CASE WHEN source.kind LIKE '%url' THEN coalesce(nullif(source.domain, ''), 'Web') WHEN source.kind LIKE 'pdf%' THEN 'PDF' WHEN source.kind LIKE 'epub%' THEN 'ePub' WHEN source.kind LIKE 'markdown%' THEN 'Markdown' ELSE 'Document' END AS label FROM playlist_items")
def d51_source_label(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "playlist_items").select("id", X.source_label(F.col("source")).alias("label")).distinct()


@query("""WITH r AS (SELECT DISTINCT doc_id, run, page, finished_at FROM ocr_results), a AS (SELECT doc_id, run, count(DISTINCT page) AS done, date_diff('microsecond', min(finished_at), max(finished_at)) / 1e6 AS sec FROM r GROUP BY 1, 2)
SELECT a.doc_id, run, CASE WHEN done > 1 THEN round(greatest(0, d.n - done) * sec / (done - 1), 3) END AS eta FROM a JOIN (SELECT DISTINCT id, page_count AS n FROM docs) d ON d.id = a.doc_id""")
def d53_page_eta(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "ocr_results").groupBy("doc_id", "run").agg(F.countDistinct("page").alias("done"), ((F.unix_micros(F.max("finished_at")) - F.unix_micros(F.min("finished_at"))) / 1e6).alias("sec"))
    d = table(spark, base, "docs").select(F.col("id").alias("doc_id"), F.col("page_count").alias("n")).distinct()
    return a.join(d, "doc_id").select("doc_id", "run", F.when(F.col("done") > 1, F.round(F.greatest(F.lit(0), F.col("n") - F.col("done")) * F.col("sec") / (F.col("done") - 1), 3)).alias("eta"))


@query("""WITH n AS (SELECT max(updated_at) AS now FROM docs), d AS (SELECT DISTINCT id, updated_at, (now - updated_at) // 60000 AS m FROM docs, n)
SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 10080 THEN (m // 1440) || 'd ago' ELSE strftime(epoch_ms(updated_at), '%Y-%m-%d') END AS label FROM d""")
def d56_relative_time(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "docs").select("id", "updated_at").distinct()
    now = docs.agg(F.max("updated_at")).first()[0]
    return docs.select("id", X.relative_time(F.col("updated_at"), F.lit(now)).alias("label"))


@query(r"SELECT doc_id, greatest(1, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')))::INTEGER AS n FROM documents")
def d57_chunk_estimate(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"(?<=[.!?])\s+", -1), lambda x: F.trim(x) != ""))).alias("n"))


@query(r"""WITH m AS (SELECT article_id, CASE WHEN trim(coalesce(title, '')) = '' THEN NULL ELSE '# ' || trim(title) END AS h,
 trim(regexp_replace(array_to_string(list_filter(string_split(markdown, chr(10)), lambda x: NOT regexp_matches(x, '^#{1,6}\s*$')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS b FROM articles)
SELECT article_id, CASE WHEN h IS NULL OR starts_with(b, h) THEN b ELSE h || chr(10) || chr(10) || b END AS markdown FROM m""")
def d61_tidy_article(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "articles").select("article_id", X.tidy_article(F.col("markdown"), F.col("title")).alias("markdown"))


@query(r"SELECT article_id, left(trim(regexp_replace(regexp_replace(markdown, '(?m)^#{1,6}\s.*$', '', 'g'), '\s+', ' ', 'g')), 280) AS excerpt FROM articles")
def d62_excerpt(spark: SparkSession, base: str) -> DataFrame:
    body = F.regexp_replace("markdown", r"(?m)^#{1,6}\s.*$", "")
    return table(spark, base, "articles").select("article_id", F.left(F.trim(F.regexp_replace(body, r"\s+", " ")), F.lit(280)).alias("excerpt"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def d67_normalisers(spark: SparkSession, base: str) -> DataFrame:
    esc = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table(spark, base, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("plain"), esc.alias("escaped"))


@query("SELECT article_id, left(CASE WHEN length(domain) > 0 THEN replace(url, domain, '***') ELSE url END, 1000) AS message FROM articles")
def d68_redact(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "articles").select("article_id", X.redact(F.col("url"), F.col("domain")).alias("message"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN failed THEN 'failed' WHEN markdown = '' THEN 'empty' ELSE 'read' END AS reason FROM ocr_results), c AS (SELECT doc_id, reason, count(*) AS n FROM r GROUP BY 1, 2)
SELECT doc_id, string_agg(n || ' ' || reason, ' · ' ORDER BY reason) AS label FROM c GROUP BY 1""")
def d70_reason_labels(spark: SparkSession, base: str) -> DataFrame:
    reason = F.when(F.col("failed"), "failed").when(F.col("markdown") == "", "empty").otherwise("read")
    c = table(spark, base, "ocr_results").groupBy("doc_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("reason", F.concat_ws(" ", F.col("n").cast("string"), "reason").alias("t"))
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), " · ").alias("label"))


@query("SELECT DISTINCT id, CASE WHEN page_count > 0 THEN least(page_count, 8) ELSE 2 END AS workers FROM docs")
def d72_concurrency(spark: SparkSession, base: str) -> DataFrame:
    n = F.col("page_count")
    return table(spark, base, "docs").select("id", F.when(n > 0, F.least(n, F.lit(8))).otherwise(2).alias("workers")).distinct()
