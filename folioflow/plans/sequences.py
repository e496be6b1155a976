"""Queries over ordered rows: sentences, sections, pages, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.functions import text as X
from folioflow.operators import library as L
from folioflow.operators import sequences as S
from folioflow.plans.library import SENTENCES
from folioflow.plans.registry import query
from folioflow.sources.tables import table


def _sections(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sections")


@query(f"WITH {SENTENCES} SELECT doc_id, g, section_id, pos, sentence FROM se")
def e01_global_sentences(spark: SparkSession, base: str) -> DataFrame:
    return L.sentences(_sections(spark, base)).select("doc_id", "g", "section_id", "pos", "sentence")


@query("SELECT doc_id, id, (unnest(CASE WHEN len(paragraphs) > 0 THEN paragraphs WHEN len(chunks) > 0 THEN [chunks] ELSE [] END)) AS pieces FROM sections")
def e02_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    p = F.when(F.size("paragraphs") > 0, F.col("paragraphs")).when(F.size("chunks") > 0, F.array("chunks")).otherwise(F.array().cast("array<array<string>>"))
    return _sections(spark, base).select("doc_id", "id", F.explode(p).alias("pieces"))


@query("""WITH p AS (SELECT doc_id, id AS section_id, heading, unnest(paragraphs) AS pieces, generate_subscripts(paragraphs, 1) - 1 AS para_idx FROM sections),
q AS (SELECT doc_id, section_id, para_idx, para_idx = 0 AND heading IS NOT NULL AS is_heading, unnest(pieces) AS sentence, generate_subscripts(pieces, 1) AS n FROM p)
SELECT doc_id, section_id, para_idx, is_heading, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, para_idx, n) - 1 AS g FROM q""")
def e03_render_rows(spark: SparkSession, base: str) -> DataFrame:
    return L.sentence_paragraphs(_sections(spark, base))


STARTS = "ss AS (SELECT doc_id, id AS section_id, len(chunks) AS n, sum(len(chunks)) OVER (PARTITION BY doc_id ORDER BY id) - len(chunks) AS start FROM sections)"


@query(f"""WITH {STARTS}, t AS (SELECT doc_id, sum(n) AS c FROM ss GROUP BY 1), p AS (SELECT DISTINCT i.doc_id, i.progress::BIGINT AS g, least(i.progress, c - 1) AS x FROM playlist_items i JOIN t USING (doc_id))
SELECT p.doc_id, g, section_id, (x - start)::BIGINT AS chunk FROM p JOIN ss ON ss.doc_id = p.doc_id AND n > 0 AND x >= start AND x < start + n""")
def f08_range_lookup(spark: SparkSession, base: str) -> DataFrame:
    points = table(spark, base, "playlist_items").select("doc_id", F.col("progress").cast("bigint").alias("g")).distinct()
    return S.locate(points, S.section_starts(_sections(spark, base)))


@query(f"WITH {STARTS} SELECT doc_id, section_id, (start + least(2, n - 1))::BIGINT AS g FROM ss WHERE n > 0")
def f09_global_index(spark: SparkSession, base: str) -> DataFrame:
    return S.section_starts(_sections(spark, base)).filter("n > 0").select("doc_id", "section_id", (F.col("start") + F.least(F.lit(2), F.col("n") - 1)).alias("g"))


LINES = r"""
pg AS (SELECT DISTINCT id AS doc_id, unnest(list_transform(raw_pages, lambda x, i: 'Page ' || i || '.' || chr(10) || x)) AS t, generate_subscripts(raw_pages, 1) AS p FROM docs WHERE raw_pages IS NOT NULL),
ln AS (SELECT doc_id, p, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM pg),
mk AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS g FROM ln)"""


def _marked_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines of scanned documents, each page led by its marker."""
    pages = table(spark, base, "docs").filter("raw_pages IS NOT NULL").select(F.col("id").alias("doc_id"), "raw_pages").distinct().select("doc_id", F.posexplode("raw_pages").alias("p", "x"))
    led = F.concat(F.lit("Page "), (F.col("p") + 1).cast("string"), F.lit(".\n"), "x")
    lines = pages.select("doc_id", "p", F.posexplode(F.split(led, "\n", -1)).alias("k", "s"))
    return lines.select("doc_id", "s", (F.row_number().over(W.partitionBy("doc_id").orderBy("p", "k")) - 1).alias("g"))


@query(rf"WITH {LINES} SELECT doc_id, g, coalesce(last_value(try_cast(regexp_extract(s, '^\s*Page (\d+)\.\s*$', 1) AS INTEGER) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY g), 1) AS page FROM mk")
def f10_page_for_sentence(spark: SparkSession, base: str) -> DataFrame:
    mark = F.nullif(F.regexp_extract("s", r"^\s*Page (\d+)\.\s*\z", 1), F.lit("")).try_cast("int")
    return _marked_lines(spark, base).select("doc_id", "g", F.coalesce(F.last(mark, ignorenulls=True).over(S.running("doc_id", "g")), F.lit(1)).alias("page"))


@query(f"WITH {LINES} SELECT doc_id, coalesce(min(g) FILTER (WHERE trim(s) = 'Page 2.'), -1) AS g FROM mk GROUP BY 1")
def f11_marker_index(spark: SparkSession, base: str) -> DataFrame:
    return _marked_lines(spark, base).groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.trim("s") == "Page 2.", F.col("g"))), F.lit(-1)).alias("g"))


CHUNKS = """
ch AS (SELECT DISTINCT doc_id, chunk_idx, sentence_indices FROM tts_chunks),
sc AS (SELECT doc_id, unnest(sentence_indices) AS g, chunk_idx FROM ch),
fc AS (SELECT doc_id, g::BIGINT AS g, min(chunk_idx) AS chunk_idx FROM sc GROUP BY ALL)"""


def _first_chunks(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "tts_chunks").select("doc_id", "chunk_idx", "sentence_indices").distinct()
    return c.select("doc_id", "chunk_idx", F.explode("sentence_indices").alias("g")).groupBy("doc_id", F.col("g").cast("bigint").alias("g")).agg(F.min("chunk_idx").alias("chunk_idx"))


@query(f"WITH {CHUNKS} SELECT * FROM fc")
def i06_first_chunk(spark: SparkSession, base: str) -> DataFrame:
    return _first_chunks(spark, base)


@query(f"""WITH {SENTENCES},{CHUNKS}, j AS (SELECT doc_id, g, fc.chunk_idx AS c FROM se LEFT JOIN fc USING (doc_id, g) WHERE doc_id IN (SELECT doc_id FROM ch))
SELECT doc_id, g, coalesce(last_value(c IGNORE NULLS) OVER w, first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS chunk_idx FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY g)""")
def i05_gap_fill(spark: SparkSession, base: str) -> DataFrame:
    chunked = table(spark, base, "tts_chunks").select("doc_id").distinct()
    rows = L.sentences(_sections(spark, base)).select("doc_id", "g").join(chunked, "doc_id", "left_semi").join(_first_chunks(spark, base), ["doc_id", "g"], "left")
    return S.fill_gaps(rows, "doc_id", "g", "chunk_idx")


@query(f"WITH {CHUNKS}, m AS (SELECT doc_id, max(g) AS top FROM fc GROUP BY 1), q AS (SELECT doc_id, least(5, top) AS g FROM m) SELECT doc_id, chunk_idx FROM q JOIN fc USING (doc_id, g)")
def f12_chunk_for_sentence(spark: SparkSession, base: str) -> DataFrame:
    c = _first_chunks(spark, base)
    top = c.groupBy("doc_id").agg(F.least(F.lit(5).cast("bigint"), F.max("g")).alias("g"))
    return top.join(c, ["doc_id", "g"]).select("doc_id", "chunk_idx")


ENDS = f"""{SENTENCES},
en AS (SELECT doc_id, g, sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY g) AS "end", sum(length(sentence)) OVER (PARTITION BY doc_id) AS total FROM se)"""


@query(f'WITH {ENDS} SELECT doc_id, g, "end"::BIGINT AS "end", total::BIGINT AS total, CASE WHEN total > 0 THEN round(coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY g), 0) / total, 6) ELSE 0 END AS start_fraction FROM en')
def i01_cumulative_ends(spark: SparkSession, base: str) -> DataFrame:
    rows = L.sentences(_sections(spark, base)).select("doc_id", "g", F.length("sentence").alias("n"))
    return S.with_ends(rows, "doc_id", "g", F.col("n")).drop("n").withColumn("start_fraction", F.round("start_fraction", 6))


@query(f'WITH {ENDS} SELECT doc_id, coalesce(min(g) FILTER (WHERE "end" > 0.4 * total), max(g)) AS index FROM en GROUP BY 1')
def f13_index_at_fraction(spark: SparkSession, base: str) -> DataFrame:
    rows = L.sentences(_sections(spark, base)).select("doc_id", "g", F.length("sentence").alias("n"))
    return S.index_at_fraction(S.with_ends(rows, "doc_id", "g", F.col("n")), "doc_id", "g", F.lit(0.4))


@query("""WITH p AS (SELECT DISTINCT id AS doc_id, unnest(list_transform(raw_pages, lambda x: trim(x))) AS t, generate_subscripts(raw_pages, 1)::INTEGER AS page FROM docs WHERE raw_pages IS NOT NULL),
s AS (SELECT *, coalesce(sum(length(t) + 2) OVER w, 0) AS a, coalesce(sum(length(t) - length(replace(t, chr(10), '')) + 2) OVER w, 0) AS l FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, page, a::BIGINT AS char_start, (a + length(t))::BIGINT AS char_end, (1 + l)::BIGINT AS start_line FROM s""")
def i03_page_offsets(spark: SparkSession, base: str) -> DataFrame:
    return S.page_offsets(table(spark, base, "docs"))


@query(f"WITH {STARTS}, c AS (SELECT doc_id, section_id, start FROM ss) SELECT doc_id, section_id, lead(start) OVER w AS next_start, lag(start) OVER w AS prev_start FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY section_id)")
def i11_neighbour_sections(spark: SparkSession, base: str) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("section_id")
    return S.section_starts(_sections(spark, base)).select("doc_id", "section_id", F.lead("start").over(w).alias("next_start"), F.lag("start").over(w).alias("prev_start"))


BLOCKS = "bk AS (SELECT doc_id, id AS section_id, doc_id || '#' || id AS key, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS n FROM sections)"


@query(f"""WITH {BLOCKS}, v AS (SELECT key, n, b.kind AS kind, b.kind IS DISTINCT FROM lag(b.kind) OVER (PARTITION BY key ORDER BY n) OR n = 1 AS new FROM bk),
r AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY key ORDER BY n) AS run FROM v) SELECT key, run::BIGINT AS run, kind, min(n) AS first, max(n) AS last, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def i10_block_runs(spark: SparkSession, base: str) -> DataFrame:
    b = _sections(spark, base).select(F.concat_ws("#", "doc_id", F.col("id").cast("string")).alias("key"), F.posexplode("blocks").alias("p", "b")).select("key", (F.col("p") + 1).cast("bigint").alias("o"), F.col("b.kind").alias("kind"))
    return S.runs(b, "key", "o", "kind")


@query("""WITH d AS (SELECT DISTINCT id, markdown FROM docs), l AS (SELECT id, unnest(string_split(markdown, chr(10))) AS s, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM d),
f AS (SELECT id, n, starts_with(ltrim(s), '```') AS is_fence, sum(starts_with(ltrim(s), '```')::INTEGER) OVER (PARTITION BY id ORDER BY n) AS k FROM l)
SELECT id, n::INTEGER AS n, k % 2 = 1 AND NOT is_fence AS in_code FROM f""")
def i08_fence_state(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "docs").select("id", "markdown").distinct().select("id", F.posexplode(F.split("markdown", "\n", -1)).alias("p", "s"))
    fence = F.startswith(F.ltrim("s"), F.lit("```"))
    k = F.sum(fence.cast("int")).over(S.running("id", "p"))
    return lines.select("id", (F.col("p") + 1).alias("n"), ((k % 2 == 1) & ~fence).alias("in_code"))


@query("""WITH d AS (SELECT DISTINCT id, markdown FROM docs), l AS (SELECT id, unnest(string_split(markdown, chr(10))) AS s, generate_subscripts(string_split(markdown, chr(10)), 1)::INTEGER AS n FROM d)
SELECT id, n, coalesce(trim(lag(s) OVER w) = '', true) AS blank_before, coalesce(trim(lead(s) OVER w) = '', true) AS blank_after FROM l WINDOW w AS (PARTITION BY id ORDER BY n)""")
def i09_blank_neighbours(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "docs").select("id", "markdown").distinct().select("id", F.posexplode(F.split("markdown", "\n", -1)).alias("p", "s"))
    w = W.partitionBy("id").orderBy("p")
    return lines.select("id", (F.col("p") + 1).alias("n"), F.coalesce(F.trim(F.lag("s").over(w)) == "", F.lit(True)).alias("blank_before"), F.coalesce(F.trim(F.lead("s").over(w)) == "", F.lit(True)).alias("blank_after"))


@query("SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM sections")
def i12_row_numbering(spark: SparkSession, base: str) -> DataFrame:
    return _sections(spark, base).select("doc_id", "id", F.row_number().over(W.partitionBy("doc_id").orderBy("id")).alias("i"), F.count(F.lit(1)).over(W.partitionBy("doc_id")).alias("n"))


@query("""WITH RECURSIVE h AS (SELECT doc_id, id, level, heading, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS n FROM sections WHERE heading IS NOT NULL),
r AS (SELECT doc_id, id, n, [heading] AS path FROM h WHERE n = 1 UNION ALL SELECT h.doc_id, h.id, h.n, list_append(r.path[1:greatest(h.level - 1, 0)], h.heading) FROM r JOIN h ON h.doc_id = r.doc_id AND h.n = r.n + 1)
SELECT doc_id, id, path FROM r""")
def i13_breadcrumb_stack(spark: SparkSession, base: str) -> DataFrame:
    h = _sections(spark, base).filter("heading IS NOT NULL").select("doc_id", "id", "level", "heading")
    return S.breadcrumbs(h, "doc_id", "id", "level", "heading")


@query("SELECT voice, first(doc_id ORDER BY doc_id, chunk_idx, text) AS first_doc, first(text ORDER BY doc_id, chunk_idx, text) AS first_text FROM tts_chunks GROUP BY 1")
def i14_first_occurrence(spark: SparkSession, base: str) -> DataFrame:
    first = F.min(F.struct("doc_id", "chunk_idx", "text"))
    return table(spark, base, "tts_chunks").groupBy("voice").agg(first.alias("f")).select("voice", F.col("f.doc_id").alias("first_doc"), F.col("f.text").alias("first_text"))


@query(r"""WITH s AS (SELECT doc_id, id AS section_id, level, upper(heading) AS heading, lower(trim(heading)) AS h, length(regexp_replace(coalesce(heading, ''), '[^A-Za-z]', '', 'g')) >= 4 AS caps FROM sections),
w AS (SELECT *, min(level) OVER (PARTITION BY doc_id) = max(level) OVER (PARTITION BY doc_id) AND count(*) OVER (PARTITION BY doc_id) >= 3 AND count(*) OVER (PARTITION BY doc_id, h) = 1 AND caps AS ok FROM s)
SELECT doc_id, section_id, last_value(CASE WHEN ok THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_id) AS chapter FROM w""")
def i07_chapters(spark: SparkSession, base: str) -> DataFrame:
    s = _sections(spark, base).withColumn("heading", F.upper("heading"))
    return S.chapters(s, X.is_chapter(F.coalesce("heading", F.lit(""))))


@query("SELECT doc_id, count(DISTINCT level) = 1 AND count(*) >= 3 AS flat FROM sections GROUP BY 1")
def h07_one_level(spark: SparkSession, base: str) -> DataFrame:
    return _sections(spark, base).groupBy("doc_id").agg(((F.countDistinct("level") == 1) & (F.count(F.lit(1)) >= 3)).alias("flat"))


@query("SELECT doc_id, lower(trim(heading)) AS heading FROM sections WHERE heading IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1")
def h06_unique_headings(spark: SparkSession, base: str) -> DataFrame:
    return _sections(spark, base).filter("heading IS NOT NULL").groupBy("doc_id", F.lower(F.trim("heading")).alias("heading")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


_REASONS = r"""rs AS (SELECT DISTINCT id AS doc_id, unnest(raw_pages) AS t, generate_subscripts(raw_pages, 1)::INTEGER AS page FROM docs WHERE raw_pages IS NOT NULL),
wr AS (SELECT doc_id, page, list_filter([CASE WHEN trim(t) = '' THEN 'scanned' END, CASE WHEN regexp_matches(t, '[|†$@¬]') THEN 'garbled' END, CASE WHEN length(t) BETWEEN 1 AND 400 THEN 'sparse' END, CASE WHEN regexp_matches(t, '(?m)^[0-9]+$') THEN 'annotation-text' END], lambda x: x IS NOT NULL) AS reasons FROM rs)"""


def _complex_pages(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, page, reasons, needs_ocr): pages with what speaks against their text layer, by what stands there."""
    p = table(spark, base, "docs").filter("raw_pages IS NOT NULL").select(F.col("id").alias("doc_id"), "raw_pages").distinct().select("doc_id", F.posexplode("raw_pages").alias("page", "t"))
    found = F.array_compact(F.array(
        F.when(F.trim("t") == "", "scanned"), F.when(F.col("t").rlike("[|†$@¬]"), "garbled"), F.when(F.length("t").between(1, 400), "sparse"), F.when(F.col("t").rlike(r"(?m)^[0-9]+$"), "annotation-text"),
    ))
    return p.select("doc_id", (F.col("page") + 1).alias("page"), found.alias("reasons")).withColumn("needs_ocr", F.size("reasons") > 0)


@query(f"WITH {_REASONS}, r AS (SELECT unnest(reasons) AS reason FROM wr) SELECT reason, count(*) AS n FROM r WHERE reason IN ('scanned', 'garbled', 'vector-text', 'annotation-text') GROUP BY 1")
def h01_reason_counts(spark: SparkSession, base: str) -> DataFrame:
    return S.reason_counts(_complex_pages(spark, base))


@query(f"WITH {_REASONS} SELECT doc_id, page, reasons FROM wr WHERE list_has_any(reasons, ['scanned', 'garbled', 'vector-text', 'annotation-text'])")
def c01_worthy_pages(spark: SparkSession, base: str) -> DataFrame:
    return S.worth_reading_again(_complex_pages(spark, base)).select("doc_id", "page", "reasons")


PACE = """
sm AS (SELECT event_type AS engine, user_id::VARCHAR AS voice, list({{'c': (100 + user_id % 7)::DOUBLE, 's': value}} ORDER BY event_id) AS l FROM events GROUP BY 1, 2),
fo AS (SELECT engine, voice, list_reduce(list_prepend({{'c': 900.0::DOUBLE, 's': 60.0::DOUBLE}}, l), lambda a, x: {{'c': (a.c + x.c) * CASE WHEN a.c + x.c > {cap} THEN 0.5 ELSE 1 END, 's': (a.s + x.s) * CASE WHEN a.c + x.c > {cap} THEN 0.5 ELSE 1 END}}) AS p FROM sm)
SELECT engine, voice, p.c AS chars, p.s AS seconds FROM fo"""


def _samples(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select(F.col("event_type").alias("engine"), F.col("user_id").cast("string").alias("voice"), F.col("event_id").alias("seq"), (F.lit(100) + F.col("user_id") % 7).cast("double").alias("chars"), F.col("value").alias("seconds"))


@query("WITH " + PACE.format(cap=500_000))
def h09_pace_totals(spark: SparkSession, base: str) -> DataFrame:
    return S.pace(_samples(spark, base)).select("engine", "voice", "chars", "seconds")


@query("WITH " + PACE.format(cap=1_200))
def h09_pace_capped(spark: SparkSession, base: str) -> DataFrame:
    """With a cap that many voices pass."""
    return S.pace(_samples(spark, base), cap=1_200.0).select("engine", "voice", "chars", "seconds")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1")
def k10_latest_state(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, event_type FROM e WHERE before IS DISTINCT FROM event_type")
def k11_changes(spark: SparkSession, base: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, base, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("before"))
    return e.filter(~F.col("before").eqNullSafe(F.col("event_type"))).drop("before")


@query("SELECT event_id, round(value / greatest(0.25, 1.0 + user_id % 3), 6) AS seconds FROM events WHERE event_type <> 'error'")
def k03_completions(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").filter("event_type <> 'error'").select("event_id", F.round(F.col("value") / F.greatest(F.lit(0.25), F.lit(1.0) + F.col("user_id") % 3), 6).alias("seconds"))
