"""Sequence analytics over ordered rows: offsets, look-ups, gap filling, runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running(key: str, *order: str):
    """Window from the first row of ``key`` to the present one."""
    return W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def with_ends(rows: DataFrame, key: str, order: str, length: Column) -> DataFrame:
    """``rows`` with end (running sum of lengths, negatives as 0), total and start_fraction."""
    size = F.greatest(length, F.lit(0))
    out = rows.withColumn("end", F.sum(size).over(running(key, order))).withColumn("total", F.sum(size).over(W.partitionBy(key)))
    before = F.lag("end", 1, 0).over(W.partitionBy(key).orderBy(order))
    return out.withColumn("start_fraction", F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), before / F.col("total")))).otherwise(0.0))


def index_at_fraction(ends: DataFrame, key: str, order: str, fraction: Column) -> DataFrame:
    """(key, index): the first row that ends past ``fraction`` of the total, else the last."""
    past = F.when(F.col("end") > fraction * F.col("total"), F.col(order))
    return ends.groupBy(key).agg(F.coalesce(F.min(past), F.max(order)).alias("index"))


def section_starts(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, start, n): where each section begins in its document's sentence list."""
    s = sections.select("doc_id", F.col("id").alias("section_id"), F.size("chunks").alias("n"))
    return s.withColumn("start", F.sum("n").over(running("doc_id", "section_id")) - F.col("n"))


def locate(points: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, g, section_id, chunk): the section and place of global sentence g; beyond the end, the last sentence.

    A range look-up: points and starts meet by document, sorted, and the last start at or before g counts.
    """
    last = starts.groupBy("doc_id").agg(F.max(F.col("start") + F.col("n")).alias("count"))
    held = points.join(last, "doc_id").withColumn("at", F.least("g", F.col("count") - 1))
    marks = starts.filter("n > 0").select("doc_id", F.col("start").alias("at"), F.lit(None).cast("bigint").alias("g"), F.struct("start", "section_id").alias("s"))
    both = held.select("doc_id", "at", F.col("g").cast("bigint").alias("g"), F.lit(None).cast(marks.schema["s"].dataType).alias("s")).unionByName(marks)
    w = W.partitionBy("doc_id").orderBy("at", F.col("s").isNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("s", F.last("s", ignorenulls=True).over(w)).filter("g IS NOT NULL").select("doc_id", "g", F.col("s.section_id").alias("section_id"), (F.col("at") - F.col("s.start")).alias("chunk"))


def fill_gaps(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``value`` carried forward over nulls; a leading gap takes the first value there is."""
    back = F.first(value, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(running(key, order)), back))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, first, last, n): adjacent rows with the same value."""
    w = W.partitionBy(key).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("run", F.sum(new.cast("int")).over(running(key, order)))
    return marked.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def breadcrumbs(headings: DataFrame, key: str, order: str, level: str, title: str) -> DataFrame:
    """(key, order, path): the titles above and at each heading; a level keeps what stands above it, empty levels dropped.

    The headings of a key are folded once, in order; a key is a document, so they are few.
    """
    path = lambda acc, h: F.array_append(F.slice(acc["path"], F.lit(1), F.greatest(h[level] - 1, F.lit(0))), h[title])
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast(f"array<struct<o:{headings.schema[order].dataType.simpleString()},path:array<string>>>").alias("out"))
    step = lambda acc, h: F.struct(path(acc, h).alias("path"), F.array_append(acc["out"], F.struct(h[order].alias("o"), path(acc, h).alias("path"))).alias("out"))
    folded = headings.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(F.struct(order, level, title))), start, step, lambda acc: acc["out"]).alias("rows"))
    return folded.select(key, F.explode("rows").alias("r")).select(key, F.col("r.o").alias(order), F.col("r.path").alias("path"))


#: Reasons that a new reading of a page can mend. Fixed values.
REASONS = ("scanned", "garbled", "vector-text", "annotation-text")


def worth_reading_again(pages: DataFrame) -> DataFrame:
    """``pages`` (needs_ocr, reasons and more) that a new reading may improve."""
    return pages.filter(F.col("needs_ocr") & F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in REASONS])))


def reason_counts(pages: DataFrame) -> DataFrame:
    """(reason, n): how many pages name each reason that counts."""
    return pages.select(F.explode("reasons").alias("reason")).filter(F.col("reason").isin(*REASONS)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def chapters(sections: DataFrame, is_chapter: Column) -> DataFrame:
    """(doc_id, section_id, chapter): for documents of one level with three sections or more, the latest unique capital heading."""
    s = sections.select("doc_id", F.col("id").alias("section_id"), "level", "heading", F.lower(F.trim("heading")).alias("h"), is_chapter.alias("caps"))
    d = W.partitionBy("doc_id")
    flat = (F.min("level").over(d) == F.max("level").over(d)) & (F.count(F.lit(1)).over(d) >= 3)
    alone = F.count(F.lit(1)).over(W.partitionBy("doc_id", "h")) == 1
    s = s.withColumn("own", F.when(flat & alone & F.col("caps"), F.col("heading")))
    return s.select("doc_id", "section_id", F.last("own", ignorenulls=True).over(running("doc_id", "section_id")).alias("chapter"))


def page_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, page, char_start, char_end, start_line): where each page lies once pages are trimmed and joined by a blank line."""
    p = docs.dropDuplicates(["id"]).filter("raw_pages IS NOT NULL").select(F.col("id").alias("doc_id"), F.posexplode("raw_pages").alias("page", "text")).withColumn("text", F.trim("text"))
    w = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))
    return p.select("doc_id", (F.col("page") + 1).alias("page"), start.alias("char_start"), (start + F.length("text")).alias("char_end"), (F.lit(1) + F.coalesce(F.sum(lines + 2).over(w), F.lit(0))).alias("start_line"))


#: The pace that a voice starts from, and the characters past which its sums are halved. Fixed values.
SEED_CHARS, SEED_SECONDS, PACE_CAP = 900.0, 60.0, 500_000.0


def fold_pace(chars: float, seconds: float, more: Iterable[tuple[float, float]], cap: float) -> tuple[float, float]:
    """The sums after more samples, both halved whenever the characters pass the cap."""
    for c, s in more:
        chars, seconds = chars + c, seconds + s
        if chars > cap:
            chars, seconds = chars * 0.5, seconds * 0.5
    return chars, seconds


def pace(samples: DataFrame, cap: float = PACE_CAP, seed_chars: float = SEED_CHARS, seed_seconds: float = SEED_SECONDS) -> DataFrame:
    """(engine, voice, chars, seconds): sums per voice from a seed, both halved whenever the characters pass the cap.

    Order counts: samples of a voice are folded by seq, one after the other as they stream by in their order,
    so that however many they are only the two sums are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, (0.0, 0.0)
        for pdf in batches:
            done = []
            for key, part in pdf.groupby(["engine", "voice"], sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != at:
                    if at is not None:
                        done.append((*at, *sums))
                    at, sums = key, (seed_chars, seed_seconds)
                sums = fold_pace(*sums, zip(part["chars"].tolist(), part["seconds"].tolist(), strict=True), cap)
            yield pd.DataFrame(done, columns=["engine", "voice", "chars", "seconds"])
        if at is not None:
            yield pd.DataFrame([(*at, *sums)], columns=["engine", "voice", "chars", "seconds"])

    rows = samples.select("engine", "voice", "seq", F.coalesce("chars", F.lit(0.0)).alias("chars"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    ordered = rows.repartition("engine", "voice").sortWithinPartitions("engine", "voice", "seq", "chars", "seconds")
    return ordered.mapInPandas(run, "engine string, voice string, chars double, seconds double")
