"""Problem 3: lines repeated across the documents of one source.

Each Arrow batch of documents builds one suffix array (prefix doubling) over the concatenated
identifiers of its lines. Identifiers are hashes of (source, letters of the line), and every document
ends in a separator of its own, so the array is the union of one suffix array per source and no suffix
runs from one document into the next. Adjacent suffixes with a common prefix of one line or more form
the classes of repeated blocks; a class gives the number of documents it spans within the batch, and the
counts are summed over batches by (source, line). A block never spans more documents than each of its
lines, so the classes at prefix length one decide which lines go. :func:`repeated_blocks` builds a second
array per batch over the runs of those lines and counts the classes at every prefix length; a class of one
suffix counts too, since what stands once in one batch may recur in the others.

No source is ever gathered into one task: a batch holds a bounded number of documents whatever the
source, and only (source, identifier, count) leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DOCS = 5
MIN_SHARE = 0.10
SALTS = 16


def line_ids(domain, text):
    """Array of 64-bit identifiers, one per line; 0 for a line without letters.

    A line's identity is its letters, lower-cased, all else dropped; the text is reduced once, whole.
    """
    reduced = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\n]+", "")), "\n", -1)
    return F.transform(reduced, lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(domain, x)))


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix lengths of ``ids``; no prefix crosses an index in ``ends``.

    ``ends[i]`` is one past the last position of the document that holds position i. Prefix doubling:
    ranks of length 2k are ranks of pairs of ranks of length k. The second result is the common prefix
    of each suffix with the one before it, in lines.
    """
    n = len(ids)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64)
    pos = np.arange(n)
    k, ranks = 1, [rank]
    while True:
        nxt = pos + k
        second = np.full(n, -1, np.int64)
        ok = nxt < ends
        second[ok] = rank[nxt[ok]]
        order = np.lexsort((second, rank))
        r, s = rank[order], second[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum((r[1:] != r[:-1]) | (s[1:] != s[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not (ok & (np.bincount(rank, minlength=n)[rank] > 1)).any():
            break
        ranks.append(rank)
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    a_end, b_end = ends[a], ends[b]
    for i in range(len(ranks) - 1, -1, -1):
        step = 1 << i
        same = ranks[i][np.minimum(a, n - 1)] == ranks[i][np.minimum(b, n - 1)]
        step = step * ((a + step <= a_end) & (b + step <= b_end) & same)
        lcp[1:] += step
        a, b = a + step, b + step
    return order, lcp


def _flatten(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and, per value, the row that holds it."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lengths = np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), lengths)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, row = _flatten(batch.column("ids"))
        keep = ids != 0
        ids, row = ids[keep], row[keep]
        if not len(ids):
            continue
        ends = np.searchsorted(row, row, side="right")
        order, lcp = suffix_array(ids, ends)
        starts = np.flatnonzero(lcp == 0)  # classes of suffixes with the first line in common
        cls = np.cumsum(lcp == 0) - 1
        pairs = np.unique(cls.astype(np.int64) * (len(batch) + 1) + row[order])
        docs = np.bincount(pairs // (len(batch) + 1), minlength=len(starts))
        first = order[starts]
        domain = batch.column("domain").take(pa.array(row[first]))
        yield pa.RecordBatch.from_arrays(
            [domain, pa.array(ids[first]), pa.array(docs.astype(np.int64))],
            ["domain", "line", "docs"],
        )


def frequent_lines(pages: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(domain, lines): per source, the identifiers of the lines that span enough documents.

    ``pages`` has domain and ids. The array of one source is bounded by 1/min_share times its mean
    number of lines per document.
    """
    counts = (
        pages.select("domain", "ids")
        .mapInArrow(_count_batches, "domain string, line bigint, docs bigint")
        .groupBy("domain", "line")
        .agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs)
    )
    sizes = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    return (
        counts.join(sizes, "domain")
        .filter(F.col("docs") >= F.col("rows") * min_share)
        .groupBy("domain")
        .agg(F.collect_list("line").alias("lines"))
    )


def source_pages(articles: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    source = F.coalesce(F.col(source_col), F.lit(""))
    return articles.select(
        F.col(id_col).alias("id"), source.alias("domain"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), line_ids(source, F.col(text_col)).alias("ids")
    )


def _with_lines(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each page with its source's repeated lines; the small side is copied once a salt, so a hot source spreads."""
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["domain", "salt"], "left").drop("salt")


def repeated_lines(articles: DataFrame, id_col: str = "article_id", source_col: str = "domain", text_col: str = "markdown", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(<id_col>, line_no): lines, counted from 1, that recur within their source.

    Null text is one empty line, null source one source of its own; lines without letters never count;
    a line that occurs twice in one document counts once; equal ids give their rows each. An empty table
    gives no rows. Other columns, whatever their names, are left aside.
    """
    pages = source_pages(articles, id_col, source_col, text_col)
    marked = _with_lines(pages.drop("text"), frequent_lines(pages, min_docs, min_share)).filter(F.size("lines") > 0)
    return (
        marked.select("id", "lines", F.posexplode("ids").alias("pos", "line"))
        .filter(F.array_contains("lines", F.col("line")))
        .select(F.col("id").alias(id_col), (F.col("pos") + 1).cast("int").alias("line_no"))
    )


def without_repeats(articles: DataFrame, id_col: str = "article_id", source_col: str = "domain", text_col: str = "markdown", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(<id_col>, text, n_removed): every document without its source's repeated lines."""
    pages = source_pages(articles, id_col, source_col, text_col)
    joined = _with_lines(pages, frequent_lines(pages, min_docs, min_share))
    zipped = F.arrays_zip(F.split("text", "\n", -1).alias("s"), F.col("ids").alias("i"))
    kept = F.filter(zipped, lambda z: ~F.coalesce(F.array_contains("lines", z["i"]), F.lit(False)))
    return joined.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform(kept, lambda z: z["s"]), "\n").alias("text"),
        (F.size("ids") - F.size(kept)).alias("n_removed"),
    )


def _mixed(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes of blocks one line longer: ``h`` of the block, then ``ids`` of the next line."""
    x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ ids
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, source and distinct block of any length, the documents that hold it; 0 among the ids ends a run."""
    for batch in batches:
        ids, row = _flatten(batch.column("ids"))
        run = np.cumsum(ids == 0) + row
        keep = ids != 0
        ids, row, run = ids[keep], row[keep], run[keep]
        if not len(ids):
            continue
        ends = np.searchsorted(run, run, side="right")
        order, lcp = suffix_array(ids, ends)
        left = ends[order] - order
        values = ids.view(np.uint64)
        hashes, shorter = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        length = 0
        while True:
            length += 1
            keep = left >= length  # suffixes that share ``length`` lines stay neighbours among those as long
            order, lcp, left = order[keep], lcp[keep], left[keep]
            if not len(order):
                break
            shorter, hashes = hashes, shorter
            hashes[order] = _mixed(shorter[order], values[order + length - 1])
            new = lcp < length
            new[0] = True
            cls = np.cumsum(new) - 1
            pairs = np.unique(cls.astype(np.int64) * (len(batch) + 1) + row[order])
            docs = np.bincount(pairs // (len(batch) + 1))
            first = order[new]
            head, tail = (shorter[first], shorter[first + 1]) if length > 1 else (shorter[first], shorter[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("domain").take(pa.array(row[first])), *(pa.array(h.view(np.int64)) for h in (hashes[first], head, tail)), pa.array(np.full(len(first), length, np.int32)), pa.array(docs.astype(np.int64))],
                ["domain", "block", "head", "tail", "n_lines", "docs"],
            )


def repeated_blocks(articles: DataFrame, id_col: str = "article_id", source_col: str = "domain", text_col: str = "markdown", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(domain, block, n_lines, n_docs): blocks of consecutive lines and all documents of the source that hold each.

    Reported are the blocks that span enough documents and that no line, put before or after, leaves in as
    many. Lines without letters do not break a block. A block is known by the hash of its identifiers.
    """
    pages = source_pages(articles, id_col, source_col, text_col)
    frequent = frequent_lines(pages, min_docs, min_share)
    marked = _with_lines(pages.drop("text"), frequent).filter(F.size("lines") > 0)
    runs = F.transform(F.filter("ids", lambda x: x != 0), lambda x: F.when(F.array_contains("lines", x), x).otherwise(F.lit(0).cast("bigint")))
    sizes = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    counts = (
        marked.select("domain", runs.alias("ids"))
        .mapInArrow(_block_batches, "domain string, block bigint, head bigint, tail bigint, n_lines int, docs bigint")
        .groupBy("domain", "block", "n_lines")
        .agg(F.sum("docs").alias("n_docs"), F.first("head").alias("head"), F.first("tail").alias("tail"))
        .filter(F.col("n_docs") >= min_docs)
        .join(sizes, "domain")
        .filter(F.col("n_docs") >= F.col("rows") * min_share)
    )
    within = (
        counts.filter("n_lines > 1")
        .select("domain", F.explode(F.array("head", "tail")).alias("block"), (F.col("n_lines") - 1).alias("n_lines"), "n_docs")
        .distinct()
    )
    return counts.select("domain", "block", "n_lines", "n_docs").join(within, ["domain", "block", "n_lines", "n_docs"], "left_anti")
