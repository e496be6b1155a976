"""Problem 6: pieces under a size limit, cut at natural boundaries, with overlap.

Agglomerative merging: a text starts as atomic segments (runs up to the next boundary of any kind);
adjacent pairs lie in a heap ordered by the strength of the boundary between them, and the weakest
boundary is merged first while the combined size plus the overlap fits. What is left are the strongest
boundaries. A piece is its core preceded by the last ``overlap`` characters of the core before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.common import unlike

#: Strength of the boundary that a match ends with, strongest first. Fixed values.
_BOUNDARIES = (
    (5, re.compile(r"\n[ \t]*\n\s*")),
    (4, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？．]+[」』”’）]*\s*|[।؟۔]+\s*|\n")),
    (3, re.compile(r"[;:；：؛]\s+|[；：]|\s+[–—]\s+")),
    (2, re.compile(r"[,，、،]\s+|[，、]")),
    (1, re.compile(r"\s+|[/_-]")),
)


def boundaries(text: str) -> dict[int, int]:
    """{offset: strength} of every place between characters where a cut is natural."""
    out: dict[int, int] = {}
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            out.setdefault(m.end(), strength)
    out.pop(len(text), None)
    out.pop(0, None)
    return out


def cut_points(text: str, max_size: int, overlap: int) -> list[int]:
    """Offsets at which ``text`` is cut; the cores between them are at most max_size - overlap long (the first may use max_size)."""
    room = max_size - overlap
    if room < 1:
        raise ValueError("overlap must be less than max_size")
    strength = boundaries(text)
    edges = [0, *sorted(strength), len(text)]
    starts: list[int] = []
    for a, b in zip(edges, edges[1:], strict=False):  # an atom longer than the room is cut anywhere
        starts.extend(range(a, b, room))
    n = len(starts)
    ends = [*starts[1:], len(text)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(strength.get(starts[i], 0), ends[i] - starts[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        s, size, i = heapq.heappop(heap)
        if not alive[i] or left[i] < 0:
            continue
        p = left[i]
        now = ends[i] - starts[p]
        if now != size:  # a neighbour has grown since
            heapq.heappush(heap, (s, now, i))
            continue
        if now > (max_size if starts[p] == 0 else room):
            continue
        alive[i] = False
        ends[p] = ends[i]
        right[p] = right[i]
        if right[i] < n:
            left[right[i]] = p
    return [starts[i] for i in range(1, n) if alive[i]]


def pieces(text: str, max_size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, piece) for each piece; piece k > 0 begins with the ``overlap`` characters before its core."""
    cuts = [0, *cut_points(text, max_size, overlap), len(text)]
    return [(max(0, a - overlap) if a else 0, text[max(0, a - overlap) if a else 0 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def split_oversized(items: DataFrame, text_col: str, max_size: Column, overlap: Column) -> DataFrame:
    """Columns of ``items`` but ``text_col``, then piece_no, char_start, piece: for items longer than ``max_size`` only.

    Sizes are code points. Items that fit, null and empty texts give no rows; a null limit sets none;
    repeated rows are split each; a kept column named like a result's gets the ending _in. The overlap must be under the limit, else an error says so.
    """
    keys = [c for c in items.columns if c != text_col]
    names = {c: f"_k{i}" for i, c in enumerate(keys)}
    over = items.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text_col).alias("_t"), max_size.cast("int").alias("_m"), overlap.cast("int").alias("_o"))
    over = over.filter(F.length("_t") > F.col("_m"))
    schema = ", ".join(f"{n} {over.schema[n].dataType.simpleString()}" for n in names.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, number, start, piece = [], [], [], []
            for k, (t, m, o) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_t", "_m", "_o")), strict=True)):
                for j, (a, p) in enumerate(pieces(t, m, o or 0)):
                    source.append(k)
                    number.append(j)
                    start.append(a)
                    piece.append(p)
            index = pa.array(source, pa.int64())
            kept = [batch.column(n).take(index) for n in names.values()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(piece, pa.string())], [*names.values(), "piece_no", "char_start", "piece"])

    out = over.mapInArrow(run, f"{schema}, piece_no int, char_start int, piece string")
    kept = unlike(keys, ("piece_no", "char_start", "piece"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names.values(), strict=True)], "piece_no", "char_start", "piece")


def reading_items(tts_chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(item_table, doc_id, outer_no, inner_no, text): what size_limits speaks of, as stored; exact repeats once."""
    chunks = tts_chunks.select(F.lit("tts_chunks").alias("item_table"), "doc_id", F.col("chunk_idx").alias("outer_no"), F.lit(0).alias("inner_no"), "text").distinct()
    parts = sections.select(F.lit("sections").alias("item_table"), "doc_id", F.col("id").alias("outer_no"), F.posexplode("chunks").alias("inner_no", "text"))
    return chunks.unionByName(parts)


def split_reading_items(tts_chunks: DataFrame, sections: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_table, doc_id, outer_no, inner_no, piece_no, char_start, piece) of every item over its limit."""
    rows = limits.filter(F.col("unit") == "characters").groupBy(F.col("target").alias("item_table")).agg(F.max("max_size").alias("_max"), F.max("overlap").alias("_over"))
    items = reading_items(tts_chunks, sections).join(rows, "item_table")
    out = split_oversized(items.filter(F.length("text") > F.col("_max")), "text", F.col("_max"), F.col("_over"))
    return out.drop("_max", "_over")
