"""Problem 9: passages of held-out test items inside documents.

Spaced seeds: over every window of words a fixed mask keeps some positions and ignores the others; the hash
of the kept words is compared between test items and documents. A hit is therefore tolerant of substituted
words at the ignored positions, and the three masks complement one another: every passage of MIN_WORDS equal
words with up to MISMATCHES substituted ones among them holds a hit, wherever those stand. Every hit is
verified along its diagonal (document position minus item position) over the words themselves: the longest
run of equal words there, and the stretch with the most equal words among at most MISMATCHES others.

The test set is a stated query set. It is broadcast only if it has at most ``max_items`` rows; beyond
that the seeds meet in a shuffled equi-join. Both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.operators.common import bounded_rows, salt_of

MIN_WORDS = 12
MISMATCHES = 2
#: Found by search: MIN_WORDS equal words and MISMATCHES others between them always hold one of these.
MASKS = ((1, 1, 1, 0, 0, 1, 0, 1, 1, 1), (1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 0, 1), (1, 0, 1, 1, 1, 0, 1, 0, 1, 1))
MAX_ITEMS = 5_000
SALTS = 8
_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return _WORD.findall((text or "").lower())


def seed_hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for every window of ``len(mask)`` ids, over the positions the mask keeps."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, keep in enumerate(mask):
            if keep:
                h = (h ^ ids[k : k + n]) * _MULT
                h ^= h >> np.uint64(29)
    return h


class Seeds:
    """Seeds of the test items: sorted hashes with the (item, position) pairs they come from."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, masks: tuple[tuple[int, ...], ...]):
        self.min_words, self.masks = min_words, masks
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for key, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            self.items.append((key, np.array(ids, np.uint64)))
        self.tables = []
        for mask in masks:
            h, who, pos = [], [], []
            for i, (_, ids) in enumerate(self.items):
                x = seed_hashes(ids, mask)
                h.append(x)
                who.append(np.full(len(x), i))
                pos.append(np.arange(len(x)))
            h = np.concatenate(h) if h else np.empty(0, np.uint64)
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], np.concatenate(who)[order] if who else order, np.concatenate(pos)[order] if pos else order))

    def find(self, text: str | None, mismatches: int = 0) -> dict[int, tuple[int, int, int]]:
        """{item index: (longest run of equal words, equal words of the best stretch, its position in the document)}."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words(text)], np.uint64)
        found: dict[int, tuple[int, int, int]] = {}
        diagonals: set[tuple[int, int]] = set()
        for mask, (table, who, pos) in zip(self.masks, self.tables, strict=True):
            h = seed_hashes(ids, mask)
            if not len(table) or not len(h):
                continue
            lo = np.searchsorted(table, h)
            hit = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == h)
            if not len(hit):
                continue
            hi = np.searchsorted(table, h[hit], side="right")
            for d, a, b in zip(hit.tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
                diagonals.update((int(who[j]), d - int(pos[j])) for j in range(a, b))
        for item, shift in diagonals:
            its = self.items[item][1]
            a = max(0, -shift)
            b = min(len(its), len(ids) - shift)
            same = (its[a:b] == ids[a + shift : b + shift]) & (its[a:b] != 0)
            run, _ = stretch(same, 0)
            total, start = stretch(same, mismatches)
            if total >= self.min_words:
                found[item] = max(found.get(item, (0, 0, 0)), (run, total, a + shift + start))
        return found


def stretch(same: np.ndarray, mismatches: int) -> tuple[int, int]:
    """The most equal words of any stretch with at most ``mismatches`` others in it, and where it begins."""
    edges = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    if len(edges) - 2 <= mismatches:
        first = int(same.argmax()) if len(same) else 0
        return int(same.sum()), first
    equal = edges[mismatches + 1 :] - edges[: -mismatches - 1] - 1 - mismatches
    k = int(equal.argmax())
    start = int(edges[k]) + 1
    return int(equal[k]), start + (int(same[start:].argmax()) if equal[k] else 0)


def leaked(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, masks: tuple[tuple[int, ...], ...] = MASKS, max_items: int = MAX_ITEMS, mismatches: int = MISMATCHES) -> DataFrame:
    """(<id_col>, <item_col>, run, equal, at): documents and the test items they hold.

    A pair is reported if some stretch of the document has at least ``min_words`` words of the item in
    their places and at most ``mismatches`` others among them; equal counts the former, at is where the
    stretch begins in the document's words, and run is the longest run of consecutive equal words, which may
    be shorter than ``min_words``. Null or empty texts hold nothing; repeated rows give their rows each;
    items shorter than ``min_words`` can't be found. No item or no document: no rows.
    """
    docs = documents.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    tests = items.select(F.col(item_col).alias("i"), F.col(item_text).alias("x"))
    rows = bounded_rows(tests, max_items)
    schema = "d {}, i {}, run int, equal int, at int".format(docs.schema["d"].dataType.simpleString(), tests.schema["i"].dataType.simpleString())
    if rows is None:
        return _joined(docs, tests, schema, min_words, masks, mismatches).toDF(id_col, item_col, "run", "equal", "at")
    pairs = [(r["i"], r["x"]) for r in rows]
    i_type = to_arrow_type(tests.schema["i"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(pairs, min_words, masks)
        for batch in batches:
            out = []
            for row, t in enumerate(batch.column(1).to_pylist()):
                out.extend((row, seeds.items[k][0], *v) for k, v in seeds.find(t, mismatches).items())
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [i_type, pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["d", "i", "run", "equal", "at"])

    return docs.mapInArrow(scan, schema).toDF(id_col, item_col, "run", "equal", "at")


def _joined(docs: DataFrame, tests: DataFrame, schema: str, min_words: int, masks: tuple[tuple[int, ...], ...], mismatches: int) -> DataFrame:
    """The same for a test set of any size: seeds meet in an equi-join, texts are joined to the pairs found.

    Rows are known by id and text together: equal rows give the same pairs, so each distinct row is searched
    once and given as often as it stands there, null ids included.
    """
    span = min(map(len, masks))

    def keyed(df: DataFrame, key: str, text: str, row: str) -> DataFrame:
        held = df.groupBy(key, text).agg(F.count(F.lit(1)).alias(f"n_{row}"))
        return held.withColumn(row, F.sha2(F.to_json(F.struct(F.col(key).alias("k"), F.col(text).alias("t"))), 256))

    docs, tests = keyed(docs, "d", "t", "dr"), keyed(tests, "i", "x", "ir")

    def seeds(df: DataFrame, key: str, text: str) -> DataFrame:
        w = df.select(key, F.expr(f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')").alias("w")).filter(F.size("w") >= span)
        pos = w.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - span)).alias("p"))
        kept = [F.when(F.size("w") - F.col("p") >= len(mask), F.xxhash64(F.lit(m), *[F.try_element_at("w", F.col("p") + 1 + k) for k, keep in enumerate(mask) if keep])) for m, mask in enumerate(masks)]
        return pos.select(key, F.explode(F.array_compact(F.array(*kept))).alias("h")).distinct()

    # a passage that very many documents hold is one hash: the tests, the smaller side, are copied once a salt
    many = seeds(docs, "dr", "t").withColumn("salt", salt_of(F.col("dr"), SALTS))
    few = seeds(tests, "ir", "x").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = many.join(few, ["h", "salt"]).select("dr", "ir").distinct()
    full = pairs.join(docs, "dr").join(tests, "ir").select("d", "t", "i", "x", (F.col("n_dr") * F.col("n_ir")).alias("n"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.extend((r["d"], r["i"], *v) for v in Seeds([(r["i"], r["x"])], min_words, masks).find(r["t"], mismatches).values() for _ in range(r["n"]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [batch.schema.field("d").type, batch.schema.field("i").type, pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["d", "i", "run", "equal", "at"])

    return full.mapInArrow(verify, schema)
