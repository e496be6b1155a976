"""Problem 8: documents into containers of fixed token capacity.

Bound-certified repacking. Documents are spread over partitions by a hash; each partition packs its own
by best-fit decreasing and computes a lower bound on its number of containers by dual-feasible functions.
A partition whose count meets the bound is certified optimal and stays. The others have a gap: they give
the documents of their emptiest containers to an exchange, where groups of several partitions run
best-fit decreasing again; the exchange is repeated with ever larger groups of what is still uncertified,
until all is certified or one group is left. The bound of all documents together, from the counts of their
sizes, certifies the whole (:func:`partition_bounds`).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.splitting import boundaries
from folioflow.operators.common import cut_lineage, salt_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern that goes with the vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PER_PARTITION = 20_000


@cache
def encoder(path: str, pattern: str = PATTERN):
    """The tokenizer whose ranks lie at ``path``: one base64 token and its id a line."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("folioflow", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which the executors get the file at ``path``, which only the driver needs to have."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def token_ends(text: str, encoding) -> np.ndarray:
    """Per token of ``text``, the characters up to its end; one that ends inside a character counts it."""
    sizes = np.fromiter((len(encoding.decode_single_token_bytes(k)) for k in encoding.encode_ordinary(text)), np.int64)
    starts = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0 != 0x80
    upto = np.concatenate(([0], np.cumsum(starts)))
    return upto[np.minimum(np.cumsum(sizes), len(upto) - 1)]


def cut_to_capacity(text: str, count, capacity: int, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive pieces of at most ``capacity`` tokens, cut at the strongest late boundary.

    Only a text that does not fit is cut. ``ends`` are the characters up to the end of each of its tokens,
    worked out once, so a text costs what its length costs; a piece is counted anew, since its tokens may
    differ at the seams, and is as long as it can be less what a good boundary costs.
    """
    out, at, n = [], 0, len(text)
    while at < n:
        k = int(np.searchsorted(ends, at, side="right"))  # the first token that ends past ``at``
        end = int(ends[k + capacity - 1]) if k + capacity - 1 < len(ends) else n
        end = max(end, at + 1)
        size = count(text[at:end])
        while size > capacity and end > at + 1:
            end -= max(1, (end - at) * (size - capacity) // (2 * size))
            size = count(text[at:end])
        if end < n:
            marks = {k: s for k, s in boundaries(text[at:end]).items() if k > 0.7 * (end - at)}
            for k in sorted(marks, key=lambda k: (marks[k], k), reverse=True):
                shorter = count(text[at : at + k])
                if shorter <= capacity:
                    end, size = at + k, shorter
                    break
        out.append((at, end, size))
        at = end
    return out or [(0, 0, 0)]


def token_sizes(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece_no, char_start, char_end, n_tokens): one row per document, more for one over the capacity.

    Null and empty texts have one piece of no tokens. The vocabulary file at ``tokenizer`` is sent to the executors.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = docs.schema["id"].dataType.simpleString()
    name = shipped(documents.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(SparkFiles.get(name))
        count = lambda s: len(encoding.encode_ordinary(s))
        for batch in batches:
            rows = []
            for k, t in enumerate(batch.column(1).to_pylist()):
                size = count(t)
                parts = [(0, len(t), size)] if size <= capacity else cut_to_capacity(t, count, capacity, token_ends(t, encoding))
                rows.extend((k, j, *p) for j, p in enumerate(parts))
            k, j, a, b, size = (np.array(c, np.int32) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int32),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(j), pa.array(a), pa.array(b), pa.array(size)], ["id", "piece_no", "char_start", "char_end", "n_tokens"])

    return docs.mapInArrow(run, f"id {kind}, piece_no int, char_start int, char_end int, n_tokens int")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes in [0, capacity]. Ties keep their order."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0  # bit r of mask: some container has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            k, room = used, capacity
            used += 1
        bins[i] = k
        by_room[room - s].append(k)
        mask |= 1 << (room - s)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The best bound on the number of containers that two families of dual-feasible functions give.

    ``counts`` says how many items have each of the sizes; one each if it is left out.
    """
    if not len(sizes):
        return 0
    n = np.zeros(capacity + 1, np.int64)
    np.add.at(n, sizes.astype(np.int64), 1 if counts is None else counts.astype(np.int64))
    x = np.arange(capacity + 1, dtype=np.int64)
    count, total = np.cumsum(n), np.cumsum(n * x)
    best = max(1, -(-int(total[-1]) // capacity))
    k = np.arange(1, capacity // 2 + 1)
    # under k: nothing; over capacity - k: a whole container; between: as they are
    large = count[-1] - count[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    best = max(best, int(np.max(large - (-middle // capacity))) if len(k) else 0)
    for q in range(1, 26):  # x (q+1)/capacity rounded down, over q, unless it is whole
        scaled = x * (q + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, x * q, (scaled // capacity) * capacity)  # over q * capacity
        best = max(best, -(-int((n * value).sum()) // (q * capacity)))
    return best


_PACKED = "id {}, piece_no int, char_start int, char_end int, n_tokens int, grp long, level int, bin long, filled int, bins long, bound long"


def _pack_groups(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Best-fit decreasing within each ``grp``."""
    schema = _PACKED.format(items.schema["id"].dataType.simpleString())

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece_no"], ascending=[False, True, True], kind="stable")
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        k = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(k, weights=sizes).astype(np.int64) if len(k) else np.empty(0, np.int64)
        return pdf.assign(level=level, bin=k, filled=filled[k], bins=len(filled), bound=lower_bound(sizes, capacity))

    return items.groupBy("grp").applyInPandas(pack, schema)


def _packed(documents: DataFrame, capacity: int, tokenizer: str, id_col: str, text_col: str, per_partition: int) -> DataFrame:
    """Every piece with the group that packed it last, its container there, and the group's count and bound."""
    sizes = cut_lineage(token_sizes(documents, capacity, tokenizer, id_col, text_col))
    parts = max(1, -(-sizes.count() // per_partition))
    packed = cut_lineage(_pack_groups(sizes.withColumn("grp", salt_of(F.struct("id", "piece_no"), parts).cast("long")), 0, capacity))
    done, level = [], 0
    # a gap of g containers can close only where g containers' worth of room is given back: the emptiest go
    give = (F.col("bins") > F.col("bound")) & (F.col("filled") < F.lit(capacity) * 0.98)
    while parts > 1 and not packed.filter(give).isEmpty():
        level, parts = level + 1, -(-parts // 8)
        done.append(packed.filter(~give))
        back = packed.filter(give).select("id", "piece_no", "char_start", "char_end", "n_tokens", F.pmod(F.col("grp"), F.lit(parts)).cast("long").alias("grp"))
        packed = cut_lineage(_pack_groups(back, level, capacity))
    for d in done:
        packed = packed.unionByName(d)
    return packed


def pack(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """(<id_col>, piece_no, char_start, char_end, n_tokens, container, filled): every document in a container.

    A document over the capacity is cut into pieces, each placed like a document; no other is cut. Null
    and empty texts take no room but are placed. Repeated rows are placed each. Partitions hold about
    ``per_partition`` documents whatever the table's size; ids spread them, not sources. An exchange takes
    eight partitions' emptiest containers into one group, the next eight of those groups, and so on.
    """
    out = _packed(documents, capacity, tokenizer, id_col, text_col, per_partition)
    return out.select(F.col("id").alias(id_col), "piece_no", "char_start", "char_end", "n_tokens", F.concat_ws("-", "level", "grp", "bin").alias("container"), "filled")


def partition_bounds(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """(level, partition, containers, bound, certified): the containers that each group keeps in the end, against the
    bound of the documents in them; level -1 is all of them together, bounded over the counts of all sizes.

    The counts that reach the driver are at most capacity + 1.
    """
    packed = cut_lineage(_packed(documents, capacity, tokenizer, id_col, text_col, per_partition))
    spark, schema = documents.sparkSession, "level int, partition long, containers long, bound long, certified boolean"

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        used, least = pdf["bin"].nunique(), lower_bound(pdf["n_tokens"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"level": pdf["level"].iloc[:1], "partition": pdf["grp"].iloc[:1], "containers": [used], "bound": [least], "certified": [used == least]})

    groups = packed.select("level", "grp", "bin", "n_tokens").groupBy("level", "grp").applyInPandas(bound, schema)
    counts = packed.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    used = packed.select("level", "grp", "bin").distinct().count()
    least = lower_bound(np.array([r["n_tokens"] for r in counts]), capacity, np.array([r["n"] for r in counts]))
    return groups.unionByName(spark.createDataFrame([(-1, 0, used, least, used == least)], schema))
