"""Problem 5: the main body of web pages.

A page is a sequence of leaf blocks, its lines that are not blank. A linear-chain conditional random field
labels each as body or outside. Features of a block are its ancestor tags (heading level, list, quote,
table, code, image, link), its text (length, final mark, separators, case, digits, words) and its place.

No page comes with labels. The field is fitted by maximum likelihood on a bounded sample of pages that the
corpus itself labels: a line that recurs throughout its source (the counts of problem 3, over all pages) is
outside, as is what stands before the title or is nothing but links or pictures; the title, code, tables,
subheadings and sentences that do not recur are body. The sample comes from sources with enough pages for
recurrence to show; the field carries what it learns there to sources with a few pages each, where it does
not show, and every page is decoded by Viterbi.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import repeats
from folioflow.llm.seeds import Seeds
from folioflow.operators.common import hashed_sample

SAMPLE_PAGES = 1_500
#: Pages from which on a source may lend pages to the sample.
SITE_PAGES = 50
STEPS = 60
MIN_COUNT = 3

_MARKER = re.compile(r"^(?:>\s*)?(?:([-*+•])\s+|(\d+)[.)]\s+)?")
_END = re.compile(r"[.!?。！？…]+[\"”»」』)]*$")
_LINKS = re.compile(r"(?:\[[^\]]*\]\([^)]*\)[\s|·/]*)+$")
_LINK = re.compile(r"\]\([^)]*\)")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_TOKEN = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ一-鿿]")


def bare(line: str) -> str:
    return _MARKER.sub("", " ".join(line.split()), count=1).strip("*_ ")


def corpus_labels(lines: list[str], recurs: list[bool], seeds: Seeds) -> list[int]:
    """1 for body, 0 for outside, by structure and by which lines recur in the source; no line given is blank."""
    title = next((i for i, x in enumerate(lines) if x.startswith("# ")), -1)
    out, code = [], False
    for i, raw in enumerate(lines):
        s, t = raw.strip(), bare(raw)
        if s.startswith("```"):
            code = not code
            out.append(1)
        elif code or i == title:
            out.append(1)
        elif i < title or recurs[i]:
            out.append(0)
        elif s.startswith(("##", "|")):
            out.append(1)
        elif _IMAGE.match(t) or _LINKS.match(t):
            out.append(0)
        else:
            out.append(1 if _END.search(t) or seeds.match(t) else 0)
    return out


_SEEDS = Seeds()


def _shape(line: str, code: bool) -> tuple[list[str], str, list[str]]:
    """Features of a block's form, its bare text, and its words."""
    s = line.strip()
    if code or s.startswith("```"):
        return ["tag=code"], "", []
    head = s[0] == "#" and s.lstrip("#")[:1] == " "
    m = _MARKER.match(s)
    t = " ".join((s.lstrip("#") if head else s[m.end() :]).split()).strip("*_ ")
    tag = (
        ("h1" if s[1] == " " else "h2") if head else "table" if s[0] == "|" else "image" if t.startswith("![") and _IMAGE.match(t)
        else "ol" if m.group(2) else "ul" if m.group(1) else "quote" if s[0] == ">" else "p"
    )
    low = t.lower()
    words = _TOKEN.findall(low)
    end = _END.search(t, max(0, len(t) - 8)) is not None
    f = [f"tag={tag}", f"end={end}", f"tag={tag},end={end}", f"n={min(6, len(words) // 3)}"]
    links = t.count("](")
    if links:
        f.append(f"links={min(links, 3)}")
        if _LINKS.match(t):
            f.append("links-only")
    if tag != "table":
        f.extend(f"sep={sep}" for sep in (" | ", " · ", " / ", " > ", " » ") if sep in t)
    if t[:1] == "©":
        f.append("copyright")
    if _SEEDS.match(t):
        f.append("template")
        f.append(f"template,end={end}")
    if t.isupper():
        f.append("capitals")
    if s[:2] == "**":
        f.append("bold")
    colon = t.find(":") if ":" in t else t.find("：")
    if 0 < colon < 25:
        f.append("colon=" + low[:colon].strip())
    if words:
        f.append("first=" + words[0])
    return f, t, words


def _pairs(t: str) -> set[str]:
    """Pairs of characters, for scripts without spaces."""
    return {t[i : i + 2] for i in range(len(t) - 1)} if _CJK.search(t) else set()


def _line_features(line: str, code: bool) -> list[str]:
    """All features that depend on a block's line alone."""
    f, t, words = _shape(line, code)
    return [*f, *("w=" + w for w in set(words)), *("c=" + c for c in _pairs(t))]


def page_features(lines: list[str], memo: dict) -> list[list[str]]:
    """Features of every block of a page; ``memo`` keeps those of lines already met."""
    out, code, title = [], False, next((i for i, x in enumerate(lines) if x.startswith("# ")), -1)
    n = len(lines)
    for i, line in enumerate(lines):
        fence = line.strip().startswith("```")
        key = (line, code and not fence)
        own = memo.get(key)
        if own is None:
            own = _line_features(line, key[1])
            if len(memo) < 50_000:
                memo[key] = own
        code ^= fence
        place = "before" if i < title else "title" if i == title else f"after{min(3, i - title)}" if title >= 0 else "none"
        out.append([*own, "place=" + place, f"left={min(3, n - 1 - i)}", "bias"])
    return out


@dataclass
class Field:
    """A fitted field: weight of each feature for body, and of each pair of neighbouring labels."""

    index: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def tables(self) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
        """Weights by form feature, by word and by pair of characters."""
        out: tuple[dict, dict, dict] = {}, {}, {}
        for x, k in self.index.items():
            kind = {"w=": 1, "c=": 2}.get(x[:2], 0)
            out[kind][x[2:] if kind else x] = float(self.weights[k])
        return out


def _pad(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each block in a table of pages by blocks."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    cols = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return rows, cols


def fit(pages: list[list[str]], labels: list[list[int]], steps: int = STEPS, min_count: int = MIN_COUNT, l2: float = 0.02) -> Field:
    """Maximum likelihood by gradient ascent; the gradient is from the forward and backward sums of all pages at once."""
    if not pages:
        return Field({}, np.zeros(0), np.zeros((2, 2)))
    memo: dict = {}
    feats = [page_features(p, memo) for p in pages]
    gold = np.array([y for p in labels for y in p], float)
    count: dict[str, int] = {}
    for p in feats:
        for f in p:
            for x in f:
                count[x] = count.get(x, 0) + 1
    index = {x: k for k, x in enumerate(sorted(x for x, c in count.items() if c >= min_count))}
    ids = [[index[x] for x in f if x in index] for p in feats for f in p]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.array([k for x in ids for k in x], np.int64)
    lengths = np.array([len(p) for p in pages])
    rows, cols = _pad(lengths)
    b, t = len(pages), int(lengths.max()) if len(lengths) else 0
    mask = np.zeros((b, t), bool)
    mask[rows, cols] = True
    y = np.zeros((b, t), int)
    y[rows, cols] = gold
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    w, pairs = np.zeros(len(index)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        e = np.zeros((b, t, 2))
        e[rows, cols, 1] = np.bincount(owner, w[flat], minlength=len(ids))
        alpha, beta = np.zeros((b, t, 2)), np.zeros((b, t, 2))
        alpha[:, 0] = e[:, 0]
        for k in range(1, t):
            x = np.logaddexp(alpha[:, k - 1, 0, None] + pairs[0], alpha[:, k - 1, 1, None] + pairs[1]) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], x, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            nxt = e[:, k + 1] + beta[:, k + 1]
            x = np.logaddexp(nxt[:, 0, None] + pairs[:, 0], nxt[:, 1, None] + pairs[:, 1])
            beta[:, k] = np.where(mask[:, k + 1, None], x, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None])
        grad = np.bincount(flat, (gold - p1[rows, cols])[owner], minlength=len(index)) - l2 * w
        expected = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                q = alpha[:, :-1, i] + pairs[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None]
                expected[i, j] = np.exp(np.where(both, q, -np.inf)).sum()
        gp = seen - expected - l2 * pairs
        for g, k, target in ((grad, 0, w), (gp, 2, pairs)):
            m[k] = 0.9 * m[k] + 0.1 * g
            m[k + 1] = 0.99 * m[k + 1] + 0.01 * g * g
            target += 0.12 * (m[k] / (1 - 0.9**step)) / (np.sqrt(m[k + 1] / (1 - 0.99**step)) + 1e-6)
    return Field(index, w, pairs)


def decode(field: Field, pages: list[list[str]], memo: dict) -> np.ndarray:
    """1 for each block that is body, all pages' blocks in a row; Viterbi over all pages at once."""
    lengths = np.array([len(p) for p in pages], np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, int)
    if "tables" not in memo:
        memo["tables"], memo["scores"] = field.tables(), {}
    form, word, pair = memo["tables"]
    own: dict[tuple, float] = memo["scores"]
    f_get, w_get, c_get = form.get, word.get, pair.get
    base = f_get("bias", 0.0)
    place = {p: f_get("place=" + p, 0.0) + base for p in ("before", "title", "after1", "after2", "after3", "none")}
    left = [f_get(f"left={k}", 0.0) for k in range(4)]
    score = np.empty(total)
    k = 0
    for p in pages:
        code, title, n = False, next((i for i, x in enumerate(p) if x.startswith("# ")), -1), len(p)
        for i, line in enumerate(p):
            fence = line.lstrip().startswith("```")
            key = (line, code and not fence)
            s = own.get(key)
            if s is None:
                f, t, words = _shape(line, key[1])
                s = sum([f_get(x, 0.0) for x in f]) + sum([w_get(x, 0.0) for x in set(words)])
                if pair and not t.isascii():
                    s += sum([c_get(x, 0.0) for x in _pairs(t)])
                if len(own) < 100_000:
                    own[key] = s
            code ^= fence
            score[k] = s + place["before" if i < title else "title" if i == title else f"after{min(3, i - title)}" if title >= 0 else "none"] + left[min(3, n - 1 - i)]
            k += 1
    # pages of like length together, so that one long page does not stretch the table
    out = np.zeros(total, int)
    start = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    for group in np.array_split(order, max(1, len(order) // 512)):
        size = lengths[group]
        t = int(size.max())
        if not t:
            continue
        e = np.zeros((len(group), t))
        rows, cols = _pad(size)
        at = np.repeat(start[group], size) + cols
        e[rows, cols] = score[at]
        best = np.stack([np.zeros(len(group)), e[:, 0]], 1)
        back = np.zeros((t, len(group), 2), np.int8)
        for c in range(1, t):
            x = best[:, :, None] + field.pairs[None]
            back[c] = x.argmax(1)
            new = x.max(1)
            new[:, 1] += e[:, c]
            live = (c < size)[:, None]
            back[c] = np.where(live, back[c], np.arange(2))
            best = np.where(live, new, best)
        y = np.zeros((len(group), t), int)
        y[:, -1] = best.argmax(1)
        for c in range(t - 1, 0, -1):
            y[:, c - 1] = back[c][np.arange(len(group)), y[:, c]]
        out[at] = y[rows, cols]
    return out


def body_lines(field: Field, texts: list[str | None], memo: dict) -> list[set[int]]:
    """Of each page the numbers, from 1, of the lines of its main body; all pages are decoded at once."""
    got = [_blocks(t) for t in texts]
    body = decode(field, [b for _, b in got], memo)
    ends = np.cumsum([0, *(len(n) for n, _ in got)])
    return [{n for n, y in zip(numbers, body[a:b], strict=True) if y} for (numbers, _), a, b in zip(got, ends, ends[1:], strict=False)]


def _blocks(text: str | None) -> tuple[list[int], list[str]]:
    """Numbers, from 1, and texts of the lines that are not blank."""
    lines = (text or "").split("\n")
    keep = [i for i, x in enumerate(lines) if x.strip()]
    return [i + 1 for i in keep], [lines[i] for i in keep]


def training_pages(articles: DataFrame, id_col: str, source_col: str, text_col: str, limit: int = SAMPLE_PAGES, site_pages: int = SITE_PAGES) -> list[tuple[list[str], list[int]]]:
    """Blocks and labels of at most ``limit`` pages, chosen by the hash of their id among the sources with
    ``site_pages`` pages or more, or among all where no source has so many. Recurrence is counted over all pages."""
    source = F.coalesce(F.col(source_col), F.lit(""))
    keys = articles.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), source.alias("domain"))
    large = keys.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= site_pages).select("domain")
    chosen = hashed_sample(keys.join(large, "domain", "left_semi") if not large.isEmpty() else keys, "id", limit)
    pages = repeats.source_pages(articles, id_col, source_col, text_col)
    frequent = repeats.frequent_lines(pages.select("domain", "ids"))
    # at most ``limit`` keys
    texts = pages.join(F.broadcast(chosen.select("id").distinct()), "id").join(frequent, "domain", "left")
    flags = F.transform("ids", lambda x: F.coalesce(F.array_contains("lines", x), F.lit(False)))
    rows = texts.select("id", "text", flags.alias("recurs")).limit(limit).collect()
    out = []
    for r in sorted(rows, key=lambda r: (str(r["id"]), r["text"])):
        numbers, lines = _blocks(r["text"])
        if lines:
            out.append((lines, corpus_labels(lines, [r["recurs"][k - 1] for k in numbers], _SEEDS)))
    return out


def fitted(articles: DataFrame, id_col: str, source_col: str, text_col: str, sample_pages: int = SAMPLE_PAGES) -> Field:
    sample = training_pages(articles, id_col, source_col, text_col, sample_pages)
    return fit([p for p, _ in sample], [y for _, y in sample])


def label_blocks(articles: DataFrame, id_col: str = "article_id", source_col: str = "domain", text_col: str = "markdown", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(<id_col>, line_no, body): every line that is not blank, numbered from 1, of every page.

    Null and blank texts have no lines; a page without a title heading is labelled by its other features;
    repeated rows are labelled each; a text of any length is labelled whole. The field is fitted on at
    most ``sample_pages`` pages, whatever the table's size; a null source is a source of its own; an empty
    table gives no rows.
    """
    field = fitted(articles, id_col, source_col, text_col, sample_pages)
    pages = articles.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            got = [_blocks(t) for t in batch.column(1).to_pylist()]
            body = decode(field, [b for _, b in got], memo)
            owner = pa.array(np.repeat(np.arange(len(got)), [len(n) for n, _ in got]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array([k for n, _ in got for k in n], pa.int32()), pa.array(body.astype(bool))], ["id", "line_no", "body"])

    out = pages.mapInArrow(run, f"id {pages.schema['id'].dataType.simpleString()}, line_no int, body boolean")
    return out.withColumnRenamed("id", id_col)


def main_text(articles: DataFrame, id_col: str = "article_id", source_col: str = "domain", text_col: str = "markdown", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(<id_col>, body, n_outside): every page's main body, its lines with the blank lines between them; nulls as empty."""
    field = fitted(articles, id_col, source_col, text_col, sample_pages)
    pages = articles.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [_blocks(t) for t in texts]
            body = decode(field, [b for _, b in got], memo)
            bodies, outside, k = [], [], 0
            for text, (numbers, _) in zip(texts, got, strict=True):
                drop = {n - 1 for n, y in zip(numbers, body[k : k + len(numbers)], strict=True) if not y}
                k += len(numbers)
                kept = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in drop)
                bodies.append(re.sub(r"\n{3,}", "\n\n", kept).strip("\n"))
                outside.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(outside, pa.int32())], ["id", "body", "n_outside"])

    out = pages.mapInArrow(run, f"id {pages.schema['id'].dataType.simpleString()}, body string, n_outside int")
    return out.withColumnRenamed("id", id_col)
