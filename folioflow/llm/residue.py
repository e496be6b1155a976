"""Problem 7: template residue, filler and error messages in place of content.

Positive-unlabelled naive Bayes, fitted by expectation-maximisation. The seeds (unfilled placeholders,
well-known error and filler texts) mark trusted positives only in records that hold hardly anything else, so
a real text that mentions them teaches nothing. All other passages are unlabelled: those of records without a
seed start as negatives, and each round re-estimates them, but only passages of records that are decided
as residue can turn positive. A line that real records hold as well (page furniture, quotations of an
error) therefore stays negative, whatever its words. The share of positives is held near that of the seeds.

Every passage of every record is then scored by the model; a score is tempered in long passages, whose words
are no independent witnesses. A record is residue if a placeholder stands for a value in it, or if the
passages that score as residue outweigh its running text. On web pages only the main body counts, as the
field of problem 5 finds it. Seeds decide nothing by themselves; quoted and code-marked spans are masked
before anything is matched or scored, so texts that mention or show such things stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import pages
from folioflow.llm.seeds import Seeds, has_placeholder, is_quoting, may_hold_placeholder, unquoted
from folioflow.operators.common import hashed_sample

SAMPLE_RECORDS = 12_000
ROUNDS = 6
THRESHOLD = 3.0
#: Words from which on a passage's evidence is averaged; occurrences below which a word tells nothing.
FULL_WORDS = 12
MIN_COUNT = 3
#: How many times the seeds' share of all passages the positives may be.
GROWTH = 3.0
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]{2,}")
_DIGIT = re.compile(r"\d")
_CJK = re.compile(r"[぀-ヿ一-鿿]+")
_END = re.compile(r"[.!?。！？…।؟][\"”»’」』)*_]*(?:\s|$)|[。！？]")
_HEADING = re.compile(r"#{1,6}\s")


def passages(text: str | None, wrapped: bool) -> list[tuple[int, str]]:
    """Number, from 1, of the first line, and text of the lines that are not blank, or where lines are wrapped of the
    paragraphs between blank lines; fenced code left out, quoted spans masked."""
    out: list[tuple[int, str]] = []
    code, fresh = False, True
    text = text or ""
    fenced = "```" in text
    for i, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if not s:
            fresh = True
            continue
        if fenced and s.startswith("```"):
            code = not code
            fresh = True
        elif code:
            continue
        elif wrapped and not fresh:
            out[-1] = out[-1][0], out[-1][1] + " " + s
        else:
            out.append((i, s))
            fresh = False
    return [(i, unquoted(p)) for i, p in out] if is_quoting(text) else out


def tokens(passage: str) -> set[str]:
    """Words, numbers as one, runs of signs, and pairs of characters of scripts without spaces."""
    low = passage.lower()
    found = set(_TOKEN.findall(low))
    if _DIGIT.search(low):
        found = {("#" if t[0].isdigit() else t) for t in found}
    if not low.isascii():
        for run in _CJK.findall(low):
            found.discard(run)
            found.update([run[i : i + 2] for i in range(len(run) - 1)])
    return found


@dataclass
class Bayes:
    """Log odds: of each token, of a match of the seeds, and of the class."""

    odds: dict[str, float]
    seed: float
    prior: float
    seeds: Seeds

    def score(self, passage: str) -> float:
        """The log odds that ``passage`` is residue; the seeds are looked for only where they can matter."""
        own = [o for o in map(self.odds.get, tokens(passage)) if o is not None]
        # rounded, as the order of a set's sum differs between processes
        found = self.prior + (round(sum(own) * min(1.0, FULL_WORDS / len(own)), 6) if own else -10.0)
        return found + self.seed if found + self.seed >= THRESHOLD > found and self.seeds.match(passage) else found


def is_running(passage: str) -> bool:
    """Whether a passage is running text rather than a label or a number."""
    return len(passage) >= 8 and (_END.search(passage) is not None or len(passage) >= 80)


@dataclass
class Record:
    """What is judged of a record: the passages of its body, headings apart."""

    body: list[str]
    heads: list[str]
    marked: bool  # whether any part of a placeholder's notation is there at all


def outweighs(residue: float, prose: float) -> bool:
    return residue > 0 and residue >= prose


def fit(records: list[Record], seeds: Seeds | None = None, rounds: int = ROUNDS, smooth: float = 0.2) -> Bayes:
    """Expectation-maximisation over the body passages of ``records``; the same records give the same model."""
    seeds = seeds or Seeds()
    owner = np.array([k for k, r in enumerate(records) for _ in r.body], np.int64)
    texts = [p for r in records for p in r.body]
    if not texts:
        return Bayes({}, 0.0, -10.0, seeds)
    index: dict[str, int] = {}
    memo: dict[str, tuple[list[int], bool]] = {}
    for p in texts:
        if p not in memo:
            memo[p] = [index.setdefault(t, len(index)) for t in sorted(tokens(p))], seeds.match(p)
    ids = [memo[p][0] for p in texts]
    size = np.array([len(x) for x in ids])
    flat, at = np.array([k for x in ids for k in x], np.int64), np.repeat(np.arange(len(ids)), size)
    known = np.bincount(flat, minlength=len(index)) >= MIN_COUNT
    keep = known[flat]
    flat, at = flat[keep], at[keep]
    size = np.bincount(at, minlength=len(texts))
    temper = np.minimum(1.0, FULL_WORDS / np.maximum(size, 1))
    seed = np.array([memo[p][1] for p in texts])
    length = np.array([len(p) for p in texts], float)
    running = np.array([is_running(p) for p in texts])

    def decided(positive: np.ndarray) -> np.ndarray:
        residue = np.bincount(owner, length * positive, len(records))
        prose = np.bincount(owner, length * (running & ~positive), len(records))
        return (residue > 0) & (residue >= prose)

    sure = seed & decided(seed)[owner]
    share = max(sure.sum(), 1) / len(texts)
    posterior = sure.astype(float)
    odds, prior, worth = np.zeros(len(index)), 0.0, 0.0
    vocabulary = int(known.sum()) or 1
    for step in range(rounds):
        one = np.bincount(flat, posterior[at], len(index))
        zero = np.bincount(flat, 1 - posterior[at], len(index))
        odds = np.log((one + smooth) / (one.sum() + smooth * vocabulary)) - np.log((zero + smooth) / (zero.sum() + smooth * vocabulary))
        # a match of the seeds is one more witness, worth what it is among the positives against the rest
        worth = float(np.log((posterior[seed].sum() + smooth) / (posterior.sum() + 1)) - np.log(((1 - posterior)[seed].sum() + smooth) / ((1 - posterior).sum() + 1)))
        found = min(max(posterior.mean(), share), min(0.5, GROWTH * share))
        prior = float(np.log(found / (1 - found)))
        if step < rounds - 1:
            score = prior + np.where(size > 0, np.bincount(at, odds[flat], len(texts)) * temper, -10.0) + worth * seed
            score[sure] = 50.0
            gate = decided(score >= THRESHOLD)[owner]
            posterior = np.where(sure, 1.0, np.where(gate, 1 / (1 + np.exp(-np.clip(score - THRESHOLD, -50, 50))), 0.0))
    return Bayes({t: float(odds[k]) for t, k in index.items() if known[k]}, worth, prior, seeds)


def parts(text: str | None, wrapped: bool, body: set[int] | None) -> Record:
    """The passages to judge; ``body`` are the line numbers of a web page's main body, None where all lines count."""
    out = Record([], [], may_hold_placeholder(text or ""))
    for i, p in passages(text, wrapped):
        if body is None or i in body:
            (out.heads if p[0] == "#" and _HEADING.match(p) else out.body).append(p)
    return out


def judge(record: Record, model: Bayes, memo: dict[str, float]) -> tuple[int, int, int]:
    """(placeholders, characters of residue, characters of running text) of a record; no text is counted where there is no residue."""
    marked = record.marked
    holes = sum([has_placeholder(p) for p in record.heads]) if marked else 0
    scores = []
    for p in record.body:
        s = memo.get(p)
        if s is None:
            s = 1e9 if marked and has_placeholder(p) else model.score(p)
            if len(memo) < 50_000:
                memo[p] = s
        scores.append(s)
    if not scores or max(scores) < THRESHOLD:
        return holes, 0, 0
    found = [s >= THRESHOLD for s in scores]
    residue = sum([len(p) for p, y in zip(record.body, found, strict=True) if y])
    prose = sum([len(p) for p, y in zip(record.body, found, strict=True) if not y and is_running(p)])
    return holes + sum([s >= 1e9 for s in scores]), residue, prose


def find_residue(records: DataFrame, key_cols: list[str], text_col: str, wrapped: bool, model: Bayes, field: pages.Field | None = None) -> DataFrame:
    """``key_cols``, placeholders, residue and prose (characters), is_residue for every record.

    Null and blank texts are no residue; repeated rows are judged each; a text of any length is judged whole.
    With a ``field`` the records are web pages, of which the main body counts; it is sought only in records in
    which some passage scores as residue.
    """
    names = [f"_k{i}" for i in range(len(key_cols))]
    df = records.select(*[F.col(c).alias(n) for c, n in zip(key_cols, names, strict=True)], F.col(text_col).alias("_t"))
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        own: dict = {}
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            got = [judge(parts(t, wrapped, None), model, memo) for t in texts]
            asked = [k for k, (_, residue, _) in enumerate(got) if residue] if field is not None else []
            for k, body in zip(asked, pages.body_lines(field, [texts[k] for k in asked], own) if asked else [], strict=True):
                got[k] = got[k][0], *judge(parts(texts[k], wrapped, body), model, memo)[1:]
            a, b, c = zip(*got, strict=True) if got else ((), (), ())
            flag = [h > 0 or outweighs(x, y) for h, x, y in got]
            cols = [pa.array(v, pa.int32()) for v in (a, b, c)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols, pa.array(flag, pa.bool_())], [*names, "placeholders", "residue", "prose", "is_residue"])

    out = df.mapInArrow(run, f"{schema}, placeholders int, residue int, prose int, is_residue boolean")
    for n, c in zip(names, key_cols, strict=True):
        out = out.withColumnRenamed(n, c)
    return out


def sample_texts(records: DataFrame, key: str, text_col: str, limit: int) -> list[str]:
    """At most ``limit`` texts, chosen by the hash of their key."""
    rows = hashed_sample(records.select(F.col(key).alias("k"), F.col(text_col).alias("t")).filter(F.length("t") > 0), "k", limit).collect()
    return [r["t"] for r in sorted(rows, key=lambda r: (str(r["k"]), r["t"]))]


def learn(articles: DataFrame, scans: DataFrame, sample: int = SAMPLE_RECORDS, seeds: Seeds | None = None) -> tuple[Bayes, pages.Field]:
    """The model and the field of the web pages; ``scans`` has record_key and markdown."""
    field = pages.fitted(articles, "article_id", "domain", "markdown")
    texts = sample_texts(articles, "article_id", "markdown", sample // 2)
    records = [parts(t, False, body) for t, body in zip(texts, pages.body_lines(field, texts, {}), strict=True)]
    records += [parts(t, True, None) for t in sample_texts(scans, "record_key", "markdown", sample // 2)]
    return fit(records, seeds), field


def flag_records(articles: DataFrame, ocr: DataFrame, sample: int = SAMPLE_RECORDS, seeds: Seeds | None = None) -> DataFrame:
    """(record_table, record_key, placeholders, residue, prose, is_residue) for all articles and all good page readings.

    A page reading's key is doc_id#page; repeated rows count once. One model is fitted on at most
    ``sample`` records, half of them articles, half readings. Empty tables give no rows.
    """
    scans = ocr.filter(~F.coalesce("failed", F.lit(False))).select(F.concat_ws("#", "doc_id", F.col("page").cast("string")).alias("record_key"), "markdown").distinct()
    model, field = learn(articles, scans, sample, seeds)
    web = find_residue(articles.select(F.col("article_id").cast("string").alias("record_key"), "markdown"), ["record_key"], "markdown", False, model, field)
    read = find_residue(scans, ["record_key"], "markdown", True, model)
    return web.withColumn("record_table", F.lit("articles")).unionByName(read.withColumn("record_table", F.lit("ocr_results")))
