"""Problem 4: sentence boundaries across languages and scripts.

Unsupervised, per language, from the whole corpus: abbreviations are the words bound to a following full
stop, sentence starters the words that stand after certain boundaries more often than elsewhere, and
collocations the pairs that a full stop joins; each is found by Dunning's log-likelihood ratio. Every full
stop is then classified by these statistics, the case of what follows, and the marks around it. Marks that
end a sentence in any script (! ? and those of Chinese, Japanese, Hindi and Arabic) are boundaries unless
a reporting clause follows a quotation. Thai, which has no final mark, divides at spaces between letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.spam import language
from folioflow.operators.common import cut_lineage, unlike

ABBREVIATION_LLR = 1.0
STARTER_LLR = 12.0
COLLOCATION_LLR = 7.88
STARTER_SHARE = 0.12
_CLOSERS = "\"'”’»)\\]」』）》"
_BOUNDARY = re.compile(rf"(?P<mark>[.!?…؟।۔。！？．]+)(?P<close>(?:[ \u00a0\u202f]?»|[{_CLOSERS}])*)(?P<gap>\s*)")
_LOW_QUOTE = re.compile("„([^„“”]*)“")
_THAI_GAP = re.compile(r"(?<=[ก-๎.])(?<!\d\.)\s+(?=[ก-๎])")
_WORD = re.compile(r"[^\s\"“”„«»()\[\]（）「」『』]+")
_NUMBER = re.compile(r"^[\d.,:–-]+$")
_LAST = re.compile(r"[^\s\"“”„«»()\[\]（）「」『』]*$")
_NEXT = re.compile(r"[^\s.,;:!?\"“”„«»()\[\]（）「」『』…。！？،؛।؟]+")
#: Words of clauses that report a quotation, in scripts without case. Fixed values.
_REPORT = re.compile(r"^(?:と|[^。！？.!?।؟]{0,24}(?:问|說|说|道|喊|答|回答))|^[^।.!?؟]{0,40}(?:पूछा|कहा|बोला)|^\s*(?:سأل|قال|صاح|أجاب)")


def _llr(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio of k1 successes in n1 trials against k2 in n2; negative where the first share is the lower."""

    def ll(k: Column, n: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.ln(p) + (n - k) * F.ln(1 - p)

    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    out = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    return F.when((n1 > 0) & (n2 > 0), F.when(p1 >= p2, out).otherwise(-out)).otherwise(0.0)


@dataclass
class Model:
    """What was learned, by language; words of abbreviations are lower-cased and lack the stop."""

    abbreviations: dict[str, frozenset[str]] = field(default_factory=dict)
    starters: dict[str, frozenset[str]] = field(default_factory=dict)
    collocations: dict[str, frozenset[tuple[str, str]]] = field(default_factory=dict)
    finals: dict[str, frozenset[str]] = field(default_factory=dict)


def _kind(word: str) -> str:
    return "#" if _NUMBER.match(word) else word


def count_text(text: str, lang: str, out: Counter) -> None:
    """Adds a text's events to ``out``: words with and without a stop, words at certain starts, pairs around a stop."""
    tokens = _WORD.findall(text)
    sure = True
    for i, tok in enumerate(tokens):
        bare = tok.rstrip(".,;:!?…؟।。！？،؛")
        if not bare:
            sure = tok[-1] in "!?؟।。！？"
            continue
        tail = tok[len(bare) :]
        stop = tail.startswith(".") and not tail.startswith("..")
        key = _kind(bare)
        out[(lang, "stop" if stop else "bare", key.lower())] += 1
        out[(lang, "start" if sure else "inner", bare)] += 1
        if stop and tail == "." and i + 1 < len(tokens):
            after = _NEXT.search(tokens[i + 1])
            if after:
                out[(lang, "pair", f"{key.lower()}\t{_kind(after.group())}")] += 1
        sure = tail[-1:] in "!?؟।。！？" if tail else False


def count_events(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, event, k, n): the events of all texts, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                count_text(t, language(t), seen)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in keys], pa.string()) for j in range(3)), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "event", "k", "n"])

    return texts.select(F.col(text_col)).filter(F.length(text_col) > 0).mapInArrow(run, "lang string, event string, k string, n bigint").groupBy("lang", "event", "k").agg(F.sum("n").alias("n"))


def learned(counts: DataFrame) -> DataFrame:
    """(lang, kind, a, b): abbreviations, finals, starters and collocations of every language, by their ratios.

    All ratios are computed where the counts lie; the totals that they need are one row per language.
    """
    n = F.col("n")

    def of(event: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("event") == event, n)), F.lit(0))

    total = counts.groupBy("lang").agg(of("stop").alias("n_stop"), (of("stop") + of("bare")).alias("n_all"), of("start").alias("n_start"), (of("start") + of("inner")).alias("n_words"), of("pair").alias("n_pairs"))
    total = F.broadcast(total)  # one row per language
    words = counts.filter(F.col("event").isin("stop", "bare")).groupBy("lang", "k").agg(of("stop").alias("stop"), of("bare").alias("bare"))
    letters = F.replace("k", F.lit("."), F.lit(""))
    held = F.col("stop") + F.col("bare")
    ratio = _llr(F.col("stop"), held, F.col("n_stop") - F.col("stop"), F.greatest(F.lit(1), F.col("n_all") - held))
    # long words and words that also stand without a stop are unlikely abbreviations
    score = ratio * F.exp(-F.length(letters)) * (F.length("k") - F.length(letters) + 1) * F.pow(F.length(letters).cast("double"), -F.col("bare"))
    short = words.filter((F.col("stop") > 0) & F.col("k").rlike(r"\p{L}")).join(total, "lang").filter(score >= ABBREVIATION_LLR).select("lang", F.col("k").alias("a"))
    starts = counts.filter(F.col("event").isin("start", "inner")).groupBy("lang", F.col("k").alias("b")).agg(of("start").alias("start"), (of("start") + of("inner")).alias("seen"))
    often = _llr(F.col("start"), F.col("seen"), F.col("n_start") - F.col("start"), F.greatest(F.lit(1), F.col("n_words") - F.col("seen")))
    good = ((F.length("b") > 1) | ~F.col("b").rlike(r"^[\x00-\x7F]*$")) & (F.col("start") / F.col("seen") >= STARTER_SHARE) & (often >= STARTER_LLR)
    starts = starts.join(total.select("lang", "n_start", "n_words"), "lang").select("lang", "b", "start", "seen", (F.coalesce(good, F.lit(False)) & (F.col("start") > 0)).alias("starter"))
    part = F.split("k", "\t")
    pairs = counts.filter(F.col("event") == "pair").select("lang", part[0].alias("a"), part[1].alias("b"), "n")
    firsts = pairs.groupBy("lang", "a").agg(F.sum("n").alias("n_a"))
    seconds = pairs.groupBy("lang", "b").agg(F.sum("n").alias("n_b"))
    number = F.col("b") == "#"
    joined = (
        pairs.filter("n > 1").join(starts, ["lang", "b"], "left").filter((number | (n >= 0.3 * F.coalesce("seen", F.lit(0)))) & ~F.coalesce("starter", F.lit(False)))
        .join(firsts, ["lang", "a"]).join(seconds, ["lang", "b"]).join(total.select("lang", "n_pairs"), "lang")
    )
    bound = joined.filter(_llr(n, F.col("n_a"), F.col("n_b") - n, F.greatest(F.lit(1), F.col("n_pairs") - F.col("n_a"))) >= COLLOCATION_LLR)
    # what follows these could as well begin a sentence: etc. and units, against titles that names follow
    after = pairs.join(short, ["lang", "a"]).filter(~number & ~F.col("b").rlike(r"^\p{Ll}")).join(starts, ["lang", "b"], "left")
    begins = (F.length("b") > 1) & (F.coalesce("start", F.lit(0)) >= 0.05 * F.coalesce("seen", F.lit(0)))
    finals = after.groupBy("lang", "a").agg(F.sum("n").alias("upper"), F.coalesce(F.sum(F.when(begins, n)), F.lit(0)).alias("ends")).filter(F.col("ends") >= 0.8 * F.col("upper"))
    kind = lambda df, name, a, b: df.select("lang", F.lit(name).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    out = kind(short, "abbreviation", F.col("a"), none).unionByName(kind(finals, "final", F.col("a"), none))
    return out.unionByName(kind(starts.filter("starter"), "starter", F.col("b"), none)).unionByName(kind(bound, "collocation", F.col("a"), F.col("b")))


def learn(texts: DataFrame, text_col: str = "text") -> Model:
    """The model of a corpus, from the events of all its texts; only the words that it learned reach the driver."""
    by: dict[str, dict[str, set]] = {}
    for r in learned(cut_lineage(count_events(texts, text_col))).collect():
        by.setdefault(r["kind"], {}).setdefault(r["lang"], set()).add((r["a"], r["b"]) if r["kind"] == "collocation" else r["a"])
    words = lambda kind: {lang: frozenset(x) for lang, x in by.get(kind, {}).items()}
    return Model(words("abbreviation"), words("starter"), words("collocation"), words("final"))


def boundaries(text: str, model: Model, lang: str | None = None) -> list[int]:
    """Offset of the first character of every sentence of ``text``."""
    lang = lang or language(text)
    abbreviations, starters, pairs, finals = (m.get(lang, frozenset()) for m in (model.abbreviations, model.starters, model.collocations, model.finals))
    text = _LOW_QUOTE.sub("„\\1”", text)
    first = len(text) - len(text.lstrip())
    cuts: set[int] = set()
    n = len(text)
    for m in _BOUNDARY.finditer(text, first):
        at = m.end()
        if at >= n:
            continue
        mark, close, gap = m.group("mark", "close", "gap")
        nxt = text[at]
        dense = mark[-1] in "。！？．"
        if not close and close is not None and gap == "" and not dense and mark[-1] != "।":
            # no space: only a capital right after a lower-case word shows a boundary
            before = _LAST.search(text, max(0, m.start() - 80), m.start()).group()
            if mark in (".", "!", "?") and nxt.isupper() and len(before) >= 3 and before[-1].islower() and "/" not in before and "." not in before and before.lower() not in abbreviations and text[at + 1 : at + 2].islower():
                cuts.add(at)
            continue
        if nxt in ",،、，;:؛—–-" or (nxt in ")]」』»”’" and not close):
            continue
        cased = nxt.isupper() or nxt.islower()
        word = _NEXT.match(text, at)
        word = word.group() if word else ""
        lower = nxt.islower() and not any(c.isupper() for c in word[1:])
        quoted = any(c in close for c in "\"”’»」』“'")
        if lower:
            continue
        if quoted and not cased and _REPORT.match(text[at : at + 60]):
            continue
        if mark[0] in "…" or (mark == "." * len(mark) and len(mark) > 1):
            if mark[0] == "…" and not (gap and nxt.isupper()):
                continue
            cuts.add(at)
            continue
        if mark != ".":
            if gap or dense or mark[-1] == "।" or close:
                cuts.add(at)
            continue
        before = _LAST.search(text, max(0, m.start() - 80), m.start()).group()
        if not before:
            cuts.add(at)
            continue
        low = before.lower()
        if close:  # a full stop inside a quotation or bracket that ends with it
            cuts.add(at)
            continue
        opening = nxt in "\"“„«(¿¡「『（"
        is_number = _NUMBER.match(before) is not None
        single = len(before) == 1 and before.isalpha()
        if is_number:
            near = language(text[max(0, m.start() - 60) : at + 40])
            if near == "de" and not opening and word not in starters and (("#", word) in pairs or nxt.isupper()):
                continue
            if ("#", word) in pairs and not opening:
                continue
            cuts.add(at)
        elif lang == "hi" and not before.isascii():
            continue  # the full stop is no final mark there
        elif single or low in abbreviations or _initials(before):
            if nxt.isdigit() or (low, word) in pairs:
                continue
            if opening or ((word in starters or low in finals) and not (single and before.isupper() and before.isascii() and word[:1].isupper() and len(word) > 1 and before not in "I")):
                cuts.add(at)
        elif (low, _kind(word)) not in pairs or word in starters:
            cuts.add(at)
    if any("ก" <= c <= "๎" for c in text):
        cuts.update(m.end() for m in _THAI_GAP.finditer(text))
    return [first, *sorted(c for c in cuts if first < c < n)] if first < n else []


def _initials(word: str) -> bool:
    """U.S, p.m and the like: single letters with stops between."""
    parts = word.split(".")
    return len(parts) > 1 and all(len(p) == 1 for p in parts)


def split_texts(texts: DataFrame, model: Model, text_col: str = "text", whole_col: str | None = None) -> DataFrame:
    """``texts`` less its text, with sentence_no, char_start, sentence: a row per sentence.

    Null and blank texts have none; where ``whole_col`` is true the text is one unit; a text of any length
    is split whole; repeated rows are split each; a kept column named like a result's gets the ending _in.
    """
    keys = [c for c in texts.columns if c not in (text_col, whole_col)]
    names = [f"_k{i}" for i in range(len(keys))]
    df = texts.select(*[F.col(c).alias(k) for c, k in zip(keys, names, strict=True)], F.col(text_col).alias("_t"), (F.col(whole_col) if whole_col else F.lit(False)).alias("_w"))
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, start, piece = [], [], [], []
            for k, (t, whole) in enumerate(zip(batch.column("_t").to_pylist(), batch.column("_w").to_pylist(), strict=True)):
                if not t or not t.strip():
                    continue
                cuts = [len(t) - len(t.lstrip())] if whole else boundaries(t, model)
                for j, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(t)], strict=True)):
                    owner.append(k)
                    number.append(j)
                    start.append(a)
                    piece.append(t[a:b].rstrip())
            index = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in names), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(piece, pa.string())], [*names, "sentence_no", "char_start", "sentence"])

    out = df.mapInArrow(run, f"{schema + ', ' if schema else ''}sentence_no int, char_start int, sentence string")
    return out.select(*[F.col(k).alias(c) for c, k in zip(unlike(keys, ("sentence_no", "char_start", "sentence")), names, strict=True)], "sentence_no", "char_start", "sentence")


def section_paragraphs(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, para_idx, text, heading): every paragraph, its stored pieces joined by one space."""
    heads = F.transform(F.filter(F.coalesce("blocks", F.array()), lambda b: b["kind"] == "heading"), lambda b: b["para_idx"])
    out = sections.select("doc_id", F.col("id").alias("section_id"), heads.alias("heads"), F.posexplode("paragraphs").alias("para_idx", "pieces"))
    return out.select("doc_id", "section_id", "para_idx", F.array_join("pieces", " ").alias("text"), F.coalesce(F.array_contains("heads", F.col("para_idx")), F.lit(False)).alias("heading"))


def section_sentences(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, para_idx, sentence_no, char_start, sentence) of all sections; a heading is one sentence."""
    paragraphs = section_paragraphs(sections)
    model = learn(paragraphs.filter(~F.col("heading")))
    return split_texts(paragraphs, model, whole_col="heading")


def document_sentences(docs: DataFrame, id_col: str = "id", text_col: str = "markdown") -> DataFrame:
    """(<id_col>, para_no, sentence_no, char_start, sentence): sentences of Markdown texts, by paragraphs between blank lines.

    Wrapped lines are joined by a space; headings are one sentence; fenced code is left out.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?s)```.*?(?:```|\z)", "")
    parts = docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(plain, r"\n\s*\n|\n(?=[-*+>#]|\d+[.)] )", -1)).alias("para_no", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^\s*(?:#{1,6}|[-*+>]|\d+[.)])\s+", ""), r"\s+", " "))
    paragraphs = parts.select("_id", "para_no", text.alias("text"), F.col("raw").rlike(r"^\s*#{1,6}\s").alias("heading")).filter(F.length("text") > 0)
    model = learn(paragraphs.filter(~F.col("heading")))
    return split_texts(paragraphs, model, whole_col="heading").withColumnRenamed("_id", id_col)
