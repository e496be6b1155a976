"""Problem 10: keyword-stuffed pages and link lists.

A document is cut into blocks. Each block has features of density (links, separators, final marks),
entropy, repetition and function words. Per language, the location and scatter of the features are
estimated robustly over the blocks of all documents (medians, median absolute deviations, correlations of
clipped scores), and every block gets its squared Mahalanobis distance. A block is spam if it is an
outlier and lies on the spam side: fewer function words, more repetition, links and separators. A document
is spam if such blocks hold the greater part of its text.

Function words are learned per language: the words, or characters in scripts without spaces, that occur
in the most documents. Languages are told apart by script, and within the Latin script by their words of
closed classes. A text is cut into words once in each of the two passes, block by block; the language, the
units and the features all read those words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.operators.common import cut_lineage

FUNCTION_WORDS = 30
OUTLIER = 45.0
SHARE = 0.5
#: Of each feature, the side of spam and the least scale, so that a feature that hardly varies stays finite.
FEATURES = {"function": (-1, 0.06), "repeat": (1, 0.05), "entropy": (-1, 0.06), "links": (1, 0.05), "separators": (1, 0.06), "marks": (-1, 0.04)}
LANGUAGES = ("en", "de", "fr", "es", "ru", "ar", "hi", "th", "zh", "ja", "other")
#: Words of closed classes (articles, prepositions, conjunctions, pronouns, auxiliaries, question words) by which
#: languages of the Latin script are told apart. Fixed values.
_LATIN = {
    "en": (
        "the a an and or but nor of in on at to from with without for by as than that this these those it its is was were are be been has had have do does did not no every any each nobody nothing"
        " who which what why when where how whenever because although while after before until unless he she they we you i his her their our my your"
    ),
    "de": (
        "der die das den dem des ein eine einen einem einer eines und oder aber in im an am auf aus bei mit nach von vom zu zum zur für ist war sind waren hat hatte haben nicht kein keine jede jeder jedes niemand nichts"
        " wer was warum wann wo wie weil obwohl während bis als wenn er sie es wir ihr ich sein ihre unser"
    ),
    "fr": (
        "le la les l un une des du de d et ou mais ni à au aux en dans sur sous avec sans pour par est était sont étaient a avait ont ne pas aucun chaque personne rien"
        " qui que quoi pourquoi quand où comment parce lorsque après avant il elle ils elles nous vous je son sa ses leur notre"
    ),
    "es": (
        "el la los las un una unos unas y o pero ni de del al en con sin para por sobre es era son eran ha había han no ningún cada nadie nada"
        " quien que qué cuando dónde cómo porque aunque mientras después antes él ella ellos nosotros yo su sus nuestro"
    ),
}
_SHORT: dict[str, tuple[str, ...]] = {}
for _lang, _words in _LATIN.items():
    for _w in _words.split():
        _SHORT[_w] = (*_SHORT.get(_w, ()), _lang)
_KANA = re.compile("[぀-ヿ]")
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e4e]+[^\W\d_]*)*")
_URL = re.compile(r"\[[^\]\n]*\]\([^)\n]*\)|<?https?://[^\s>)]+>?|\bwww\.[^\s)]+")
_SEPARATOR = re.compile(r"[|#,;、，；•·/>　]| - |\d+")
_MARK = re.compile(r"[.!?。！？।؟]")
_DENSE = {"zh", "ja", "th"}


def words_language(words: list[str], is_ascii: bool) -> str:
    """The language of lower-cased words, by their script and, in the Latin script, those of closed classes."""
    if not is_ascii:
        foreign = [w for w in words if w[0] >= "ɐ"]
        if foreign:
            letters, found = sum(map(len, words)), Counter()
            dense = ""
            for w in foreign:
                c = w[0]
                if c >= "぀":
                    dense += w
                else:
                    found["ru" if "Ѐ" <= c <= "ӿ" else "ar" if "؀" <= c <= "ۿ" else "hi" if "ऀ" <= c <= "ॿ" else "th" if "฀" <= c <= "๿" else "other"] += len(w)
            if sum(found.values()) + len(dense) >= 0.5 * letters:
                if dense:
                    found["ja" if len(_KANA.findall(dense)) > 0.08 * letters else "zh"] = len(dense)
                return found.most_common(1)[0][0]
    hits = dict.fromkeys(_LATIN, 0)
    for langs, n in Counter(filter(None, map(_SHORT.get, words))).items():
        for k in langs:
            hits[k] += n
    best = max(hits, key=hits.get)
    return best if hits[best] else "other"


def language(text: str) -> str:
    """The language of a text."""
    return words_language(_WORD.findall(text.lower()), text.isascii())


def block_language(own: str, of_text: str) -> str:
    """A block's own language if it shows one, else that of its text: quotations in another language are judged by theirs."""
    return of_text if own == "other" or (own == "zh" and of_text == "ja") else own


def words_units(words: list[str], lang: str) -> list[str]:
    """Words, or the characters of words in scripts without spaces."""
    return [c for w in words for c in ([w] if w.isascii() else w)] if lang in _DENSE else words


def without_links(text: str) -> str:
    return _URL.sub(" ", text) if "](" in text or "http" in text or "www." in text else text


def blocks(text: str) -> list[str]:
    """Lines; runs of short lines within a paragraph as one block."""
    out: list[str] = []
    loose = False
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            loose = False
            continue
        short = len(s) < 80 and _MARK.search(s[-2:]) is None
        if out and loose and short:
            out[-1] += "\n" + s
        else:
            out.append(s)
        loose = short and not s.startswith("#" * 2)
    return out


#: c ln c for the counts that occur most, so that an entropy is a sum of looked-up values.
_C_LOG_C = [0.0] + [c * math.log(c) for c in range(1, 4096)]


def features(block: str, plain: str, units: list[str], function: frozenset[str]) -> tuple[float, ...]:
    """The features of one block, in the order of FEATURES; ``plain`` and ``units`` are of the block without its links."""
    n = len(units)
    links = (len(block) - len(plain)) / max(1, len(block))
    if not n:
        return 0.0, 1.0, 0.0, links, 1.0, 0.0
    rest = [x for x in units if x not in function]
    total = len(rest)
    entropy, repeat = 1.0, 0.0
    if total > 3 and total >= 0.2 * n:  # a few words left tell nothing
        counts = Counter(rest).values()
        most = max(counts)
        # of the content words: how evenly they spread, against the most that their number allows
        entropy = 1 - sum(map(_C_LOG_C.__getitem__, counts) if most < 4096 else [c * math.log(c) for c in counts]) / total / math.log(total)
        repeat = (most - 1) / total
    return 1 - total / n, repeat, entropy, links, min(1.5, len(_SEPARATOR.findall(plain)) / n), min(0.5, len(_MARK.findall(plain)) / n)


def _plain(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def function_words(docs: DataFrame, count: int = FUNCTION_WORDS) -> dict[str, frozenset[str]]:
    """Per language the ``count`` units found in the most documents; counted over all documents, a few hundred rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for t in batch.column(1).to_pylist():
                words = _WORD.findall(without_links(t).lower())
                lang = words_language(words, t.isascii())
                seen.update([(lang, u) for u in set(words_units(words, lang))])
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "u", "n"])

    counts = docs.mapInArrow(run, "lang string, u string, n bigint").groupBy("lang", "u").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "u"))).filter(F.col("r") <= count)
    out: dict[str, set[str]] = {}
    for r in top.collect():
        out.setdefault(r["lang"], set()).add(r["u"])
    out["other"] = set()
    # quotations within a block of another script keep their own function words
    latin = out.get("en", set())
    return {k: frozenset(v if k in _LATIN or k == "other" else v | latin) for k, v in out.items()}


def block_features(docs: DataFrame, function: dict[str, frozenset[str]]) -> DataFrame:
    """(id, row, lang, chars, <features>) for every block; ``row`` tells repeated ids apart by their text."""
    names = list(FEATURES)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, langs, chars, rows = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                plain = [(b, without_links(b)) for b in blocks(t)]
                words = [_WORD.findall(p.lower()) for _, p in plain]
                whole = words_language([w for x in words for w in x], t.isascii())
                for (b, p), w in zip(plain, words, strict=True):
                    lang = block_language(words_language(w, b.isascii()), whole)
                    owner.append(k)
                    langs.append(lang)
                    chars.append(len(b))
                    rows.append(features(b, p, words_units(w, lang), function.get(lang, frozenset())))
            x = np.array(rows, float).reshape(-1, len(names))
            index = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(2).take(index), pa.array(langs, pa.string()), pa.array(chars, pa.int32()), *(pa.array(x[:, j]) for j in range(len(names)))], ["id", "row", "lang", "chars", *names])

    keyed = docs.select("id", "t", F.xxhash64("t").alias("row"))
    return keyed.mapInArrow(run, f"id {kind}, row bigint, lang string, chars int, " + ", ".join(f"{n} double" for n in names))


def robust_fit(blocks_: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: medians, scales and the inverse of the robust correlation, over all blocks of 20 characters or more.

    Medians are approximate, off by a two-thousandth of the rows of a language at most. A shorter block has too few
    words to measure; it is scored like any other.
    """
    names = list(FEATURES)
    big = blocks_.filter(F.col("chars") >= 20)
    mid = big.groupBy("lang").agg(*[F.percentile_approx(n, 0.5, 2_000).alias(n) for n in names])
    centred = big.join(F.broadcast(mid.select("lang", *[F.col(n).alias(f"m_{n}") for n in names])), "lang")  # one row a language
    mad = centred.groupBy("lang").agg(*[F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{n}")), 0.5, 2_000).alias(n) for n in names])
    medians = {r["lang"]: np.array([r[n] for n in names]) for r in mid.collect()}
    scales = {r["lang"]: np.maximum(1.4826 * np.array([r[n] for n in names]), [s for _, s in FEATURES.values()]) for r in mad.collect()}

    def clipped(n: str):
        j = names.index(n)
        m = F.create_map(*[F.lit(v) for k, x in medians.items() for v in (k, float(x[j]))])
        s = F.create_map(*[F.lit(v) for k, x in scales.items() for v in (k, float(x[j]))])
        return F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(n) - F.try_element_at(m, F.col("lang"))) / F.try_element_at(s, F.col("lang"))))

    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    z = big.select("lang", *[clipped(n).alias(n) for n in names]) if medians else big
    moments = z.groupBy("lang").agg(*[F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]) if medians else None
    out = {}
    for r in moments.collect() if moments is not None else []:
        c = np.zeros((len(names), len(names)))
        for a, b in pairs:
            c[names.index(a), names.index(b)] = c[names.index(b), names.index(a)] = r[f"{a}_{b}"]
        d = np.sqrt(np.maximum(np.diag(c), 0.05))
        corr = c / d[:, None] / d[None, :]
        np.fill_diagonal(corr, 1.0)
        # part of the identity, so that features bound to one another do not blow the distance up
        out[r["lang"]] = (medians[r["lang"]], scales[r["lang"]] * np.maximum(1.0, d), np.linalg.inv(0.6 * corr + 0.4 * np.eye(len(names))))
    if moments is not None:
        # a text without a word that shows its language is held against the language with the most blocks
        main = big.filter(F.col("lang") != "other").groupBy("lang").count().orderBy(F.col("count").desc(), "lang").first()
        if main:
            out["other"] = out[main["lang"]]
    return out


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", outlier: float = OUTLIER) -> DataFrame:
    """(<id_col>, lang, chars, spam_chars, spam_share, distance, is_spam) for every document with any text.

    distance is the mean squared distance of its blocks, by size. Null and blank texts give no row, an
    empty table none; repeated rows are judged once per (id, text). A language's statistics are those of
    all its blocks, whatever their number.
    """
    docs = _plain(documents, id_col, text_col)
    found = cut_lineage(block_features(docs, function_words(docs)))
    model = robust_fit(found)
    names = list(FEATURES)
    side = np.array([s for s, _ in FEATURES.values()], float)
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            d2, toward = np.zeros(len(x)), np.zeros(len(x))
            for lang in set(langs.tolist()):
                at = langs == lang
                if lang in model:
                    mid, scale, inv = model[lang]
                    z = np.clip((x[at] - mid) / scale, -12, 12)
                    d2[at] = np.einsum("ij,jk,ik->i", z, inv, z)
                    toward[at] = (z * side).sum(1)
            spam = (d2 > outlier) & (toward > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row", "lang", "chars")), pa.array(d2), pa.array(spam)], ["id", "row", "lang", "chars", "d2", "spam"])

    scored = found.mapInArrow(run, f"id {kind}, row bigint, lang string, chars int, d2 double, spam boolean")
    out = scored.groupBy("id", "row").agg(
        F.max_by("lang", "chars").alias("lang"), F.sum("chars").alias("chars"), F.coalesce(F.sum(F.when(F.col("spam"), F.col("chars"))), F.lit(0)).alias("spam_chars"), (F.sum(F.col("d2") * F.col("chars")) / F.sum("chars")).alias("distance")
    )
    share = F.col("spam_chars") / F.col("chars")
    return out.select(F.col("id").alias(id_col), "lang", "chars", "spam_chars", share.alias("spam_share"), "distance", (share > SHARE).alias("is_spam"))
