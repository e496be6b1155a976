"""Problem 1: noise in the text of scanned pages.

Headers are found by masking digits and roman numerals: a line at the edge of a page whose masked skeleton
recurs on other pages of the document, or (with a number in it) in other documents, or repeats the title,
is furniture. Words are grouped by the skeleton that confusable glyphs share; within a group the frequent
forms are genuine. A rare one is a misreading, a less rare one is so where its left neighbour stands before
the frequent form instead; the form that replaces it is the one its left neighbour supports most. Cut words
are joined where the join is a better attested form than the hyphenated word. What remains is reflowed into
paragraphs with SQL windows over (document, page, line).

A page is one row, its lines an array, until single words are counted. What a page must know of its
document (masks, title, the next page's first word) comes to it in joins by runs of pages, so that a long
document spreads; each of them moves the texts once, and no line or word is ever shuffled with its text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.operators.common import broadcast_if_small, cut_lineage, stored

#: Glyphs that scanning confuses, and the one that stands for both in a skeleton; then sequences likewise, in
#: the letters that the first step leaves, in this order. Fixed values.
CONFUSED_FROM = "ceyvbh" + "@0íìîï†159!6(|$83áàóòú"
CONFUSED_TO = "eevvhh" + "aoiiiitlsgihelsheaaoou"
CONFUSED = (("ri", "n"), ("rn", "m"), ("el", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"))
EDGE = 3
#: Pages of a document that stay together, and the columns that tell such runs.
RUN = 200
RUN_KEYS = ["field", "doc_id", "run"]
SHARED_DOCS = 4
SHARED_ENDS = 8
RARE = 0.08
DOUBTFUL = 0.3
FREQUENT = 4
HYPHENS = "[-­¬‐‑]"
_ROMAN = r"(?<![\p{L}\p{N}])(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})(?![\p{L}\p{N}])"
_TEMPLATE = r"[{}<>%]|__|\*\||\|\*|@@|\[\[|\[INSERT|TBD"
_NUMBER = r"(?<![\p{L}\p{N}])(?=[lIioO|!SB\d]*\d)[lIioO|!SB\d]+(?![\p{L}\p{N}])"


def skeleton(word: Column) -> Column:
    """The form in which confusable glyphs are alike; genuine words and their misreadings meet here."""
    s = F.replace(F.replace(F.lower(word), F.lit("â‚¬"), F.lit("e")), F.lit("vv"), F.lit("w"))
    s = F.translate(s, CONFUSED_FROM, CONFUSED_TO)
    for a, b in CONFUSED:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def page_rows(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """(field, doc_id, page, rows): a row per page, its lines that are not blank with what their place tells.

    Repeated rows once, failed readings not. A document's pages are numbered in runs of RUN.
    """
    raw = docs.filter(F.col("raw_pages").isNotNull()).select(F.col("id").alias("doc_id"), F.posexplode("raw_pages").alias("page", "text")).withColumn("page", F.col("page") + 1)
    again = ocr.filter(~F.coalesce("failed", F.lit(False))).select("doc_id", "page", F.col("markdown").alias("text"))
    both = raw.withColumn("field", F.lit("raw_pages")).unionByName(again.withColumn("field", F.lit("ocr_results"))).filter(F.col("text").isNotNull())
    both = both.withColumn("run", F.floor(F.coalesce("page", F.lit(0)) / RUN).cast("int"))
    pages = both.distinct().select(*RUN_KEYS, "page", F.split("text", "\n", -1).alias("raw"))
    pages = pages.withColumn("ts", F.transform("raw", lambda x: F.regexp_replace(x, r"^[\s*#>_]+|[\s*_]+$", "")))
    blank = lambda i: F.coalesce(F.get("ts", i) == "", F.lit(True))
    rows = F.filter(
        F.transform("raw", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.get("ts", i).alias("t"), blank(i - 1).alias("alone_before"), blank(i + 1).alias("alone_after"))),
        lambda r: r["t"] != "",
    )
    pages = pages.select(*RUN_KEYS, "page", rows.alias("rows"))

    def placed(r: Column, i: Column) -> Column:
        edge = (i < EDGE) | (i >= F.size("rows") - EDGE)
        masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(r["t"], _NUMBER, "#"), _ROMAN, "#"), r"\s+", " ")
        letters = _letters(F.regexp_replace(r["t"], rf"^\[?{_ROMAN}\]?|{_NUMBER}", ""))
        kept = [r[c].alias(c) for c in ("line_no", "line", "t", "alone_before", "alone_after")]
        return F.struct(*kept, edge.alias("edge"), F.when(edge, skeleton(masked)).alias("mask"), F.when(edge, letters).alias("letters"))

    # no filter before the lineage is cut: it would be pushed below the shuffle, with all that it reads
    return cut_lineage(pages.withColumn("rows", F.transform("rows", placed))).filter(F.size("rows") > 0)


def _letters(c: Column) -> Column:
    return F.regexp_replace(skeleton(c), r"[^\p{L}]+", "")


def _tail(mask: Column) -> Column:
    """The last three words of a masked line that ends in a number: what the stamps of one house have in common."""
    return F.nullif(F.regexp_extract(mask, r"(\S+ \S+ #)$", 1), F.lit(""))


def known_masks(pages: DataFrame) -> DataFrame:
    """(doc_id, recurring, shared, tails): of each document, the masks that recur on its own pages, those with a number
    that edges of other documents have as well, and the ends that lines of other documents share. A mask that recurs
    without a bound is one entry."""
    edges = F.transform(F.filter("rows", lambda r: r["edge"]), lambda r: r["mask"])
    e = cut_lineage(pages.select("field", "doc_id", "page", F.explode(edges).alias("mask")))
    recurring = e.groupBy("doc_id", "field", "mask").agg(F.countDistinct("page").alias("n")).filter("n >= 2").select("doc_id", "mask", F.lit("recurring").alias("how"))
    # masks without a letter are known by their form alone
    numbered = e.filter(F.col("mask").contains("#") & F.col("mask").rlike(r"\p{L}")).select("doc_id", "mask").distinct()
    often = broadcast_if_small(numbered.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED_DOCS).select("mask"))
    shared = numbered.join(often, "mask").select("doc_id", "mask", F.lit("shared").alias("how"))
    ends = numbered.select("doc_id", _tail(F.col("mask")).alias("mask")).filter(F.col("mask").rlike(r"\p{L}")).distinct()
    common = broadcast_if_small(ends.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED_ENDS).select("mask"))
    tails = ends.join(common, "mask").select("doc_id", "mask", F.lit("tails").alias("how"))
    of = lambda how: F.collect_set(F.when(F.col("how") == how, F.col("mask"))).alias(how)
    return recurring.unionByName(shared).unionByName(tails).groupBy("doc_id").agg(of("recurring"), of("shared"), of("tails"))


def mark_furniture(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """``pages`` with ``furniture`` in each of their rows."""
    known = titles.groupBy("doc_id").agg(F.max("title").alias("title"))
    runs = pages.select(*RUN_KEYS).distinct().join(known_masks(pages), "doc_id", "left").join(known, "doc_id", "left")
    full = pages.join(runs, RUN_KEYS, "left")
    full = full.withColumn("b", _letters(F.coalesce("title", F.lit("")))).withColumn("has_body", F.size(F.filter("rows", lambda r: ~r["alone_before"])) >= 2)
    b, has_body = F.col("b"), F.col("has_body")
    held = lambda name, x: F.coalesce(F.array_contains(name, x), F.lit(False))

    def sure(r: Column) -> Column:
        t, mask, a = r["t"], r["mask"], r["letters"]
        head = b.substr(F.lit(1), F.length(a))
        like_title = (F.length(b) > 0) & (F.length(a) >= 8) & ((F.levenshtein(a, b) <= F.length(b) * 0.25) | (a == head) | ((F.levenshtein(a, head) <= F.length(a) * 0.12) & t.rlike(r"/\s*\S+$")))
        bare_number = t.rlike(rf"^[^\p{{L}}\p{{N}}]*(?:{_NUMBER}|{_ROMAN})[^\p{{L}}\p{{N}}]*$")
        capitals = (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 4) & (F.upper(t) == t) & (F.lower(t) != t)
        prefixed = t.rlike(r"^\[[^\]\s]{1,10}\]\s|^\S{1,4}\s{3,}\S|\S\s{3,}\S{1,4}$|\S\s/\s\S{1,4}$")
        bold = r["line"].rlike(r"^\s*\*\*.*\*\*\s*$")
        # a line of text may stand at two edges by chance; a header does not read like a sentence's end
        recurs = held("recurring", mask) & ~(_running(t) & ~mask.contains("#")) & has_body
        return bare_number | (~t.rlike(_TEMPLATE) & (held("shared", mask) | recurs | capitals | prefixed | bold | like_title | held("tails", _tail(mask))))

    flags = F.transform("rows", lambda r: F.when(r["edge"], F.coalesce(sure(r), F.lit(False))).otherwise(False))
    full = full.withColumn("flags", flags)

    def settled(r: Column, i: Column) -> Column:
        # a line set off at the top, or between a header and the text, that does not read like a sentence's end
        above = r["alone_before"] | F.coalesce(F.get("flags", i - 1), F.lit(True))
        below = r["alone_after"] | F.coalesce(F.get("flags", i + 1), F.lit(False))
        apart = (i < EDGE) & above & below & has_body & r["t"].rlike(r"^[^\p{Ll}]") & ~_running(r["t"]) & ~r["t"].rlike(_TEMPLATE)
        return F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), (F.get("flags", i) | F.coalesce(apart, F.lit(False))).alias("furniture"))

    return full.select(*RUN_KEYS, "page", F.transform("rows", settled).alias("rows"))


def _running(t: Column) -> Column:
    """Whether a line ends like running text, not like a stamp behind its dot."""
    return t.rlike(r"[.?!;,:]$") & ~t.rlike(r"^\S+\s·")


def body_rows(pages: DataFrame) -> DataFrame:
    """(field, doc_id, page, furniture, lines, words, cuts): of each page the numbers of the furniture lines, the lines of
    running text, the words of each that no cut touches, and what stands around each cut."""
    cut = lambda x: x.rlike(rf"{HYPHENS}\s*$") & x.rlike(rf"\p{{L}}\S*{HYPHENS}\s*$")
    lines = F.transform(F.filter("rows", lambda r: ~r["furniture"]), lambda r: F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), F.regexp_extract(r["line"], r"^\s*(\S+)", 1).alias("tok"), cut(r["line"]).alias("cut")))
    p = pages.withColumn("l", lines)
    first, last = F.get("l", F.lit(0)), F.get("l", F.size("l") - 1)
    p = p.withColumn("first", F.when(F.size("l") > 0, F.struct(first["tok"].alias("tok"), F.col("page"), first["line_no"].alias("line_no")))).withColumn("last_cut", last["cut"])
    # the next and the last page that have any text, in the run or, over its ends, in the document
    within = "OVER (PARTITION BY field, doc_id, run ORDER BY page)"
    p = cut_lineage(p.withColumn("after", F.expr(f"lead(first) IGNORE NULLS {within}")).withColumn("before", F.expr(f"lag(last_cut) IGNORE NULLS {within}")))
    ends = p.groupBy(*RUN_KEYS).agg(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("page"))).alias("run_first"), F.max_by("last_cut", F.when(F.col("last_cut").isNotNull(), F.col("page"))).alias("run_cut"))
    over = "OVER (PARTITION BY field, doc_id ORDER BY run)"
    ends = ends.select(*RUN_KEYS, F.expr(f"lead(run_first) IGNORE NULLS {over}").alias("run_after"), F.expr(f"lag(run_cut) IGNORE NULLS {over}").alias("run_before"))
    p = p.join(ends, RUN_KEYS, "left").withColumn("after", F.coalesce("after", "run_after")).withColumn("before", F.coalesce("before", "run_before"))

    def joined(r: Column, i: Column) -> Column:
        nxt = F.get("l", i + 1)
        inner = i < F.size("l") - 1
        was = F.when(i == 0, F.coalesce("before", F.lit(False))).otherwise(F.get("l", i - 1)["cut"])
        whole = r["line"]
        for touched, ends in ((was, r"^\s*\S+"), (r["cut"], r"\S+\s*$")):
            whole = F.when(touched, F.regexp_replace(whole, ends, "")).otherwise(whole)
        return F.struct(
            r["line_no"].alias("line_no"), r["line"].alias("line"), _cores(whole).alias("cores"), r["cut"].alias("cut"), F.when(r["cut"], F.regexp_extract(r["line"], r"(\S+)\s*$", 1)).alias("last"),
            F.when(inner, nxt["tok"]).otherwise(F.col("after.tok")).alias("next_first"), F.when(inner, F.col("page")).otherwise(F.col("after.page")).alias("next_page"),
            F.when(inner, nxt["line_no"]).otherwise(F.col("after.line_no")).alias("next_line"),
        )

    furniture = F.transform(F.filter("rows", lambda r: r["furniture"]), lambda r: r["line_no"])
    p = p.select("field", "doc_id", "page", furniture.alias("furniture"), F.transform("l", joined).alias("body"))
    of = lambda *names: F.transform("body", lambda r: F.struct(*[r[n].alias(n) for n in names]))
    cut_rows = F.transform(F.filter("body", lambda r: r["cut"]), lambda r: F.struct(*[r[n].alias(n) for n in ("line_no", "last", "next_first", "next_page", "next_line")]))
    return p.select("field", "doc_id", "page", "furniture", of("line_no", "line").alias("lines"), of("line_no", "cores").alias("words"), cut_rows.alias("cuts"))


def _core(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^\p{L}\p{N}@|†$!(]+|[^\p{L}\p{N}@|†$¬]+$", "")


def _cores(line: Column) -> Column:
    """The words of a line as :func:`_core` leaves them, the line read once."""
    bare = F.regexp_replace(line, r"(?<=\s|^)[^\s\p{L}\p{N}@|†$!(]+|[^\s\p{L}\p{N}@|†$¬]+(?=\s|$)", "")
    return F.filter(F.split(F.lower(bare), r"\s+"), lambda w: w != "")


@dataclass
class Reading:
    """What the lines of all pages hold: ``pages`` with furniture and lines; cut words; misread words with the forms that
    replace them; and the lines, next to a cut, that a misread half of the cut word lies in."""

    pages: DataFrame
    cuts: DataFrame
    fixes: DataFrame
    halves: DataFrame


KEYS = ["field", "doc_id", "page", "line_no"]


def _analyse(docs: DataFrame, ocr: DataFrame) -> Reading:
    pages = stored(body_rows(mark_furniture(page_rows(docs, ocr), docs.select(F.col("id").alias("doc_id"), "title"))))
    text = pages.select("field", "doc_id", "page", F.explode("words").alias("r")).select("field", "doc_id", "page", "r.*")
    # each word with the one to its left
    tokens = text.select(*KEYS, F.explode(F.transform("cores", lambda c, i: F.struct(i.alias("pos"), c.alias("core"), F.get("cores", i - 1).alias("prev")))).alias("x")).select(*KEYS, "x.*")
    halves = F.when(F.col("core").contains("-") | F.col("core").contains("‐"), F.split("core", "[-‐]")).otherwise(F.array("core"))
    parts = tokens.select(*KEYS, "pos", "prev", F.explode(halves).alias("w")).filter(F.length("w") >= 2)
    vocab = cut_lineage(parts.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    pairs = tokens.filter(F.col("core").contains("-")).groupBy(F.col("core").alias("pair")).agg(F.count(F.lit(1)).alias("pair_n"))
    forms = vocab.withColumn("skel", skeleton(F.col("w")))
    clean = ~F.col("w").rlike(r"[^\p{L}'’]")
    by_skel = W.partitionBy("skel").orderBy(F.when(clean, F.col("n")).desc_nulls_last(), "w").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    forms = forms.withColumn("best_n", F.first(F.when(clean, F.col("n"))).over(by_skel)).withColumn("best", F.first(F.when(clean, F.col("w"))).over(by_skel))
    forms = cut_lineage(forms.filter(F.col("best_n") >= FREQUENT))
    share = F.col("n") / F.col("best_n")
    # rare beside the most frequent form of its skeleton, or less rare and then a misreading only where the context says so
    suspects = forms.filter((F.col("w") != F.col("best")) & ((share <= DOUBTFUL) | ~clean)).select("w", "skel", ((share <= RARE) | ~clean).alias("sure"))
    found = cut_lineage(parts.join(broadcast_if_small(suspects), "w"))
    choice = forms.filter(clean & (F.col("n") >= FREQUENT) & (share > RARE)).select("skel", F.col("w").alias("form"), F.col("n").alias("form_n"))
    asked = found.select("prev", "skel").distinct().join(choice.select("skel", "form"), "skel").select("prev", F.col("form").alias("w"))
    asked = asked.unionByName(found.filter("NOT sure").select("prev", "w")).filter(F.col("prev").isNotNull()).distinct()
    seen = parts.select("prev", "w").join(broadcast_if_small(asked), ["prev", "w"]).groupBy("prev", F.col("w").alias("form")).agg(F.count(F.lit(1)).alias("seen"))
    options = found.join(choice, "skel").filter(F.col("form") != F.col("w")).join(seen, ["prev", "form"], "left")
    picked = options.groupBy(*KEYS, "pos", "w", "prev", "sure").agg(F.max(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "form_n", "form")).alias("x"))
    own = seen.select("prev", F.col("form").alias("w"), F.col("seen").alias("own"))
    fixes = picked.join(own, ["prev", "w"], "left").filter(F.col("sure") | ((F.col("x.seen") >= 2) & (F.col("x.seen") > 3 * F.coalesce("own", F.lit(0)))))
    fixes = fixes.select(*KEYS, "w", F.col("x.form").alias("form"))
    ends = pages.select("field", "doc_id", "page", F.explode("cuts").alias("r")).select("field", "doc_id", "page", "r.*")
    cuts, halves = _cut_words(ends, vocab, forms, pairs)
    return Reading(pages, cuts, fixes, halves)


def _cut_words(ends: DataFrame, vocab: DataFrame, forms: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that end in a hyphen with ``hyphen``, whether only the line break cut the word; and the lines with a misread half."""
    clean = ~F.col("w").rlike(r"[^\p{L}'’]")
    best = forms.filter(F.col("w") == F.col("best")).select("skel", F.col("best").alias("whole"), F.col("best_n").alias("whole_n"))
    cuts = ends.select(
        *KEYS, "next_page", "next_line", F.regexp_replace(F.lower(_core(F.regexp_replace("last", rf"{HYPHENS}\s*$", ""))), "[\u00ad]", "").alias("left"),
        F.lower(_core(F.coalesce("next_first", F.lit("")))).alias("right"), F.col("last").rlike("[¬\u00ad]\\s*$").alias("sure"),
    )
    cuts = cuts.withColumn("l", F.element_at(F.split("left", "[-‐]"), -1)).withColumn("r", F.element_at(F.split("right", "[-‐]"), 1))
    cuts = cuts.withColumn("skel", skeleton(F.concat("l", "r"))).withColumn("pskel", skeleton(F.concat_ws("-", "l", "r")))
    pair_skel = pairs.withColumn("pskel", skeleton(F.col("pair"))).groupBy("pskel").agg(F.sum("pair_n").alias("pair_n"))
    cuts = cuts.join(best, "skel", "left").join(pair_skel, "pskel", "left")
    joined_n, pair_n = F.coalesce("whole_n", F.lit(0)), F.coalesce("pair_n", F.lit(0))
    hyphen = F.when(joined_n + pair_n > 0, joined_n > pair_n).otherwise(F.col("sure") | ~F.col("right").rlike(r"^\p{Lu}"))
    cuts = cut_lineage(cuts.withColumn("hyphen", hyphen))
    whole = F.col("hyphen") & F.col("whole").isNotNull()
    here, there = [F.col(k) for k in KEYS], [F.col("field"), F.col("doc_id"), F.col("next_page").alias("page"), F.col("next_line").alias("line_no")]
    off = cuts.filter(whole & ~F.expr("startswith(whole, l)")).select(*here).unionByName(cuts.filter(whole & ~F.expr("endswith(whole, r)")).select(*there))
    # where the hyphen belongs to the word, both halves are whole words, held against the frequent forms like any other
    known = best.select(F.col("skel").alias("k"), F.col("whole").alias("known"), F.col("whole_n").alias("known_n"))
    kept = cuts.filter(~F.col("hyphen"))
    sides = kept.select(*here, F.col("left").alias("core")).unionByName(kept.select(*there, F.col("right").alias("core")))
    sides = sides.select(*KEYS, F.explode(F.split("core", "[-‐]")).alias("w")).filter(F.length("w") >= 2)
    wrong = sides.join(known, skeleton(F.col("w")) == F.col("k")).filter(F.col("w") != F.col("known")).join(vocab, "w", "left")
    wrong = wrong.filter((F.coalesce("n", F.lit(0)) <= F.col("known_n") * RARE) | ~clean).select(*KEYS)
    return cuts.select(*KEYS, "hyphen"), off.unionByName(wrong).filter(F.col("line_no").isNotNull())


def paragraphs(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """(field, doc_id, page, para_no, text): pages as continuous paragraphs, furniture and cuts gone, misreadings mended.

    A paragraph that runs over a page break belongs to the page it begins on. Nulls and empties as in
    :func:`noise`.
    """
    got = _analyse(docs, ocr)
    mended = got.fixes.groupBy(*KEYS).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("w", "form")))).alias("fix"))
    lines = got.pages.select("field", "doc_id", "page", F.explode("lines").alias("r")).select("field", "doc_id", "page", "r.*").distinct()
    cuts = got.cuts.filter("hyphen").select(*KEYS, F.lit(True).alias("hyphen")).distinct()
    text = lines.join(mended, KEYS, "left").join(cuts, KEYS, "left").withColumn("hyphen", F.coalesce("hyphen", F.lit(False)))

    def mend(tok: Column) -> Column:
        # part by part, so that a compound keeps its other half; the case of the first letter stays
        part = F.regexp_extract(tok, r"[\p{L}\p{N}@|†$!(â‚¬'’]+", 0)
        form = F.try_element_at("fix", F.lower(part))
        return F.when(form.isNull() | (part == ""), tok).otherwise(F.replace(tok, part, F.when(part.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(form, 1, 1)), form.substr(F.lit(2), F.length(form)))).otherwise(form)))

    words = F.transform(F.split(F.trim("line"), r"\s+"), lambda t: F.when(F.col("fix").isNull(), t).otherwise(mend(t)))
    text = text.withColumn("words", F.array_join(words, " "))
    w = W.partitionBy("field", "doc_id").orderBy("page", "line_no")
    ended = F.lag(F.trim("line").rlike(r"[.?!…。！？”\")]$")).over(w)
    gap = (F.lag("page").over(w) != F.col("page")) | (F.lag("line_no").over(w) < F.col("line_no") - 1)
    cut = F.coalesce(F.lag("hyphen").over(w), F.lit(False))
    new = F.coalesce(gap & ended & ~cut, F.lit(True))
    text = text.withColumn("para", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    piece = F.when(F.col("hyphen"), F.regexp_replace("words", rf"{HYPHENS}\s*$", "")).when(F.col("words").rlike(r"\p{L}-$"), F.col("words")).otherwise(F.concat("words", F.lit(" ")))
    out = text.withColumn("piece", piece).groupBy("field", "doc_id", "para").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("page", "line_no", "piece"))).alias("pieces"))
    joined = F.trim(F.array_join(F.transform("pieces", lambda x: x["piece"]), ""))
    return out.select("field", "doc_id", "page", F.row_number().over(W.partitionBy("field", "doc_id", "page").orderBy("para")).alias("para_no"), joined.alias("text"))


def noise(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """(field, doc_id, page, line_no, kind): furniture, hyphen and misread lines; a line may be both of the last two.

    Null pages and failed readings have no lines, an empty page has none; a document without a title relies
    on masks alone; repeated rows count once; lines of any length are read whole. Two different readings of
    one page are judged each.
    """
    got = _analyse(docs, ocr)
    furniture = got.pages.select("field", "doc_id", "page", F.explode("furniture").alias("line_no"), F.lit("furniture").alias("kind"))
    hyphens = got.cuts.filter("hyphen").select(*KEYS, F.lit("hyphen").alias("kind"))
    misread = got.fixes.select(*KEYS).unionByName(got.halves).select(*KEYS, F.lit("misread").alias("kind"))
    return furniture.unionByName(hyphens).unionByName(misread).distinct()
