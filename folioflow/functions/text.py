"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders of language, dialect and gender in voice lists, fixed values.
LANGUAGES = ("English", "German", "French", "Spanish", "Japanese")
DIALECTS = ("American", "British", "Australian", "Indian")
GENDERS = ("female", "male")
_CLOSE = "[\"')\\]]*"


def half_up(x: Column) -> Column:
    """Rounded to the nearest whole number, halves upward."""
    return F.floor(x + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent of ``part`` in ``whole``; 0 of nothing."""
    return F.when(whole > 0, half_up(part.cast("double") / whole * 100)).otherwise(F.lit(0)).cast("bigint")


def clock(seconds: Column) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on; never below zero."""
    s = half_up(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def split_sentences(text: Column) -> Column:
    """Sentences at a final mark, closing quotes kept with it, before a capital, digit or quote; else at any final mark and space."""
    mark = "\u0001"

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(F.regexp_replace(text, pattern, f"$1{mark}"), mark, -1), lambda x: F.trim(x)), lambda x: x != "")

    strict = parts(rf"([.!?]{_CLOSE})\s+(?=[A-Z0-9\"']|[(\[][A-Z0-9\"'])")
    return F.when(F.size(strict) > 1, strict).otherwise(parts(r"([.!?])\s+"))


def dehyphenate(md: Column) -> Column:
    """Words cut by a soft hyphen, or by a hyphen and a gap, joined again; not within fences."""
    sep = "```"
    joined = lambda x: F.regexp_replace(F.regexp_replace(x, "­\\s*", ""), r"(\p{L})-\s+(\p{Ll})", "$1$2")
    return F.array_join(F.transform(F.split(md, sep, -1), lambda x, i: F.when(i % 2 == 0, joined(x)).otherwise(x)), sep)


def is_chapter(title: Column) -> Column:
    """Four ASCII letters or more, all of them capitals."""
    letters = F.regexp_replace(title, "[^A-Za-z]", "")
    return (F.length(letters) >= 4) & (letters == F.upper(letters))


def display_title(title: Column) -> Column:
    """Titles all in capitals in title case; trailing stops dropped.

    A word is a run of ASCII letters and digits, raised if it begins with a letter; all else keeps its form.
    """
    clean = F.regexp_replace(F.regexp_replace(title, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z", ""), r"\.+\z", "")
    words = F.split(F.lower(clean), r"(?<=[a-z0-9])(?=[^a-z0-9])|(?<=[^a-z0-9])(?=[a-z0-9])", -1)
    cased = F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), "")
    return F.when(is_chapter(clean), cased).otherwise(clean)


def host(url: Column) -> Column:
    """Lower-case host of a URL, with or without its scheme; empty if there is none."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.coalesce(F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def url_kind(url: Column) -> Column:
    """pdf, epub or article, by the path's suffix."""
    path = F.trim(F.split_part(F.split_part(F.lower(url), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)))
    return F.when(F.endswith(path, F.lit(".pdf")), "pdf").when(F.endswith(path, F.lit(".epub")), "epub").otherwise("article")


def source_label(source: Column) -> Column:
    """Short label of where an item came from."""
    kind = source["kind"]
    return F.when(kind.like("%url"), F.coalesce(F.nullif(source["domain"], F.lit("")), F.lit("Web"))).when(kind.like("pdf%"), "PDF").when(kind.like("epub%"), "ePub").when(kind.like("markdown%"), "Markdown").otherwise("Document")


def speakable(text: Column) -> Column:
    """Text made easy to read aloud: plain quotes, dashes as commas, addresses as their host."""
    t = F.translate(text, "“”‘’", "\"\"''")
    t = F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), "[—–|]", ", ")
    t = F.regexp_replace(t, r"(?i)\bhttps?://(?:www\.)?([^\s)>\]\"/:?#]+)[^\s)>\]\"]*", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)\bwww\.([^\s)>\]\"/:?#]+)[^\s)>\]\"]*", "$1"), r"\s+", " "))


def pack_pieces(text: Column, limit: int = 220) -> Column:
    """An over-long text in pieces of at most ``limit``: packed greedily by clauses, else by words; a longer word stays whole."""

    def pack(parts: Column, sep: str) -> Column:
        empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

        def step(acc: Column, x: Column) -> Column:
            nxt = F.when(acc["cur"] == "", x).otherwise(F.concat(acc["cur"], F.lit(sep), x))
            full = (F.length(nxt) > limit) & (acc["cur"] != "")
            return F.struct(F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(full, x).otherwise(nxt).alias("cur"))

        return F.aggregate(parts, empty, step, lambda acc: F.filter(F.array_append(acc["done"], acc["cur"]), lambda x: x != ""))

    t = F.trim(text)
    clauses = F.filter(F.transform(F.split(t, r"\s*;\s*|\s+[—–,:]\s+|\s*[()]\s*", -1), lambda x: F.trim(x)), lambda x: x != "")
    by_words = lambda x: pack(F.split(x, r"\s+", -1), " ")
    by_clauses = F.flatten(F.transform(pack(clauses, ", "), lambda x: F.when(F.length(x) > limit, by_words(x)).otherwise(F.array(x))))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= limit, F.array(t)).when(F.size(clauses) > 1, by_clauses).otherwise(by_words(t))


def text_hash(text: Column) -> Column:
    """A 32-bit hash of a text's UTF-16 units in base 36: h = 33 h + unit, from 5381."""
    put = lambda h, unit: F.pmod(h * 33 + unit, F.lit(4294967296))
    pair = lambda h, code: put(put(h, F.lit(0xD7C0) + F.shiftright(code, 10)), F.lit(0xDC00) + F.pmod(code, F.lit(1024)))
    step = lambda h, c: F.when(c == "", h).when(F.ascii(c) < 65536, put(h, F.ascii(c))).otherwise(pair(h, F.ascii(c)))
    h = F.aggregate(F.split(text, ""), F.lit(5381).cast("bigint"), step)
    return F.lower(F.conv(h.cast("string"), 10, 36))


def voice_key(name: Column) -> Column:
    """Lower case, all else than letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(title: Column) -> Column:
    """ASCII slug of a title; untitled if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*[F.lit(x.lower()) for x in order]), F.lower(F.coalesce(value, F.lit(""))))
    return F.when(at == 0, F.lit(len(order)).cast("bigint")).otherwise(at - 1)


def language_rank(x: Column) -> Column:
    return _rank(x, LANGUAGES)


def dialect_rank(x: Column) -> Column:
    return _rank(x, DIALECTS)


def gender_rank(x: Column) -> Column:
    return _rank(x, GENDERS)


def group_label(language: Column, dialect: Column, gender: Column) -> Column:
    """Language · Dialect · Gender, of what is there; Voices if nothing is."""
    g = F.when(gender.isNotNull(), F.concat(F.upper(F.substring(gender, 1, 1)), F.lower(gender.substr(F.lit(2), F.length(gender)))))
    return F.coalesce(F.nullif(F.concat_ws(" · ", F.nullif(language, F.lit("")), F.nullif(dialect, F.lit("")), F.nullif(g, F.lit(""))), F.lit("")), F.lit("Voices"))


def natural_key(name: Column) -> Column:
    """A sort key in which numbers count by value: every run of digits padded to ten."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "0000000000$1")
    return F.regexp_replace(padded, r"0*(\d{10})(?!\d)", "$1")


def blank_page(md: Column) -> Column:
    """Empty where a reading says that the page holds no text."""
    return F.when(F.lower(F.trim(md)) == "<no text found>", "").otherwise(md)


#: What of Markdown is not read aloud, in this order, and what stands for it. Fixed values.
SPOKEN = (
    (r"(?s)```.*?```", ""),
    (r"`([^`]+)`", "$1"), (r"(?m)^[ \t]*>[ \t]?", ""), (r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$", ""), (r"(?m)^[ \t]*\[[^\]\n]+\]:[ \t]*\S.*$", ""),
    (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\](?:\[[^\]]*\]|\([^)]+\))", "$1"), (r"</?[A-Za-z][A-Za-z0-9-]*(?=[\s/>])[^>]*>", ""),
    (r"(\*\*|__|~~)(\S(?:[^\n]*?\S)?)\1", "$2"), (r"(?<![\w*])\*(\S(?:[^*\n]*\S)?)\*(?![\w*])", "$1"), (r"(?<!\w)_(\S(?:[^_\n]*\S)?)_(?!\w)", "$1"),
    (r"(?m)^[ \t]*[-*+•][ \t]+(?:\[[ xX]\][ \t]+)?", ""), (r"\A\s*\d{1,3}[.)]\s+|(?m)^[ \t]+\d{1,3}[.)]\s+", ""), (r"(?m)^#{1,6}[ \t]+", ""), (r"\s+", " "),
)


def strip_markdown(text: Column) -> Column:
    """Markdown to spoken text: code, images, markers and emphasis gone, links by their label, spaces collapsed."""
    for pattern, put in SPOKEN:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def tidy_article(md: Column, title: Column) -> Column:
    """Empty headings dropped, blank runs collapsed, the title leading once."""
    lines = F.filter(F.split(md, "\n", -1), lambda x: ~x.rlike(r"^#{1,6}\s*$"))
    body = F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))
    head = F.concat(F.lit("# "), F.trim(title))
    same = F.startswith(body, head)
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", body).when(same, body).otherwise(F.concat(head, F.lit("\n\n"), body))


def redact(message: Column, secret: Column, limit: int = 1000) -> Column:
    """A message without its secret, at most ``limit`` characters."""
    return F.substring(F.when(F.length(secret) > 0, F.replace(message, secret, F.lit("***"))).otherwise(message), 1, limit)


def relative_time(then_ms: Column, now_ms: Column) -> Column:
    """just now, minutes, hours or days ago; the date beyond a week."""
    m = F.floor((now_ms - then_ms) / 60_000)
    ago = lambda n, u: F.concat(n.cast("string"), F.lit(u))
    return F.when(m < 1, "just now").when(m < 60, ago(m, "m ago")).when(m < 1440, ago(F.floor(m / 60), "h ago")).when(m < 10080, ago(F.floor(m / 1440), "d ago")).otherwise(F.date_format(F.timestamp_millis(then_ms), "yyyy-MM-dd"))
