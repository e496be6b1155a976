"""Markdown structure: tables as records, blocks, sections, and repair of extracted pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import SPOKEN


def clean_cell(c: Column) -> Column:
    """A table cell without inline Markdown."""
    for pattern, put in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"\*\*|__|~~", ""), (r"(?<!\w)[*_](\S[^*_]*)[*_](?!\w)", "$1"), (r"<[^>]+>", " "), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, put)
    return F.trim(c)


def table_records(md: Column) -> Column:
    """Rows of a pipe table as spoken records: Row i of n: Header: value, ...; none without a row under the header."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"(?<!\\)\|", -1), clean_cell)
    lines = F.filter(F.split(md, "\n", -1), lambda x: F.startswith(F.trim(x), F.lit("|")) & ~x.rlike(r"^[\s|:-]+$"))
    head, rows = cells(F.try_element_at(lines, F.lit(1))), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    pair = lambda h, v: F.when((v == "") | v.isNull(), F.lit(None)).when((h == "") | h.isNull(), v).otherwise(F.concat(h, F.lit(": "), v))
    text = lambda r: F.array_join(F.zip_with(head, cells(r), pair), ", ")
    n = F.size(rows).cast("string")
    out = F.transform(rows, lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(" of "), n, F.lit(": "), text(r), F.lit(".")))
    return F.when(F.size(lines) > 1, out).otherwise(F.array().cast("array<string>"))


# Row-local structure: plain functions, applied to whole documents in Arrow batches.

# What marks structure, and what is not read aloud; fixed values.
_FENCE = re.compile(r"^\s*```")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_RULE = re.compile(r"^\s*(?:[-*_]\s*){3,}$")
_ITEM = re.compile(r"^(\s*)(?:([-*+•])|(\d{1,3})[.)])(?:\s+|\s*$)")
_BARE_MAX = 60
_TERMINAL = re.compile(r"[.!?…][\"')\]]*$")
_SENTENCE = re.compile(r"([.!?][\"')\]]*)\s+(?=[A-Z0-9\"']|[(\[][A-Z0-9\"'])")
#: The same list as on the JVM side, whose line breaks Python's patterns know too.
_STRIP = tuple((re.compile(re.sub(r"^(.+)\(\?m\)", r"(?m)\1", p)), put.replace("$", "\\")) for p, put in SPOKEN)


def spoken(text: str) -> str:
    """A block's Markdown as the text that is read."""
    for pattern, put in _STRIP:
        text = pattern.sub(put, text)
    return text.strip()


def spoken_sentences(text: str) -> list[str]:
    """Sentences of a block; where the strict rule finds one only, any final mark before a space divides."""
    plain = spoken(text)
    if not plain:
        return []
    strict = [p.strip() for p in _SENTENCE.sub("\\1\x01", plain).split("\x01") if p.strip()]
    return strict if len(strict) > 1 else [p for p in re.split(r"(?<=[.!?])\s+", plain) if p]


def _bare(line: str) -> bool:
    """A short line without an end: an item of an unmarked list rather than wrapped prose."""
    t = line.strip()
    last = t.split()[-1].strip("([\"')];:,.!?") if t else ""
    return bool(t) and len(t) <= _BARE_MAX and t[-1] not in ",;:—–-" and not _TERMINAL.search(t) and not re.match(r"^\s*(?:#{1,6}\s|[-*+•]\s|\d{1,3}[.)]\s|>|\|)", line) and not re.fullmatch(r"[A-Za-z]{1,4}", last)


def starts_item(before: str, line: str) -> bool:
    """Whether a line break divides two unmarked items."""
    if not _bare(before):
        return False
    lead = line.lstrip()[:1]
    return (lead.isascii() and lead.isupper()) or (lead.isdigit() and not before.split()[-1].lstrip("([\"'")[:1].isupper())


def _line_kind(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if _HEADING.match(s):
        return "heading"
    if _RULE.match(line):
        return "hr"
    if s[0] == "|":
        return "table"
    return "list-item" if _ITEM.match(line) else "blockquote" if s[0] == ">" else "paragraph"


def blocks(lines: list[str]) -> list[dict]:
    """Blocks of a section's lines: kind, raw, level, ordered. An unfinished fence is dropped with its lines."""
    out: list[dict] = []
    fence: list[str] | None = None
    item: dict | None = None  # the list item that indented lines go on with
    indent = 0
    last = "blank"
    n = len(lines)
    for i, line in enumerate(lines):
        if _FENCE.match(line):
            fence = [line] if fence is None else [*fence, line]
            if len(fence) > 1 and fence[-1] is line:
                out.append({"kind": "code", "lines": fence})
                fence = None
            item, last = None, "blank"
            continue
        if fence is not None:
            fence.append(line)
            continue
        if re.match(r"\t| {4}", line) and line.strip() and (i == 0 or not lines[i - 1].strip()) and (i == n - 1 or not lines[i + 1].strip()):
            line = line.lstrip()  # one indented line alone is a centred title
        kind = _line_kind(line)
        if kind == "list-item":
            m = _ITEM.match(line)
            if last == "paragraph" and m.group(3) and int(m.group(3)) != 1:
                kind = "paragraph"  # only a first number breaks into prose
                out[-1]["lines"].append(line)
                continue
            at = len(m.group(1).expandtabs(4))
            text = line.replace("•", "-", 1) if m.group(2) == "•" else line
            if item is None or at <= indent:
                item, indent = {"kind": kind, "lines": [text], "ordered": m.group(3) is not None}, at
                out.append(item)
            else:
                item["lines"].append(text)
            last = kind
        elif item is not None and kind in ("paragraph", "blockquote") and line[:1].isspace():
            item["lines"].append(line)
        elif kind == "blank":
            item, last = None, kind
        elif kind in ("heading", "hr"):
            out.append({"kind": kind, "lines": [line.strip()]} | ({"level": len(_HEADING.match(line.strip()).group(1))} if kind == "heading" else {}))
            item, last = None, "blank"
        else:
            item = None
            if kind == last and not (kind == "paragraph" and starts_item(out[-1]["lines"][-1], line)):
                out[-1]["lines"].append(line)
            else:
                out.append({"kind": kind, "lines": [line]})
            last = kind
    return out


def sections(md: str) -> list[dict]:
    """Sections of a document: id, titles, level, heading, paragraphs (lists of sentences), blocks.

    A title replaces those at its level and below among the titles that are left above it; a section
    without a sentence is dropped.
    """
    parts: list[tuple[int, str | None, list[str], list[str]]] = []
    stack: list[str] = []
    lines: list[str] = []
    level, heading, code = 0, None, False
    for line in md.split("\n"):
        if _FENCE.match(line):
            code = not code
        m = None if code else _HEADING.match(line.strip())
        if m is None:
            lines.append(line)
            continue
        parts.append((level, heading, list(stack), lines))
        level, heading, lines = len(m.group(1)), m.group(2).strip(), []
        stack = [*stack[: level - 1], heading]
    parts.append((level, heading, list(stack), lines))
    out: list[dict] = []
    for level, heading, titles, lines in parts:
        paragraphs: list[list[str]] = []
        metas: list[dict] = []
        if heading is not None:
            metas.append({"kind": "heading", "raw": f"{'#' * level} {heading}", "para_idx": 0, "level": level, "ordered": None})
            paragraphs.append(spoken_sentences(heading) or [heading])
        for b in blocks(lines):
            raw = "\n".join(b["lines"])
            said = [] if b["kind"] in ("code", "hr") else spoken_sentences(raw)
            metas.append({"kind": b["kind"], "raw": raw, "para_idx": len(paragraphs) if said else None, "level": b.get("level"), "ordered": b.get("ordered")})
            if said:
                paragraphs.append(said)
        if paragraphs:
            out.append({"id": len(out), "titles": titles or ["Document"], "level": level or 1, "heading": heading, "paragraphs": paragraphs, "blocks": metas})
    return out


SECTIONS = "array<struct<id:int,titles:array<string>,level:int,heading:string,paragraphs:array<array<string>>,blocks:array<struct<kind:string,raw:string,para_idx:int,level:int,ordered:boolean>>>>"


def _column(f, kind: str):
    """``f`` over a column of strings, a batch at a time; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return run


def parse_sections(md: Column) -> Column:
    """Sections of a Markdown column."""
    return _column(sections, SECTIONS)(md)


def join_continuations(md: str) -> str:
    """Paragraphs that a column or page break cut, joined; tables split by blank lines repaired."""
    paras: list[str] = []
    code = False
    for chunk in re.split(r"(\n\s*\n)", md):
        if not chunk.strip():
            continue
        odd = len(re.findall(r"^\s*```", chunk, re.M)) % 2
        if code:
            paras[-1] += "\n\n" + chunk
        else:
            # headings and quotes stand alone, the rest of a chunk stays together
            for piece in re.split(r"\n(?=\s*(?:#{1,6}\s|>))|(?<=\n)(?=\|)", chunk.strip("\n")) if not odd else [chunk.strip("\n")]:
                paras.append(piece)
        code ^= bool(odd)
    out: list[str] = []
    is_table = lambda p: all(x.lstrip().startswith("|") for x in p.split("\n") if x.strip())
    fixed = lambda p: _HEADING.match(p.strip().split("\n")[0]) or p.lstrip().startswith((">", "```")) or is_table(p) or "```" in p
    for p in paras:
        before = out[-1] if out else ""
        if out and is_table(p) and is_table(before):
            out[-1] += "\n" + p
            continue
        lead = p.lstrip()[:1]
        open_end = bool(before) and not fixed(before) and (before.rstrip().endswith("-") or not _TERMINAL.search(before.strip()))
        goes_on = not fixed(p) and (before.rstrip().endswith("-") or (lead.isascii() and lead.islower()) or ((lead.isdigit() or lead == "(") and not _bare(before.split("\n")[-1])))
        if open_end and goes_on:
            out[-1] = before.rstrip()[:-1] + p.lstrip() if before.rstrip().endswith("-") else before.rstrip() + " " + p.lstrip()
        else:
            out.append(p.strip("\n"))
    return "\n\n".join(out)


def reflow(md: Column) -> Column:
    """See :func:`join_continuations`."""
    return _column(join_continuations, "string")(md)


def calm_capitals(md: str) -> str:
    """Runs of two or more words in capitals, and single ones of five letters or more, in title case; not within fences."""
    code = False
    out = []
    for line in md.split("\n"):
        if _FENCE.match(line):
            code = not code
        elif not code:
            line = re.sub(r"\b[A-Z]{2,}(?:\W+[A-Z]{2,})+\b|\b[A-Z]{5,}\b", lambda m: re.sub(r"[A-Z]+", lambda w: w.group()[0] + w.group()[1:].lower(), m.group()), line)
        out.append(line)
    return "\n".join(out)


def normalise_capitals(md: Column) -> Column:
    """See :func:`calm_capitals`."""
    return _column(calm_capitals, "string")(md)


def drop_image_notes(md: str) -> str:
    """Image comments, a line "Other" right after one, and other comments gone; page breaks kept."""
    out: list[str] = []
    after_image = False
    for line in md.split("\n"):
        if re.search(r"<!--\s*page\s*break\s*-->", line, re.I):
            out.append(line)
            after_image = False
        elif re.fullmatch(r"\s*<!--\s*image\s*-->\s*", line, re.I):
            after_image = True
        elif after_image and line.strip() == "Other":
            after_image = False
        else:
            bare = re.sub(r"<!--.*?-->", "", line)
            if bare.strip() or bare == line:
                out.append(line if bare == line else bare.strip())
            after_image &= not line.strip()
    return "\n".join(out)


def strip_image_notes(md: Column) -> Column:
    """See :func:`drop_image_notes`."""
    return _column(drop_image_notes, "string")(md)


def mark_pages(pages: list[str], first: int = 1) -> tuple[str, list[dict]]:
    """Pages joined with "Page N." lines, the unfinished first sentence of each page carried back; and where each page lies."""
    out, where = "", []
    texts = [p.strip() for p in pages]
    for k, text in enumerate(texts):
        if out and text and not _TERMINAL.search(out.rstrip()) and text[:1].islower():
            end = re.search(r"[.!?][\"')\]]*(?=\s|$)", text)
            cut = end.end() if end else len(text)
            head, text = text[:cut], text[cut:].lstrip()
            body = out.rstrip()
            out = body[:-1] + head if body.endswith("-") else f"{body} {head}"
        at = len(out) + (2 if out else 0)
        out = f"{out}\n\nPage {first + k}." if out else f"Page {first + k}."
        if text:
            out += "\n\n" + text
        where.append({"page": first + k, "char_start": at, "char_end": len(out), "start_line": out[:at].count("\n") + 1})
    return out, where


def join_pages(pages: Column) -> Column:
    """Arrays of pages as one text with page markers and the page map; see :func:`mark_pages`."""

    @F.pandas_udf("struct<markdown:string,pages:array<struct<page:int,char_start:int,char_end:int,start_line:int>>>")
    def run(batch: pd.Series) -> pd.DataFrame:
        got = [mark_pages([x or "" for x in p]) if p is not None else (None, None) for p in batch]
        return pd.DataFrame({"markdown": [m for m, _ in got], "pages": [w for _, w in got]})

    return run(pages)


#: Comment marks of languages and their aliases: line marks, block marks, names. Fixed values.
COMMENTS = (
    (("//",), (("/*", "*/"),), "javascript js jsx typescript ts tsx java c h cpp c++ csharp c# cs go rust rs swift kotlin kt scala dart scss json"),
    (("//", "#"), (("/*", "*/"),), "php"),
    (("#",), (), "bash sh shell zsh fish dockerfile makefile mak cmake nginx yaml yml toml ruby rb perl pl r"),
    (("#",), (('"""', '"""'), ("'''", "'''")), "python py"),
    (("#",), (("<#", "#>"),), "powershell ps1"),
    (("--",), (("/*", "*/"),), "sql"),
    (("--",), (("--[[", "]]"),), "lua"),
    (("--",), (("{-", "-}"),), "haskell"),
    (("--",), (), "ada"),
    ((";",), (), "clojure lisp scheme elisp"),
    ((";", "#"), (), "ini"),
    (("%",), (("%{", "%}"),), "matlab octave"),
    (("%",), (), "latex tex"),
    (('"',), (), "vim"),
    ((), (("/*", "*/"),), "css"),
    ((), (("<!--", "-->"),), "html xml vue svelte"),
)
_MARKS = {name: (single, pairs) for single, pairs, names in COMMENTS for name in names.split()}
#: What stands in unlabelled code of a language, fixed values; a language needs two kinds of them to be taken.
_SIGNS = (
    ("python", (r"^\s*def \w+\(.*\):", r"^\s*(?:from \w[\w.]* )?import \w", r"^\s*(?:if|for|while|class|elif|else|try|with)\b.*:\s*$", r"\bself\.\w", r"\bprint\(")),
    ("javascript", (r"\b(?:const|let|var) \w+ =", r"=>", r"\bfunction\b.*\{", r"\bconsole\.\w+\(", r"===")),
    ("java", (r"\bpublic (?:static |final |class )", r"\bSystem\.out\.", r"\bprivate \w+ \w+", r"\bnew \w+\(.*\);")),
    ("c", (r"^\s*#include\s*[<\"]", r"\b(?:int|void|char) \w+\(.*\)\s*\{?", r"\bprintf\(")),
    ("go", (r"^package \w+", r"^func \w*\(?", r":=")),
    ("rust", (r"\bfn \w+\(", r"\blet mut \w", r"\w+!\(")),
    ("sql", (r"(?i)^\s*(?:select|insert into|update|delete from|create table)\b", r"(?i)\b(?:from|where|values|join|group by)\b.*")),
    ("bash", (r"\$\{?\w+\}?", r"^\s*(?:fi|done|esac|then|do)\b", r"^\s*(?:echo|export|cd|sudo|grep) ")),
    ("css", (r"^[.#]?[\w-]+\s*\{", r"^\s*[\w-]+:\s*[^;]+;\s*$")),
    ("html", (r"<!DOCTYPE html", r"</(?:html|body|div|p|span|head)>", r"<(?:div|span|p|a|html|body)\b[^>]*>")),
    ("yaml", (r"^[\w-]+:\s*$", r"^\s+- \w", r"^[\w-]+: \S")),
)
_SIGNS = tuple((name, tuple(re.compile(p, re.M) for p in patterns)) for name, patterns in _SIGNS)
_SHEBANG = re.compile(r"^\s*#!\S*?(?:env\s+)?([A-Za-z+#]+)[\d.]*\s*$")
_SHELLS = {"node": "javascript"}


def code_language(lines: list[str]) -> str | None:
    """The language of a fenced block, by its label, its first line, or what stands in it; None where unsure."""
    name = lines[0].strip().lstrip("`").strip().split(" ")[0].lower() if lines else ""
    if name in _MARKS:
        return name
    code = [x for x in lines[1:] if not _FENCE.match(x)]
    first = next((x for x in code if x.strip()), "")
    m = _SHEBANG.match(first)
    if m:
        name = m.group(1).lower()
        name = _SHELLS.get(name, name)
        if name in _MARKS:
            return name
    text = "\n".join(code)
    seen = [(sum(p.search(text) is not None for p in patterns), -k, lang) for k, (lang, patterns) in enumerate(_SIGNS)]
    best = max(seen, default=(0, 0, None))
    return best[2] if best[0] >= 2 else None


def code_comments(fence: str) -> list[str]:
    """Comments of a fenced block; none where its language is unknown; marks within strings don't count."""
    lines = fence.split("\n")
    marks = _MARKS.get(code_language(lines) or "")
    if marks is None:
        return []
    single, pairs = marks
    text = "\n".join(x for x in lines[1:] if not x.startswith("#!") and not _FENCE.match(x))
    kinds = [f"(?P<b{k}>{re.escape(a)}(?P<c{k}>.*?){re.escape(z)})" for k, (a, z) in enumerate(pairs)]
    strings = [] if '"' in single else [r"\"(?:\\.|[^\"\\\n])*\"", r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"]
    if single:
        strings.append("(?:" + "|".join(map(re.escape, single)) + r")(?P<line>[^\n]*)")
    out = []
    for m in re.finditer("|".join(kinds + strings), text, re.S):
        got = m.groupdict()
        inner = next((x for x in (got.get("line"), *(got[f"c{k}"] for k in range(len(pairs)))) if x), None)
        if inner is None:
            continue
        said = " ".join(re.sub(r"^\s*\*+\s?|[#/*-]{3,}", "", x).strip() for x in inner.split("\n")).strip()
        if re.search(r"[^\W\d_]{2}", said):
            out.append(said)
    return out


def extract_comments(fence: Column) -> Column:
    """See :func:`code_comments`."""
    return _column(code_comments, "array<string>")(fence)
