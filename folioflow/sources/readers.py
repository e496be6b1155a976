"""Readers of web pages, e-books, voice files and catalogues, as DataFrames over files or columns."""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_LIMIT = 5 * 1024 * 1024
BOOK_LIMIT = 100 * 1024 * 1024
_SKIP = {"script", "style", "noscript", "template", "svg", "head"}
_FURNITURE = {"nav", "footer", "aside", "form"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "ul", "ol", "table", "tr", "figure", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr"}


class _Markdown(HTMLParser):
    """HTML to Markdown: headings, lists, quotes, emphasis, links, images, code and tables."""

    def __init__(self, readable: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.drop = _SKIP | (_FURNITURE if readable else set())
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0
        self.cells: list[str] | None = None
        self.rows = 0

    def _break(self, mark: str = "\n\n") -> None:
        self.out.append(mark)

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in self.drop:
            if tag not in ("br", "img", "hr", "meta", "link", "input"):
                self.hidden.append(tag)
            return
        a = dict(attrs)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._break()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self._break("\n" if self.lists else "\n\n")
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "    " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "blockquote":
            self._break()
            self.out.append("> ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "br":
            self._break("\n")
        elif tag == "table":
            self._break()
            self.rows = 0
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.out.append("\x02")
        elif tag in _BLOCK:
            self._break()

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden and self.hidden.pop() != tag:
                    pass
            return
        if tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._break("\n\n" if not self.lists else "\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "]")
        elif tag == "tr" and self.cells is not None:
            k = next((i for i in range(len(self.out) - 1, -1, -1) if self.out[i] == "\x02" and "\x03" not in self.out[i:]), None)
            start = k
            while start is not None and start > 0 and "\x03" not in self.out[:start] and any(x == "\x02" for x in self.out[:start]):
                start = next(i for i in range(start - 1, -1, -1) if self.out[i] == "\x02")
            if start is not None:
                cells = [" ".join(c.split()) for c in "".join(self.out[start:]).split("\x02")[1:]]
                del self.out[start:]
                self.out.append("| " + " | ".join(cells) + " |\n" + ("| " + " | ".join("---" for _ in cells) + " |\n" if self.rows == 0 else ""))
                self.rows += 1
            self.cells = None
        elif tag in _BLOCK:
            self._break()

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        t = "".join(self.out).replace("\x02", " ")
        t = re.sub(r"(?<!!)\[\s*\]\([^)]*\)|(\*\*)\s*\1", "", t)
        t = re.sub(r"(?m)^#{1,6}[ \t]*$", "", t)  # headings of nothing
        lines = [x.rstrip() for x in t.split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.startswith("    ") else x.lstrip() for x in lines)).strip()


def html_markdown(html: str, readable: bool = True) -> str:
    """A page as Markdown; ``readable`` leaves navigation, footers, asides and forms out."""
    p = _Markdown(readable)
    p.feed(html)
    p.close()
    return p.text()


class _Meta(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.values: dict[str, str] = {}
        self.title: list[str] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = a.get("property") or a.get("name") or a.get("itemprop")
            if key and a.get("content", "").strip():
                self.values.setdefault(key.lower(), a["content"].strip())
        self.inside = tag == "title" and not self.title

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)


#: Meta keys by what they tell, in order of preference. Fixed values.
META_KEYS = {
    "title": ("og:title", "twitter:title", "title"),
    "author": ("author", "article:author", "og:article:author", "parsely-author", "dc.creator"),
    "site": ("og:site_name", "application-name", "twitter:site"),
    "date": ("article:published_time", "datepublished", "date", "dc.date", "publish-date"),
}


def html_meta(html: str, limit: int = 1_000_000) -> dict[str, str | None]:
    """Title, author, site and date of a page's head; the title element stands in for a missing title."""
    p = _Meta()
    p.feed(html[:limit])
    out = {k: next((p.values[x] for x in keys if x in p.values), None) for k, keys in META_KEYS.items()}
    out["title"] = out["title"] or " ".join("".join(p.title).split()) or None
    return out


def page_markdown(html: Column, readable: bool = True) -> Column:
    """Markdown of an HTML column; null stays null, a page beyond the size limit is null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else html_markdown(x, readable) for x in s], dtype=object)

    return run(F.when(F.octet_length(html) <= PAGE_LIMIT, html))


def page_meta(html: Column) -> Column:
    """struct(title, author, site, date) of an HTML column."""

    @F.pandas_udf("struct<title:string,author:string,site:string,date:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_meta(x or "") for x in s], columns=["title", "author", "site", "date"])

    return run(html)


def upload_kind(path: Column, content: Column) -> Column:
    """pdf, epub, image types or text, by extension, then by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    name = F.lower(path)
    return (
        F.when(F.endswith(name, F.lit(".pdf")) | F.startswith(head, F.lit("25504446")), "pdf")
        .when(F.endswith(name, F.lit(".epub")) | (F.startswith(head, F.lit("504B0304")) & F.contains(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), F.lit("application/epub+zip"))), "epub")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(head, F.lit("47494638")), "image/gif")
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise("text")
    )


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e, name: str):
    return (x for x in e.iter() if _name(x) == name)


def read_epub(data: bytes) -> dict:
    """Title, author, chapters (title, markdown) and images of an e-book; ValueError says why one can't be read."""
    if len(data) > BOOK_LIMIT:
        raise ValueError("too large")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ValueError("not an ePub") from None
    names = set(z.namelist())
    if "META-INF/encryption.xml" in names:
        raise ValueError("protected")
    if "META-INF/container.xml" not in names:
        raise ValueError("no container")
    opf = next((r.get("full-path") for r in _all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")), None)
    if opf not in names:
        raise ValueError("no package")
    base, package = posixpath.dirname(opf), ElementTree.fromstring(z.read(opf))
    at = lambda root, href: posixpath.normpath(posixpath.join(root, unquote(href.split("#")[0])))
    files = {m.get("id"): (at(base, m.get("href") or ""), m.get("media-type") or "") for m in _all(package, "item")}
    labels: dict[str, str] = {}
    for path, kind in files.values():
        if kind == "application/x-dtbncx+xml" and path in names:
            for point in _all(ElementTree.fromstring(z.read(path)), "navPoint"):
                text, src = next(_all(point, "text"), None), next(_all(point, "content"), None)
                if text is not None and src is not None:
                    labels.setdefault(at(base, src.get("src") or ""), " ".join("".join(text.itertext()).split()))
    chapters, images = [], {}
    for ref in _all(package, "itemref"):
        path, kind = files.get(ref.get("idref"), ("", ""))
        if path not in names or "html" not in kind:
            continue
        md = html_markdown(z.read(path).decode("utf-8", "replace"), readable=False)

        def keep(m: re.Match, path: str = path) -> str:
            target = at(posixpath.dirname(path), m.group(2))
            if target not in names:
                return ""
            images.setdefault(target, z.read(target))
            return f"![{m.group(1)}]({target})"

        md = re.sub(r"!\[([^\]]*)\]\(([^)]+)\)", keep, md).strip()
        first = re.match(r"#{1,3}[ \t]+(\S.*)", md)
        title = labels.get(path) or (first.group(1).strip() if first else posixpath.splitext(posixpath.basename(path))[0].replace("_", " ").replace("-", " ").title())
        if first and first.group(1).strip().lower() == title.lower():
            md = md[first.end() :].lstrip()
        chapters.append((title, md))
    meta = lambda name: next((" ".join("".join(e.itertext()).split()) for e in _all(package, name)), None)
    return {"title": meta("title"), "author": meta("creator"), "chapters": chapters, "images": images}


def epub_chapters(files: DataFrame) -> DataFrame:
    """(path, chapter, title, markdown, book_title, author, error) of binary files with path and content; a bad book has its error in one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["path", "chapter", "title", "markdown", "book_title", "author", "error"]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    b = read_epub(bytes(content or b""))
                    rows.extend((path, k, t, md, b["title"], b["author"], None) for k, (t, md) in enumerate(b["chapters"]))
                except (ValueError, ElementTree.ParseError, KeyError) as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({"chapter": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, chapter int, title string, markdown string, book_title string, author string, error string")


def epub_images(files: DataFrame) -> DataFrame:
    """(path, name, content): the images that the chapters of binary files with path and content show; of a bad book none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.extend((path, name, data) for name, data in read_epub(bytes(content or b""))["images"].items())
                except (ValueError, ElementTree.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def voice_file_kind(content: Column) -> Column:
    """pocket, phonon or unknown, by the tensor names in a voice file's header (a length, then JSON)."""

    def kind(data: bytes | None) -> str:
        try:
            n = struct.unpack("<Q", bytes(data[:8]))[0]
            keys = list(json.loads(bytes(data[8 : 8 + n]))) if 0 < n <= 32 * 1024 * 1024 else []
        except (struct.error, ValueError, TypeError):
            return "unknown"
        if any("cache" in k for k in keys) and any("offset" in k for k in keys):
            return "pocket"
        return "phonon" if any(k == "emb" or "speaker" in k for k in keys) else "unknown"

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(kind)

    return run(content)


def voice_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Voices of a JSON catalogue {"voices": [...]}; of names with one key the last counts."""
    from pyspark.sql import Window as W

    from folioflow.functions.text import voice_key

    rows = spark.read.json(path, multiLine=True).select(F.posexplode("voices").alias("n", "v")).select("n", "v.*")
    w = W.partitionBy(voice_key(F.col("name"))).orderBy(F.col("n").desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "n")


def voice_lines(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    """Voices of a JSON-lines catalogue in one language; bad lines skipped, of one name the first."""
    from pyspark.sql import Window as W

    schema = "filename string, name string, language string, locale string, gender string, description string, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_n", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()))
    good = rows.filter(F.col("_bad").isNull() & F.col("name").isNotNull() & (F.col("language") == language))
    w = W.partitionBy("name").orderBy("_n")
    return good.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("filename", "name", "language", "locale", "gender", "description")
