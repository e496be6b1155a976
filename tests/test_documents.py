import io
import json
import struct
import time
import zipfile

from pyspark.sql import functions as F

from folioflow.operators import markdown as M
from folioflow.operators import sequences as S
from folioflow.plans import documents, records
from folioflow.sources import readers as R
from folioflow.streaming import pace


def kinds(md):
    return [b["kind"] for b in M.blocks(md.split("\n"))]


def test_blocks():
    assert kinds("- a\n- b\n\ntail text here goes on and on and on and on for more than sixty") == ["list-item", "list-item", "paragraph"]
    assert kinds("```py\nx\n```\n---\nText.") == ["code", "hr", "paragraph"] and kinds("| a |\n| b |\n> q\n> r") == ["table", "blockquote"]
    assert kinds("- a\n  more of a\n    - nested\nnot indented any more, so the list ends here and prose begins") == ["list-item", "paragraph"]
    assert kinds("Prose that goes on for quite a while so that it is no item line at\n2. all") == ["paragraph"] and kinds("- - -") == ["hr"] and kinds("```\nlost") == []


def test_sections():
    got = M.sections("# One\n\n## Two\n\nFirst sentence. Second one.\n\n### Three\n\n## Four\nEnd.")
    assert [s["titles"] for s in got] == [["One"], ["One", "Two"], ["One", "Two", "Three"], ["One", "Four"]]
    assert got[1]["paragraphs"] == [["Two"], ["First sentence.", "Second one."]] and [b["para_idx"] for b in got[1]["blocks"]] == [0, 1]
    assert M.sections("### Deep\n\n## Under\nText.")[1]["titles"] == ["Deep", "Under"]
    assert M.sections("plain text.")[0]["titles"] == ["Document"] and M.sections("") == []


def test_repairs(spark):
    assert M.join_continuations("It was cut\n\nhere again. Next.\n\n| a |\n\n| b |") == "It was cut here again. Next.\n\n| a |\n| b |"
    assert M.join_continuations("# Head\n\nlower text. Done.\n\nNew one.") == "# Head\n\nlower text. Done.\n\nNew one."
    assert M.calm_capitals("THE END of NASA and GLORIOUS\n```\nTHE END\n```") == "The End of NASA and Glorious\n```\nTHE END\n```"
    assert M.drop_image_notes("a\n<!-- image -->\nOther\nb <!-- x -->\n<!-- page break -->") == "a\nb\n<!-- page break -->"
    df = spark.createDataFrame([("x\n\ny",), (None,)], "m string").select(M.reflow(F.col("m")).alias("r"), M.parse_sections(F.col("m")).alias("s"))
    assert [r["r"] for r in df.collect()] == ["x y", None]


def test_pages():
    text, where = M.mark_pages(["It begins and", "", "goes on. More."], first=5)
    assert text == "Page 5.\n\nIt begins and\n\nPage 6.\n\nPage 7.\n\ngoes on. More." or text.startswith("Page 5.\n\nIt begins and goes on.")
    assert [w["page"] for w in where] == [5, 6, 7] and all(text[w["char_start"] :].startswith("Page") for w in where)


def test_comments_and_tables(spark):
    assert M.code_comments("```python\n#!/bin/x\nx = '# no'  # yes it is\n```") == ["yes it is"]
    assert M.code_comments("```js\n/* one\n * two */ a // three\n```") == ["one two", "three"] and M.code_comments("```zz\n# no\n```") == [] and M.code_comments("```\n#!/usr/bin/env python3\n# said\n```") == ["said"]
    row = spark.createDataFrame([("| A | **B** |\n|---|---|\n| 1 | [x](u) |\n| 2 |  |",), ("| A |",)], "m string").select(M.table_records(F.col("m")).alias("r")).collect()
    assert row[0]["r"] == ["Row 1 of 2: A: 1, B: x.", "Row 2 of 2: A: 2."] and row[1]["r"] == []


def test_html():
    html = "<html><head><title> A  b </title><meta name='author' content='Ann'></head><body><nav>no</nav><h1>T</h1><p>Some <b>bold</b> <a href='u'>link</a></p><ul><li>one<li>two</ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><script>x</script></body></html>"
    md = R.html_markdown(html)
    assert "# T" in md and "**bold** [link](u)" in md and "- one\n- two" in md and "| a | b |\n| --- | --- |\n| 1 | 2 |" in md and "no" not in md.split() and "x" not in md.split()
    assert R.html_meta(html) == {"title": "A b", "author": "Ann", "site": None, "date": None}


def epub(extra=None):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="u"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="p" xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b%20c.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="zz"/></spine></package>')
        z.writestr("O/t.ncx", '<ncx xmlns="n"><navMap><navPoint><navLabel><text>First</text></navLabel><content src="b%20c.xhtml#x"/></navPoint></navMap></ncx>')
        z.writestr("O/a.xhtml", "<html><body><h2>Second</h2><p>Text <img src='i.png' alt='i'/> <img src='no.png'/></p></body></html>")
        z.writestr("O/b c.xhtml", "<html><body><p>Begin.</p></body></html>")
        z.writestr("O/i.png", b"png")
        for k, v in (extra or {}).items():
            z.writestr(k, v)
    return b.getvalue()


def test_epub(spark):
    b = R.read_epub(epub())
    assert b["title"] == "Book" and b["chapters"] == [("First", "Begin."), ("Second", "Text ![i](O/i.png)")] and list(b["images"]) == ["O/i.png"]
    files = spark.createDataFrame([("a", bytearray(epub())), ("b", bytearray(b"junk")), ("c", bytearray(epub({"META-INF/encryption.xml": "x"}))), ("d", None)], "path string, content binary")
    got = {(r["path"], r["chapter"]): r for r in R.epub_chapters(files).collect()}
    assert got[("a", 0)]["title"] == "First" and got[("b", None)]["error"] == "not an ePub" and got[("c", None)]["error"] == "protected" and got[("d", None)]["error"]


def test_voice_files_and_catalogues(spark, tmp_path):
    def f(keys):
        head = json.dumps({k: {} for k in keys}).encode()
        return bytearray(struct.pack("<Q", len(head)) + head)

    df = spark.createDataFrame([(1, f(["speaker.w"])), (2, f(["emb"])), (3, f(["l.cache", "l.offset"])), (4, f(["x"])), (5, bytearray(b"ab"))], "i int, c binary")
    assert [r[0] for r in df.orderBy("i").select(R.voice_file_kind(F.col("c"))).collect()] == ["phonon", "phonon", "pocket", "unknown", "unknown"]
    (tmp_path / "v.json").write_text(json.dumps({"voices": [{"name": "A b", "x": 1}, {"name": "a-b", "x": 2}]}))
    assert [r["x"] for r in R.voice_catalog(spark, str(tmp_path / "v.json")).collect()] == [2]
    (tmp_path / "v.jsonl").write_text('{"name":"a","language":"en","filename":"1"}\n\nbad\n{"name":"a","language":"en","filename":"2"}\n{"name":"b","language":"de"}\n')
    assert [(r["name"], r["filename"]) for r in R.voice_lines(spark, str(tmp_path / "v.jsonl")).collect()] == [("a", "1")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("e", f"v{i % 3}", i, 100.0 + i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "engine string, voice string, seq bigint, chars double, seconds double")
    pace.append_log(df.filter("seq < 15").coalesce(1), str(tmp_path / "log"))
    time.sleep(1.1)  # files of one batch after those of the other
    pace.append_log(df.filter("seq >= 15").coalesce(1), str(tmp_path / "log"))
    stream = pace.read_log(spark, str(tmp_path / "log"), df.schema, maxFilesPerTrigger="1")
    out = pace.drain(pace.running_pace(stream, cap=1_500.0), f"t{tmp_path.name}", "update").collect()
    assert {r["batch"] for r in out} == {0, 1}
    back = S.pace(df, cap=1_500.0).collect()
    assert sorted(tuple(r)[:4] for r in out if r["batch"] == 1) == sorted(map(tuple, back))


def test_pace_by_hand(spark):
    df = spark.createDataFrame([("e", "v", 2, 700.0, 5.0), ("e", "v", 1, 500.0, 7.0), (None, "w", 1, None, 1.0)], "engine string, voice string, seq int, chars double, seconds double")
    got = {r["voice"]: (r["chars"], r["seconds"]) for r in S.pace(df, cap=1_300.0).collect()}
    # 900 + 500 passes the cap: 700 and 33.5; then 700 more passes it again
    assert got == {"v": (700.0, 19.25), "w": (900.0, 61.0)}
    assert S.pace(df.limit(0)).count() == 0


def test_code_languages():
    assert M.code_comments("```python\n# one thing\nx = '# no'\n\"\"\"doc here\"\"\"\n```") == ["one thing", "doc here"]
    assert M.code_comments("```\ndef f(x):\n    # inner note\n    return x\nprint(f(1))\n```") == ["inner note"]
    assert M.code_comments("```\n#!/usr/bin/env python3\n# hi there\n```") == ["hi there"]
    assert M.code_comments("```ini\n; first\n# second\nk=v\n```") == ["first", "second"]
    assert M.code_comments("```ps1\n<# long\none #>\n# short\n```") == ["long one", "short"]
    assert M.code_comments("```\njust some words\n```") == [] == M.code_comments("")


def test_pages_of_the_articles_own_text(spark, tmp_path):
    rows = [(1, "A & <b>", "Ann", "S \"q\"", "2020", "# Über uns\n\n* one\n- two\n1 < 2 & 3 > 2\n\n## 図書館\n**By Ann**\nEnd  of it."), (2, None, None, None, None, None), (3, " T  t ", "", " x ", None, "plain")]
    spark.createDataFrame(rows, "article_id bigint, title string, author string, site string, date string, markdown string").write.parquet(f"{tmp_path}/articles.parquet")
    md = {r["article_id"]: [x for x in r["markdown"].split("\n") if x] for r in documents.d58_article_markdown(spark, str(tmp_path)).collect()}
    assert md == {1: ["# Über uns", "- one", "- two", "1 < 2 & 3 > 2", "## 図書館", "**By Ann**", "End of it."], 2: [], 3: ["plain"]}
    html = {r["article_id"]: r["html"] for r in documents.d59_article_scripts(spark, str(tmp_path)).collect()}
    assert html[3] == "<html><body><nav>Menu</nav><p>plain</p></body></html>" and "<h2>図書館</h2>" in html[1] and "x()" not in html[1]
    meta = {r["article_id"]: tuple(r)[1:] for r in documents.d60_article_meta(spark, str(tmp_path)).collect()}
    assert meta == {1: ("A & <b>", "Ann", 'S "q"', "2020"), 2: (None, None, None, None), 3: ("T t", None, "x", None)}


def test_urls_of_the_tables_are_judged(spark, tmp_path):
    want = {"https://a.example/x": True, "ftp://a.example": False, "http://127.0.0.1/": False, "http://10.1.2.3/x": False, "http://localhost": False, "http://8.8.8.8/": True, "": False, "http://169.254.0.1": False, "http://[::1]/x": False, "http://u@[fe80::1]:80/": False, "http://[2606:4700::1]/": True, "https://a.example/" + "x" * 2048: False, None: False}
    spark.createDataFrame(list(enumerate(want)), "article_id bigint, url string").write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([(f"i{n}", (u,)) for n, u in enumerate(want)], "id string, source struct<url:string>").write.parquet(f"{tmp_path}/playlist_items.parquet")
    got = sorted((r["record_table"], r["record_key"], r["ok"]) for r in records.c08_url_admission_all(spark, str(tmp_path)).collect())
    assert got == sorted([("articles", str(n), ok) for n, ok in enumerate(want.values())] + [("playlist_items", f"i{n}", ok) for n, ok in enumerate(want.values())])
