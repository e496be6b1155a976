from pyspark.sql import functions as F

from folioflow.operators import editing as E
from folioflow.operators import library as L
from folioflow.operators import settings


def test_rename_takes_the_first_free_slug(spark):
    docs = spark.createDataFrame([("a", "One", "one"), ("b", "Two", "two"), ("c", "Two!", "two-2"), ("d", None, "x"), ("e", "Two", "two-4"), ("f", "z", "z")], "id string, title string, slug string")
    ask = spark.createDataFrame([("a", " Two "), ("d", ""), ("f", "two"), ("gone", "x")], "id string, title string")
    got = {r["id"]: (r["title"], r["slug"]) for r in E.rename(docs, ask).collect()}
    assert got == {"a": ("Two", "two-3"), "b": ("Two", "two"), "c": ("Two!", "two-2"), "d": (None, "untitled"), "e": ("Two", "two-4"), "f": ("two", "two-5")}
    assert E.rename(docs.limit(0), ask).count() == 0
    assert {r["id"]: r["slug"] for r in E.rename(docs, ask.limit(0)).collect()} == {"a": "one", "b": "two", "c": "two-2", "d": "x", "e": "two-4", "f": "z"}


def test_render_again_and_sources(spark):
    rows = [("a", "Old.", None, "Page 3.\nNew."), ("b", "Old.", ["One li-\nne.", "Two."], None), ("c", "Stored.", None, None), ("d", None, None, None)]
    got = {r["id"]: r for r in E.render_again(spark.createDataFrame(rows, "id string, markdown string, raw_pages array<string>, edited string")).collect()}
    assert (got["a"]["source"], got["a"]["raw_markdown"], got["a"]["raw_pages"]) == ("edited", "New.", None) and "New." in got["a"]["markdown"]
    assert got["b"]["source"] == "pages" and "One line." in got["b"]["markdown"] and got["b"]["raw_pages"] == ["One li-\nne.", "Two."]
    assert got["c"]["source"] == "stored" and got["c"]["raw_markdown"] == "Stored." and got["d"]["markdown"] is None
    kinds = "draft string, saved string, stored array<struct<paragraphs:array<array<string>>>>"
    cases = [("x", "y", [([["s"]],)], "draft"), ("x", "x", [([["s"]],)], "stored"), ("x", "x", [(None,)], "saved"), ("x", "x", [], "draft"), ("x", None, None, "draft"), ("x", None, [([["s"]],)], "stored")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {kinds}, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", E.section_source(F.col("draft"), F.col("saved"), F.col("stored")).alias("got")).collect())


def test_item_stats_by_hand(spark):
    items = spark.createDataFrame([("i", "p", "d", 1, 3), ("j", "p", "d", 9, 3), ("k", "p", "gone", 1, 4), ("l", "p", None, None, None), ("m", "p", "d", -2, -1)], "id string, playlist_id string, doc_id string, progress int, total_sentences int")
    sections = spark.createDataFrame([("d", 0, ["ab", "cde"]), ("d", 1, ["f"]), ("e", 0, [])], "doc_id string, id int, chunks array<string>")
    got = {r["id"]: tuple(r)[2:] for r in L.item_stats(items, sections).collect()}
    assert got == {"i": (1, 3, 8, 5), "j": (3, 3, 8, 0), "k": (1, 4, 0, 0), "l": (0, 0, 0, 0), "m": (0, 0, 8, 8)}


def test_settings(spark):
    df = spark.createDataFrame([("", "http://e//", None, "x"), (None, None, " ON ", " 7 "), ("http://a/", "b", "no", None)], "e string, v string, t string, n string")
    got = df.select(settings.base_url(F.col("e"), F.col("v"), "http://d/").alias("u"), settings.truth(F.col("t"), True).alias("t"), settings.whole(F.col("n"), 2).alias("n")).collect()
    assert [tuple(r) for r in got] == [("http://e", True, 2), ("http://d", True, 7), ("http://a", False, 2)]


def test_what_models_say(spark):
    said = {
        '{"architecture":{"input_modalities":["text"]},"modalities":["image"]}': False, '{"architecture":{"input_modalities":"image"},"capabilities":{"vision":true}}': True, '{"capabilities":{"vision":"true"}}': None,
        '{"capabilities":["multimodal"]}': True, '{"capabilities":["vision"],"input_modalities":["image"]}': True, '{"modalities":[]}': False, "{}": None,
    }
    df = spark.createDataFrame([(j,) for j in said], "j string")
    assert {r["j"]: r["v"] for r in df.select("j", settings.sees_images(F.parse_json("j")).alias("v")).collect()} == said
