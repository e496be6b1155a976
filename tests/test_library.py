from pyspark.sql import functions as F

from folioflow.operators import library as L
from folioflow.operators import sequences as S
from folioflow.plans import library as plans


def test_move_item(spark):
    row = spark.range(1).select(*[L.move_item(F.array(*map(F.lit, "abcd")), F.lit(x), F.lit(to)).alias(f"r{k}") for k, (x, to) in enumerate([("a", 2), ("d", 0), ("b", 99), ("b", -5), ("z", 1)])]).first()
    assert ["".join(r) for r in row] == ["bcad", "dabc", "acdb", "bacd", "abcd"]


def test_locate_and_fill(spark):
    starts = spark.createDataFrame([("d", 0, 2, 0), ("d", 1, 0, 2), ("d", 2, 3, 2)], "doc_id string, section_id int, n int, start bigint")
    points = spark.createDataFrame([("d", g) for g in (0, 1, 2, 4, 99)], "doc_id string, g bigint")
    got = {r["g"]: (r["section_id"], r["chunk"]) for r in S.locate(points, starts).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (2, 0), 4: (2, 2), 99: (2, 2)}
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate([None, 3, None, None, 5])], "k string, i int, v int")
    assert [r["v"] for r in S.fill_gaps(rows, "k", "i", "v").orderBy("i").collect()] == [3, 3, 3, 3, 5]


def test_fractions(spark):
    rows = spark.createDataFrame([("d", 0, 5), ("d", 1, 5), ("d", 2, 10)], "k string, i int, n int")
    ends = S.with_ends(rows, "k", "i", F.col("n"))
    assert [r["start_fraction"] for r in ends.orderBy("i").collect()] == [0, 0.25, 0.5]
    assert [S.index_at_fraction(ends, "k", "i", F.lit(f)).first()["index"] for f in (0.0, 0.25, 0.6, 1.0)] == [0, 1, 2, 2]


def test_pace_cap(spark):
    df = spark.createDataFrame([("e", "v", i, 100.0, 10.0) for i in range(200)], "engine string, voice string, seq int, chars double, seconds double")
    c, s = 900.0, 60.0
    for _ in range(200):
        c, s = c + 100, s + 10
        if c > 2000:
            c, s = c / 2, s / 2
    row = S.pace(df, cap=2000.0).first()
    assert abs(row["chars"] - c) < 1e-9 and abs(row["seconds"] - s) < 1e-9


def test_breadcrumbs(spark):
    df = spark.createDataFrame([("d", 0, 3, "a"), ("d", 1, 2, "b"), ("d", 2, 1, "c")], "k string, i int, level int, t string")
    assert [r["path"] for r in S.breadcrumbs(df, "k", "i", "level", "t").orderBy("i").collect()] == [["a"], ["a", "b"], ["c"]]


def test_runs_and_order(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate("aabba")], "k string, i int, v string")
    assert [(r["value"] if "value" in r else r["v"], r["n"]) for r in S.runs(df, "k", "i", "v").orderBy("first").collect()] == [("a", 2), ("b", 2), ("a", 1)]
    lists = spark.createDataFrame([("p", ["y", "gone", "x"])], "playlist_id string, item_ids array<string>")
    items = spark.createDataFrame([("p", "x"), ("p", "y"), ("p", "late")], "playlist_id string, id string")
    assert [r["id"] for r in L.ordered_items(lists, items).orderBy("pos").collect()] == ["y", "x", "late"]


def test_audio_is_stale_by_its_text(spark, tmp_path):
    said = {"old": ["New one.", "Two."], "whole": ["One.", "Two."], "long": ["One.", "Two."], "part": ["One.", "Two."], "mute": ["One."], "bare": ["One."]}
    spark.createDataFrame([(d, i, [x]) for d, t in said.items() for i, x in enumerate(t)], "doc_id string, id int, chunks array<string>").write.parquet(f"{tmp_path}/sections.parquet")
    audio = [("old", 0, "Old one.", [0], "v"), ("old", 1, "Two.", [1], "v"), ("whole", 1, "Two.", [1], "v"), ("whole", 0, "One.", [0], "v"), ("whole", 0, "One.", [0], "v"), ("whole", 2, "Row 1", [], "v")]
    audio += [("whole", 0, "One.", [0], "w"), ("long", 0, "One. Two.", [0, 1], "v"), ("part", 0, "One.", [0], "v"), ("part", 1, "Row 1", [], "v"), ("mute", 0, "Row 1", [], "v")]
    spark.createDataFrame([(*r, "pocket") for r in audio], "doc_id string, chunk_idx int, text string, sentence_indices array<int>, voice string, engine string").write.parquet(f"{tmp_path}/tts_chunks.parquet")
    items = [(f"i-{d}", "p", "t", d, 0, 2, 1, 1) for d in (*said, None)]
    spark.createDataFrame([*items, items[0]], "id string, playlist_id string, title string, doc_id string, progress int, total_sentences int, created_at bigint, updated_at bigint").write.parquet(f"{tmp_path}/playlist_items.parquet")
    want = {("old", "v"): True, ("whole", "v"): False, ("whole", "w"): True, ("long", "v"): False, ("part", "v"): True, ("mute", "v"): True}
    assert {(r["doc_id"], r["voice"]): r["stale"] for r in plans.c10_stale_audio(spark, str(tmp_path)).collect()} == want
    got = [(r["id"], r["voice"], r["state"]) for r in plans.f04_item_audio(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([*((f"i-{d}", v, "stale" if s else "fresh") for (d, v), s in want.items()), ("i-bare", None, "none"), ("i-None", None, "none")], key=str)
