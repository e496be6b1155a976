import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;\n。猫", min_size=0, max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_fit_and_join_to_the_text(text, size, overlap):
    got = S.pieces(text, size, overlap)
    assert all(len(p) <= size for _, p in got)
    rebuilt = ""
    for k, (at, p) in enumerate(got):
        assert text[at : at + len(p)] == p
        if k:
            assert at == len(rebuilt) - min(overlap, len(rebuilt))
        rebuilt = rebuilt[:at] + p
    assert rebuilt == text


def test_strongest_boundaries_stay():
    text = "One two three, four five. Six seven eight nine ten."
    assert [p for _, p in S.pieces(text, 30, 0)] == ["One two three, four five. ", "Six seven eight nine ten."]
    assert [p for _, p in S.pieces("x" * 95, 40, 10)][1].startswith("x" * 10)


def test_operator(spark):
    rows = [("a", 0, "word " * 100), ("b", 1, "short"), ("c", 2, None), ("d", 3, ""), ("a", 0, "word " * 100)]
    df = spark.createDataFrame(rows, "k string, piece int, text string")
    out = S.split_oversized(df, "text", F.lit(60), F.lit(5)).collect()
    assert {r["k"] for r in out} == {"a"} and all(len(r["piece"]) <= 60 and r["piece_in"] == 0 for r in out)
    assert S.split_oversized(df.limit(0), "text", F.lit(60), F.lit(5)).count() == 0
    assert S.split_oversized(df, "text", F.lit(None), F.lit(5)).count() == 0
    with pytest.raises(ValueError):
        S.cut_points("x" * 50, 10, 10)


def test_long_text():
    text = ("Sentence number one goes here. " * 20_000)[:500_000]
    assert all(len(p) <= 400 for _, p in S.pieces(text, 400, 40))
