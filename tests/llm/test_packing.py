import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import packing as P


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 90))
def test_best_fit_never_overfills_and_bound_holds(sizes, cap):
    s = np.array(sizes, np.int64)
    k = P.best_fit_decreasing(s, cap)
    filled = np.bincount(k, weights=s) if len(s) else np.array([])
    assert (filled <= cap).all()
    assert P.lower_bound(s, cap) <= max(len(filled), 0)


def test_bound_sees_large_items():
    assert P.lower_bound(np.array([60] * 7), 100) == 7
    assert P.lower_bound(np.array([34] * 7), 100) == 4
    assert P.lower_bound(np.array([50, 50, 50]), 100) == 2


def test_whole_and_within_capacity(spark):
    rows = [(i, "word " * (7 * i % 90)) for i in range(300)] + [(900, "Long text here. " * 400), (901, None), (902, ""), (903, "x" * 5_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = P.pack(df, 100, per_partition=40).cache()
    per = out.groupBy("container").agg(F.sum("n_tokens").alias("s"), F.max("filled").alias("f")).collect()
    assert all(r["s"] == r["f"] <= 100 for r in per)
    assert out.select("doc_id").distinct().count() == len(rows)
    assert out.filter("piece_no > 0").select("doc_id").distinct().count() <= 3
    whole = {r["doc_id"]: r["t"] for r in out.join(df, "doc_id").withColumn("p", F.expr("substring(text, char_start + 1, char_end - char_start)")).groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(piece_no, p))), x -> x.p), '')").alias("t")).collect()}
    assert all((whole.get(i) or "") == (t or "") for i, t in rows)
    total = out.agg(F.sum("n_tokens")).first()[0]
    assert len(per) <= total / 100 * 1.1 + 3
    assert P.pack(df.limit(0), 100).count() == 0


def test_cut_to_capacity():
    encoding = P.encoder(P.TOKENIZER)
    count = lambda s: len(encoding.encode_ordinary(s))
    for text in ("a b c d. e f g h i j", "x" * 5_000, "猫は犬を見た。" * 60, "👩\u200d💻 é" * 50, "Long text here. " * 400):
        for capacity in (5, 64):
            got = P.cut_to_capacity(text, count, capacity, P.token_ends(text, encoding))
            assert "".join(text[a:b] for a, b, _ in got) == text and all(0 < s == count(text[a:b]) <= max(capacity, 4) for a, b, s in got)
            assert len(got) <= 1.6 * count(text) / capacity + 2
    assert P.cut_to_capacity("", count, 5, np.empty(0, np.int64)) == [(0, 0, 0)]


@pytest.mark.parametrize("capacity", [64])
def test_bounds_table(spark, capacity):
    df = spark.createDataFrame([(i, "word " * 20) for i in range(50)], "doc_id bigint, text string")
    rows = P.partition_bounds(df, capacity, per_partition=20).collect()
    assert all(r["bound"] <= r["containers"] for r in rows)
    whole = next(r for r in rows if r["level"] == -1)
    assert whole["containers"] == sum(r["containers"] for r in rows if r["level"] >= 0) == P.pack(df, capacity, per_partition=20).select("container").distinct().count()


def test_bound_over_counts():
    sizes = np.array([60, 60, 34, 34, 34, 0])
    assert P.lower_bound(sizes, 100) == P.lower_bound(np.array([60, 34, 0]), 100, np.array([2, 3, 1]))
