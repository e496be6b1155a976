import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import repeats as R

ARTICLES = "article_id bigint, domain string, markdown string, ids string, lines string"


def brute(rows, min_docs=5, share=0.1):
    """Lines by letters, counted per domain in plain Python."""
    key = lambda s: "".join(c for c in s if c.isalpha()).lower()
    docs, size = {}, {}
    for i, d, t in rows:
        d = d or ""
        size[d] = size.get(d, 0) + 1
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            docs[(d, k)] = docs.get((d, k), 0) + 1
    return {(i, n) for i, d, t in rows for n, x in enumerate((t or "").split("\n"), 1) if docs.get((d or "", key(x)), 0) >= max(min_docs, share * size[d or ""])}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=6))
def test_suffix_array_is_sorted_with_right_prefixes(docs):
    ids = np.array([x for d in docs for x in d])
    ends = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
    order, lcp = R.suffix_array(ids, ends)
    suffixes = [tuple(ids[i : ends[i]]) for i in order]
    assert sorted(order.tolist()) == list(range(len(ids)))
    assert suffixes == sorted(suffixes)
    for k in range(1, len(order)):
        a, b = suffixes[k - 1], suffixes[k]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        d = rng.choice(["a", "a", "a", "b", None])
        lines = [rng.choice(["Share this!", "share  THIS", "© 2020 — legal", "123", ""]) for _ in range(3)] + [f"body {rng.random()}" + "xyz"[i % 3] * (i % 7)]
        rows.append((i, d, None if i == 7 else "\n".join(lines)))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ARTICLES)
    got = {tuple(r) for r in R.repeated_lines(df).collect()}
    assert got == brute(rows)
    clean = {r["article_id"]: r for r in R.without_repeats(df).collect()}
    assert len(clean) == 120
    assert all(clean[i]["n_removed"] == sum(1 for a, _ in got if a == i) for i in clean)
    assert R.repeated_blocks(df).filter("n_docs < 1").count() == 0


def test_edges(spark):
    empty = spark.createDataFrame([], ARTICLES)
    assert R.repeated_lines(empty).count() == 0
    assert R.without_repeats(empty).count() == 0
    long = "same line\n" * 20_000
    rows = [(i, None, long if i == 0 else "same line", None, None) for i in range(6)] + [(6, "x", "", None, None), (6, "x", "", None, None)]
    got = R.repeated_lines(spark.createDataFrame(rows, ARTICLES))
    assert got.filter("article_id = 0").count() == 20_000
    assert got.filter("article_id = 6").count() == 0


@pytest.mark.parametrize("text", ["ÉCOLE, école!", "学校。学校"])
def test_letters_only(spark, text):
    a, b = text.replace("。", "!").split(",")[0], text
    rows = [(i, "d", x) for i, x in enumerate([text] * 5)]
    df = spark.createDataFrame(rows, "article_id bigint, domain string, markdown string")
    assert R.repeated_lines(df).count() == 5
    assert a and b


def brute_blocks(rows, min_docs=5, share=0.1):
    """(domain, n_lines, n_docs) of every block that no line more leaves in as many documents, counted in plain Python."""
    key = lambda s: "".join(c for c in s if c.isalpha()).lower()
    docs, size = {}, {}
    for _, d, t in rows:
        size[d] = size.get(d, 0) + 1
        k = [x for x in map(key, t.split("\n")) if x]
        for b in {tuple(k[i:j]) for i in range(len(k)) for j in range(i + 1, len(k) + 1)}:
            docs[(d, b)] = docs.get((d, b), 0) + 1
    held = {(d, b): n for (d, b), n in docs.items() if n >= max(min_docs, share * size[d])}
    longer = {(d, x, n) for (d, b), n in held.items() if len(b) > 1 for x in (b[:-1], b[1:])}
    return sorted((d, len(b), n) for (d, b), n in held.items() if (d, b, n) not in longer)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_blocks_match_brute_force(spark, batch):
    rng = random.Random(8)
    rows = [(i, rng.choice("aab"), "\n".join(rng.choice(["Share", "Legal", "Sign up", "About us", "12", f"only {'x' * i}"]) for _ in range(9))) for i in range(80)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = R.repeated_blocks(spark.createDataFrame(rows, "article_id bigint, domain string, markdown string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["domain"], r["n_lines"], r["n_docs"]) for r in got) == brute_blocks(rows)
    assert len({(r["domain"], r["block"]) for r in got}) == len(got)


def test_block_inside_a_longer_run_counts(spark):
    rows = [(i, "d", "Share\nLegal" if i < 5 else "Share\nLegal\nSign up") for i in range(10)]
    got = R.repeated_blocks(spark.createDataFrame(rows, "article_id bigint, domain string, markdown string"))
    assert sorted((r["n_lines"], r["n_docs"]) for r in got.collect()) == [(2, 10), (3, 5)]
