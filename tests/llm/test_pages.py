import itertools

import numpy as np

from folioflow.llm import pages as P
from folioflow.llm.seeds import Seeds

TOP = "We use cookies to remember you. Accept all | Manage\n\n[Home](/home) [News](/news)\n\n"
TAIL = "\n\nPass this on: X · Y\n\nFiled under: a, b\n\nWritten for you by the house."
NAMES = ["cat", "dog", "heron", "fox", "mole", "newt", "otter"]


def letters(i):
    return "".join(chr(97 + int(d)) for d in str(i))


def page(i):
    a, b = NAMES[i % 7] + letters(i), NAMES[i % 5] + letters(i * 3)
    return f"{TOP}# A title of {a}\n\nBy Ann Moor\n\nThe first paragraph of the {a} is here.\n\n- It has a list item about {b} in it.\n\n## A second part on {b}\n\nAnd another paragraph follows the {a}.{TAIL}"


def sample(n=40):
    recurs = [True, True, False, True, False, False, False, False, True, True, True]
    lines = [P._blocks(page(i))[1] for i in range(n)]
    return lines, [P.corpus_labels(x, recurs, Seeds()) for x in lines]


def test_field_agrees_with_the_corpus_and_viterbi_is_best():
    train, gold = sample()
    assert gold[0] == [0, 0, 1, 0, 1, 1, 1, 1, 0, 0, 0]
    f = P.fit(train, gold, steps=40)
    assert P.decode(f, train[:3], {}).tolist() == [y for p in gold[:3] for y in p]
    some = train[0][:8]
    feats = P.page_features(some, {})
    score = [sum(f.weights[f.index[x]] for x in fs if x in f.index) for fs in feats]
    best = max(itertools.product((0, 1), repeat=len(some)), key=lambda y: sum(s for s, k in zip(score, y) if k) + sum(f.pairs[a, b] for a, b in zip(y, y[1:])))
    assert tuple(P.decode(f, [some], {}).tolist()) == best


def test_operator(spark):
    rows = [(i, page(i), "a", "x") for i in range(60)] + [(90, None, "a", "x"), (91, "", "a", "x"), (92, "\n\n", None, "x"), (0, page(0), "a", "x"), (93, "One sentence only.", "b", "x"), (94, "para. \n" * 3_000, "b", "x")]
    # a source with one page, where nothing can recur
    rows.append((95, page(777), "c", "x"))
    df = spark.createDataFrame(rows, "article_id bigint, markdown string, domain string, line_no string")
    got = P.label_blocks(df, sample_pages=40)
    outside = {(r[0], r[1]) for r in got.filter("NOT body").collect()}
    for k in (3, 95):
        assert {n for i, n in outside if i == k} == {1, 3, 7, 17, 19, 21}
    assert got.filter("article_id IN (90, 91, 92)").count() == 0
    assert got.filter("article_id = 94").count() == 3_000
    body = {r["article_id"]: r["body"] for r in P.main_text(df, sample_pages=40).collect()}
    assert "first paragraph" in body[3] and "cookies" not in body[3] and body[90] == ""
    assert P.label_blocks(df.limit(0)).count() == 0


def test_recurrence_decides(spark):
    """Without recurrence the same lines are body: the labels come from the corpus, not from words."""
    lines = P._blocks(page(1))[1]
    with_, without = P.corpus_labels(lines, [True] * len(lines), Seeds()), P.corpus_labels(lines, [False] * len(lines), Seeds())
    assert with_[-1] == 0 and without[-1] == 1


def test_labels_know_code_tables_and_placeholders():
    lines = ["# T", "```", "render('cookies')", "```", "| a | b |", "Dear {{ user.name }}, your order", "Pass it on | Copy link | Print"]
    assert P.corpus_labels(lines, [False] * 7, Seeds()) == [1, 1, 1, 1, 1, 1, 0]
    assert np.array(P.decode(P.fit([], []), [[]], {})).size == 0
