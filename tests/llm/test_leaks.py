import itertools
import random

from folioflow.llm import leaks as K

W = [f"w{i}" for i in range(400)]


def brute(docs, items, n=12):
    grams = lambda t: {tuple(x[i : i + n]) for x in [K.words(t)] for i in range(len(x) - n + 1)}
    return {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}


def data():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(W) for _ in range(40))) for i in range(12)]
    docs = []
    for d in range(120):
        words = [rng.choice(W) for _ in range(60)]
        if d % 3 == 0:
            x = items[d % 12][1].split()
            k = rng.choice([8, 11, 12, 13, 30])
            at = rng.randrange(len(x) - k)
            words[20:20] = x[at : at + k]
        docs.append((d, rng.choice([" ", "-", ",\n"]).join(words).upper() if d % 2 else " ".join(words)))
    return [*docs, (900, None), (901, ""), (902, "w1")], items


def test_matches_brute_force_both_ways(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert {(r[0], r[1]) for r in K.leaked(d, i).filter("run >= 12").collect()} == want and want
    assert {(r[0], r[1]) for r in K.leaked(d, i, max_items=3, mismatches=0).collect()} == want


def test_runs_and_substitutions():
    item = " ".join(W[:40])
    seeds = K.Seeds([(1, item)], 12, K.MASKS)
    changed = W[:40]
    changed[13] = "other"
    assert seeds.find(" ".join(changed), 2) == {0: (26, 39, 0)}  # the run after the change; all but one word
    assert seeds.find(" ".join(changed)) == {0: (26, 26, 14)}
    assert not seeds.find(" ".join(W[:11]), 2)


def test_no_substitution_escapes_the_masks():
    """Twelve equal words with up to two others among them, at every place where those may stand."""
    seeds = K.Seeds([(1, " ".join(W[:14]))], 12, K.MASKS)
    for bad in [(), *itertools.combinations(range(1, 13), 1), *itertools.combinations(range(1, 13), 2)]:
        for n in {12 + len(bad), 14}:
            if all(b < n - 1 for b in bad):
                text = " ".join(f"x{k}" if k in bad else w for k, w in enumerate(W[:n]))
                assert seeds.find(f"before {text} after", 2)[0][1] == n - len(bad), bad


def test_overlaps_match_brute_force_both_ways(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(W) for _ in range(30))) for i in range(6)]
    docs = []
    for d in range(90):
        text = [rng.choice(W) for _ in range(50)]
        x = items[d % 6][1].split()
        k = rng.randrange(8, 28)
        at = rng.randrange(30 - k)
        part = x[at : at + k]
        for b in rng.sample(range(k), rng.randrange(4)):
            part[b] = "y"
        text[10:10] = part
        docs.append((d, " ".join(text)))

    def best(a, b):
        most = 0
        for shift in range(-len(b), len(a)):
            same = [a[j + shift] == b[j] for j in range(len(b)) if 0 <= j + shift < len(a)]
            for i in range(len(same)):
                off = equal = 0
                for y in same[i:]:
                    off, equal = off + (not y), equal + y
                    if off > 2:
                        break
                    most = max(most, equal)
        return most

    want = {(d, i): n for d, t in docs for i, x in items if (n := best(K.words(t), K.words(x))) >= 12}
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for k in ({}, {"max_items": 2}):
        assert {(r["doc_id"], r["item_id"]): r["equal"] for r in K.leaked(d, i, **k).collect()} == want
    assert want


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(W[:20])), (2, None), (3, "short")], "item_id bigint, text string")
    assert K.leaked(none, items).count() == 0
    docs = spark.createDataFrame([(1, " ".join(W[:20])), (1, " ".join(W[:20])), (2, "x " * 200_000)], "doc_id bigint, text string")
    assert K.leaked(docs, items).count() == 2
    assert K.leaked(docs, items.filter("item_id > 5")).count() == 0


def test_repeats_and_null_ids_both_ways(spark):
    docs, items = data()
    docs = [*docs, *docs[:40], (docs[0][0], docs[3][1]), (None, docs[0][1]), (None, docs[0][1]), (None, docs[3][1])]
    items = [*items, items[0], items[3], (None, items[0][1]), (items[3][0], items[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda **k: sorted((tuple(r) for r in K.leaked(d, i, **k).collect()), key=str)
    assert rows(max_items=3) == rows() and len(set(rows())) < len(rows())
    assert any(r[0] is None for r in rows()) and any(r[1] is None for r in rows())
