import random

from folioflow.llm import spam as S

N, V, A = "cat dog house river tree stone lamp door road hill boat bird".split(), "sees likes finds takes leaves holds".split(), "old new red small quiet dark".split()


def prose(rng):
    return " ".join(f"The {rng.choice(A)} {rng.choice(N)} {rng.choice(V)} a {rng.choice(N)} in the {rng.choice(N)} and it was with every {rng.choice(N)}." for _ in range(12))


def rows():
    rng = random.Random(1)
    out = [(i, prose(rng)) for i in range(200)]
    out += [(1000 + i, ", ".join(rng.choice(["lamp cheap", "lamp online", "buy lamp", "lamp"]) for _ in range(60))) for i in range(6)]
    out += [(1100 + i, "\n".join(f"- [{rng.choice(N)} {rng.choice(N)}](https://{rng.choice(N)}.example/{k})" for k in range(30))) for i in range(6)]
    out += [(1200 + i, prose(rng) + "\n\n" + "\n".join(f"- {rng.choice(A)} {rng.choice(N)}" for _ in range(5))) for i in range(6)]
    return [*out, (2000, None), (2001, ""), (2002, prose(rng) * 100), (0, out[0][1])]


def test_flags_lists_not_prose(spark):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "doc_id bigint, text string, lang string")
    got = {r["doc_id"] for r in S.score_documents(df).filter("is_spam").collect()}
    assert got == {*range(1000, 1006), *range(1100, 1106)}
    assert S.score_documents(df.limit(0)).count() == 0


def test_languages():
    assert S.language("猫は犬を見た。") == "ja" and S.language("老师发现了列车") == "zh" and S.language("The cat and the dog") == "en" and S.language("Die Katze und der Hund") == "de"
    assert S.language("") == "other"
