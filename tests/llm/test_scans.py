from folioflow.llm import scans as S

W = "open quiet summer long noticed today old near garden letter nobody every".split()
BODY = "The quiet garden covered the old library near the river.\nNobody noticed the letter in the quiet garden today.\nThe library and the river were open every long summer.\n"


def docs(spark):
    rows = []
    for d in range(12):
        pages = [f"THE TITLE OF BOOK {d}\n\n{BODY}The old li-\nbrary by the river {W[(3 * d + p) % 12]} was covered the qui¬\net garden again.\n\nPage {p} of 90" for p in range(1, 4)]
        if d == 0:
            pages[0] = pages[0].replace("noticed", "notíced").replace("every long", "cvery long")
            pages[1] = pages[1].replace("letter in", "well-\nknown letter in")
        rows.append((f"d{d}", f"The title of book {d}", pages, "x"))
    rows += [rows[0], ("n", None, None, "x"), ("e", "", ["", None], "x")]
    return spark.createDataFrame(rows, "id string, title string, raw_pages array<string>, line string")


def ocr(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id string, page int, markdown string, failed boolean")


def test_kinds(spark):
    again = ocr(spark, [("d1", 1, BODY, False), ("d1", 1, BODY, False), ("d1", 2, "", True), ("d1", 3, None, False)] + [("d2", k, "A well-known letter.\n" * 3, False) for k in range(3)])
    got = [tuple(r) for r in S.noise(docs(spark), again).collect()]
    assert len(got) == len(set(got))
    of = lambda d, p, k: sorted(n for f, a, b, n, kind in got if (f, a, b, kind) == ("raw_pages", d, p, k))
    assert of("d3", 2, "furniture") == [1, 10]
    assert of("d3", 2, "hyphen") == [6, 7]
    assert of("d3", 2, "misread") == []
    assert of("d0", 1, "misread") == [4, 5]
    assert of("d0", 2, "hyphen") == [7, 8]  # well-known keeps its hyphen


def test_paragraphs(spark):
    got = S.paragraphs(docs(spark), ocr(spark))
    text = " ".join(r["text"] for r in got.filter("doc_id = 'd0' AND page = 1").collect())
    assert "The old library by the river" in text and "covered the quiet garden again." in text and "noticed" in text and "Page" not in text and "every long" in text


def test_empty(spark):
    assert S.noise(docs(spark).limit(0), ocr(spark)).count() == 0


def test_halves_of_genuine_compounds_are_read(spark):
    pages = [BODY + "The well-known letter was near.\n"] * 6 + [BODY.replace("letter", "well-\nknown letter", 1), BODY.replace("letter", "wcll-\nknown letter", 1), BODY.replace("letter", "well-\nknovvn letter", 1)]
    table = spark.createDataFrame([(f"d{k}", "x", [p], "x") for k, p in enumerate(pages)], "id string, title string, raw_pages array<string>, line string")
    got = {(r["doc_id"], r["line_no"], r["kind"]) for r in S.noise(table, ocr(spark)).collect()}
    assert {x for x in got if x[2] != "furniture"} == {("d7", 2, "misread"), ("d8", 3, "misread")}


def test_context_decides_on_doubtful_forms(spark):
    """A form that is no rarity beside the frequent one is a misreading only where its left neighbour stands before the latter."""
    good, alike = "They saw the letter there.", "We met lctter once."
    pages = ["\n".join([good] * 15 + ["They saw the lctter there."] * 2 + [alike] * 2)]
    table = spark.createDataFrame([("d", "x", pages, "x")], "id string, title string, raw_pages array<string>, line string")
    got = {(r["line_no"], r["kind"]) for r in S.noise(table, ocr(spark)).collect() if r["kind"] == "misread"}
    assert got == {(16, "misread"), (17, "misread")}


def test_stamps_are_learned_from_their_ends(spark):
    """Lines at the edge that end alike in many documents are furniture, whatever stands before."""
    text = BODY.replace("\n", " ").strip()
    pages = [(f"d{k}", "x", [f"{W[k % 12].title()}{k} House Press no. {1900 + k}\n{text}\n{text}\n{text}"], "x") for k in range(12)]
    one = [("z", "x", [f"Lone words told in {1900}\n{text}\n{text}\n{text}"], "x")]
    table = spark.createDataFrame(pages + one, "id string, title string, raw_pages array<string>, line string")
    got = {(r["doc_id"], r["line_no"]) for r in S.noise(table, ocr(spark)).collect() if r["kind"] == "furniture"}
    assert got == {(f"d{k}", 1) for k in range(12)}


def test_runs_of_pages_give_what_whole_documents_give(spark, monkeypatch):
    whole = sorted(map(tuple, S.noise(docs(spark), ocr(spark)).collect()))
    monkeypatch.setattr(S, "RUN", 1)
    assert sorted(map(tuple, S.noise(docs(spark), ocr(spark)).collect())) == whole
