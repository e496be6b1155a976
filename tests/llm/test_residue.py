from folioflow.llm import residue as R
from folioflow.llm.seeds import FAMILIES, Seeds

PROSE = "The cat sat on the mat and looked at the dog. Then it went home to sleep.\n\nAnother day came, and the dog was still there."
BAD = ["Sorry, the image of the page is too blurred to transcribe.", "Lorem ipsum dolor sit amet. Lorem ipsum again.", "# T\n\nPage not found. Return to the start page.", "Please enable JavaScript to view this page."]


def model(seeds=None, bad=BAD):
    texts = [PROSE.replace("cat", f"cat{i}") for i in range(40)] + bad * 5
    return R.fit([R.parts(t, False, None) for t in texts], seeds)


def is_bad(text, m, wrapped=False):
    holes, residue, prose = R.judge(R.parts(text, wrapped, None), m, {})
    return holes > 0 or R.outweighs(residue, prose)


def test_judgements():
    m = model()
    assert all(is_bad(b, m) for b in BAD)
    assert is_bad("# T\n\nDear {{ user.name }}, hello.\n\n" + PROSE, m)
    assert not is_bad("# T\n\n" + PROSE, m)
    assert not is_bad("# T\n\n“[INSERT NAME HERE]” was the title of the play.\n\n" + PROSE, m)
    assert not is_bad("# T\n\nOne writes `${name}` there.\n\n```\nrender('{{ x.y }}')\n```\n\n" + PROSE, m)
    assert not is_bad("# T\n\nPage not found, said the cat, was honest.\n\n" + PROSE, m)
    assert not is_bad("", m) and not is_bad(None, m)


def test_words_alone_carry_over():
    m = model()
    assert m.score("Sorry, this image is too blurred for us") > 0 > m.score("The dog went home to sleep")


def test_a_family_held_out_is_found_by_its_words():
    """Fitted without the seeds of errors, the model still finds an error page by what it shares with the rest."""
    m = model(Seeds(tuple(f for f in FAMILIES if f != "errors")), [*BAD, "Please enable JavaScript. Return to the start page."])
    assert is_bad("# T\n\nReturn to the start page.", m) and not is_bad("# T\n\n" + PROSE, m)


def test_every_part_is_implied_by_its_pattern():
    """Each seed's examples pass the parts that are looked for first."""
    said = [
        "Return: page not found", "Oops! That page has gone missing.", "404 — the page about x could not be found.", "not available in your region", "Access denied.", "Session expired", "Your session has expired",
        "Service temporarily unavailable", "was moved or deleted", "Too many requests", "Fatal error: x", "Checking your browser", "Your browser is too old", "Seite nicht gefunden", "Page introuvable",
        "La página solicitada no existe.", "página no encontrada", "ページは見つかりません", "JAVASCRIPT", "スクリプト", "This page requires scripts", "allow scripts", "Lorem ipsum", "asdf", "xxx xxxx",
        "Blindtext", "Sample text.", "click to edit", "Add your x text here", "TK TK", "[illegible]", "unable to read", "too blurred to", "Here is the Markdown", "Extracted text will", "the model stopped", "<page_content/>", '{"error"',
    ]
    seeds = Seeds()
    assert all(seeds.match(x) for x in said)
    for parts, pattern in seeds.patterns:
        assert any(pattern.search(x) for x in said), pattern.pattern
    assert not seeds.match("The manuscript supported the shelf.")


def test_furniture_of_real_records_stays_negative():
    """A line that real records hold as well does not turn positive by the words it shares with seeds."""
    line = "Please view this page in colour."
    texts = [PROSE.replace("cat", f"cat{i}") + "\n\n" + line for i in range(40)] + ["Please enable JavaScript to view this page.\n\n" + line] * 3
    m = R.fit([R.parts(t, False, None) for t in texts])
    assert m.score(line) < R.THRESHOLD < m.score("Please enable JavaScript to view this page.")


def test_the_same_records_give_the_same_model():
    assert model().odds == model().odds


def test_operator(spark):
    a = spark.createDataFrame([(i, "s", "# T\n\n" + PROSE.replace("cat", f"cat{i}")) for i in range(20)] + [(50, "s", BAD[2]), (51, None, None), (52, "s", ""), (50, "s", BAD[2])], "article_id bigint, domain string, markdown string")
    o = spark.createDataFrame([("d", 1, BAD[0], False), ("d", 1, BAD[0], False), ("d", 2, BAD[0], True), ("e", 1, PROSE, False), ("f", 1, None, False)], "doc_id string, page int, markdown string, failed boolean")
    got = R.flag_records(a, o)
    bad = [(r["record_table"], r["record_key"]) for r in got.filter("is_residue").collect()]
    assert sorted(bad) == [("articles", "50"), ("articles", "50"), ("ocr_results", "d#1")]
    assert R.flag_records(a.limit(0), o.limit(0)).count() == 0
