import math
from collections import Counter

from folioflow.llm import sentences as S

EN = ["Dr. Vosk came. The cat sat. Dr. Vosk left. It rained at 5 p.m. and stopped.", "The dog ran. Dr. Hall saw it. The U.S. Office closed.", "Is it? The end. Nobody saw. Dr. Moor sat. Nobody came."] * 12


def llr(k1, n1, k2, n2):
    def ll(k, n, p):
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    if not n1 or not n2:
        return 0.0
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    out = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    return out if p1 >= p2 else -out


def brute(rows):
    """The model from (language, event, key) counts, in plain Python."""
    by = {}
    for (lang, event, key), n in rows.items():
        by.setdefault(lang, {}).setdefault(event, {})[key] = n
    out = S.Model()
    for lang, ev in by.items():
        get = lambda e: ev.get(e, {})  # noqa: E731, B023
        stop, bare, start, inner, pair = map(get, ("stop", "bare", "start", "inner", "pair"))
        n_stop, n_all = sum(stop.values()), sum(stop.values()) + sum(bare.values())
        found = set()
        for w, k in stop.items():
            x = w.replace(".", "")
            n = k + bare.get(w, 0)
            if any(c.isalpha() for c in x) and llr(k, n, n_stop - k, max(1, n_all - n)) * math.exp(-len(x)) * (w.count(".") + 1) * float(len(x)) ** -bare.get(w, 0) >= S.ABBREVIATION_LLR:
                found.add(w)
        seen = {w: start.get(w, 0) + inner.get(w, 0) for w in {*start, *inner}}
        n_start, n_words = sum(start.values()), sum(seen.values())
        starters = {w for w, k in start.items() if (len(w) > 1 or not w.isascii()) and k / seen[w] >= S.STARTER_SHARE and llr(k, seen[w], n_start - k, max(1, n_words - seen[w])) >= S.STARTER_LLR}
        firsts, seconds, ends, upper, bound = Counter(), Counter(), Counter(), Counter(), set()
        split = {tuple(p.split("\t")): k for p, k in pair.items()}
        for (a, b), k in split.items():
            firsts[a] += k
            seconds[b] += k
            if b != "#" and not b[:1].islower():
                upper[a] += k
                ends[a] += k * (len(b) > 1) * (start.get(b, 0) >= 0.05 * seen.get(b, 0))
        for (a, b), k in split.items():
            if k > 1 and (b == "#" or k >= 0.3 * seen.get(b, 0)) and b not in starters and llr(k, firsts[a], seconds[b] - k, max(1, sum(pair.values()) - firsts[a])) >= S.COLLOCATION_LLR:
                bound.add((a, b))
        for where, what in ((out.abbreviations, found), (out.starters, starters), (out.collocations, bound), (out.finals, {w for w in found if upper[w] and ends[w] >= 0.8 * upper[w]})):
            if what:
                where[lang] = frozenset(what)
    return out


def model(texts):
    c = Counter()
    for t in texts:
        S.count_text(t, S.language(t), c)
    return brute(c)


def test_ratios_on_executors_are_those_of_brute_force(spark):
    more = ["Er kam am 3. Mai an. Der Hund lief z.B. weg. Die Katze sah Hrn. Moor.", "Vgl. S. 4 und Abb. 7 dort. Die Katze schlief. Er kam am 3. Mai."] * 9
    df = spark.createDataFrame([(t,) for t in EN + more + ["", None]], "text string")
    assert S.learn(df) == model(EN + more)


def cut(text, m):
    b = S.boundaries(text, m)
    return [text[a:e].rstrip() for a, e in zip(b, [*b[1:], len(text)])]


def test_learned_abbreviations():
    m = model(EN)
    assert "dr" in m.abbreviations["en"] and "The" in m.starters["en"]
    assert cut("The cat saw Dr. Vosk. The dog ran at 5 p.m. and sat.", m) == ["The cat saw Dr. Vosk.", "The dog ran at 5 p.m. and sat."]


def test_marks_of_other_scripts():
    m = model(EN)
    assert cut("猫が来た。犬も来た！なぜ？", m) == ["猫が来た。", "犬も来た！", "なぜ？"]
    assert cut("「どこですか？」と先生は言った。猫。", m) == ["「どこですか？」と先生は言った。", "猫。"]
    assert cut("पाठक ने पढ़ा। क्या देखा? हाँ।", m) == ["पाठक ने पढ़ा।", "क्या देखा?", "हाँ।"]
    assert cut("“Wait!” said Ann. (It rained.) It cost 3.14 or more.", m) == ["“Wait!” said Ann.", "(It rained.)", "It cost 3.14 or more."]
    assert cut("ครูอ่าน ครูปิด 48 เล่ม", m) == ["ครูอ่าน", "ครูปิด 48 เล่ม"]
    assert cut("„Halt!“, rief Anna. Er ging.", m) == ["„Halt!“, rief Anna.", "Er ging."]
    assert cut("It ran to the barn.Then it sat.", m) == ["It ran to the barn.", "Then it sat."]


def test_operator_edges(spark):
    rows = [(1, "A bit came. Dogs ran.", False), (2, None, False), (3, "  ", True), (4, "Head. Line", True), (1, "A bit came. Dogs ran.", False), (5, "word " * 50_000 + ".", False)]
    df = spark.createDataFrame(rows, "sentence bigint, text string, h boolean")
    m = S.learn(df)
    out = S.split_texts(df, m, whole_col="h")
    got = [tuple(r) for r in out.select("sentence_in", "sentence_no", "char_start").collect()]
    assert got.count((1, 1, 12)) == 2 and (4, 0, 0) in got and sum(x[0] == 4 for x in got) == 1 and not [x for x in got if x[0] in (2, 3)]
    empty = df.limit(0)
    assert S.split_texts(empty, S.learn(empty)).count() == 0


def test_offsets_cover_sections(spark):
    rows = [("d", 0, [["Head"], ["One. ", "Two."], []], [("heading", "# Head", 0, 1, None)]), ("e", 1, None, None)]
    s = spark.createDataFrame(rows, "doc_id string, id int, paragraphs array<array<string>>, blocks array<struct<kind:string,raw:string,para_idx:int,level:int,ordered:boolean>>")
    got = S.section_sentences(s).collect()
    assert {(r["para_idx"], r["char_start"]) for r in got} == {(0, 0), (1, 0), (1, 6)}


def test_documents(spark):
    d = spark.createDataFrame([("a", "# T\n\nOne two\nthree. Four.\n\n```\ncode. More.\n```"), ("b", None)], "id string, markdown string")
    got = [(r["id"], r["sentence"]) for r in S.document_sentences(d).collect()]
    assert ("a", "One two three.") in got and ("a", "T") in got and not any("code" in s for _, s in got)
