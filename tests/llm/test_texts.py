import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import blocks, encoding, forms, language, markup, quality, residue, scans

FRENCH = "La vanne de l’été «Bavok» était fermée à côté du dépôt, où l’équipe répète sa leçon. Le réseau a été vérifié après la première étape — tout fonctionne."
GERMAN = "Die Prüfstelle für die Qualität übermittelt das Gerät an der östlichen Rampe, während größere Posten warten. Das Aggregat läuft wieder."
ENGLISH = "The crew checks the valve in the cold area before the end of the month. It was not received, because the piece is no longer made."
SPANISH = "La válvula del muelle no se ha recibido todavía, aunque el plazo parezca corto. El año pasado se revisó la instalación según las notas."
ITALIAN = "La valvola della banchina non è stata ricevuta, perché il pezzo non si produce più. La squadra ha già verificato la linea dopo la riunione."
EDGES = [(100, 0, None), (101, 0, ""), (102, 0, " \n\t"), (103, 0, "\xa0"), (104, 0, "word " * 20_000)]


def frame(spark, texts, extra=EDGES):
    rows = [(i, 0, t) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, pos int, content string").selectExpr("*", "1 as text", "'x' as clean", "0 as spans")


# p2


@pytest.mark.parametrize("pair", encoding.PAIRS)
def test_garbled_text_comes_back(pair):
    for text in (FRENCH, GERMAN):
        try:
            garbled = encoding.garble(text, pair)
        except UnicodeError:
            continue
        repaired, spans = encoding.repair(garbled)
        assert spans, (pair, garbled)
        wrong = sum(a != b for a, b in zip(repaired, text)) + abs(len(repaired) - len(text))
        assert wrong <= 0.03 * len(text), (pair, repaired)


def test_a_garbled_passage_is_found_in_clean_text():
    mixed = f"{FRENCH} {encoding.garble(FRENCH, ('utf-8', 'cp1252'))} {FRENCH}"
    assert encoding.repair(mixed)[0] == f"{FRENCH} {FRENCH} {FRENCH}"


@pytest.mark.parametrize("text", [FRENCH, GERMAN, SPANISH, ITALIAN, "(проверка) (αρχείο) AÇÃO-3 Ångra", "(AÇÃO-3) and (SÃO TALVO) and ÉTÉ", "1¼ cups of 5 m²", "Le ｒａｐｐｏｒｔ  ﬁn", "Pourquoi? Oui. Price 5 € · 7 °C", "сontrol lоcatif", "wher¬\neas", ""])
def test_clean_text_is_left_alone(text):
    assert encoding.repair(text) == (text, [])


def test_lost_characters():
    assert encoding.is_garbled("le v?hicule gr?ce") and encoding.is_garbled("l’�tage") and not encoding.is_garbled("What? Nothing.")


def test_what_the_filter_drops_has_no_span():
    """The sum of gains bounds what Viterbi can find, on texts of all kinds and with the filter switched off."""
    r = random.Random(7)
    texts = [FRENCH, GERMAN, SPANISH, ITALIAN, "– the archive;\n" * 12, "low ÔÇö the pump", "shown ù the report", "a — b “c” d’e", "L’ÉTÉ À CÔTÉ"]
    for _ in range(400):
        own = r.choice(texts[:4])
        i = r.randrange(len(own))
        part = own[i : i + r.randrange(1, 30)]
        try:
            part = encoding.garble(part, r.choice(encoding.PAIRS))
        except UnicodeError:
            pass
        texts.append(own[:i] + part + own[i + len(part) :])
    keep = encoding.may_be_garbled
    told = [(t, keep(t)) for t in texts]
    encoding.may_be_garbled = lambda t: True
    try:
        assert [t for t, may in told if encoding.labels(t) and not may] == []
    finally:
        encoding.may_be_garbled = keep
    assert 0 < sum(may for _, may in told) < len(told)


@pytest.mark.parametrize("text", ["– the archive;\n– the expense;\n" * 8, "prix 5 £\n" + "– le prix;\n" * 12, "a ó b", "— à — è —"])
def test_lists_and_lone_letters_are_clean(text):
    assert encoding.labels(text) == []


@pytest.mark.parametrize("text", ["remains low ÔÇö the pump", "already shown ù the report", "die Ãœbersicht im"])
def test_single_garbled_signs(text):
    assert encoding.is_garbled(text)


def test_garbled_rows(spark):
    df = frame(spark, [FRENCH, encoding.garble(FRENCH, ("utf-8", "latin-1"))])
    assert [(r.doc_id, r.repaired) for r in encoding.garbled_rows(df).collect()] == [(1, FRENCH)]
    assert encoding.garbled_rows(df.limit(0)).count() == 0


# p4


@pytest.mark.parametrize(
    ("text", "form"),
    [("ｆｕｌｌ Ａ", "full A"), ("e\u0301t\u00e9", "été"), ("ﬁn", "fin"), ("a b c", "a b c"), ("in​vis\xadible", "invisible"), ("сontrol", "control"), ("K", "K"), ("x\r\n\ty", "x\r\n\ty")],
)
def test_consistent_form(text, form):
    assert forms.consistent(text) == form


@pytest.mark.parametrize("text", ["“a” ‘b’ – — • … ".replace("… ", ""), "déjà", "проверка αρχείο", "l’été"])
def test_consistent_texts_stay(text):
    assert forms.consistent(text) == text and not forms.mixed_scripts(text)


def test_consistent_forms_are_stable():
    points = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000))]
    r = random.Random(5)
    texts = points + ["".join(r.choice(points[:2500]) for _ in range(6)) for _ in range(20_000)] + ["e\u034f\u0301", "p\u0435\u0301n"]
    once = forms.consistent_values(texts)
    assert forms.consistent_values(once) == once and once[-2:] == ["é", "pén"]
    assert not [t for t, f in zip(texts, once) if t != f and not forms.may_change(t)]
    folded = forms.folded_values(texts)
    assert forms.folded_values(folded) == folded and forms.folded_values(["\u0390", "Straße", None, ""]) == ["\u0390", "strasse", None, ""]


def test_inconsistent_rows(spark):
    df = frame(spark, [FRENCH, "le ｂｕｔ", encoding.garble(FRENCH, ("utf-8", "cp1252")) + " ｂｕｔ"])
    assert [(r.doc_id, r.consistent) for r in forms.inconsistent_rows(df).collect()] == [(1, "le but")]
    keys = df.select("doc_id", forms.fold_key(F.col("content")).alias("k"), forms.consistent_form(F.col("content")).alias("c")).where("doc_id in (1, 100, 101)").collect()
    assert {r.doc_id: (r.k, r.c) for r in keys} == {1: ("le but", "le but"), 100: (None, None), 101: ("", "")}


# p5

LIST = "\n".join(f"{i}) the valve of line {i}" for i in range(1, 9))
TABLE = "\n".join(f"K{i}B;valve;{i}00,5;n/a" for i in range(9))
CONTENTS = "\n".join(f"The valve of the line {i} ........ {i}" for i in range(9))
REFERENCES = "\n".join(f"[{i}] Marlin J., The valve of the line, 200{i}." for i in range(9))
JUNK = "\n".join("tC9G7ZM++Ipc+GBQTRMzfM7+XudlNxbtYexuTBmDzDqW9UJm+YPCalc14QSB" for _ in range(4))


@pytest.mark.parametrize(("text", "prose"), [(FRENCH, True), (ENGLISH.replace(". ", ".\n"), True), (LIST, False), (TABLE, False), (CONTENTS, False), (REFERENCES, False), (JUNK, False), (f"# Title\n\n{ENGLISH}\n\n- a valve\n- a pump", True), (f"{ENGLISH}\n\n{LIST}\n\n{TABLE}", False), (f"{ENGLISH}\n\n{ENGLISH}\n\n{ENGLISH}", True)])
def test_prose(text, prose):
    assert (blocks.prose_share(blocks.parse(text)) >= 0.5) is prose


PLAIN = {"n_words": 100, "mean_word": 5.0, "symbols": 0.05, "line_ends": 0.5, "common": 0.4, "lines": 0.0, "paragraphs": 0.0, "runs": 0.0, "sentences": 0.7}


@pytest.mark.parametrize(
    ("change", "natural"),
    [
        ({}, True), ({"sentences": 0.49}, False), ({"symbols": 0.6}, False), ({"mean_word": 17.0}, False), ({"common": 0.01}, False), ({"common": 0.01, "n_words": 10}, True),
        ({"lines": 0.9}, True), ({"lines": 0.9, "line_ends": 0.1}, False), ({"paragraphs": 0.9, "line_ends": 0.1}, False), ({"runs": 0.9, "line_ends": 0.1}, False),
        ({"lines": 0.9, "line_ends": 0.1, "sentences": 0.9}, True),
    ],
)
def test_each_rule_of_prose(change, natural):
    assert quality.is_natural(**(PLAIN | change)) is natural


def test_shares_of_runs_by_brute_force():
    from collections import Counter

    r = random.Random(3)
    texts = [[r.choice(["a", "b", "cd", "efg", "hiiii"]) for _ in range(r.randrange(30))] for _ in range(200)]
    got = quality.top_shares(texts)
    for n in quality.RUNS:
        for k, w in enumerate(texts):
            runs = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            most = max((times * sum(map(len, g)) for g, times in runs.items() if times > 1), default=0)
            assert got[n - 2][k] == pytest.approx(min(1.0, most / max(1, sum(map(len, w)))))
    assert all(x.tolist() == [0.0] for x in quality.top_shares([[]])) and all(not len(x) for x in quality.top_shares([]))


def test_statistics(spark):
    got = {r.doc_id: r for r in quality.text_statistics(frame(spark, ["The end. The end.\nThe end. The end.", TABLE])).collect()}
    a = got[0]
    assert (a.n_words, a.line_end_share, a.duplicate_lines) == (8, 1.0, 0.5) and a.top_run_share > 0.5 and got[101].n_words == got[100].n_words == 0
    assert sorted(r.doc_id for r in quality.unnatural_rows(frame(spark, [ENGLISH, TABLE, LIST], EDGES[:4])).collect()) == [1, 2]
    assert quality.text_statistics(frame(spark, []).limit(0)).count() == 0


# p1


def sample():
    r = random.Random(2)
    out = []
    for lang, text in zip(language.LANGUAGES, (ENGLISH, FRENCH, GERMAN, SPANISH, ITALIAN)):
        words = text.split()
        out += [(" ".join(r.sample(words, 12)), lang) for _ in range(60)]
    return [t for t, _ in out], [k for _, k in out]


def test_languages_and_segments(spark):
    model = language.fit(*sample())
    df = frame(spark, [f"{ENGLISH} {FRENCH}", GERMAN, TABLE, f"- {ITALIAN[:30]}\n\n{SPANISH}"])
    got = sorted((r.doc_id, r.segment, r.lang, r.n_sentences) for r in language.language_segments(df, model, prose_only=True).where("doc_id < 100").collect())
    assert got == [(0, 0, "en", 2), (0, 1, "fr", 2), (1, 0, "de", 2), (3, 0, "es", 2)]
    assert all(0 <= r.confidence <= 1 for r in language.document_languages(language.language_segments(df, model)).collect())
    assert model.classify([])[0].shape == (0,) and model.classify(["12 !"])[1][0] == 0


def test_held_out_accuracy(spark, folder):
    documents, sections = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents_out", "sections"))
    texts, labels = language.labelled_sample(sections, documents)
    model = language.fit(texts[::2], labels[::2])
    found, _ = model.classify(texts[1::2])
    right = sum(language.LANGUAGES[a] == b for a, b in zip(found, labels[1::2]))
    assert right >= 0.9 * len(found)  # the rest is mostly labels that are wrong on purpose


@pytest.mark.parametrize(("label", "names"), [("fra+eng", ["en", "fr"]), ("en-GB,deu", ["de", "en"]), ("ITA", ["it"]), ("und", []), ("", []), (None, []), ("n/a", []), ("xx", [])])
def test_labels(label, names):
    assert language.declared(label) == names


def test_undeclared(spark):
    found = spark.createDataFrame([(1, 0, "en"), (1, 0, "fr"), (2, 0, "fr"), (3, 0, "de")], "doc_id long, pos int, lang string")
    docs = spark.createDataFrame([(1, "fra"), (1, "fra"), (2, None)], "doc_id long, language string")
    assert sorted(tuple(r) for r in language.undeclared(found, docs).collect()) == [(1, 0, "en"), (2, 0, "fr"), (3, 0, "de")]


# p7


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ("<h2>One</h2><p>a <b>b</b> &eacute;</p><ul><li>x<li>y</ul>", "## One\n\na b é\n\n- x\n- y"),
        ("### One\n\na **b** _c_ ~~d~~ `e` [f](g)", "### One\n\na b c d e f"),
        ("== One ==\n\n'''a''' [[b|c]] {{d}}<ref name=x/>", "## One\n\na c"),
        ("\\section{One}\n\n\\textbf{a} d\\'{e}j\\`a \\cite{x}\n\\[ a = \\frac{1}{2} \\]", "## One\n\na déjà\n\n$$a = \\frac{1}{2}$$"),
        ("text\n\n```\nx = **1**\n```", "text\n\n```\nx = **1**\n```"),
    ],
)
def test_markup(text, cleaned):
    assert markup.clean(text).text == cleaned and markup.clean(text).n_marks > 0


@pytest.mark.parametrize("text", ["• a\n- b\n1) c\n(a) d", "see [7] and [12]", "from $48 to $12, or 5 $", "a < 24 und\n> 10 bleiben", "— 5 —\n- 6 -", "+^-:./@+,@;%(!@@?^", "a & b; R&D", "it's 'so' l''a", "x_1 and y_2", "f(x) = 2 * 3 * 4", ""])
def test_plain_typing(text):
    assert not markup.has_marks(text)


NOISE = "@^?%/ ,):;.:^:? ;;^^(^;^!: @@?%@ :((:!/^+^)+-)@)@@/^. )(/"


@pytest.mark.parametrize(
    ("text", "marks"),
    [
        (f"{NOISE}\n\nq *zz* k\n\n{NOISE}", 0), (f"{NOISE}\n\nq *zz* k\n\n{ENGLISH}", 1), ("q *zz* k", 1), (f"{NOISE}\n\nq *zz* k", 0), (f"{NOISE} *zz* {NOISE}", 0),
        (f"{NOISE}\n\nq <b>z</b> k\n\n{NOISE}", 2), (f"{ENGLISH} *zz* and", 1),
    ],
)
def test_weak_marks_in_junk_are_chance(text, marks):
    """Short blocks are decided by their neighbours: without the second pass the first and the fourth case have a mark."""
    assert markup.count_marks(text) == marks


def test_blocks_inherit_labels():
    links = "<a href=x>Home of the portal</a> <a href=y>News of it</a>"
    assert markup.label_blocks([links, "All", links, "More", ENGLISH, "Less", NOISE, "q z"]) == ["bad", "bad", "bad", "good", "good", "good", "junk", "junk"]
    assert markup.label_blocks([]) == [] and markup.label_blocks(["All"]) == ["good"]


def test_marked_rows_and_boilerplate(spark):
    df = frame(spark, ["plain", "a **b** c", "<p><a href=x>Home</a> | <a href=y>News</a></p><p>" + ENGLISH + "</p>"])
    got = {r.doc_id: r for r in markup.marked_rows(df).collect()}
    assert set(got) == {1, 2} and got[1].clean == "a b c" and got[2].clean == ENGLISH and got[2].n_dropped == 1
    assert markup.clean(None) is None and markup.clean("").text == "" and markup.marked_rows(df.limit(0)).count() == 0


# p3


def lexicon():
    words = (f"{FRENCH} {ENGLISH} sous-sol technique service modern corner").lower()
    counts = {w: 2000 for w in scans.WORD.findall(words)}
    return scans.Lexicon(counts, frozenset({"sous-sol"}), 200_000)


def test_words_are_decoded():
    lex = lexicon()
    assert lex.decode([("tech", "-"), ("nique", "")]) == [("technique", "h")]
    assert lex.decode([("sous", "-"), ("sol", "")]) == [("sous", ""), ("sol", "")]
    assert lex.decode([("ser", " "), ("vice", "")]) == [("service", "m")]
    assert [w for w, _ in lex.decode([("thecrew", "")])] == ["the", "crew"]
    assert lex.decode([("techn!que", "")]) == [("technique", "c")] and lex.decode([("bavok", "")])[0][1] == ""


@pytest.mark.parametrize(("text", "broken", "misread"), [("the tech-\nnique", True, False), ("the tech=\r\nnique", True, False), ("the tech�\nnique", True, False), ("fini�\ndu", False, False), ("au sous-\nsol", False, False), ("the serv1ce here", False, True), ("the rnodern corner", False, True), ("K3B R-45 T9D code", False, False), ("fine service.", False, False), ("The expe-", True, False)])
def test_scan_noise_in_words(text, broken, misread):
    lex = lexicon()
    assert (scans.has_break(text, lex), scans.has_misread(text, lex)) == (broken, misread)


@pytest.mark.parametrize(("lines", "found"), [(["One goes on", "here and there", "— 5 —", "and goes on here", "to its", "end."], True), (["12"], False), (["K3B 4", "7 | 5", "12", "13", "8 | 9", "y z"], False), (["\u200b", "a b c"], False)])
def test_page_numbers_between_lines(lines, found):
    assert scans.has_page_line(lines) is found


@pytest.mark.parametrize(("line", "is_page"), [("— 5 —", True), ("- 4 -", True), ("3 / 7", True), ("p. 5/7", True), ("Seite 2 von 5", True), ("Page 3", True), ("12", True), ("iv", True), ("6270/23", False), ("1024/15.", False), ("chapter 3", False)])
def test_page_lines(line, is_page):
    assert scans.page_line(line) is is_page


def test_repair_of_a_scan():
    got = scans.repair("A RUNNING TITLE\nThe crew checks the valve in the cold area be-\nfore the end of the rnonth.\n— 5 —", lexicon(), frozenset({scans.title_key("A running title")}))
    assert got == "The crew checks the valve in the cold area before the end of the month."
    assert scans.repair(None, lexicon()) is None and scans.repair("", lexicon()) == ""


def test_scan_noise(spark):
    titles = ["The report of the design office    1", "THE REPORT OF THE DESIGN OFFICE - p. 2", "The rep0rt of the design offlce | 3"]
    rows = [(1, i, f"{t}\nThe crew of part {i} checks valve {'abc'[i]} now.") for i, t in enumerate(titles)] + [(2, 0, "Fine text here.\n— 5 —"), (2, 0, "Fine text here.\n— 5 —"), (3, 0, "Fine."), (3, 1, None)]
    df = spark.createDataFrame(rows + EDGES, "doc_id long, pos int, content string").withColumn("doc", F.lit(1))
    got = {(r.doc_id, r.pos): r for r in scans.scan_noise(df, scans.build_lexicon(df)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0)} and got[2, 0].page_number and all(got[1, i].running_title for i in range(3))
    assert scans.scan_noise(df.limit(0), scans.build_lexicon(df.limit(0))).count() == 0


def test_windows_of_long_documents(spark):
    """Titles that stand within a span are found wherever windows begin, others only where a window holds them."""
    titled = {2, 5, 6, 9, 21, 40}
    r = random.Random(11)

    def other():
        return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)).capitalize()

    rows = [(1, i, f"{'The report of the design office' if i in titled else other()}\nThe crew checks part {'abcdefgh'[i % 8]}{'xyz'[i % 3]} now.") for i in range(50)]
    df = spark.createDataFrame(rows + rows[:7], "doc_id long, pos int, content string")
    for span, expected in ((5000, titled), (5, {2, 5, 6, 9}), (12, {2, 5, 6, 9, 21})):
        got = scans.scan_noise(df, lexicon(), span=span).where("running_title").collect()
        assert sorted(r.pos for r in got) == sorted(expected), span


def test_the_whole_stream_is_decoded():
    lex = lexicon()
    text = "The ser vice of\nthecrew is mod\nern in the cold area."
    assert [(text[i:j], w, o) for i, j, w, o in scans.stream_operations(text, lex)] == [("ser vice", "service", "m"), ("thecrew", "the crew", "split"), ("mod\nern", "modern", "mn")]
    assert scans.repair(text, lex) == "The service of the crew is modern in the cold area."
    assert scans.stream_operations("The crew checks, 5 K3B in the area.", lex) == []
    long = [f"the crew checks the valve in the cold area {'abc'[i % 3]}" for i in range(150)]
    assert scans.repair("\n".join(long), lex) == " ".join(long)


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        (["the crew checks the valve", "in the cold area."], ["the crew checks the valve in the cold area."]),
        (["The crew checks", "", "the valve", "", "in the cold area."], 2),  # a piece joins a neighbour, which blank lines alone wouldn't make it do
        (["The crew checks the valve.", "", "The end of the month."], 2), (["The end.", "The crew checks the valve in the cold area now"], 2), (["Area:", "- the valve", "- the crew"], 3), ([], 0), (["", " "], 0), (["crew"], 1),
    ],
)
def test_paragraphs_at_least_cost(lines, expected):
    got = scans.paragraphs(lines, lexicon())
    assert got == expected if isinstance(expected, list) else len(got) == expected


def brute_paragraphs(lines):
    """The least cost over all ways to begin paragraphs."""
    from itertools import product

    texts = [x.strip() for x in lines if x.strip()]
    before, blank = [], True
    for x in lines:
        if x.strip():
            before.append(blank)
        blank = not x.strip()
    width = max(map(len, texts))

    def piece(x):
        return scans.PIECE * (x[0].islower() and x[-1] not in ".!?:" and blocks.line_kind(x) == "text")

    def cost(begins):
        total = 0.0
        for k, begin in enumerate(begins):
            last = k + 1 == len(begins) or begins[k + 1]
            total += piece(texts[k]) * (begin and last) + scans.BEGIN * begin
            if not begin:
                a, b = texts[k - 1], texts[k]
                end = a[-1] in ".!?:"
                total += (scans.WITHIN if b[0].islower() and not end else scans.AT_BLANK) * before[k] + scans.AT_END * (end and (b[0].isupper() or not b[0].isalnum()) and len(a) < 0.7 * width)
                total += scans.AT_KIND * (not b[0].islower() and blocks.line_kind(b) != "text")
        return total

    return min((cost((True, *rest)), sum(rest) + 1) for rest in product((True, False), repeat=len(texts) - 1))


def test_paragraphs_against_all_ways():
    r = random.Random(12)
    for _ in range(150):
        lines = [r.choice(["", "the crew checks", "the valve.", "The crew checks the valve", "The area of the crew is cold now.", "- the valve", "in the"]) for _ in range(r.randrange(2, 9))]
        if any(lines):
            assert scans.begin_paragraphs(lines)[2] == pytest.approx(brute_paragraphs(lines)[0])


def test_windows_give_what_the_whole_stream_gives():
    lex, r = lexicon(), random.Random(4)
    for _ in range(200):
        pieces = [r.choice(["ser", "vice", "thecrew", "the", "crew", "mod", "ern", "sous", "sol", "cold", "xqz", "area"]) for _ in range(12)]
        seps = [r.choice([" ", " ", "\n"]) for _ in range(11)] + [""]
        whole = [w for w, _ in lex.decode(list(zip(pieces, seps)))]
        text = "".join(a + b for a, b in zip(pieces, seps))
        for i, j, w, _ in reversed(scans.stream_operations(text, lex)):
            text = text[:i] + w + text[j:]
        assert text.split() == whole


def test_no_like_title_is_missed():
    r = random.Random(6)
    base = ["".join(r.choice("abcdeil ") for _ in range(r.randrange(8, 40))) for _ in range(40)]
    keys = list(dict.fromkeys("".join(c if r.random() > 0.12 else r.choice("abcdeil ") for c in r.choice(base)) for _ in range(600)))
    alike, compared, left = scans.Alike(keys), scans.Alike(keys, few=1000), dict.fromkeys(keys, 1)
    pairs = 0
    for k in keys:
        near = alike.near(k, left)
        assert near == compared.near(k, left)
        assert near == {x for x in keys if scans.similarity(k, x) >= scans.ALIKE} | {k}
        pairs += len(near) - 1
    assert pairs > 1000


def test_repaired_rows(spark):
    titles = ["The report of the design office    1", "THE REPORT OF THE DESIGN OFFICE - p. 2", "The rep0rt of the design offlce | 3"]
    rows = [(1, i, f"{t}\nThe crew of part {i} checks the serv-\nice {'abc'[i]} now.") for i, t in enumerate(titles)] + [(2, 0, "The mod\nern service."), (2, 0, "The mod\nern service."), (3, 0, None), (4, 0, "Fine.")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, content string")
    got = {r.doc_id * 10 + r.pos: r for r in scans.repaired_rows(df, lexicon()).collect()}
    assert {k: r.repaired for k, r in got.items()} == {**{10 + i: f"The crew of part {i} checks the service {'abc'[i]} now." for i in range(3)}, 20: "The modern service.", 30: None, 40: "Fine."}
    assert got[20].broken and got[40].broken is None


# p10


@pytest.mark.parametrize("text", ["Dear {{name}}, hello", "vom ${datum_1}.", "le [[PRÉNOM]] du", "<%= name %>", "%%x%%", "@@X@@", "__name_1__", "#client#", "<<nom>>", "[INSERT TITLE HERE]", "<your text>", "le XX/XX/XXXX", "[à compléter]", "{amount}"])
def test_placeholders(text):
    assert residue.has_placeholder(text)


@pytest.mark.parametrize("text", ["The letter template replaces the field “{{amount}}” when it is sent.", "Le script lit la variable ${nom} avant.", "see [12] and [...]", "a < b > c", "5 % and 7 %", "#1 and #2", "snake_case_name"])
def test_no_placeholders(text):
    assert not residue.has_placeholder(text)


def test_residue_spreads_to_near_duplicates_only(spark):
    message = "Your browser does not support scripts so the document on this page of the portal cannot be shown to you at the moment please come back later"
    near = message.replace("support scripts", "support s c r i p t s")
    texts = [f"{ENGLISH}\n{message}", ENGLISH, "Erreur 404 : la page demandée est introuvable.", "When the portal answers error 404, the administrator checks the link.", "lorem ipsum dolor sit amet enim", "Dear {{name}}", near]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, " "), (0, texts[0]), (53, ENGLISH.replace("\n", " ") * 500)], "doc_id long, text string").withColumn("unit", F.lit(1))
    got = sorted(r.doc_id for r in residue.residue_rows(df).collect())
    assert residue.jaccard(message.lower(), near.lower()) < residue.SIMILARITY and got == [0, 2, 4, 5]
    assert residue.residue_rows(df.limit(0)).count() == 0
    assert residue.jaccard("a b c d e f", "a b c d e f") == 1 and residue.jaccard("a b", "a c") == 0


@pytest.mark.parametrize(("text", "kind"), [("xxxx xxx xxxxxxx xx xxxxx.", 2), ("Please switch on JavaScript in your browser.", 2), ("Oops! That page can't be found.", 2), ("Error 404: " + "the page of the portal " * 12, 2), ("Dear %(name)s,", 3), ("The code is XX-4855 now.", 0), ("If error 404 comes, call us.", 1)])
def test_labels_of_units(text, kind):
    assert [k for k, _ in residue.labelled_units(text)][-1] == kind


@pytest.mark.parametrize("length", [15, 20, 30, 60])
def test_near_duplicates_of_residue_are_all_found(spark, length):
    """Each text differs by one word from the one before and holds no fixed form itself."""
    r = random.Random(length)
    texts = []
    for _ in range(12):
        words = ["blindtext", *(f"w{r.randrange(10**9)}" for _ in range(length - 1))]
        texts.append(" ".join(words))
        for k in (0, -1, 1 if length > 40 else -1):
            words[k] = f"v{r.randrange(10**9)}"
            texts.append(" ".join(words))
    assert all(residue.jaccard(a, b) >= residue.SIMILARITY for a, b in zip(texts, texts[1:]) if "blindtext" not in b)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, ENGLISH])], "doc_id long, text string")
    assert sorted(r.doc_id for r in residue.residue_rows(df).collect()) == list(range(len(texts)))


def test_prefixes_miss_no_pair():
    r = random.Random(1)
    tried = 0
    for _ in range(600):
        a = [f"w{r.randrange(10**9)}" for _ in range(r.randrange(5, 80))]
        b = list(a)
        for _ in range(r.randrange(1, 3)):
            k = r.choice([0, len(b) - 1, r.randrange(len(b))])
            b[k : k + r.randrange(2)] = [f"v{r.randrange(10**9)}"]
        if residue.jaccard(" ".join(a), " ".join(b)) >= residue.SIMILARITY:
            tried += 1
            _, (x, y) = residue.prefixes(residue.word_codes(a + b), residue.np.array([len(a), len(b)]))
            assert set(x.tolist()) & set(y.tolist())
    assert tried > 100


@pytest.mark.parametrize("first", ["XX", "DD", "JJ", "TT", "MM", "GG"])
def test_date_placeholders_pass_the_gate(first):
    for sign in "/.-":
        for middle in ("XX", "MM", "DD"):
            for last in ("XXXX", "YYYY", "AAAA", "JJJJ", "YY"):
                date = sign.join((first, middle, last))
                for text in (f"vom {date} an", f"vom {date.lower()} an", f"vom {date.title()} an"):
                    assert residue.has_placeholder(text) and [k for k, _ in residue.labelled_units(text)] == [3], text


def test_null_keys_and_clashing_columns(spark):
    """Rows without keys go through every operator on sections; columns that bear the names of results don't matter."""
    garbled = encoding.garble(FRENCH, ("utf-8", "cp1252"))
    rows = [(None, None, f"{ENGLISH} *zz*"), (None, 1, garbled), (1, None, TABLE), (2, 2, "le ｂｕｔ"), (2, 2, "le ｂｕｔ"), (None, None, None)]
    names = ("clean", "repaired", "consistent", "lang", "is_prose", "segment", "n_marks")
    df = spark.createDataFrame(rows, "doc_id long, pos int, content string").select("*", *[F.lit("x").alias(n) for n in names], F.lit(1).alias("text"))
    assert [(r.doc_id, r.pos) for r in encoding.garbled_rows(df).collect()] == [(None, 1)]
    assert [(r.doc_id, r.pos) for r in forms.inconsistent_rows(df).collect()] == [(2, 2), (2, 2)]
    assert [(r.doc_id, r.pos) for r in quality.unnatural_rows(df).collect()] == [(1, None), (2, 2), (2, 2)]
    assert quality.text_statistics(df).count() == 6
    assert [(r.doc_id, r.pos) for r in markup.marked_rows(df).collect()] == [(None, None)]
    model = language.fit(*sample())
    assert {(r.doc_id, r.pos, r.lang) for r in language.language_segments(df, model).where("lang = 'en'").collect()} == {(None, None, "en")}
    assert scans.scan_noise(df, lexicon()).count() >= 0
