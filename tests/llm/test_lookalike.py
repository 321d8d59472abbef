import unicodedata

from attestra.llm.lookalike import look_classes, one_form, readable, same_look, same_looking_pairs

BASE = "Ещё один текст № 5: résumé, код URL и ёлка; MIDI of words."


def variants(t):
    yield unicodedata.normalize("NFD", t)
    yield t.replace(" ", "\u00a0").replace("и", "и\u200b")
    yield t.replace("о", "o").replace("е", "e").replace("I", "\u0406")
    yield t.replace("URL", "\uff35\uff32\uff2c").replace("5", "\uff15").replace(" ", "\u3000", 1)
    yield "\ufeff" + t.replace("кт", "к\u00adт").replace("o", "\u03bf").replace("Е", "\u0395")


def test_same_looks():
    forms = same_look([BASE, *variants(BASE)])
    assert len(set(forms)) == 1
    assert {readable(f) for f in forms} == {BASE}


def test_listed_letters_planes_and_hangul():
    text = "Had a long IDLE hold, длинный ход 한글 각"
    for other in (text.translate(str.maketrans("hdDl", "һԁԀӏ")), text.replace("g", "g\U000e0061"), text.replace("글", "글\U000e0101"), unicodedata.normalize("NFD", text)):
        a, b = same_look([text, other])
        assert a == b and readable(b) == text
    assert readable(same_look(["қазақ һәм had all"])[0]) == "қазақ һәм had all"


def test_ligatures():
    assert same_look(["ﬁnal eﬃcient work\ufb02ow Ⅳ"]) == same_look(["final efficient workflow IV"])
    assert len(set(same_look(["x²", "x2", "½", "1/2"]))) == 4


def test_other_letters_accents_cases_digits_differ():
    others = [BASE.replace("ё", "е"), BASE.lower(), BASE.replace("5", "6"), BASE.replace("é", "e"), BASE + "!", BASE.replace("код", "кот")]
    forms = same_look([BASE, *others])
    assert len(set(forms)) == len(forms)


def test_marks_in_any_order_and_empty_texts():
    assert len(set(same_look(["a\u0323\u0302", "a\u0302\u0323", "\u1ead"]))) == 1
    assert same_look([]) == [] and same_look(["", "\u200b", "x", ""]) == ["", "", "х", ""]


def test_pairs_and_forms(spark):
    rows = [("d1", BASE), ("d2", BASE), *((f"s{i}", v) for i, v in enumerate(variants(BASE))), ("d3", None), ("d4", ""), ("d5", "\u200b"), ("d6", " "), ("d7", BASE[:-1])]
    df = spark.createDataFrame([(r, t, b"") for r, t in rows], "rec string, text string, look binary")
    got = [tuple(r) for r in same_looking_pairs(df).collect()]
    like = [r for r, t in rows if t and r not in ("d4", "d5", "d6", "d7")]
    expected = {(a, b) for a in like for b in like if a < b and dict(rows)[a] != dict(rows)[b]}
    assert len(got) == len(set(got)) and set(got) == expected
    forms = {r["rec"]: r["form"] for r in one_form(df).collect()}
    assert forms["d3"] is None and forms["d5"] == "" and forms["s2"] == BASE
    assert same_looking_pairs(df.where("rec = 'x'")).count() == 0


def test_clusters_of_several_code_points():
    same = [("i\u0307x", "іx"), ("ı\u0307", "i"), ("о\u0338re", "øre"), ("l\u0338\u0301", "ł\u0301"), ("l\u0301\u0338", "ł\u0301"), ("ɡo", "go"), ("ԁog", "dog"), ("һello", "hello"), ("ab\u200dc", "abc")]
    for a, b in same:
        assert same_look([a])[0] == same_look([b])[0], (a, b)
    other = [("👩\u200d👩\u200d👧", "👩👩👧"), ("İ", "I"), ("ї", "і"), ("ø", "o"), ("o\u0308", "o"), ("👍🏽", "👍")]
    for a, b in other:
        assert same_look([a])[0] != same_look([b])[0], (a, b)
    assert same_look(["👩\ufe0f\u200d👧"])[0] == same_look(["👩\u200d👧"])[0]
    assert readable(same_look(["👩\u200d👧 dog"])[0]) == "👩\u200d👧 dog"
    assert same_look(["x", "", "о\u0338", "y"]) == [same_look([t])[0] for t in ("x", "", "ø", "y")]
    for form in ("о\u0338re", "i\u0307", "👩\u200d👧"):
        once = same_look([form])[0]
        assert same_look([once])[0] == once


def test_classes_are_in_proportion_to_records(spark):
    rows = [("d1", "abc"), ("d2", "аbc"), ("d3", "abc"), ("s4", "abd"), ("d5", None), ("d6", ""), ("d7", "\u200b")]
    got = {r["rec"]: (r["look_class"], r["records"], r["forms"]) for r in look_classes(spark.createDataFrame(rows, "rec string, text string")).collect()}
    assert got == {"d1": ("d1", 3, 2), "d2": ("d1", 3, 2), "d3": ("d1", 3, 2), "s4": ("s4", 1, 1), "d6": ("d6", 2, 2), "d7": ("d6", 2, 2)}
