from attestra.llm.encoding import CONFUSED, READ_AS, LetterModel, count_pairs, garbled, pair_counts, restore, to_bytes

RU = "Для исторической федерации сотрудничества применяется итоговая ценность, которая раскрывает городской жанр — «Модель № 7». Кроме того, система включает проверку."
DE = "Die gründliche Übung fördert die ländliche Ausbildung der Messung größer als möglich."
EN = "The “quoted” process isn’t covered – it is described elsewhere."


def misread(text, encoding):
    char = {b: chr(c) for c, b in to_bytes(encoding).items()}
    return "".join(char.get(b, chr(b)) for b in text.encode())


def test_utf8_read_as_legacy_round_trips():
    model = LetterModel([])
    for text in (RU, DE, EN):
        for encoding in READ_AS:
            bad = misread(text, encoding)
            if encoding in ("koi8_r", "cp866", "iso8859_5", "mac_cyrillic") and text == DE:
                continue  # Latin letters with marks have no such history
            got = restore([bad], model)[0]
            assert got and got[0] == text, (encoding, got)
    for encoding in ("cp1251", "cp1252"):
        for text in (RU, EN):
            assert restore([misread(misread(text, encoding), encoding)], model)[0][0] == text
    half = RU[:40] + misread(RU[40:90], "cp1251") + RU[90:]
    assert restore([half], model)[0][0] == half[:0] + RU


def test_single_byte_mix_ups_are_found():
    model = LetterModel([])
    text = RU.replace("—", "-").replace("«", '"').replace("»", '"').replace("№", "N")
    for read_as, was in CONFUSED:
        if {read_as, was} == {"mac_cyrillic", "cp1251"}:
            continue  # small letters are the same bytes in both
        char = {b: chr(c) for c, b in to_bytes(read_as).items()}
        bad = "".join(char.get(b, chr(b)) for b in text.encode(was))
        got = restore([bad], model)[0]
        same = got and sum(a == b for a, b in zip(got[0], text)) / len(text)
        assert got and same > 0.97, (read_as, was, got)


def test_correct_text_is_left_alone():
    good = [
        RU, DE, EN, RU.upper(), "«СССР» и ТРЁХ. РЁБРА", "Записи Ísvör и Ðarn даны по словарю. São Velho, Ångbro, Ñalun.", "Сравниваются формы «Ђурђен», «Ћопић» и «Ўзган».",
        "См. également l’œuvre « Été à Nîvel ».", "Обозначения µ, ±, § 5, № 7 и ©Вектор.", "слово¬\nперенос и сло­во­ с мяг­ки­ми пе­ре­но­са­ми",
        "Рівень її знань; об'єднання", "ТЕХНОЛОГИЯ ПОЛИМЕРА", "тeкст c лaтинскими бyквaми", "", "x"]
    assert restore(good, LetterModel([])) == [None] * len(good)


def test_records(spark):
    rows = [("d1", RU), ("d2", misread(RU, "cp1251")), ("d3", None), ("d4", ""), ("s5", "ÐŸÑ€Ð¸Ð\x8f� " + misread(RU, "cp1252")), ("s6", misread(RU, "cp1251")), ("s7", "Die Aufl\ufffdsung der Messung.")]
    df = spark.createDataFrame([(r, t, True) for r, t in rows], "rec string, text string, complete boolean")
    got = {r["rec"]: (r["restored"], r["complete"]) for r in garbled(df).collect()}
    assert got.keys() == {"d2", "s5", "s6", "s7"} and got["d2"] == (RU, True) and not got["s5"][1] and got["s7"] == ("Die Aufl\ufffdsung der Messung.", False)
    assert garbled(df.where("rec = 'x'")).count() == 0


def test_letter_pairs_are_counted_over_all_texts(spark):
    # the pair "ёэ" stands in one of 3 000 texts only
    df = spark.range(3000).selectExpr("concat('d', id) AS rec", "CASE WHEN id = 1234 THEN 'ёэ' ELSE 'да' END AS text")
    counts = count_pairs(df.repartition(7))
    assert counts.tolist() == pair_counts(["ёэ"] + ["да"] * 2999).tolist() == count_pairs(df).tolist()
    assert counts.sum() == 3 * 3000 and sorted(counts[counts > 0].tolist()) == [1, 1, 1, 2999, 2999, 2999]


def test_spaced_words_are_not_garbled():
    texts = ["Система включает п р о м ы ш л е н н о г о тарифа.", RU]
    pairs = pair_counts([RU] * 5000)  # many texts, in which hardly a letter stands alone
    assert restore(texts, LetterModel([], pairs)) == [None, None]


def test_other_blocks_of_utf8():
    model = LetterModel([])
    for text in ("The bound is x ≤ y here.", "Das Ziel − hier.", "Das Maß ≈ 3 ∑ a.", "\ufeffThe start.", "Good 😀 work.", "The λόγος of it.", "star ☺ here"):
        for encoding in ("cp1251", "cp1252"):
            got = restore([misread(text, encoding)], model)[0]
            assert got and got[0] == text, (text, encoding, got)
    good = ["ООО «НПО» и «ПАО».", "много слов”–", "в слове»—", "таблица уважаемая удача", "λόγος и ≤, 日本語 😀"]
    assert restore(good, model) == [None] * len(good)
