import random

from attestra.llm.scans import Speller, decode_steps, decode_words, document_words, is_scan, known_words, page_lines, paragraph_breaks, repair, scanned, skeleton

WORDS = "система модель метод образование развитие общество структура анализ результат экономика которая определяет научный процесс влияние студент культура проверка точность журнал договор".split()


def sentence(rng):
    words = [rng.choice(WORDS) for _ in range(rng.randrange(8, 16))]
    return " ".join(words).capitalize() + "."


def clean(rng, n):
    return [" ".join(sentence(rng) for _ in range(rng.randrange(3, 6))) for _ in range(n)]


def lines_of(text, width):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            room = width - len(line) - 2
            if room > 3 and len(w) - room > 2 and w.isalpha():
                out.append(f"{line} {w[:room]}-")
                line = w[room:]
            else:
                out.append(line)
                line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


def scan(rng, paragraphs, page=9):
    out, number, count = [], 30, 0
    for p in paragraphs:
        for x in lines_of(p, 52):
            out.append(x)
            count += 1
            if count % page == 0:
                out += [f"{number} | Научный журнал", ""] if number % 2 else [str(number), "Научный журнал"]
                number += 1
        out.append("")
    text = "\n".join(out)
    return text.replace("система", "сисгема", 1).replace("развитие", "развигие", 1).replace("договор", "дог0вор", 1).replace("процесс", "п р о ц е с с", 1)


def speller():
    return Speller({w: 50 for w in WORDS})


def test_scans_are_found_and_repaired():
    rng = random.Random(3)
    right = total = 0
    for _ in range(10):
        source = clean(rng, 5)
        bad = scan(rng, source)
        assert is_scan(bad, speller())
        fixed = repair(bad, speller())
        assert "|" not in fixed and "30" not in fixed
        a, b = " ".join(source).split(), fixed.split()
        assert len(a) == len(b)
        right += sum(x == y for x, y in zip(a, b))
        total += len(a)
        assert abs(len(fixed.split("\n\n")) - len(source)) <= 2
    assert right / total > 0.995


def test_clean_texts_are_not_scans():
    rng = random.Random(4)
    s = speller()
    body = "\n\n".join(clean(rng, 4))
    wrapped = "\n".join(x for p in clean(rng, 3) for x in __import__("textwrap").wrap(p, 50))
    contents = "Университет\nТема: Научный метод\n2015\n\nСодержание\n1 Система 3\n2 Модель ..... 10\n\nВВЕДЕНИЕ\n" + body
    listed = "\n".join(f"{i}) {sentence(rng)}" for i in range(1, 8))
    pages = body + "\n--- Страница 2 ---\n" + body
    for text in (body, wrapped, contents, listed, pages, "", "   \n", "Модель типа Навадонол-9,8 и Becizamad-659."):
        assert not is_scan(text, s), text


def test_pieces():
    s = speller()
    assert [w for _, w in decode_words(["Сис-", "тема", "ана", "лиз", "методобразование", "С", "Т", "У", "Д", "Е", "Н", "Т", "хуz"], [True] + [False] * 12, s)] == [
        "Система", "анализ", "метод", "образование", "СТУДЕНТ", "хуz"]
    assert page_lines(["конец фразы и", "12", "дальше текст."]) == ({1}, 1)
    assert paragraph_breaks([], []) == [] and paragraph_breaks(["a"], [False]) == [False]
    assert repair("", s) == "" and Speller({}).cost("слово")[1] == "слово"


def test_records(spark):
    rng = random.Random(5)
    rows = [(f"d{i}", "\n".join(clean(rng, 4))) for i in range(30)]
    rows += [("s1", scan(rng, clean(rng, 6))), ("s2", None), ("s3", "")]
    df = spark.createDataFrame([(r, t, 1) for r, t in rows], "rec string, text string, repaired int")
    got = {r["rec"]: r["repaired"] for r in scanned(df).collect()}
    assert got.keys() == {"s1"} and "дог0вор" not in got["s1"]
    counts = {r["word"]: r["n"] for r in document_words(df).collect()}
    assert counts["система"] == sum("система" in {w.strip(".").lower() for w in (t or "").split()} for _, t in rows)
    assert scanned(df.where("rec = 'x'")).count() == 0


def test_found_by_decoding():
    s = Speller({**{w: 50 for w in WORDS}, "баргузин": 3})
    # noise that only decoding sees, and words that decoding must leave alone
    for text, clean_text in (("Метод и сис тема.", "Метод и система."), ("Метод и развигие.", "Метод и развитие."), ("Метод и сис-\nтема.", "Метод и система.")):
        assert is_scan(text, s) and repair(text, s) == clean_text
    assert repair("Метод баргузон келмотан модель", s) == "Метод баргузон келмотан модель"
    assert repair("методобразование", s) == "метод образование" and not is_scan("методобразование", s)
    gains = [g for _, _, _, g in decode_steps(["метод", "сис", "тема"], [False] * 3, s)]
    assert gains[0] == 0 and gains[1] > 4


def test_labelled_and_repeated_headers():
    s = speller()
    for label in ("Стр. 29", "Page 59", "Сторінка 7", "[Seite 3]"):
        lines = ["система определяет", label, "Научный Журнал", "результат анализа.", "Модель влияет."]
        assert page_lines(lines) == ({1, 2}, 1) and is_scan("\n".join(lines), s)
        assert repair("\n".join(lines), s).startswith("система определяет результат анализа.")
    repeated = "система модель\nНаучный Журнал\nметод анализа. Общество и\nНаучный Журнал\nкультура."
    assert is_scan(repeated, s) and "Журнал" not in repair(repeated, s)
    copied = "система модель\nНаучный Журнал\nметод анализа.\n" * 3
    for text in (copied, "система [65,\nс. 233].\nМодель влияет.", "система [65,\nс. 233\nмодель].", "модель.\n--- Страница 2 ---\nСистема."):
        assert not is_scan(text, s), text


def test_words_are_known_at_any_size(spark):
    # one word in three of 8 000 texts
    df = spark.range(8000).selectExpr("concat('d', id) AS rec", "CASE WHEN id < 3 THEN 'модель редкость' ELSE 'модель' END AS text")
    assert {r["word"]: r["n"] for r in known_words(df).collect()} == {"модель": 8000, "редкость": 3}
    # a misreading that stands in many texts, and a rare word that is only rarer
    s = Speller({"зависит": 60_000, "завнсит": 75, "лупирон": 99, "лунирон": 50})
    assert s.cost("завнсит")[1] == "зависит" and s.misread("завнсит") and not s.misread("лунирон")
    assert skeleton("rnоdcl") == skeleton("mоclcl") == skeleton("mоdd")


def test_words_beyond_those_sent_out(spark):
    rng = random.Random(6)
    rows = [(f"d{i}", "\n".join(clean(rng, 4))) for i in range(150)]
    rows += [(f"s{i}", scan(rng, clean(rng, 6))) for i in range(1)] + [(f"t{i}", f"Метод и {w}.") for i, w in enumerate(["сис тема", "развигие", "журн4л", "методобразование", "дог0вор"])]
    df = spark.createDataFrame(rows, "rec string, text string")
    whole = {tuple(r) for r in scanned(df).collect()}
    assert {r for r, _ in whole} >= {"s0", "t0", "t1", "t4"} and ("t0", "Метод и система.") in whole
    for most in (0, 5):
        assert {tuple(r) for r in scanned(df, most_words=most).collect()} == whole
