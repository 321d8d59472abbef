import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import scoring, vectors
from attestra.operators.front_matter import note, without_front_matter
from attestra.operators.vectors import at_least, cosine, exists_above, top_k
from attestra.sources.files import decode_text, image_size, read_file, read_uploads, table_text
from attestra.sources.sinks import replace_partitions, upserted
from attestra.streaming.runner import on_batches, windowed_counts

BODY = "Первая глава рассказывает о предмете работы достаточно подробно. " * 5


def test_front_matter(spark):
    whole = f"Министерство образования\nКафедра систем\n\nСодержание\nВведение 3\n1 Обзор 5\n\nВВЕДЕНИЕ\n{BODY}\n--- Страница 3 ---\n{BODY}\n\nОглавление\nОбзор 3\n\nКонец работы."
    short = "Министерство образования\n\nВВЕДЕНИЕ\nКороткая, но всё же больше сорока знаков строка.\n\nКонец."
    lined = "\n".join(["Кафедра систем", "Содержание", "Обзор 3", "Вывод 9", "Введение", *[BODY.strip()] * 4])
    chapter = "Титул\n\n1. Обзор предметной области\n" + BODY
    listed = f"Титул\n\n1 Обзор\t7\n1 Метод\n{BODY}\n\nСодержание\n{BODY}"
    texts = [whole, None, short, "Введение 5\n\n" + BODY, " ", lined, chapter, "", listed, "1 Обзор 5\n\nТекст " + BODY, "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("body", F.lit(1))
    got = {r["id"]: r for r in without_front_matter(df, "id", "text").collect()}
    body = got[0]["body"]
    assert body.startswith("ВВЕДЕНИЕ\n" + BODY.strip()[:20]) and got[0]["body_start_marker"] == "Введение" and got[0]["removed_chars"] == len(whole) - len(body)
    assert "Страница" not in body and "Оглавление" not in body and body.endswith("Конец работы.")
    for i in (1, 2, 3, 4, 7, 9, 10):
        assert tuple(got[i])[1:] == (texts[i], 0, ""), i
    assert got[5]["body_start_marker"] == "Введение" and got[5]["body"].startswith("Введение\nПервая")
    assert got[6]["body_start_marker"] == "1. Обзор предметной области"
    # the search starts at a contents line if a chapter with text follows in the same paragraph; service parts after it go
    assert got[8]["body_start_marker"] == "1 Обзор\t7" and "Содержание" not in got[8]["body"]
    said = spark.createDataFrame([(5, "Введение"), (0, "")], "n int, m string").select(note(F.col("n"), F.col("m")).alias("x")).collect()
    assert [r["x"] for r in said] == ["удалено 5 симв., начало с «Введение»", ""]
    assert without_front_matter(df.where("id < 0"), "id", "text").count() == 0


def test_decisions(spark):
    rows = [(0.82, None, True), (0.8199, None, False), (0.50, 0.75, True), (0.82, 0.65, True), (0.81, 0.74, False), (None, None, False), (0.9, -3.0, False), (0.1, 7.0, True)]
    got = spark.createDataFrame(rows, "s double, r double, y boolean").select(scoring.deep_borrowing(F.col("s"), F.col("r")).alias("x"), "y").collect()
    assert all(r["x"] == r["y"] for r in got)
    chunks = spark.createDataFrame([(1, 0.9, 0.9, 0.9, 0.0), (1, 0.9, 0.1, 0.1, 0.02), (1, None, 0.7, None, None), (2, 0.74996, None, None, 0.6)], "d long, copy_score double, semantic_score double, rerank_score double, ai_score double")
    decided = scoring.decide(chunks)
    assert sorted((r["d"], r["kind"], r["risk"], r["ai"]) for r in decided.collect()) == [(1, "copy", "high", False), (1, "deep_borrow", "high", False), (1, "original", "medium", False), (2, "copy", "medium", True)]
    r = {x["d"]: x for x in scoring.roll_up(decided, "d").collect()}
    assert (r[1]["copy_percent"], r[1]["plagiarism_percent"], r[1]["originality_percent"], r[1]["ai_percent"], r[1]["risk_level"]) == (33.33, 66.67, 33.33, 2.0, "high")
    assert scoring.roll_up(decided.where("d = 9"), "d").count() == 0


def test_targets_and_ai(spark):
    rows = [(1, i, "a", 0.5 + i / 100, 0.4, True) for i in range(25)] + [(1, 30, "a", 0.99, 0.9, False)]
    r = scoring.by_target(spark.createDataFrame(rows, "d long, segment_index int, l string, combined_score double, tfidf_score double, is_borrowing boolean"), ["d", "l"]).first()
    assert (r["similarity_percent"], r["fragments"], r["first_segments"]) == (74.0, 25, ",".join(map(str, range(20))))
    one = lambda p, m, size, z: spark.range(1).select(scoring.ai_score(F.lit(p), F.lit(m), F.lit(size), F.lit(z))).first()[0]
    assert one(1.0, 0.0, 2000, 1000) == pytest.approx(0.0201632, abs=2e-6)
    assert one(1.0, 0.0, 9000, 1) < 0.0330
    docs = spark.createDataFrame([(1, "слово за слово " * 20), (2, "short"), (3, None), (4, "x" * 60)], "id long, t string")
    got = {r["id"]: r["ai_score"] for r in scoring.bigram_ai_scores(docs, "id", "t").collect()}
    assert got[1] > 0 and got[2] == got[3] == got[4] == 0


def test_vector_search(spark, monkeypatch):
    from attestra.operators import vectors

    monkeypatch.setattr(vectors, "PASS_BYTES", 2000)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 8)).round(3)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = top_k(df.where("id % 10 = 0"), df, "id", "v", 3).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 100, 10):
        s = n @ n[q]
        best = sorted((j for j in range(100) if j != q), key=lambda j: (-round(s[j], 9), j))[:3]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best
    over = at_least(df, df, "id", "v", 0.999).collect()
    found = {r["query_id"]: r["found"] for r in exists_above(df, df, "id", "v", 0.999).collect()}
    assert len(found) == 103 and {i for i, f in found.items() if f} == {3, 7}
    some = top_k(df.where("id = 3"), df, "id", "v", 3, 0.0, among=df.where("id < 50")).collect()
    s = n @ n[3]
    assert [r["id"] for r in sorted(some, key=lambda r: r["rank"])] == sorted((j for j in range(50) if j != 3 and s[j] >= 0), key=lambda j: (-round(s[j], 9), j))[:3]
    assert {(r["query_id"], r["id"]) for r in over} == {(3, 7), (7, 3)}
    pair = df.where("id = 3").crossJoin(df.where("id in (7, 201, 202)").select(F.col("id").alias("j"), F.col("v").alias("w")))
    assert {r["j"]: r["c"] and round(r["c"], 9) for r in pair.select("j", cosine(F.col("v"), F.col("w")).alias("c")).collect()} == {7: 1.0, 201: None, 202: None}
    assert top_k(df.where("id < 0"), df, "id", "v", 3).count() == 0


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = f"{p('First')}{p(' ')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell('c')}</w:tr></w:tbl>{p('Last')}"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    path.write_bytes(raw.getvalue())


def test_files(spark, tmp_path):
    assert decode_text("Привет".encode("cp1251")) == "Привет" and decode_text(b"\x98") == "\x98" and decode_text(" Привет\n".encode()) == "Привет"
    assert decode_text("﻿x".encode()) == "﻿x"
    assert table_text([["a\nb", ""], ["", ""], ["c", "d"]]) == "a b\nc | d"
    assert read_file("x.exe", b"").error == "unsupported format" and read_file("x.docx", b"no").error.startswith("unreadable") and read_file("x.txt", b" ").error == "empty text"
    assert read_file("x.txt", b"x" * (10 * 1024 * 1024 + 1)).error == "too large" and read_file("x.pdf", b"%PDF").error
    docx(tmp_path / "a.docx")
    (tmp_path / "b.md").write_text("Text")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_uploads(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "First\n\n[Таблица 1]\na | b\nc\n\nLast" and got["a.docx"]["tables"] == 1
    assert got["b.md"]["text"] == "Text" and got["b.md"]["error"] == "" and got["c.pdf"]["error"]


def picture(width, height):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big")


def test_images_and_pages_through_given_readers(spark, tmp_path):
    assert image_size(picture(90, 81)) == (90, 81) and image_size(b"?") is None and image_size(b"GIF89a\x05\x00\x07\x00") == (5, 7)
    assert image_size(b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08\x00\x20\x00\x30") == (48, 32)
    docx(tmp_path / "a.docx")
    with zipfile.ZipFile(tmp_path / "a.docx", "a") as z:
        z.writestr("word/media/image1.png", picture(200, 100))
        z.writestr("word/media/image2.png", picture(200, 79))
        z.writestr("word/media/image3.png", b"broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")

    def ocr(raw):
        if raw == b"broken":
            raise ValueError
        return [" seen ", "", "there"]

    def pdf(raw):
        return [("One", [[["a", "b"]], [["c"]]], None), ("", [], picture(500, 500)), (" ", [], picture(100, 500)), ("Four", [], None)]

    got = {r["path"].rsplit("/", 1)[1]: r for r in read_uploads(spark, str(tmp_path), pdf, ocr).collect()}
    a, c = got["a.docx"], got["c.pdf"]
    assert a["text"].endswith("Last\n\nseen\nthere") and (a["images_ocr"], a["tables"], a["ocr_available"]) == (1, 1, True)
    assert c["text"] == "--- Страница 1 ---\nOne\n\n[Таблица 1]\na | b\n\n[Таблица 2]\nc\n\n--- Страница 2 ---\nseen\nthere\n\n--- Страница 4 ---\nFour"
    assert (c["pages"], c["tables"], c["images_ocr"], c["error"]) == (4, 2, 1, "")


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "d long, x string")
    for _ in range(2):
        replace_partitions(df, str(tmp_path / "t"), "d")
    replace_partitions(df.where("d = 2").withColumn("x", F.lit("z")), str(tmp_path / "t"), "d")
    assert sorted((r["d"], r["x"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "z")]
    old = spark.createDataFrame([(1, "o", 9), (2, "o", 1)], "k long, x string, v int")
    new = spark.createDataFrame([(1, "n1", 1), (1, "n2", 2), (3, "n", None)], "k long, x string, v int")
    assert sorted((r["k"], r["x"]) for r in upserted(old, new, ["k"], "v").collect()) == [(1, "n2"), (2, "o"), (3, "n")]


def test_streams(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,id div 10) as ts, concat('k', id % 3) as k, cast(id as double) as v from range(60)")
    src = str(tmp_path / "src")
    rows.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = on_batches(stream, lambda b: b.groupBy("k").agg(F.sum("v").alias("s")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("k").agg(F.sum("s").alias("s"))
    assert {r["k"]: r["s"] for r in out.collect()} == {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    q = windowed_counts(stream, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: {(r["window_start"], r["k"]): (r["n"], r["total"]) for r in df.collect()}
    assert key(spark.table("windows")) == key(windowed_counts(rows, "ts", "k", "v"))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "hybrid_best_match" in e.queries()


def test_a_further_row_must_reach_a_querys_kth_best():
    found = tuple(map(np.array, ([4, 4, 7, 9, 9, 9], [1, 2, 3, 4, 5, 6], [0.9, 0.5, 0.8, 0.7, 0.6, 0.6])))
    assert vectors._least(found, np.array([9, 4, 7, 5]), 2).tolist() == [0.6 - 1e-9, 0.5 - 1e-9, -np.inf, -np.inf]
