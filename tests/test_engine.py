import json

import pytest
from pyspark.sql import functions as F

from attestra.config import Options, from_env, profile, read_env
from attestra.engine import Engine
from attestra.operators import pipeline, providers, reports
from attestra.plans import runtime
from attestra.sources.store import Busy, Missing, Store, in_order, others
from attestra.streaming import tasks

TEXT = "Искусственный интеллект меняет подход к анализу текстов. Современные системы проверяют оригинальность на нескольких уровнях."
SOURCES = ["Искусственный интеллект меняет подход к анализу текстов в образовании.", "Машинное обучение применяется в медицине и финансах."]
LONG = "Разные работы рассказывают о предмете подробно и приводят примеры, таблицы и выводы. "


def corpus(spark, texts, labels=None):
    return spark.createDataFrame([(i, labels[i] if labels else None, t) for i, t in enumerate(texts)], "source long, label string, text string")


def test_known_analysis(spark):
    text = spark.createDataFrame([(7, TEXT), (8, ""), (9, None)], "doc long, text string")
    results, chunks = pipeline.analyze_corpus(text, corpus(spark, SOURCES), profile(semantic_top_k=1))
    rows = {r["doc"]: r for r in results.collect()}
    chunk = chunks.first()
    assert chunks.count() == 1 and chunk["copy_score"] == 0.3081 and chunk["match_type"] == "none" and not chunk["is_copy"]
    assert rows[7]["originality_percent"] == 100 and rows[7]["total_segments"] == 1 and rows[7]["risk_level"] == "none"
    assert rows[7]["summary"] == "Оригинальность: 100.0%. Глубокое заимствование: 0.0%. Копирование: 0.0%. ИИ: 0.0%. Фрагментов: 1, совпадений: 0."
    assert rows[8]["summary"] == rows[9]["summary"] == reports.EMPTY and rows[8]["originality_percent"] == 100 and rows[8]["total_segments"] == 0


def test_copies_and_deep_borrowings(spark):
    others_ = [LONG * 3 + f"Отличие номер {i} стоит здесь и меняет слова текста {i * 7}." for i in range(4)]
    own = "Совсем другая работа о море, ветре, птицах, кораблях и людях, которые живут на берегу далёкого острова."
    text = spark.createDataFrame([(1, others_[0]), (2, own)], "doc long, text string")
    for options in (profile(), profile(enable_reranker=True), profile(enable_ai=True, own_idf=False)):
        results, chunks = pipeline.analyze_corpus(text, corpus(spark, others_, [f"doc_{10 + i}" for i in range(4)]), options)
        rows = {r["doc"]: r for r in results.collect()}
        assert rows[1]["deep_borrow_percent"] == 100 and rows[1]["risk_level"] == "high" and rows[2]["plagiarism_percent"] == 0
        got = {r["doc"]: r for r in chunks.collect()}
        assert got[1]["match_type"] == "deep" and got[1]["source_label"].startswith("doc_1") and got[2]["source_label"] == ""
        assert (got[1]["ai_score"] > 0) == options.enable_ai
    # without vectors that are near enough, the copy is left to the lexical scores
    results, chunks = pipeline.analyze_corpus(text, corpus(spark, others_ + [own]), profile(deep_semantic_threshold=2.0))
    got = {r["doc"]: r for r in chunks.collect()}
    assert got[2]["match_type"] == "copy" and got[2]["deep_score"] == 0 and got[2]["semantic_score"] > 0.99 and got[2]["source_label"] == "Источник 5"
    known = spark.createDataFrame([("Источник 5", 55)], "label string, id long")
    best = {(r["doc"], r["target_document_id"]): r for r in reports.by_target(reports.match_rows(chunks), known).collect()}
    assert best[2, 55]["copy_percent"] == round(got[2]["copy_score"] * 100, 2) and len(best[2, 55]["fragments"]) == 1


def test_compare(spark):
    rows = [(0, TEXT + " Лексический анализ выявляет прямое копирование фрагментов.", SOURCES[0] + " Современные системы проверяют оригинальность работ студентов."), (1, TEXT, ""), (2, None, None), (3, LONG * 5, LONG * 5)]
    got = {r["pair"]: r for r in pipeline.analyze_compare(spark.createDataFrame(rows, "pair long, text_a string, text_b string"), profile()).collect()}
    assert (got[0]["similarity_percent"], got[0]["tfidf_percent"], got[0]["bm25_percent"], got[0]["originality_percent"]) == (26.9, 44.9, 0.0, 73.1)
    assert got[0]["verdict"] == reports.UNRELATED and got[1]["verdict"] == got[2]["verdict"] == reports.TOO_SHORT and got[1]["originality_percent"] == 100
    assert got[3]["deep_borrow_percent"] == 100 and got[3]["plagiarism_percent"] == 100


def test_recognize(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, None), (3, "...")], "doc long, text string")
    got = {(r["doc"], r["segment_index"]): r for r in pipeline.recognize(texts, corpus(spark, SOURCES)).collect()}
    assert set(got) == {(1, 0), (1, 1), (3, 0)}
    assert got[1, 0]["source"] == 0 and got[1, 0]["tfidf_score"] > 0.5 and got[1, 1]["combined_score"] == 0 == got[3, 0]["source"]
    none = pipeline.recognize(texts, corpus(spark, SOURCES).where("source > 9")).collect()
    assert len(none) == 3 and all(r["source"] is None and r["combined_score"] == 0 for r in none)


def test_rerank_takes_the_first_of_equals(spark):
    rows = [(1, "a b c", "a b", 1), (1, "a b c", "a b c", 2), (1, "a b c", "c b a", 3), (2, "x", None, 1)]
    df = spark.createDataFrame(rows, "k int, q string, c string, rank int")
    got = {r["k"]: (r["score"], r["rank"]) for r in providers.reranked(df, ["k"], "q", "c", "rank", providers.OverlapReranker()).collect()}
    assert got == {1: (1.0, 2), 2: (0.0, 1)}
    v = df.select(providers.vectors(F.col("c"), providers.HashEncoder(8)).alias("v")).collect()
    assert len(v[0]["v"]) == 8 and v[3]["v"] is None


def test_fragments_and_borrowings(spark):
    raw = '[{"segment_index": 3, "combined_score": 0.51234, "tfidf_percent": 12.345, "semantic_score": null, "is_borrowing": true}, {"other": 1}]'
    rows = [(1, raw), (2, "[]"), (3, '[{"segment'), (4, None), (5, '{"a": 1}'), (6, "")]
    got = {r["id"]: r["f"] for r in spark.createDataFrame(rows, "id int, x string").select("id", reports.normalized_fragments(F.col("x")).alias("f")).collect()}
    first = got[1][0]
    assert (first["combined_percent"], first["copy_percent"], first["deep_borrow_percent"], first["is_borrowing"], first["segment_text"]) == (51.23, pytest.approx(12.345, abs=0.006), None, True, "")
    assert not got[1][1]["is_borrowing"] and all(got[i] == [] for i in (2, 4, 5, 6)) and len(got[3]) <= 1
    m = spark.createDataFrame([(1, 1, 5, 10.0, None, None, None, None), (2, 1, 6, None, 1.0, 2.0, "[]", "x"), (3, 1, 7, 99.0, 1.0, 2.0, "[]", "")], "id long, source_document_id long, target_document_id long, similarity_percent double, copy_percent double, deep_borrow_percent double, matched_fragments string, algorithm string")
    d = spark.createDataFrame([(5, "t5", None), (6, "t6", "f")], "doc_id long, title string, filename string")
    got = [(r["id"], r["rank"], r["similarity_percent"], r["algorithm"]) for r in reports.borrowings(m, d).orderBy("rank").collect()]
    assert got == [(1, 1, 10.0, reports.ALGORITHM), (2, 2, 0.0, "x")]


def test_labels_metadata_summaries(spark):
    labels = spark.createDataFrame([("a",), ("doc_12",), ("doc_13:5",), ("doc_x",), (None,), ("",)], "source_label string")
    known = spark.createDataFrame([("a", 3), ("doc_12", 99)], "label string, id long")
    assert {r["source_label"]: r["target_document_id"] for r in reports.target_ids(labels, known).collect()} == {"a": 3, "doc_12": 99, "doc_13:5": 13, "doc_x": None, None: None, "": None}
    parts = spark.createDataFrame([(1, 0, 2, None, 1, 3, False, "docx"), (1, 1, 1, 4, None, 0, None, "pdf"), (1, 2, 0, 0, 0, 0, True, "docx"), (2, 0, None, None, None, None, None, None)], "t int, i int, paragraphs int, tables int, images_ocr int, pages int, ocr_available boolean, format string")
    got = {r["t"]: tuple(r)[1:] for r in reports.merged_extraction(parts, ["t"], "i").collect()}
    assert got == {1: (3, 4, 1, 3, True, ["docx", "pdf"]), 2: (0, 0, 0, 0, False, [])}
    said = spark.createDataFrame([(4, 1, 3), (0, 0, 0), (2, None, 0)], "t int, i int, p int").select(reports.extraction_note(F.col("t"), F.col("i"), F.col("p")).alias("x")).collect()
    assert [r["x"] for r in said] == ["Из документа извлечено — таблиц: 4, OCR изображений: 1, страниц: 3.", "", "Из документа извлечено — таблиц: 2."]
    m = spark.createDataFrame([(1, 0, 0.5, "x"), (1, 1, 0.9, "y"), (1, 2, 0.9, "z")], "d int, i int, s double, t string")
    assert tuple(reports.top_fragment(m, ["d"], "s", "t", "i").first()) == (1, 0.9, "y")
    text = spark.range(1).select(reports.lexical_summary(F.lit(83.4), F.lit(3), F.lit(1), F.lit(0.668), F.lit("слово"), F.lit("high")).alias("x")).first()["x"]
    assert text == "Оригинальность текста: 83.4%. Проанализировано фрагментов: 3. Обнаружено потенциальных заимствований: 1. Наиболее похожий фрагмент (совпадение 67%): «слово…». Общая оценка: Высокий риск заимствования."
    c = spark.createDataFrame([(1, "x" * 101, 0.5), (1, "y" * 101, None), (1, "short", 0.9), (2, "s", 0.3)], "d int, t string, s double")
    assert {r["d"]: r["ai_percent"] for r in reports.document_ai(c, "d", "t", "s").collect()} == {1: 25.0, 2: 0.0}


def test_task_log(spark):
    t = spark.createDataFrame([(i, "corpus", None, "{}", p, f"2024-01-0{i} 00:00:00") for i, p in ((1, 2), (2, 1), (3, 0), (4, 1))], "id long, mode string, filename string, payload string, priority int, c string").withColumn("created_at", F.col("c").cast("timestamp")).drop("c")
    e = [(4, "2024-02-01 00:00:00", "PROCESSING"), (4, "2024-02-02 00:00:00", "PENDING"), (4, "2024-02-03 00:00:00", "PROCESSING"), (4, "2024-02-04 00:00:00", "DONE")]
    schema = "task_id long, c string, status string, progress string, error_message string, plagiarism_pct double, copy_pct double, deep_borrow_pct double, ai_pct double, result_json string"
    e = spark.createDataFrame([(*x, "", None, None, None, None, None, None) for x in e], schema).withColumn("at", F.col("c").cast("timestamp"))
    s = tasks.state(t, e)
    got = {r["id"]: r for r in s.collect()}
    assert got[1]["status"] == "PENDING" and got[4]["status"] == "DONE" and str(got[4]["started_at"]).startswith("2024-02-03") and str(got[4]["finished_at"]).startswith("2024-02-04")
    assert [r["id"] for r in tasks.next_pending(s, 9).collect()] == [3, 2, 1]
    assert {r["id"]: r["position"] for r in tasks.positions(s).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r["status"]: r["n"] for r in tasks.counts(s).collect()} == {"PENDING": 3, "DONE": 1}
    cases = spark.createDataFrame([(0, 0, ["a.txt"], [], 1), (0, 2, [], None, 2), (None, None, ["x.PDF", None], None, 2), (0, 0, None, ["docx"], 2), (3, 0, None, None, 2), (0, 0, [".pdf"], None, 1)], "i int, t int, n array<string>, f array<string>, p int")
    assert all(r["p"] == r["q"] for r in cases.select("p", tasks.priority(*[F.col(c) for c in "itnf"]).alias("q")).collect())
    done = spark.createDataFrame([(1, 0.0, 5.0, 7.0)], "task_id long, plagiarism_percent double, copy_percent double, copy_percent_ml double").withColumns({"at": F.current_timestamp(), "deep_borrow_percent": F.lit(None).cast("double"), "ai_percent": F.lit(1.0)})
    r = tasks.completed(done).first()
    assert (r["plagiarism_pct"], r["copy_pct"], r["deep_borrow_pct"], r["ai_pct"]) == (None, 5.0, None, 1.0)


def test_service(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    assert len(store.create()) == len(store.schemas) and store.create() == []
    assert {r["name"]: r["n_rows"] for r in store.catalog().collect()}["users"] == 1
    engine = Engine(store, profile())
    with pytest.raises(ValueError):
        engine.add_document("  ")
    first = engine.add_document(LONG * 4, title="one", filename="a.TXT")
    assert engine.analyze(first) | {"processing_time_ms": 0} == {"document_id": first, "analytics_status": "done", "originality_percent": 100.0, "plagiarism_percent_ml": 0.0, "copy_percent_ml": 0.0, "deep_borrow_percent_ml": 0.0, "ai_percent_ml": 0.0, "borrowings_count": 0, "processing_time_ms": 0, "algorithm": reports.ALGORITHM}
    second = engine.add_document(LONG * 4 + "И ещё.", title="two")
    row = store.document(second).first()
    assert row["word_count"] == len((LONG * 4 + "И ещё.").split()) and row["analytics_status"] == "pending"
    queued = engine.analyze(second, wait=False)
    with pytest.raises(Busy):
        engine.analyze(second)
    with pytest.raises(Missing):
        engine.status(999)
    assert engine.task(queued["task_id"])["position"] == 1
    assert engine.work(5) == 1 and engine.status(second)["analytics_status"] == "done"
    task = engine.task(queued["task_id"])
    assert task["status"] == "DONE" and task["deep_borrow_pct"] == 100 and task["plagiarism_pct"] == 100 and task["copy_pct"] == 0
    found = engine.borrowings(second)
    assert [b["target_document_id"] for b in found] == [first] and found[0]["similarity_percent"] > 95 and found[0]["matched_fragments"][0]["match_type"] == "deep"
    engine._analyze(second)  # again: the matches are replaced
    assert len(engine.borrowings(second)) == 1 and engine.documents().count() == 2
    source = engine.index("Источник\n\n" + LONG * 40, "label", "s.txt")
    assert engine.sources().first()["chunk_count"] == store.read("corpus_chunks").where(F.col("source_id") == source).count() > 1
    assert store.read("corpus_chunks").first()["embedding"] is not None
    bad = engine.submit("corpus", {"source_ids": [source], "text": LONG * 4}), engine.submit("nonsense", {}), engine.submit("compare", {"text": TEXT, "reference": TEXT}, "x.pdf"), engine.submit("corpus", {"text": TEXT, "corpus": "A\n" + SOURCES[0] + "\n---\nB\n" + SOURCES[1]})
    assert engine.work(9) == 4
    states = {r["id"]: r for r in engine.states().collect()}
    assert states[bad[0]]["status"] == "DONE" and states[bad[1]]["status"] == "FAILED" and "nonsense" in states[bad[1]]["error_message"] and states[bad[2]]["priority"] == 2
    assert json.loads(states[bad[3]]["result_json"])["matches"][0]["tfidf_score"] == 0.3081
    engine.requeue()


def test_order_and_settings(spark, tmp_path, monkeypatch):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(7)
    assert all(r["x"] == 999 - r["n"] for r in runtime.in_order(df, F.desc("x"), name="n").collect())
    ids = spark.createDataFrame([(0, 3), (1, 1), (2, 9), (3, 3)], "place int, id long")
    assert [r["id"] for r in in_order(ids, spark.createDataFrame([(1, "a"), (3, "b")], "id long, t string")).collect()] == [3, 1, 3]
    d = spark.createDataFrame([(1, "x", "2024-01-01"), (2, " ", "2024-01-02"), (3, "y", None), (4, "z", "2024-01-03")], "doc_id long, text string, u string").withColumn("upload_date", F.col("u").cast("timestamp"))
    assert [r["doc_id"] for r in others(d, 1).collect()] == [4, 3]
    env = tmp_path / "env"
    env.write_text("# c\n\nnot a setting\nMAX_CHUNKS='7'\nENABLE_AI=yes\nFAST_MODE=0\nMAX_CHUNKS=9\n")
    assert read_env(str(env))["MAX_CHUNKS"] == "7" and read_env(str(tmp_path / "none")) == {}
    monkeypatch.setenv("SEMANTIC_TOP_K", "4")
    o = from_env(str(env))
    assert (o.max_chunks, o.enable_ai, o.semantic_top_k, o.chunk_size) == (7, True, 4, 500) and Options() == profile()
