import pytest

from attestra.operators import lexical, pipeline
from attestra.plans import catalog, runtime

WORDS = "море ветер птица корабль берег остров книга город дорога песня лес поле".split()


def sentence(k: int) -> str:
    return " ".join(WORDS[(k * 5 + i * (1 + k % 3)) % len(WORDS)] for i in range(6)).capitalize() + f" номер {k}."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, sentence(i) + " " + sentence(i + 1)) for i in (3, 50, 77, 101)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, f"s{i}", sentence(i) + " " + sentence(i + 2)) for i in range(1, 80)], "id long, label string, content string").write.parquet(f"{d}/corpus_sources.parquet")
    return d


def test_every_document_is_searched(spark, tables):
    assert {(r["doc_id"], r["seg_index"]) for r in catalog.hybrid_best_match(spark, tables).collect()} == {(i, k) for i in (3, 50, 77, 101) for k in (0, 1)}


def test_every_document_has_an_originality(spark, tables):
    assert {(r["doc_id"], r["total_segments"]) for r in catalog.lexical_originality(spark, tables).collect()} == {(i, 2) for i in (3, 50, 77, 101)}


def test_every_document_is_analyzed_against_the_whole_corpus(spark, tables, monkeypatch):
    seen = {}
    meet = pipeline.semantic_candidates
    monkeypatch.setattr(pipeline, "semantic_candidates", lambda chunks, corpus, *x: seen.setdefault("n", corpus.count()) and meet(chunks, corpus, *x))
    assert {r["doc"] for r in catalog.analyze_documents(spark, tables).collect()} == {3, 50, 77, 101}
    assert seen["n"] == 79  # a chunk a source, more than an analysis takes of one text


@pytest.fixture(scope="module")
def chunked(spark, tables):
    rows = [(i, i // 2, i % 2, sentence(i) + " " + sentence(i + 3)) for i in range(100, 420)]
    spark.createDataFrame(rows, "id long, source_id long, chunk_index int, content string").write.parquet(f"{tables}/corpus_chunks.parquet")
    return tables


def test_an_analysis_neither_writes_nor_shuffles_the_texts_it_compares_with(spark, chunked, monkeypatch):
    written, write = [], runtime.materialize

    def kept(df):
        written.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()))
        return write(df)

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for m in (pipeline, lexical, catalog):
        monkeypatch.setattr(m, "materialize", kept)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as where tables are large
        few = {tuple(r) for r in catalog.analyze_chunks(spark, chunked).collect()}
        assert not any({"segment", "label", "text"} <= set(columns) for columns, *_ in written)
        found = next(plan for columns, _, plan in written if {"rank", "score", "content"} <= set(columns))
        assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found
        written.clear()
        monkeypatch.setattr(runtime, "SENT_ROWS", 0)  # many: both sides are shuffled, with the same result
        assert {tuple(r) for r in catalog.analyze_chunks(spark, chunked).collect()} == few and len(few) == 8
        assert "SortMergeJoin" in next(plan for columns, _, plan in written if {"rank", "score", "content"} <= set(columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_found_sources_are_cut_again(spark, chunked):
    segments = catalog.segment_documents(spark, chunked).selectExpr("doc_id source", "seg_index segment", "'' label", "segment text")
    lex = runtime.materialize(spark.createDataFrame([(1, 50_000_001), (2, 77_000_000)], "q long, c long"))
    got = pipeline._named(lex, segments)
    assert {(r["q"], r["copy_text"]) for r in got.collect()} == {(1, sentence(51)), (2, sentence(77))}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")  # documents are left out before their texts are cut
