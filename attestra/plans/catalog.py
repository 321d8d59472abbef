"""Queries of the analytics operators over whole tables, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attestra.functions import text as T
from attestra.config import profile
from attestra.operators import chunking, front_matter, lexical, pipeline, reports, scoring, vectors
from attestra.plans.runtime import in_order, materialize, table
from attestra.sources import files, store
from attestra.streaming import tasks

#: A unit's number is its record's id times this plus its place in the record.
UNIT = 1_000_000
#: Queries of the vector searches, and the sources that analyses look at, are the rows whose id is divisible by this.
EVERY = 50

# ---- SQL building blocks -------------------------------------------------------------------------------------------

_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


def _segments_sql(c: str) -> str:
    whole = _strip_sql(f"coalesce({c}, '')")
    paragraphs = f"list_filter(list_transform(string_split(regexp_replace({whole}, '\\n{_WS}*\\n', chr(1), 'g'), chr(1)), lambda x: {_strip_sql('x')}), lambda x: x <> '')"
    sentences = f"list_filter(list_transform(string_split(regexp_replace({whole}, '([.!?…]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip_sql('x')}), lambda x: length(x) >= 20)"
    return (
        f"CASE WHEN {whole} = '' THEN [] WHEN len({paragraphs}) > 1 THEN list_filter({paragraphs}, lambda x: length(x) >= 20) "
        f"WHEN len({sentences}) > 0 THEN {sentences} ELSE [{whole}] END")


def _exploded_sql(tbl: str, id: str, c: str, where: str = "true") -> str:
    return (
        f"SELECT {id}, unnest(range(len(s))) AS seg_index, unnest(s) AS segment "
        f"FROM (SELECT {id}, {_segments_sql(c)} AS s FROM {tbl} WHERE {where})")


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _hybrid_sql(q: str, c: str) -> str:
    """CTEs from the relations q(scope, q, text) and c(scope, c, text) to best(scope, q, c, ...)."""
    tok = _TOKENS.format("text")
    return f"""
 qu AS ({q}), cu AS ({c}),
 qp AS (SELECT scope, q, term, count(*) AS f FROM (SELECT scope, q, unnest({tok}) AS term FROM qu) GROUP BY ALL),
 cp AS (SELECT scope, c, term, count(*) AS f FROM (SELECT scope, c, unnest({tok}) AS term FROM cu) GROUP BY ALL),
 n AS (SELECT scope, count(*) AS n FROM (SELECT scope FROM qu UNION ALL SELECT scope FROM cu) GROUP BY scope),
 idf AS (SELECT scope, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM (SELECT scope, term FROM qp UNION ALL SELECT scope, term FROM cp) JOIN n USING (scope) GROUP BY scope, term, n),
 qw AS (SELECT scope, q, term, f, (1 + ln(f)) * idf AS w FROM qp JOIN idf USING (scope, term)),
 cw AS (SELECT scope, c, term, f, (1 + ln(f)) * idf AS w FROM cp JOIN idf USING (scope, term)),
 qn AS (SELECT scope, q, sqrt(sum(w * w)) AS qn FROM qw GROUP BY ALL),
 cn AS (SELECT scope, c, sqrt(sum(w * w)) AS cn, sum(f) AS dl FROM cw GROUP BY ALL),
 m AS (SELECT scope, count(*) AS units FROM cu GROUP BY scope),
 av AS (SELECT scope, sum(dl) / any_value(units) AS avgdl FROM cn JOIN m USING (scope) GROUP BY scope),
 raw AS (SELECT scope, term, ln(any_value(units) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM cp JOIN m USING (scope) GROUP BY scope, term),
 bi AS (SELECT scope, term, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY scope) ELSE r END AS bi FROM raw),
 pairs AS (SELECT scope, q, c, sum(qw.w / qn * cw.w / cn) AS tfidf, sum(qw.f * bi * cw.f * 2.5 / (cw.f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw
   FROM qw JOIN cw USING (scope, term) JOIN qn USING (scope, q) JOIN cn USING (scope, c) JOIN av USING (scope) JOIN bi USING (scope, term) GROUP BY scope, q, c),
 normed AS (SELECT scope, q, c, tfidf, CASE WHEN max(raw) OVER w > 0 THEN raw / max(raw) OVER w ELSE raw END AS bm25 FROM pairs WINDOW w AS (PARTITION BY scope, q)),
 scored AS (SELECT *, greatest(0, least(1, 0.6 * tfidf + 0.4 * bm25)) AS combined FROM normed),
 top AS (SELECT * FROM scored WHERE combined > 0 QUALIFY row_number() OVER (PARTITION BY scope, q ORDER BY round(combined, 12) DESC, c) = 1),
 best AS (SELECT qu.scope, qu.q, coalesce(top.c, f.c0) AS c, round(greatest(0, least(1, coalesce(tfidf, 0))), 4) AS tfidf_score,
   round(greatest(0, least(1, coalesce(bm25, 0))), 4) AS bm25_score, round(round(coalesce(combined, 0), 9), 4) AS combined_score,
   round(coalesce(combined, 0), 9) >= 0.55 AS is_borrowing,
   CASE WHEN round(coalesce(combined, 0), 9) >= 0.75 THEN 'high' WHEN round(coalesce(combined, 0), 9) >= 0.55 THEN 'medium' WHEN round(coalesce(combined, 0), 9) >= 0.35 THEN 'low' ELSE 'none' END AS risk_level
   FROM qu LEFT JOIN top USING (scope, q) LEFT JOIN (SELECT scope, min(c) AS c0 FROM cu GROUP BY scope) f ON f.scope = qu.scope)
"""


# ---- queries -------------------------------------------------------------------------------------------------------

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


@query(_exploded_sql("documents", "doc_id", "text"))
def segment_documents(spark, d):
    return lexical.explode_segments(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens, len(list_distinct({_TOKENS.format('text')})) AS n_distinct FROM documents WHERE text IS NOT NULL")
def tokenize_counts(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g'), ' '), lambda x: x <> '')) AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"))


@query("SELECT doc_id, length(coalesce(text, '')) AS n_chars FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0")
def corpus_filter(spark, d):
    return table(spark, d, "documents").where("text is not null and length(trim(text)) > 0").select("doc_id", F.length("text").alias("n_chars"))


@query("SELECT doc_id, title, length(coalesce(text, '')) AS content_length, epoch_us(upload_date) AS upload_us FROM documents ORDER BY upload_date DESC NULLS LAST, doc_id DESC LIMIT 200")
def list_documents_topn(spark, d):
    t = table(spark, d, "documents").select("doc_id", "title", F.length(F.coalesce("text", F.lit(""))).alias("content_length"), F.unix_micros("upload_date").alias("upload_us"))
    return t.orderBy(F.desc_nulls_last("upload_us"), F.desc("doc_id")).limit(200)


@query(f"""WITH s AS ({_exploded_sql('documents', 'doc_id', 'text')}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT doc_id, seg_index FROM s JOIN n USING (doc_id) WHERE n <= 20 OR list_contains(list_transform(range(20), lambda i: round_even(i * (n - 1) / 19.0, 0)::BIGINT), seg_index)""")
def even_thinning(spark, d):
    return chunking.thin_evenly(segment_documents(spark, d).select("doc_id", "seg_index"), "doc_id", "seg_index", 20)


def _corpus_units(spark, d) -> DataFrame:
    s = lexical.explode_segments(table(spark, d, "corpus_sources"), "id", "content")
    return s.select(F.lit(0).alias("scope"), (F.col("id") * UNIT + F.col("seg_index")).alias("c"), F.col("segment").alias("text"))


_CORPUS_SQL = f"SELECT 0 AS scope, id * {UNIT} + seg_index AS c, segment AS text FROM ({_exploded_sql('corpus_sources', 'id', 'content')})"


@query(f"""WITH cu AS ({_CORPUS_SQL}), cp AS (SELECT DISTINCT c, unnest({_TOKENS.format('text')}) AS term FROM cu), n AS (SELECT count(*) AS n FROM cu),
 raw AS (SELECT term, count(*) AS df, any_value(n) AS n FROM cp CROSS JOIN n GROUP BY term), r AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM raw)
SELECT term, df, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf, round(CASE WHEN r < 0 THEN 0.25 * avg(r) OVER () ELSE r END, 9) AS bm25_idf FROM r""")
def term_df_idf(spark, d):
    s = lexical.corpus_statistics(_corpus_units(spark, d), ["c"], [], "text")
    return s.select("term", "df", F.round("idf", 9).alias("idf"), F.round("bm25_idf", 9).alias("bm25_idf"))


def _query_units(spark, d) -> DataFrame:
    s = lexical.explode_segments(table(spark, d, "documents"), "doc_id", "text")
    return s.select(F.lit(0).alias("scope"), (F.col("doc_id") * UNIT + F.col("seg_index")).alias("q"), F.col("segment").alias("text"))


_QUERY_SQL = f"SELECT 0 AS scope, doc_id * {UNIT} + seg_index AS q, segment AS text FROM ({_exploded_sql('documents', 'doc_id', 'text')})"


@query(f"WITH {_hybrid_sql(_QUERY_SQL, _CORPUS_SQL)} SELECT q // {UNIT} AS doc_id, q % {UNIT} AS seg_index, c // {UNIT} AS source_id, c % {UNIT} AS source_seg, tfidf_score, bm25_score, combined_score, is_borrowing, risk_level FROM best")
def hybrid_best_match(spark, d):
    b = lexical.best_matches(_query_units(spark, d), _corpus_units(spark, d))
    part = lambda c: (F.floor(F.col(c) / UNIT), F.col(c) % UNIT)
    return b.select(
        part("q")[0].alias("doc_id"), part("q")[1].alias("seg_index"), part("c")[0].alias("source_id"), part("c")[1].alias("source_seg"),
        "tfidf_score", "bm25_score", "combined_score", "is_borrowing", "risk_level")


@query(f"""WITH {_hybrid_sql(_QUERY_SQL, _CORPUS_SQL)}, a AS (SELECT q // {UNIT} AS doc_id, count(*) AS total_segments, count(*) FILTER (is_borrowing) AS borrowed_segments,
 100 * greatest(0, least(1, 0.5 * avg(is_borrowing::INT) + 0.5 * avg(CASE WHEN is_borrowing THEN combined_score ELSE 0 END))) AS r FROM best GROUP BY 1)
SELECT doc_id, total_segments, borrowed_segments, round(round(r, 6), 1) AS borrowing_percent, round(round(greatest(100 - r, 0), 6), 1) AS originality_percent FROM a""")
def lexical_originality(spark, d):
    return lexical.originality(hybrid_best_match(spark, d), "doc_id")


_PAIR = "SELECT DISTINCT source_document_id AS a, target_document_id AS b FROM plagiarism_matches WHERE source_document_id <> target_document_id"


@query(f"""WITH pr AS ({_PAIR}), sg AS ({_exploded_sql('documents', 'doc_id', 'text')}),
{_hybrid_sql("SELECT (a, b) AS scope, seg_index AS q, segment AS text FROM pr JOIN sg ON sg.doc_id = a", "SELECT (a, b) AS scope, seg_index AS c, segment AS text FROM pr JOIN sg ON sg.doc_id = b")}
SELECT scope[1] AS source_document_id, scope[2] AS target_document_id, round(round(avg(combined_score) * 100, 6), 1) AS similarity_percent, round(round(avg(tfidf_score) * 100, 6), 1) AS tfidf_percent,
 round(round(avg(bm25_score) * 100, 6), 1) AS bm25_percent, round(round(greatest(0, 100 - avg(combined_score) * 100), 6), 1) AS originality_percent,
 CASE WHEN round(avg(combined_score), 9) >= 0.75 THEN 'Высокая лексическая близость — возможное заимствование' WHEN round(avg(combined_score), 9) >= 0.55 THEN 'Умеренная лексическая близость — тематическое сходство'
  WHEN round(avg(combined_score), 9) >= 0.35 THEN 'Слабая связь — частичное пересечение терминов' ELSE 'Тексты лексически не связаны' END AS verdict FROM best WHERE c IS NOT NULL GROUP BY scope""")
def compare_matched_documents(spark, d):
    p = table(spark, d, "plagiarism_matches").select(F.col("source_document_id").alias("a"), F.col("target_document_id").alias("b")).where("a <> b").distinct()
    s = segment_documents(spark, d)
    side = lambda key, name: p.join(s, F.col(key) == F.col("doc_id")).select(F.struct("a", "b").alias("scope"), F.col("seg_index").alias(name), F.col("segment").alias("text"))
    c = lexical.compare(side("a", "q"), side("b", "c"))
    return c.select(F.col("scope.a").alias("source_document_id"), F.col("scope.b").alias("target_document_id"), "similarity_percent", "tfidf_percent", "bm25_percent", "originality_percent", reports.compared_verdict(F.col("similarity")).alias("verdict"))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@query(f"""SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0) WHERE rank <= 5""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e.where(F.col("vec_id") % EVERY == 0), e, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0 AND {_COS} >= 0.3")
def vector_threshold_search(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.at_least(e.where(F.col("vec_id") % EVERY == 0), e, "vec_id", "embedding", 0.3).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
 WHERE q.vec_id % {EVERY} = 0 AND e.label IN (1, 3, 5) AND {_COS} >= 0.1) WHERE rank <= 5""")
def vector_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e.where(F.col("vec_id") % EVERY == 0), e, "vec_id", "embedding", 5, 0.1, among=e.where("label in (1, 3, 5)")).withColumn("score", F.round("score", 6))


@query(f"SELECT q.vec_id AS query_id, coalesce(bool_or({_COS} >= 0.4), false) AS found FROM embeddings q LEFT JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0 GROUP BY 1")
def vector_exists_above(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.exists_above(e.where(F.col("vec_id") % EVERY == 0), e, "vec_id", "embedding", 0.4)


_CHUNKS = "(SELECT DISTINCT doc_id, chunk_index, copy_score, semantic_score, rerank_score, ai_score, source_label FROM chunk_analyses)"
_DECIDED = f"""d AS (SELECT *, CASE WHEN rerank_score IS NULL THEN coalesce(semantic_score, 0) >= 0.82
   ELSE (coalesce(semantic_score, 0) >= 0.82 AND greatest(0, least(1, rerank_score)) >= 0.65) OR greatest(0, least(1, rerank_score)) >= 0.75 END AS deep FROM {_CHUNKS}),
 k AS (SELECT *, NOT deep AND round_even(coalesce(copy_score, 0), 4) >= 0.75 AS copied FROM d)"""


def _decided(spark, d) -> DataFrame:
    c = table(spark, d, "chunk_analyses").select("doc_id", "chunk_index", "copy_score", "semantic_score", "rerank_score", "ai_score", "source_label").distinct()
    return scoring.decide(c)


@query(f"""WITH {_DECIDED} SELECT doc_id, chunk_index, deep, copied, CASE WHEN deep THEN 'deep_borrow' WHEN copied THEN 'copy' ELSE 'original' END AS kind, coalesce(ai_score, 0) >= 0.55 AS ai,
 CASE WHEN deep THEN 'high' WHEN copied THEN CASE WHEN copy_score >= 0.75 THEN 'high' WHEN copy_score >= 0.55 THEN 'medium' ELSE 'low' END WHEN coalesce(semantic_score, 0) >= 0.7 THEN 'medium' ELSE 'none' END AS risk FROM k""")
def chunk_cascade(spark, d):
    return _decided(spark, d).select("doc_id", "chunk_index", "deep", "copied", "kind", "ai", "risk")


@query(f"""WITH {_DECIDED}, a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (copied) AS c, count(*) FILTER (deep) AS e, avg(ai_score) FILTER (ai_score > 0) AS ai FROM k GROUP BY doc_id),
 p AS (SELECT *, round_even((c + e) / total * 100, 2) AS pp FROM a)
SELECT doc_id, total, round_even(c / total * 100, 2) AS copy_percent, round_even(e / total * 100, 2) AS deep_borrow_percent, pp AS plagiarism_percent, round(coalesce(ai * 100, 0), 6) AS ai_percent,
 round_even(greatest(0, 100 - pp), 2) AS originality_percent, CASE WHEN pp >= 60 THEN 'high' WHEN pp >= 35 THEN 'medium' WHEN pp >= 15 THEN 'low' ELSE 'none' END AS risk_level FROM p""")
def document_rollup(spark, d):
    return scoring.roll_up(_decided(spark, d), "doc_id")


@query("""WITH h AS (SELECT DISTINCT doc_id, segment_index, source_label, tfidf_score, combined_score FROM segment_matches WHERE is_borrowing AND source_label IS NOT NULL),
 g AS (SELECT doc_id, source_label, round_even(max(combined_score) * 100, 2) AS similarity_percent, round_even(max(tfidf_score) * 100, 2) AS copy_percent, count(*) AS fragments FROM h GROUP BY ALL),
 f AS (SELECT doc_id, source_label, segment_index FROM (SELECT DISTINCT doc_id, source_label, segment_index FROM h) QUALIFY row_number() OVER (PARTITION BY doc_id, source_label ORDER BY segment_index) <= 20)
SELECT g.*, s AS first_segments FROM g JOIN (SELECT doc_id, source_label, string_agg(segment_index, ',' ORDER BY segment_index) AS s FROM f GROUP BY ALL) USING (doc_id, source_label)""")
def matches_by_target(spark, d):
    h = table(spark, d, "segment_matches").where("source_label is not null").select("doc_id", "segment_index", "source_label", "tfidf_score", "combined_score", "is_borrowing").distinct()
    return scoring.by_target(h, ["doc_id", "source_label"])


@query("""SELECT m.id, m.source_document_id, m.target_document_id, t.title AS target_title, t.filename AS target_filename, coalesce(round_even(m.similarity_percent, 2), 0) AS similarity_percent,
 round_even(m.copy_percent, 2) AS copy_percent, round_even(m.deep_borrow_percent, 2) AS deep_borrow_percent FROM plagiarism_matches m JOIN documents t ON t.doc_id = m.target_document_id""")
def borrowings_report(spark, d):
    m = table(spark, d, "plagiarism_matches")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("target_document_id"), F.col("title").alias("target_title"), F.col("filename").alias("target_filename"))
    return m.join(t, "target_document_id").select(
        "id", "source_document_id", "target_document_id", "target_title", "target_filename", F.coalesce(F.bround("similarity_percent", 2), F.lit(0.0)).alias("similarity_percent"),
        F.bround("copy_percent", 2).alias("copy_percent"), F.bround("deep_borrow_percent", 2).alias("deep_borrow_percent"))


@query("""SELECT source_document_id, target_document_id, id, similarity_percent, epoch_us(created_at) AS created_us FROM plagiarism_matches
QUALIFY row_number() OVER (PARTITION BY source_document_id, target_document_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1""")
def upsert_matches(spark, d):
    m = table(spark, d, "plagiarism_matches").select("source_document_id", "target_document_id", "id", "similarity_percent", F.unix_micros("created_at").alias("created_us"))
    return scoring.latest(m, ["source_document_id", "target_document_id"], [F.col("created_us"), F.col("id")])


@query("""SELECT source_label, CASE WHEN regexp_matches(source_label, '^doc_\\d+$') THEN try_cast(regexp_extract(source_label, '^doc_(\\d+)$', 1) AS BIGINT) END AS target_id, count(*) AS fragments,
 count(DISTINCT doc_id) AS documents FROM segment_matches GROUP BY 1, 2""")
def label_targets(spark, d):
    s = table(spark, d, "segment_matches").groupBy("source_label").agg(F.count("*").alias("fragments"), F.count_distinct("doc_id").alias("documents"))
    return s.select("source_label", scoring.target_ids(F.col("source_label")).alias("target_id"), "fragments", "documents")


@query("""SELECT s.id AS source_id, s.label, s.chunk_count, count(c.id) AS chunks, count(DISTINCT c.chunk_index) AS places, coalesce(sum(length(c.content)), 0)::BIGINT AS n_chars
FROM corpus_sources s LEFT JOIN corpus_chunks c ON c.source_id = s.id GROUP BY ALL""")
def source_chunks_join(spark, d):
    # chunks are added up by source before the join: a source with very many is one row by then
    c = table(spark, d, "corpus_chunks").groupBy("source_id").agg(F.count("id").alias("chunks"), F.count_distinct("chunk_index").alias("places"), F.sum(F.length("content")).alias("n_chars"))
    s = table(spark, d, "corpus_sources").select(F.col("id").alias("source_id"), "label", "chunk_count")
    return s.join(c, "source_id", "left").fillna(0, ["chunks", "places", "n_chars"])


@query("""SELECT risk_level, CASE risk_level WHEN 'high' THEN 'Высокий риск заимствования' WHEN 'medium' THEN 'Средний риск заимствования' WHEN 'low' THEN 'Низкий риск заимствования'
 WHEN 'none' THEN 'Оригинальный фрагмент' ELSE 'Не определено' END AS risk_label, count(*) AS n, round(avg(combined_score), 6) AS mean_score FROM segment_matches GROUP BY 1, 2""")
def risk_labels(spark, d):
    s = table(spark, d, "segment_matches").groupBy("risk_level").agg(F.count("*").alias("n"), F.round(F.avg("combined_score"), 6).alias("mean_score"))
    return s.select("risk_level", T.risk_label(F.col("risk_level")).alias("risk_label"), "n", "mean_score")


@query("SELECT lower(regexp_extract(coalesce(filename, ''), '[^/\\\\]*[^/\\\\.](\\.[^./\\\\]+)$', 1)) AS extension, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1")
def file_formats(spark, d):
    return table(spark, d, "documents").groupBy(T.extension(F.col("filename")).alias("extension")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT u.username, u.user_role, count(d.doc_id) AS documents, coalesce(sum(d.n_chars), 0)::BIGINT AS n_chars, round(avg(d.originality_percent), 6) AS originality
FROM users u LEFT JOIN documents d ON d.user_id = u.username GROUP BY 1, 2""")
def documents_by_user(spark, d):
    # a tenth of the documents belong to one user: they are added up before the join
    a = table(spark, d, "documents").groupBy("user_id").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("n_chars"), F.round(F.avg("originality_percent"), 6).alias("originality"))
    u = table(spark, d, "users").select("username", "user_role")
    return u.join(a, u.username == a.user_id, "left").drop("user_id").fillna(0, ["documents", "n_chars"])


@query("""SELECT doc_id, epoch_us(upload_date) AS upload_us, count(*) OVER (ORDER BY upload_date RANGE UNBOUNDED PRECEDING) AS position FROM documents WHERE analytics_status = 'pending'""")
def queue_position(spark, d):
    # rows are counted by day first; only the days are in one window, and each day's rows in another
    p = table(spark, d, "documents").where("analytics_status = 'pending'").select("doc_id", "upload_date", F.to_date("upload_date").alias("day"))
    days = p.groupBy("day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.count("*").over(Window.partitionBy("day").orderBy("upload_date").rangeBetween(Window.unboundedPreceding, 0))
    return p.withColumn("within", within).join(days.select("day", before.alias("before")), "day").select("doc_id", F.unix_micros("upload_date").alias("upload_us"), (F.col("before") + F.col("within")).alias("position"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from attestra.streaming.runner import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


# ---- listings, reports and tasks --------------------------------------------------------------------------------------

@query("SELECT doc_id, CASE WHEN coalesce(analytics_status, '') = '' THEN 'pending' ELSE analytics_status END AS analytics_status, round_even(originality_percent, 2) AS originality_percent, round_even(copy_percent_ml, 2) AS copy_percent_ml, round_even(deep_borrow_percent_ml, 2) AS deep_borrow_percent_ml FROM documents")
def document_status(spark, d):
    return reports.status(table(spark, d, "documents"))


@query("""WITH f AS (SELECT min(doc_id) AS x FROM documents) SELECT doc_id, row_number() OVER (ORDER BY upload_date DESC NULLS LAST, doc_id DESC) - 1 AS place
FROM documents, f WHERE text IS NOT NULL AND length(trim(text)) > 0 AND doc_id <> x""")
def other_documents_newest_first(spark, d):
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("doc_id")).first()[0]
    held = store.others(docs, first).select("doc_id", "upload_date")
    return in_order(held, F.desc_nulls_last("upload_date"), F.desc("doc_id"), name="place").select("doc_id", "place")


@query("SELECT id, label, filename, chunk_count, epoch_us(indexed_at) AS indexed_us, epoch_us(created_at) AS created_us FROM corpus_sources")
def list_sources(spark, d):
    s = store.newest_sources(table(spark, d, "corpus_sources"))
    return s.select("id", "label", "filename", "chunk_count", F.unix_micros("indexed_at").alias("indexed_us"), F.unix_micros("created_at").alias("created_us"))


@query("""WITH asked AS (SELECT c.id AS place, unnest([source_id, -1, source_id]) AS id, unnest([0, 1, 2]) AS k FROM corpus_chunks c)
SELECT place * 3 + k AS place, s.id, s.label, length(s.content) AS n_chars FROM asked JOIN corpus_sources s USING (id)""")
def load_texts_in_order(spark, d):
    asked = table(spark, d, "corpus_chunks").select(F.col("id").alias("place"), F.posexplode(F.array("source_id", F.lit(-1).cast("long"), "source_id")).alias("k", "asked"))
    asked = asked.select((F.col("place") * 3 + F.col("k")).alias("place"), F.col("asked").alias("id"))
    rows = table(spark, d, "corpus_sources").select("id", "label", F.length("content").alias("n_chars"))
    return store.in_order(asked, rows).select("place", "id", "label", "n_chars")


_FRAGMENTS = """valid AS (SELECT *, CASE WHEN json_type(try_cast(matched_fragments AS JSON)) = 'ARRAY' THEN try_cast(matched_fragments AS JSON) END AS j FROM plagiarism_matches)"""


@query(f"""WITH {_FRAGMENTS}, r AS (SELECT m.id, source_document_id, target_document_id, t.title AS target_title, t.filename AS target_filename, coalesce(round_even(similarity_percent, 2), 0) AS similarity_percent,
 round_even(copy_percent, 2) AS copy_percent, round_even(deep_borrow_percent, 2) AS deep_borrow_percent, CASE WHEN coalesce(algorithm, '') = '' THEN '{reports.ALGORITHM}' ELSE algorithm END AS algorithm,
 coalesce(json_array_length(j), 0)::INT AS n_fragments FROM valid m JOIN documents t ON t.doc_id = m.target_document_id)
SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY similarity_percent DESC, id) AS rank FROM r""")
def sorted_borrowings(spark, d):
    b = reports.borrowings(table(spark, d, "plagiarism_matches"), table(spark, d, "documents"))
    return b.withColumn("n_fragments", F.size("matched_fragments")).drop("matched_fragments")


@query(f"""WITH {_FRAGMENTS}, f AS (SELECT id, unnest(range(json_array_length(j)::BIGINT))::INT AS place, unnest(json_extract(j, '$[*]')) AS x FROM valid WHERE j IS NOT NULL)
SELECT id, place, (x->>'segment_index')::INT AS segment_index, coalesce(x->>'segment_text', '') AS segment_text, coalesce(x->>'source_label', '') AS source_label,
 round_even(coalesce((x->>'combined_percent')::DOUBLE, (x->>'combined_score')::DOUBLE * 100), 2) AS combined_percent, round_even(coalesce((x->>'tfidf_percent')::DOUBLE, (x->>'tfidf_score')::DOUBLE * 100), 2) AS copy_percent,
 round_even(coalesce((x->>'semantic_percent')::DOUBLE, (x->>'semantic_score')::DOUBLE * 100), 2) AS deep_borrow_percent, coalesce((x->>'is_borrowing')::BOOLEAN, false) AS is_borrowing, coalesce(x->>'match_type', '') AS match_type FROM f""")
def normalized_fragments(spark, d):
    m = table(spark, d, "plagiarism_matches").select("id", F.posexplode(reports.normalized_fragments(F.col("matched_fragments"))).alias("place", "f"))
    return m.select("id", "place", *[f"f.{c}" for c in ("segment_index", "segment_text", "source_label", "combined_percent", "copy_percent", "deep_borrow_percent", "is_borrowing", "match_type")])


def _zipped(spark, d) -> DataFrame:
    """Fragments with lexical and semantic scores side by side: both tables at one grain, exact duplicates once."""
    s = table(spark, d, "segment_matches").groupBy("doc_id", "segment_index").agg(*[F.max(c).alias(c) for c in ("segment_text", "source_label", "tfidf_score", "combined_score", "is_borrowing", "risk_level")])
    c = table(spark, d, "chunk_analyses").groupBy("doc_id", F.col("chunk_index").alias("segment_index")).agg(*[F.max(c).alias(c) for c in ("semantic_score", "ai_score", "match_type")])
    return s.join(c, ["doc_id", "segment_index"], "left")


_ZIPPED = """zipped AS (SELECT s.*, semantic_score, ai_score, match_type FROM (SELECT doc_id, segment_index, max(segment_text) AS segment_text, max(source_label) AS source_label, max(tfidf_score) AS tfidf_score, max(combined_score) AS combined_score,
  bool_or(is_borrowing) AS is_borrowing, max(risk_level) AS risk_level FROM segment_matches GROUP BY ALL) s LEFT JOIN (SELECT doc_id, chunk_index AS segment_index, max(semantic_score) AS semantic_score, max(ai_score) AS ai_score,
  max(match_type) AS match_type FROM chunk_analyses GROUP BY ALL) c USING (doc_id, segment_index))"""
_KNOWN = "known AS (SELECT label AS source_label, max(id) AS named FROM corpus_sources GROUP BY label)"
_TARGET = r"coalesce(named, CASE WHEN regexp_matches(source_label, '^doc_\s*(-?\d+)\s*(:.*)?$') THEN try_cast(regexp_extract(source_label, '^doc_\s*(-?\d+)\s*(:.*)?$', 1) AS BIGINT) END)"


@query(f"""WITH {_ZIPPED}, {_KNOWN}, t AS (SELECT z.*, {_TARGET} AS target_document_id FROM zipped z LEFT JOIN known USING (source_label) WHERE is_borrowing),
 g AS (SELECT doc_id, target_document_id, round_even(max(combined_score) * 100, 2) AS similarity_percent, round_even(max(tfidf_score) * 100, 2) AS copy_percent, round_even(max(semantic_score) * 100, 2) AS deep_borrow_percent
  FROM t WHERE target_document_id IS NOT NULL GROUP BY ALL),
 f AS (SELECT doc_id, target_document_id, segment_index FROM t WHERE target_document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, target_document_id ORDER BY segment_index) <= 20)
SELECT g.*, s AS first_segments FROM g JOIN (SELECT doc_id, target_document_id, string_agg(segment_index, ',' ORDER BY segment_index) AS s FROM f GROUP BY ALL) USING (doc_id, target_document_id)""")
def targets_report(spark, d):
    z = _zipped(spark, d).withColumnRenamed("doc_id", "doc").withColumns({c: F.lit(None).cast("string") for c in ("source_text", "risk_label")} | {f"{c}_percent": F.lit(None).cast("double") for c in ("combined", "tfidf", "semantic")})
    r = reports.by_target(z, table(spark, d, "corpus_sources").select("label", "id"))
    first = F.concat_ws(",", F.transform("fragments", lambda x: x["segment_index"].cast("string")))
    return r.select(F.col("doc").alias("doc_id"), "target_document_id", "similarity_percent", "copy_percent", "deep_borrow_percent", first.alias("first_segments"))


@query(f"WITH {_ZIPPED} SELECT doc_id, max_by(combined_score, (combined_score, -segment_index)) AS combined_score, max_by(segment_text, (combined_score, -segment_index)) AS segment_text FROM zipped WHERE combined_score IS NOT NULL GROUP BY 1")
def top_fragments(spark, d):
    return reports.top_fragment(_zipped(spark, d).where("combined_score is not null"), ["doc_id"], "combined_score", "segment_text", "segment_index")


@query(f"""WITH {_ZIPPED}, a AS (SELECT doc_id, round(coalesce(avg(coalesce(ai_score, 0)) FILTER (length(trim(segment_text)) > 60), 0) * 100, 6) AS ai_percent FROM zipped GROUP BY 1)
SELECT doc_id, ai_percent, CASE WHEN ai_percent >= 70 THEN 'Высокая вероятность генерации ИИ' WHEN ai_percent >= 50 THEN 'Возможно частично сгенерирован ИИ' WHEN ai_percent >= 30 THEN 'Преимущественно человеческий текст' ELSE 'Скорее всего написан человеком' END AS verdict FROM a""")
def document_ai_verdicts(spark, d):
    a = reports.document_ai(_zipped(spark, d), "doc_id", "segment_text", "ai_score", 60, digits=6)
    return a.withColumn("verdict", reports.ai_verdict(F.col("ai_percent")))


@query("""WITH p AS (SELECT user_id, doc_id, word_count AS paragraphs, file_format AS format, file_format = 'pdf' AS ocr_available FROM documents WHERE user_id IS NOT NULL),
 f AS (SELECT user_id, format, min(doc_id) AS place FROM p WHERE format <> '' GROUP BY ALL), l AS (SELECT user_id, string_agg(format, ',' ORDER BY place) AS formats FROM f GROUP BY 1)
SELECT p.user_id, coalesce(sum(paragraphs), 0)::BIGINT AS paragraphs, bool_or(coalesce(ocr_available, false)) AS ocr_available, coalesce(any_value(formats), '') AS formats FROM p LEFT JOIN l USING (user_id) GROUP BY 1""")
def extraction_by_user(spark, d):
    none = {c: F.lit(None).cast("int") for c in ("tables", "images_ocr", "pages")}
    p = table(spark, d, "documents").where("user_id is not null").select("user_id", "doc_id", F.col("word_count").alias("paragraphs"), F.col("file_format").alias("format"), (F.col("file_format") == "pdf").alias("ocr_available")).withColumns(none)
    return reports.merged_extraction(p, ["user_id"], "doc_id").select("user_id", "paragraphs", "ocr_available", F.concat_ws(",", "formats").alias("formats"))


_SHOWN = "regexp_replace(printf('%.2f', {}), '0$', '')"


@query(f"""WITH {_DECIDED}, a AS (SELECT doc_id, count(*) AS total, count(*) FILTER (copied) AS c, count(*) FILTER (deep) AS e, avg(ai_score) FILTER (ai_score > 0) AS ai FROM k GROUP BY doc_id),
 p AS (SELECT *, round_even((c + e) / total * 100, 2) AS pp, round_even(c / total * 100, 2) AS cp, round_even(e / total * 100, 2) AS ep, floor(round(coalesce(ai * 100, 0), 6) * 100 + 0.5) / 100 AS ap FROM a)
SELECT doc_id, 'Оригинальность: ' || {_SHOWN.format('round_even(greatest(0, 100 - pp), 2)')} || '%. Глубокое заимствование: ' || {_SHOWN.format('ep')} || '%. Копирование: ' || {_SHOWN.format('cp')} || '%. ИИ: ' || {_SHOWN.format('ap')}
 || '%. Фрагментов: ' || total || ', совпадений: ' || (c + e) || '.' AS summary FROM p""")
def document_summaries(spark, d):
    k = _decided(spark, d)
    n = scoring.roll_up(k, "doc_id").join(k.groupBy("doc_id").agg(F.count_if(F.col("copied") | F.col("deep")).alias("found")), "doc_id")
    said = reports.summary(F.col("originality_percent"), F.col("deep_borrow_percent"), F.col("copy_percent"), F.floor(F.col("ai_percent") * 100 + 0.5) / 100, F.col("total"), F.col("found"))
    return n.select("doc_id", said.alias("summary"))


_TASKS = """tasks AS (SELECT o_orderkey AS id, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'PROCESSING' ELSE 'DONE' END AS status FROM orders)"""


def _tasks(spark, d) -> DataFrame:
    """Orders as tasks: their priority, date and status."""
    state = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("DONE")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("created_at"), state.alias("status"))


@query(f"WITH {_TASKS} SELECT id, priority, epoch_us(created_at) AS created_us FROM tasks WHERE status = 'PENDING' ORDER BY priority, created_at, id LIMIT 100")
def queue_next(spark, d):
    return tasks.next_pending(_tasks(spark, d), 100).select("id", "priority", F.unix_micros("created_at").alias("created_us"))


@query(f"WITH {_TASKS} SELECT status, count(*) AS n FROM tasks GROUP BY 1")
def status_counts(spark, d):
    return tasks.counts(_tasks(spark, d))


@query(f"WITH {_TASKS} SELECT id, count(*) OVER (ORDER BY created_at RANGE UNBOUNDED PRECEDING) AS position FROM tasks WHERE status = 'PENDING'")
def task_positions(spark, d):
    return tasks.positions(_tasks(spark, d))


@query("""WITH e AS (SELECT user_id AS id, ts AS t, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'DONE' ELSE 'PENDING' END AS status FROM events),
 ends AS (SELECT id, max_by(status, (t, status)) AS status, max(t) AS t FROM e GROUP BY 1), backs AS (SELECT id, max(t) AS back FROM e WHERE status = 'PENDING' GROUP BY 1),
 begun AS (SELECT id, min(t) AS started FROM e LEFT JOIN backs USING (id) WHERE status = 'PROCESSING' AND (back IS NULL OR t > back) GROUP BY 1)
SELECT id, status, epoch_us(started) AS started_us, CASE WHEN status IN ('DONE', 'FAILED') THEN epoch_us(t) END AS finished_us FROM ends LEFT JOIN begun USING (id)""")
def task_latest_state(spark, d):
    kind = F.when(F.col("event_type") == "click", "PROCESSING").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "DONE").otherwise("PENDING")
    none = {c: F.lit(None).cast("double") for c in ("plagiarism_pct", "copy_pct", "deep_borrow_pct", "ai_pct")} | {c: F.lit(None).cast("string") for c in ("progress", "error_message", "result_json")}
    log = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("status")).withColumns(none)
    s = tasks.state(log.select(F.col("task_id").alias("id")).distinct(), log)
    return s.select("id", "status", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"))


@query(r"SELECT doc_id, CASE WHEN coalesce(regexp_matches(lower(filename), '[^/]\.(pdf|docx)$'), false) OR coalesce(file_format IN ('pdf', 'docx'), false) THEN 2 ELSE 1 END AS priority FROM documents")
def priority_rule(spark, d):
    rule = tasks.priority(F.lit(None).cast("int"), F.lit(None).cast("int"), F.array("filename"), F.array("file_format"))
    return table(spark, d, "documents").select("doc_id", rule.alias("priority"))


_PIECES = f"list_filter(list_transform(string_split(coalesce(content, ''), '---'), lambda b: {_strip_sql('b')}), lambda b: b <> '')"


@query(f"""WITH b AS (SELECT id, {_PIECES} AS p FROM corpus_sources), e AS (SELECT id, unnest(range(len(p)))::INT AS block, unnest(p) AS x FROM b),
 n AS (SELECT *, instr(x, chr(10)) > 0 AND length(split_part(x, chr(10), 1)) < 80 AS named FROM e)
SELECT id, block, CASE WHEN named THEN {_strip_sql("split_part(x, chr(10), 1)")} ELSE 'Источник ' || (block + 1) END AS label, CASE WHEN named THEN {_strip_sql("substr(x, instr(x, chr(10)) + 1)")} ELSE x END AS text FROM n""")
def parse_pasted(spark, d):
    return files.parse_pasted(table(spark, d, "corpus_sources"), "id", "content")


# ---- whole analyses -----------------------------------------------------------------------------------------------------

#: A wider profile, so that all parts of an analysis have rows in invented texts.
_PROFILE = profile(enable_reranker=True, semantic_top_k=2, copy_threshold=0.6, deep_semantic_threshold=0.6, deep_rerank_threshold=0.2, own_idf=False, max_chunks=0)

_QCHUNKS = f"""(SELECT source_id AS doc, chunk_index, max_by(content, id) AS text FROM corpus_chunks WHERE source_id % {EVERY} = 0 AND content IS NOT NULL GROUP BY ALL)"""
_ANALYSIS_SQL = f"""chunks AS {_QCHUNKS}, segs AS ({_exploded_sql('documents', 'doc_id', 'text')}),
 corpus AS (SELECT id, source_id, content AS text, 'source_' || source_id AS label FROM corpus_chunks WHERE source_id % {EVERY} <> 0 AND content IS NOT NULL),
 words AS (SELECT 'q' AS side, doc * {UNIT} + chunk_index AS u, unnest({_TOKENS.format('text')}) AS w FROM chunks UNION ALL SELECT 'c', id, unnest({_TOKENS.format('text')}) FROM corpus),
 placed AS (SELECT side, u, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS k, sum(CASE WHEN substr(md5(w), 5, 1) < '8' THEN 1 ELSE -1 END) AS x FROM words GROUP BY ALL),
 norms AS (SELECT side, u, sqrt(sum(x * x)) AS n FROM placed GROUP BY ALL HAVING sum(x * x) > 0),
 cos AS (SELECT a.u AS q, b.u AS c, sum(a.x * b.x) / any_value(na.n) / any_value(nb.n) AS score FROM placed a JOIN placed b ON a.k = b.k AND a.side = 'q' AND b.side = 'c'
   JOIN norms na ON na.side = 'q' AND na.u = a.u JOIN norms nb ON nb.side = 'c' AND nb.u = b.u GROUP BY 1, 2),
 cand AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, c) AS rank FROM cos QUALIFY rank <= 2),
 full_ AS (SELECT cand.*, k.text AS content, k.label, h.text AS asked FROM cand JOIN corpus k ON k.id = c JOIN chunks h ON h.doc * {UNIT} + h.chunk_index = q),
 first_ AS (SELECT q, score AS semantic, label, content AS first_text FROM full_ WHERE rank = 1),
 pairs_ AS (SELECT *, list_distinct({_TOKENS.format('asked')}) AS x, list_distinct({_TOKENS.format('content')}) AS y FROM full_),
 scored_ AS (SELECT q, rank, content, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS s FROM pairs_),
 rr AS (SELECT q, max(s) AS pair, max_by(content, (s, -rank)) AS pair_text FROM scored_ JOIN first_ USING (q) WHERE semantic >= 0.55 GROUP BY q),
 {_hybrid_sql(f"SELECT 0 AS scope, doc * {UNIT} + chunk_index AS q, text FROM chunks", f"SELECT 0 AS scope, doc_id * {UNIT} + seg_index AS c, segment AS text FROM segs")},
 both_ AS (SELECT h.doc, h.chunk_index, coalesce(semantic, 0) AS semantic, greatest(0, least(1, coalesce(pair, 0))) AS rerank, coalesce(pair_text, first_text, '') AS found_text, coalesce(label, '') AS label,
   best.combined_score, best.risk_level AS copy_risk, best.is_borrowing, s.segment AS copy_text, 'doc_' || s.doc_id AS copy_label FROM chunks h LEFT JOIN first_ ON first_.q = h.doc * {UNIT} + h.chunk_index
   LEFT JOIN rr ON rr.q = h.doc * {UNIT} + h.chunk_index LEFT JOIN best ON best.q = h.doc * {UNIT} + h.chunk_index LEFT JOIN segs s ON s.doc_id * {UNIT} + s.seg_index = best.c),
 flagged AS (SELECT *, (semantic >= 0.6 AND rerank >= 0.2) OR rerank >= 0.75 AS deep FROM both_),
 decided AS (SELECT *, NOT deep AND coalesce(combined_score >= 0.6, false) AS copied FROM flagged)"""


def _analysis(spark, d) -> DataFrame:
    """Stored chunks of the query sources against all documents' segments, and against the chunks of the other sources."""
    held = table(spark, d, "corpus_chunks").where("content is not null")
    chunks = held.where(F.col("source_id") % EVERY == 0).groupBy(F.col("source_id").alias("doc"), "chunk_index").agg(F.max_by("content", "id").alias("text"))
    corpus = held.where(F.col("source_id") % EVERY != 0).select(F.col("id").alias("unit"), F.concat(F.lit("source_"), F.col("source_id").cast("string")).alias("label"), F.col("content").alias("text"))
    segs = segment_documents(spark, d).select(F.col("doc_id").alias("source"), F.col("seg_index").alias("segment"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("label"), F.col("segment").alias("text"))
    return pipeline.analyze_chunks(chunks, segs, corpus, _PROFILE)


@query(f"""WITH {_ANALYSIS_SQL} SELECT doc, chunk_index, coalesce(combined_score, 0) AS copy_score, round(CASE WHEN copied THEN 0 ELSE greatest(semantic, rerank) END, 9) AS deep_score, round(semantic, 9) AS semantic_score, round(rerank, 9) AS rerank_score,
 copied AS is_copy, deep AS is_deep_borrow, CASE WHEN deep THEN 'deep' WHEN copied THEN 'copy' ELSE 'none' END AS match_type, CASE WHEN deep THEN found_text WHEN copied THEN copy_text ELSE '' END AS source_text,
 CASE WHEN deep THEN label WHEN copied THEN copy_label ELSE '' END AS source_label, CASE WHEN deep THEN 'high' WHEN copied THEN copy_risk WHEN semantic >= 0.7 THEN 'medium' ELSE 'none' END AS risk_level FROM decided""")
def analyze_chunks(spark, d):
    c = _analysis(spark, d)
    return c.select("doc", "chunk_index", "copy_score", *[F.round(x, 9).alias(x) for x in ("deep_score", "semantic_score", "rerank_score")], "is_copy", "is_deep_borrow", "match_type", "source_text", "source_label", "risk_level")


@query(f"""WITH {_ANALYSIS_SQL}, a AS (SELECT doc, count(*) AS total, count(*) FILTER (copied) AS c, count(*) FILTER (deep) AS e,
  round(greatest(100 - 100 * greatest(0, least(1, 0.5 * avg(coalesce(is_borrowing, false)::INT) + 0.5 * avg(CASE WHEN is_borrowing THEN combined_score ELSE 0 END))), 0), 6) AS lex FROM decided GROUP BY doc),
 p AS (SELECT *, round_even((c + e) / total * 100, 2) AS pp, round_even(c / total * 100, 2) AS cp, round_even(e / total * 100, 2) AS ep FROM a)
SELECT doc, round_even(greatest(0, 100 - pp), 2) AS originality_percent, pp AS plagiarism_percent, cp AS copy_percent, ep AS deep_borrow_percent, CASE WHEN pp >= 60 THEN 'high' WHEN pp >= 35 THEN 'medium' WHEN pp >= 15 THEN 'low' ELSE 'none' END AS risk_level,
 total AS total_segments, c + e AS borrowed_segments, round(lex, 1) AS lexical_originality_percent,
 'Оригинальность: ' || {_SHOWN.format('round_even(greatest(0, 100 - pp), 2)')} || '%. Глубокое заимствование: ' || {_SHOWN.format('ep')} || '%. Копирование: ' || {_SHOWN.format('cp')} || '%. ИИ: 0.0%. Фрагментов: ' || total || ', совпадений: ' || (c + e) || '.' AS summary FROM p""")
def analyze_sources(spark, d):
    c = materialize(_analysis(spark, d))
    r = reports.assembled(c.select("doc").distinct(), c)
    return r.select("doc", "originality_percent", "plagiarism_percent", "copy_percent", "deep_borrow_percent", "risk_level", "total_segments", "borrowed_segments", "lexical_originality_percent", "summary")


@query()
def analyze_documents(spark, d):
    """All documents against all of the corpus, from text to result."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    corpus = table(spark, d, "corpus_sources").select(F.col("id").alias("source"), "label", F.col("content").alias("text"))
    return pipeline.analyze_corpus(texts, corpus, profile(own_idf=False, max_chunks=0))[0]


@query()
def compare_documents(spark, d):
    """Every pair of matched documents, compared as texts."""
    p = table(spark, d, "plagiarism_matches").select("source_document_id", "target_document_id").where("source_document_id <> target_document_id").distinct()
    t = table(spark, d, "documents").select("doc_id", "text")
    pairs = in_order(p, F.col("source_document_id"), F.col("target_document_id"), name="pair")
    texts = pairs.join(t.toDF("source_document_id", "text_a"), "source_document_id").join(t.toDF("target_document_id", "text_b"), "target_document_id")
    out = pipeline.analyze_compare(texts.select("pair", "text_a", "text_b"), profile())
    return out.join(pairs, "pair").drop("pair")


@query()
def chunk_documents(spark, d):
    return chunking.chunk_texts(table(spark, d, "documents"), "doc_id", "text")


_SERVICE = " OR ".join(f"starts_with({{0}}, '{h}')" for h in front_matter.SERVICE)
_TITLED = " OR ".join(f"contains({{0}}, '{t}')" for t in front_matter.TITLE)
_NOISE_SQL = f"({{0}} = '' OR regexp_matches({{0}}, '(?i)^---{_WS}*Страница{_WS}+[0-9]+{_WS}*---$') OR regexp_matches({{0}}, '(?i)^\\[Таблица{_WS}+[0-9]+\\]'))"
_CONTENTS_SQL = f"(regexp_matches({{0}}, '\\t[0-9]+$') OR (regexp_matches({{0}}, '{_WS}\\p{{{{Nd}}}}+$') AND length({_strip_sql("regexp_replace({0}, '\\p{{Nd}}+$', '')")}) > 2))".replace("{{{{Nd}}}}", "{{Nd}}")
_PLAIN_SQL = f"lower(regexp_replace({{0}}, '{_WS}+', ' ', 'g'))"


def _of(sql: str, c: str) -> str:
    return sql.replace("{0}", c).replace("{{", "{").replace("}}", "}")


#: The same by relations: paragraphs, their lines in order, windows over the lines, and the kept paragraphs put together.
_FRONT_MATTER_SQL = f"""WITH t AS (SELECT doc_id, text, {_strip_sql("coalesce(text, '')")} AS w FROM documents),
 parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(w, '\\n{_WS}*\\n', chr(1), 'g'), chr(1)), lambda x: {_strip_sql('x')}), lambda x: x <> '') AS p FROM t),
 one AS (SELECT doc_id, list_filter(list_transform(string_split(p[1], chr(10)), lambda x: {_strip_sql('x')}), lambda x: x <> '') AS l FROM parts WHERE len(p) = 1),
 cut AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM one WHERE len(l) >= 8),
 headed AS (SELECT *, i = 0 OR regexp_matches({_of(_PLAIN_SQL, 'x')}, '^(реферат|аннотация|содержание|оглавление|задание|введение|перечень условных|перечень сокращений|1(\\.{_WS}+|{_WS}+)[^{_WS[1:-1]}])')
   OR {_of(_NOISE_SQL, 'x')} OR {_of(_CONTENTS_SQL, 'x')} OR (length(x) < 120 AND ({_of(_TITLED, 'lower(x)')})) AS head FROM cut),
 grouped AS (SELECT doc_id, i, x, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM headed),
 para AS (SELECT doc_id, k, string_agg(x, chr(10) ORDER BY i) AS p FROM grouped GROUP BY ALL
   UNION ALL SELECT doc_id, unnest(range(len(p))), unnest(p) FROM parts WHERE doc_id NOT IN (SELECT doc_id FROM cut)),
 raw AS (SELECT doc_id, k, unnest(range(len(string_split(p, chr(10))))) AS r, unnest(string_split(p, chr(10))) AS x FROM para),
 clean AS (SELECT doc_id, k, r, x, {_strip_sql('x')} AS s FROM raw WHERE NOT {_of(_NOISE_SQL, _strip_sql('x'))}),
 line AS (SELECT doc_id, k, r, s, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id, k) AS n, {_of(_PLAIN_SQL, 's')} AS plain, {_of(_CONTENTS_SQL, 's')} AS contents,
   regexp_matches(s, '^1\\.?{_WS}+[^0-9]') AS chapter, lead(s) OVER w AS after, sum(length(s) + 1) OVER (PARTITION BY doc_id, k ORDER BY r DESC) - 1 AS below FROM clean WINDOW w AS (PARTITION BY doc_id, k ORDER BY r)),
 under AS (SELECT *, min(CASE WHEN chapter AND NOT contents THEN i END) OVER (PARTITION BY doc_id, k ORDER BY i DESC) AS j,
   CASE WHEN i = n - 1 THEN length(s) >= 50 ELSE length(after) >= 30 OR below >= 100 END AS enough FROM line),
 opening AS (SELECT a.doc_id, a.k, a.i, a.plain = 'введение' AS intro, a.s FROM under a LEFT JOIN under b ON b.doc_id = a.doc_id AND b.k = a.k AND b.i = a.j
   WHERE (a.plain = 'введение' AND (a.i = a.n - 1 OR length(a.after) >= 40)) OR (a.chapter AND coalesce(b.enough, false))),
 start AS (SELECT doc_id, k, i, CASE WHEN intro THEN 'Введение' ELSE substr(s, 1, 60) END AS marker FROM opening QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, i) = 1),
 shown AS (SELECT doc_id, k, bool_or(i = 0 AND ({_of(_SERVICE, 'plain')})) OR count(*) FILTER (contents) >= 2 OR bool_or(false) AS dropped, lower(string_agg(s, ' ' ORDER BY i) FILTER (i < 6)) AS sample FROM line GROUP BY ALL),
 prose AS (SELECT c.doc_id, c.k, {_strip_sql("string_agg(c.x, chr(10) ORDER BY c.r)")} AS b FROM clean c JOIN start USING (doc_id) JOIN shown s ON s.doc_id = c.doc_id AND s.k = c.k
   WHERE c.k > start.k AND NOT s.dropped AND NOT ({_of(_TITLED, 's.sample')}) GROUP BY ALL),
 kept AS (SELECT line.doc_id, line.k, string_agg(s, chr(10) ORDER BY line.i) AS b FROM line JOIN start ON start.doc_id = line.doc_id AND start.k = line.k AND line.i >= start.i GROUP BY ALL UNION ALL SELECT * FROM prose),
 body AS (SELECT doc_id, {_strip_sql("string_agg(b, chr(10) || chr(10) ORDER BY k)")} AS b FROM kept GROUP BY 1)
SELECT t.doc_id, CASE WHEN length(b) >= {front_matter.LEAST_BODY} THEN b ELSE text END AS body, CASE WHEN length(b) >= {front_matter.LEAST_BODY} THEN length(text) - length(b) ELSE 0 END::INT AS removed_chars,
 CASE WHEN length(b) >= {front_matter.LEAST_BODY} THEN marker ELSE '' END AS body_start_marker FROM t LEFT JOIN body USING (doc_id) LEFT JOIN start USING (doc_id)"""


@query(_FRONT_MATTER_SQL)
def strip_front_matter(spark, d):
    return front_matter.without_front_matter(table(spark, d, "documents"), "doc_id", "text")


@query()
def bigram_ai_scores(spark, d):
    return scoring.bigram_ai_scores(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
