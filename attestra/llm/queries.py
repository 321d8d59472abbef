"""Queries of the training-data operators over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attestra.plans.runtime import table


def records(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """rec, text of documents (d), corpus sources (s) or corpus chunks (c)."""
    of = {"d": ("documents", "doc_id", "text"), "s": ("corpus_sources", "id", "content"), "c": ("corpus_chunks", "id", "content")}
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(k), F.col(i).cast("string")).alias("rec"), F.col(x).alias("text")) for k in kinds for t, i, x in [of[k]]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.spans import SharedSpans

    return SharedSpans(records(spark, sf_dir, "d", "c")).pairs()


def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.spans import SharedSpans

    return SharedSpans(records(spark, sf_dir, "d", "c")).spans()


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.spans import SharedSpans

    return SharedSpans(records(spark, sf_dir, "d", "c")).coverage()


def p1_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.spans import SharedSpans

    return SharedSpans(records(spark, sf_dir, "d", "c")).shared()


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.neighbours import vector_classes

    classes = vector_classes(table(spark, sf_dir, "corpus_chunks"), "id", "embedding_json")
    return classes.select(F.col("id").alias("chunk_id"), F.col("point").alias("class_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_similar(spark, sf_dir).select("chunk_a", "chunk_b")


def p2_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.neighbours import similar_pairs

    pairs = similar_pairs(table(spark, sf_dir, "corpus_chunks"), "id", "embedding_json")
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"), "cosine")


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "segment_matches").select("doc_id", "segment_index", "tfidf_score", "bm25_score", F.lit(1).alias("held"))
    b = table(spark, sf_dir, "chunk_analyses").select("doc_id", F.col("chunk_index").alias("segment_index"), "semantic_score", "rerank_score")
    both = a.unionByName(b, allowMissingColumns=True).groupBy("doc_id", "segment_index")
    return both.agg(F.max("held").alias("held"), *[F.max(c).alias(c) for c in SCORES]).where("held = 1")


SCORES = ["tfidf_score", "bm25_score", "semantic_score", "rerank_score"]


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.ranking import net_flow_ranking

    return net_flow_ranking(_fragments(spark, sf_dir), "doc_id", "segment_index", SCORES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.ranking import best_item

    return best_item(p3_ranking(spark, sf_dir), "doc_id", "segment_index", 3)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.components import connected_groups

    return connected_groups(table(spark, sf_dir, "plagiarism_matches"), "source_document_id", "target_document_id", "doc_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_restored(spark, sf_dir).select("rec")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.encoding import garbled

    return garbled(records(spark, sf_dir, "d", "s"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.scans import scanned

    return scanned(records(spark, sf_dir, "d", "s"), repaired=False).select("rec")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.scans import scanned

    return scanned(records(spark, sf_dir, "d", "s"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.lookalike import same_looking_pairs

    return same_looking_pairs(records(spark, sf_dir, "d", "s"))


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.lookalike import one_form

    return one_form(records(spark, sf_dir, "d", "s"))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.lookalike import look_classes

    return look_classes(records(spark, sf_dir, "d", "s"))


def _counted(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    from attestra.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", list(keep))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.packing import harmonic_packing

    return harmonic_packing(_counted(spark, sf_dir), "doc_id", "n_tokens", table(spark, sf_dir, "pack_capacities"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and the share of unused space, by capacity."""
    bins = p8_containers(spark, sf_dir).groupBy("capacity_id", "container").agg(F.first("unused").alias("unused"), F.sum("n_tokens").alias("used"))
    total = F.sum("unused") + F.sum("used")
    return bins.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("unused").alias("unused"), (F.sum("unused") / total).alias("unused_share"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity, what must hold of any packing: documents with a token and none of them missing, no container over its capacity or empty,
    unused space as reported, no document cut that fits a container, and every cut one in pieces that are full but for the last."""
    bins = p8_containers(spark, sf_dir).join(table(spark, sf_dir, "pack_capacities"), "capacity_id")
    held = bins.groupBy("capacity_id", "max_tokens", "container").agg(F.sum("n_tokens").alias("used"), F.min("unused").alias("least"), F.max("unused").alias("most"))
    held = held.groupBy("capacity_id").agg(
        F.count_if((F.col("used") > F.col("max_tokens")) | (F.col("used") < 1)).alias("misfilled"), F.count_if((F.col("least") != F.col("most")) | (F.col("used") + F.col("least") != F.col("max_tokens"))).alias("misreported"))
    each = bins.groupBy("capacity_id", "max_tokens", "doc_id").agg(
        F.count("*").alias("pieces"), F.count_distinct("piece").alias("places"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"),
        F.count_if(F.col("n_tokens") < F.col("max_tokens")).alias("short"))
    wrong = (F.col("pieces") != F.ceil(F.col("n") / F.col("max_tokens"))) | (F.col("places") != F.col("pieces")) | (F.col("last") != F.col("pieces") - 1) | (F.col("short") > 1)
    each = each.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("miscut"))
    return each.join(held, "capacity_id")


def _curriculum(spark: SparkSession, sf_dir: str):
    from attestra.llm.mixing import Curriculum

    return Curriculum(_counted(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"), "doc_id")


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curriculum(spark, sf_dir).usage()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curriculum(spark, sf_dir).shares()


def p9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curriculum(spark, sf_dir).order()


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the targets: whether it gives its target share of the tokens to within a document (its own, and its share of one of every
    other source), and no document is used more often than it may be."""
    mix = _curriculum(spark, sf_dir)
    most = mix.usage().groupBy("source").agg(F.max("n_tokens").alias("longest"))
    shares = mix.shares().join(table(spark, sf_dir, "mix_targets").select("source", "max_repeats"), "source").join(most, "source")
    whole = Window.partitionBy(F.lit(0))  # a row a source
    total, slack = F.sum("used_tokens").over(whole), F.sum("longest").over(whole)
    met = F.abs(F.col("used_tokens") - F.col("target_share") * total) <= F.col("longest") + F.col("target_share") * slack + 1
    return shares.select("source", "target_share", met.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.repetition import repetitive

    return repetitive(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestra.llm.repetition import repetition

    return repetition(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Every stretch of 300 characters of every record.
P1_SQL = """
WITH recs AS (SELECT 'd' || doc_id AS rec, text FROM documents UNION ALL SELECT 'c' || id, content FROM corpus_chunks),
 grams AS (SELECT rec, hash(substr(text, i, 300)) AS h, i FROM recs, unnest(range(1, length(text) - 298)) AS t(i))
"""
P1_COVERAGE_SQL = P1_SQL + """, held AS (SELECT h FROM grams GROUP BY h HAVING count(DISTINCT rec) > 1),
 starts AS (SELECT rec, least(300, coalesce(lead(i) OVER (PARTITION BY rec ORDER BY i) - i, 300)) AS covers FROM grams JOIN held USING (h)),
 shared AS (SELECT rec, sum(covers)::BIGINT AS s FROM starts GROUP BY rec)
SELECT rec, coalesce(length(text), 0) AS n_chars, coalesce(s, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(s, 0) / length(text) ELSE 0.0 END AS shared_share
FROM recs LEFT JOIN shared USING (rec)
"""
P1_SPANS_SQL = P1_SQL + """, held AS (SELECT h FROM grams GROUP BY h HAVING count(DISTINCT rec) > 1),
 starts AS (SELECT rec, i, CASE WHEN i - lag(i) OVER (PARTITION BY rec ORDER BY i) <= 300 THEN 0 ELSE 1 END AS new FROM grams JOIN held USING (h)),
 runs AS (SELECT rec, i, sum(new) OVER (PARTITION BY rec ORDER BY i) AS run FROM starts)
SELECT rec, (min(i) - 1)::INT AS start, (max(i) - min(i) + 300)::INT AS n_chars FROM runs GROUP BY rec, run
"""
P3_SQL = """
WITH held AS (SELECT doc_id, segment_index, max(tfidf_score) AS a, max(bm25_score) AS b FROM segment_matches WHERE doc_id IS NOT NULL AND segment_index IS NOT NULL GROUP BY 1, 2),
 more AS (SELECT doc_id, chunk_index AS segment_index, max(semantic_score) AS c, max(rerank_score) AS d FROM chunk_analyses GROUP BY 1, 2),
 wide AS (SELECT h.*, c, d FROM held h LEFT JOIN more USING (doc_id, segment_index)),
 long AS (SELECT doc_id, segment_index, unnest([1, 2, 3, 4]) AS k, unnest([a, b, c, d]) AS v FROM wide),
 placed AS (SELECT *, (rank() OVER w + count(*) OVER (PARTITION BY doc_id, k, v) / 2.0 - 1) / count(*) OVER (PARTITION BY doc_id, k) AS x, count(*) OVER (PARTITION BY doc_id, k) AS n
   FROM long WHERE v IS NOT NULL WINDOW w AS (PARTITION BY doc_id, k ORDER BY v)),
 flows AS (SELECT a.doc_id, a.segment_index, a.k, sum(greatest(0, least(1, (a.x - b.x - 0.05) / 0.9)) - greatest(0, least(1, (b.x - a.x - 0.05) / 0.9))) / greatest(1, any_value(a.n) - 1) AS f
   FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.k = b.k GROUP BY 1, 2, 3),
 net AS (SELECT w.doc_id, w.segment_index, round(coalesce(sum(f), 0) / 4, 9) + 0.0 AS net_flow, count(f) AS n_scores
   FROM wide w LEFT JOIN flows f ON f.doc_id = w.doc_id AND f.segment_index = w.segment_index GROUP BY 1, 2)
"""
P4_SQL = """
WITH RECURSIVE links AS (SELECT source_document_id AS a, target_document_id AS b FROM plagiarism_matches
   UNION SELECT target_document_id, source_document_id FROM plagiarism_matches),
 reach(doc_id, other) AS (SELECT a, a FROM links WHERE a IS NOT NULL UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other WHERE l.b IS NOT NULL)
SELECT doc_id, min(other) AS group_id FROM reach GROUP BY doc_id
"""

#: Vectors that take part, of unit length.
P2_SQL = r"""
WITH parsed AS (SELECT id, try_cast(try_cast(embedding_json AS JSON) AS DOUBLE[]) AS v, try_cast(embedding_json AS JSON) AS j FROM corpus_chunks WHERE embedding_json IS NOT NULL),
 usable AS (SELECT id, v FROM parsed WHERE json_type(j) = 'ARRAY' AND len(v) = 64 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)))
   AND list_bool_or(list_transform(v, lambda x: x <> 0)) AND list_bool_and(list_transform(json_extract(j, '$[*]'), lambda x: json_type(x) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT')))),
 scaled AS (SELECT id, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM usable),
 unit AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM scaled)
"""
#: All pairs: for tables of a size where that many are no trouble.
P2_FOUND_SQL = P2_SQL + """, cos AS (SELECT a.id AS q, b.id AS c, list_inner_product(a.u, b.u) AS s FROM unit a JOIN unit b ON a.id <> b.id),
 fifth AS (SELECT q, min(s) AS f FROM (SELECT q, s FROM cos QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC) <= 5) GROUP BY q)
SELECT DISTINCT least(q, c) AS chunk_a, greatest(q, c) AS chunk_b FROM cos JOIN fifth USING (q) WHERE s >= f - 1e-6
"""
P2_CLASSES_SQL = P2_SQL + "SELECT id AS chunk_id, min(id) OVER (PARTITION BY list_transform(u, lambda x: x::FLOAT)) AS class_id FROM unit"
P8_CHECKS_SQL = """
SELECT capacity_id, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0 AS miscut, 0 AS misfilled, 0 AS misreported FROM pack_capacities
"""
#: The rule itself: five-word runs that began earlier in the text, counted place by place.
P10_SQL = r"""
WITH split AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' '),
   lambda w: lower(regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', ''))), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
 runs AS (SELECT doc_id, len(w) AS n, i, array_to_string(w[i:i + 4], ' ') AS r FROM split, unnest(range(1, len(w) - 3)) AS t(i)),
 again AS (SELECT doc_id, n, i FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, r ORDER BY i) > 1),
 marked AS (SELECT DISTINCT doc_id, n, i + k AS place FROM again, range(5) AS u(k))
SELECT doc_id FROM marked GROUP BY doc_id, n HAVING count(*) >= 0.3 * n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_spans, p1_coverage, p1_shared, p2_found, p2_similar, p2_classes, p3_found, p3_ranking, p4_found, p5_found, p5_restored, p6_found, p6_repaired, p7_found, p7_forms, p7_classes, p8_containers, p8_fill, p8_checks, p9_usage, p9_shares, p9_order, p9_checks, p10_found, p10_repetition)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL + "SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM grams a JOIN grams b ON a.h = b.h AND a.rec < b.rec",
        "p1_spans": P1_SPANS_SQL,
        "p1_coverage": P1_COVERAGE_SQL,
        "p3_ranking": P3_SQL + "SELECT * FROM net",
        "p3_found": P3_SQL + "SELECT doc_id, arg_max(segment_index, (net_flow, -segment_index)) AS segment_index FROM net GROUP BY doc_id HAVING count(*) >= 3",
        "p4_found": P4_SQL,
        "p2_found": P2_FOUND_SQL,
        "p2_classes": P2_CLASSES_SQL,
        "p8_checks": P8_CHECKS_SQL,
        "p9_checks": "SELECT source, target_share, true AS share_met, true AS repeats_kept FROM mix_targets",
        "p10_found": P10_SQL,
    }
