"""Whole analyses: texts against a corpus, and text against text, as one plan from chunks to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.config import Options
from attestra.functions import text as T
from attestra.operators import lexical, providers, reports, scoring, vectors
from attestra.operators.chunking import chunk_texts, thin_evenly
from attestra.operators.front_matter import stripped
from attestra.plans import runtime
from attestra.plans.runtime import discard, join_few, materialize, ship

#: A number for a unit: its text's number times this, plus its place in the text.
PLACES = 1_000_000


def chunks_of(texts: DataFrame, id: str, text: str, options: Options) -> DataFrame:
    """(id, chunk_index, text) of the texts' chunks, thinned evenly to max_chunks a text and numbered anew."""
    cut = chunk_texts(texts, id, text, options.chunk_size, options.chunk_overlap)
    kept = thin_evenly(cut, id, "chunk_index", options.max_chunks)
    place = F.row_number().over(Window.partitionBy(id).orderBy("chunk_index")) - 1
    return kept.select(id, place.alias("chunk_index"), F.col("chunk").alias("text"))


def corpus_segments(corpus: DataFrame, strip: bool = True) -> DataFrame:
    """(source, segment, label, text) of a corpus (source long, label, text): segments of at least 20 characters, without front matter. A source
    without a label is named by its number from 1."""
    body = stripped(F.col("text"))["body"] if strip else F.col("text")
    label = F.coalesce("label", F.concat(F.lit("Источник "), (F.col("source") + 1).cast("string")))
    return corpus.select("source", label.alias("label"), F.posexplode(T.segments(body)).alias("segment", "text")).select("source", "segment", "label", "text")


def corpus_chunks(corpus: DataFrame, options: Options, strip: bool = True) -> DataFrame:
    """(unit, label, text) of all the corpus' chunks without front matter; max_chunks limits texts, not what they are compared with."""
    body = stripped(F.col("text"))["body"] if strip else F.col("text")
    label = F.coalesce("label", F.concat(F.lit("Источник "), (F.col("source") + 1).cast("string")))
    cut = chunk_texts(corpus.select("source", label.alias("label"), body.alias("text")), ["source", "label"], "text", options.chunk_size, options.chunk_overlap)
    return cut.select((F.col("source") * PLACES + F.col("chunk_index")).alias("unit"), "label", F.col("chunk").alias("text"))


def recognize(texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc, segment_index, source, source_segment, scores, is_borrowing, risk_level): for each segment of each text (doc, text) the best segment of a corpus
    (source, label, text), both without front matter; a text's idf counts its own segments. Without a corpus all scores are 0 and the source is null."""
    own = texts.select(F.col("doc").cast("long").alias("scope"), F.posexplode(T.segments(stripped(F.col("text"))["body"]))).toDF("scope", "q", "text")
    scopes = own.select("scope").distinct()
    c = corpus_segments(corpus).select((F.col("source") * PLACES + F.col("segment")).alias("c"), "text").join(F.broadcast(scopes))
    best = lexical.best_matches(own, c)
    return best.select(
        F.col("scope").alias("doc"), F.col("q").alias("segment_index"), F.floor(F.col("c") / PLACES).alias("source"), (F.col("c") % PLACES).alias("source_segment"),
        "tfidf_score", "bm25_score", "combined_score", "is_borrowing", "risk_level")


def semantic_candidates(chunks: DataFrame, corpus: DataFrame, encoder: providers.Encoder, options: Options) -> DataFrame:
    """(doc, chunk_index, rank, score, label, content): for each chunk the semantic_top_k corpus chunks of highest cosine, from rank 1.

    chunks: doc, chunk_index, text. corpus: unit, label, text. With semantic_least only candidates of that score count.
    """
    unit = F.col("doc") * PLACES + F.col("chunk_index")
    q = materialize(chunks.select(unit.alias("unit"), providers.vectors(F.col("text"), encoder, options.encode_batch_size).alias("vector")))
    d = corpus.select("unit", providers.vectors(F.col("text"), encoder, options.encode_batch_size).alias("vector"))
    top = materialize(vectors.top_k(q, d, "unit", "vector", options.semantic_top_k, options.semantic_least, skip_self=False))
    discard(q)
    held = join_few(corpus.select(F.col("unit").alias("id"), "label", F.col("text").alias("content")), top, "id")
    doc = F.floor(F.col("query_id") / PLACES)
    out = materialize(held.select(doc.alias("doc"), (F.col("query_id") - doc * PLACES).cast("int").alias("chunk_index"), "rank", "score", "label", "content"))
    discard(top)
    return out


def _named(lex: DataFrame, segments: DataFrame) -> DataFrame:
    """lex, which is materialized, with label and text of its segments c. Where it has few rows, only the sources in it are read for that."""
    if lex.count() <= runtime.SENT_ROWS:
        segments = segments.join(F.broadcast(lex.select(F.floor(F.col("c") / PLACES).alias("source")).distinct()), "source", "left_semi")
    names = segments.select((F.col("source") * PLACES + F.col("segment")).alias("c"), F.col("label").alias("copy_label"), F.col("text").alias("copy_text"))
    return join_few(names, lex, "c")


def deep_flag(semantic: Column, rerank: Column, options: Options) -> Column:
    """Whether scores show deep borrowing; rerank is the raw pair score, ignored without a reranker."""
    if not options.enable_reranker:
        return semantic >= options.deep_semantic_threshold
    rr = T.clamp(rerank)
    return ((semantic >= options.deep_semantic_threshold) & (rr >= options.deep_rerank_threshold)) | (rr >= options.deep_rerank_alone)


def analyze_chunks(
    chunks: DataFrame, segments: DataFrame, corpus: DataFrame, options: Options, encoder: providers.Encoder | None = None, reranker: providers.Reranker | None = None,
) -> DataFrame:
    """One row per chunk: scores of copying, deep borrowing and AI, the decision (deep before copy), its source and risk.

    chunks: doc long, chunk_index int, text. segments: source, segment, label, text, what copies are looked for in; they are not written, but read twice. corpus: unit, label, text, what meanings are
    compared with. Chunks without a candidate score 0; without segments nothing is a copy. Rerank scores are asked for only
    where the best candidate reaches rerank_from. AI scores come from the surrogate of scoring.bigram_ai_scores, for chunks over ai_least_chars.
    """
    encoder, reranker = encoder or providers.HashEncoder(), reranker or providers.OverlapReranker()
    spark = chunks.sparkSession
    ship(spark)
    key = ["doc", "chunk_index"]
    chunks = materialize(chunks.select(*key, "text"))
    candidates = semantic_candidates(chunks, corpus, encoder, options)
    first = candidates.where("rank = 1").select(*key, F.col("score").alias("semantic"), "label", F.col("content").alias("first_text"))
    out = chunks.join(first, key, "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    if options.enable_reranker:
        likely = first.where(F.col("semantic") >= options.rerank_from).select(*key)
        asked = candidates.join(likely, key, "left_semi").join(chunks.withColumnRenamed("text", "asked"), key)
        best = providers.reranked(asked, key, "asked", "content", "rank", reranker).select(*key, F.col("score").alias("pair"), F.col("content").alias("pair_text"))
        out = out.join(best, key, "left")
    else:
        out = out.withColumns({"pair": F.lit(None).cast("double"), "pair_text": F.lit(None).cast("string")})
    rerank = F.coalesce("pair", F.lit(0.0))
    out = out.withColumns({"deep": deep_flag(F.col("semantic"), rerank, options), "rerank": T.clamp(rerank), "found_text": F.coalesce("pair_text", "first_text", F.lit(""))})
    # copies: each chunk's best segment
    scope = F.col("doc") if options.own_idf else F.lit(0).cast("long")
    q = chunks.select(scope.alias("scope"), (F.col("doc") * PLACES + F.col("chunk_index")).alias("q"), "text")
    c = segments.select((F.col("source") * PLACES + F.col("segment")).alias("c"), "text")
    if options.own_idf:  # a text's idf counts its own chunks, so each text has the corpus to itself
        c = c.join(F.broadcast(chunks.select(F.col("doc").alias("scope")).distinct()))
    else:
        c = c.withColumn("scope", F.lit(0).cast("long"))
    doc = F.floor(F.col("q") / PLACES)
    lex = _named(lexical.best_matches(q, c), segments).select(doc.alias("doc"), (F.col("q") - doc * PLACES).cast("int").alias("chunk_index"), "combined_score", F.col("risk_level").alias("copy_risk"), "is_borrowing", "copy_label", "copy_text")
    out = out.join(lex, key, "left")
    if options.enable_ai:
        long = chunks.where(F.length(T.strip("text")) > options.ai_least_chars)
        scores = scoring.bigram_ai_scores(long.select((F.col("doc") * PLACES + F.col("chunk_index")).alias("u"), "text"), "u", "text")
        at = F.floor(F.col("u") / PLACES)
        out = out.join(scores.select(at.alias("doc"), (F.col("u") - at * PLACES).cast("int").alias("chunk_index"), "ai_score"), key, "left")
    else:
        out = out.withColumn("ai_score", F.lit(0.0))
    score = F.coalesce("combined_score", F.lit(0.0))
    copied = ~F.col("deep") & F.coalesce(F.col("combined_score") >= options.copy_threshold, F.lit(False))
    pick = lambda deep, copy, none: F.when(F.col("deep"), deep).when(F.col("copied"), copy).otherwise(none)
    out = out.withColumn("copied", copied)
    risk = pick(F.lit("high"), F.col("copy_risk"), F.when(F.col("semantic") >= 0.7, "medium").otherwise("none"))
    ai = F.coalesce("ai_score", F.lit(0.0))
    return out.select(
        *key, "text", score.alias("copy_score"), F.when(F.col("copied"), 0.0).otherwise(F.greatest("semantic", "rerank")).alias("deep_score"), F.col("semantic").alias("semantic_score"),
        F.col("rerank").alias("rerank_score"), ai.alias("ai_score"), F.col("copied").alias("is_copy"), F.col("deep").alias("is_deep_borrow"), (ai >= options.ai_threshold).alias("is_ai"),
        pick(F.lit("deep"), F.lit("copy"), F.lit("none")).alias("match_type"), pick(F.col("found_text"), F.col("copy_text"), F.lit("")).alias("source_text"),
        pick(F.coalesce("label", F.lit("")), F.col("copy_label"), F.lit("")).alias("source_label"), risk.alias("risk_level"), T.risk_label(risk).alias("risk_label"),
        F.coalesce("is_borrowing", F.lit(False)).alias("lexical_borrowing"))


def analyze_corpus(
    texts: DataFrame, corpus: DataFrame, options: Options | None = None, encoder: providers.Encoder | None = None, reranker: providers.Reranker | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, chunks) of texts (doc long, text) against a corpus (source long, label, text): a row per text as reports.assembled makes it, and a row per chunk.

    The texts' own front matter stays, the corpus' goes. A text without chunks gets the empty result. Null texts count as empty.
    """
    options = options or Options()
    corpus = materialize(corpus.select(F.col("source").cast("long").alias("source"), "label", "text"))
    chunks = chunks_of(texts.select(F.col("doc").cast("long").alias("doc"), "text"), "doc", "text", options)
    found = materialize(analyze_chunks(chunks, materialize(corpus_segments(corpus)), materialize(corpus_chunks(corpus, options)), options, encoder, reranker))
    return reports.assembled(texts.select(F.col("doc").cast("long").alias("doc")), found), found


def analyze_compare(
    pairs: DataFrame, options: Options | None = None, encoder: providers.Encoder | None = None, reranker: providers.Reranker | None = None,
) -> DataFrame:
    """One row per pair (pair long, text_a, text_b): lexical similarity of the segments, share of chunks of a that are deep borrowings from b, AI
    percentages, and what follows from them. Candidates are reranked always, and chunks are not thinned."""
    options = options or Options()
    encoder, reranker = encoder or providers.HashEncoder(), reranker or providers.OverlapReranker()
    pairs = materialize(pairs.select(F.col("pair").cast("long").alias("pair"), "text_a", "text_b"))
    cut = {s: materialize(chunk_texts(pairs, "pair", f"text_{s}", options.chunk_size, options.chunk_overlap)) for s in "ab"}
    unit = lambda s: cut[s].select("pair", F.col("chunk_index").alias(f"i_{s}"), F.col("chunk").alias(f"chunk_{s}"), providers.vectors(F.col("chunk"), encoder, options.encode_batch_size).alias(f"v_{s}"))
    # within a pair every chunk of a meets those of b: as many as a text has chunks
    near = unit("a").join(unit("b"), "pair").withColumn("score", F.coalesce(vectors.cosine(F.col("v_a"), F.col("v_b")), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("pair", "i_a").orderBy(F.desc(F.round("score", 9)), F.desc("i_b")))
    near = near.withColumn("rank", place).where(F.col("rank") <= options.semantic_top_k).select("pair", "i_a", "chunk_a", "chunk_b", "score", "rank")
    near = materialize(near)
    best = providers.reranked(near, ["pair", "i_a"], "chunk_a", "chunk_b", "rank", reranker).select("pair", "i_a", F.col("score").alias("rr"))
    flags = near.where("rank = 1").join(best, ["pair", "i_a"]).select("pair", deep_flag(F.col("score"), F.col("rr"), _always(options)).alias("deep"))
    deep = flags.groupBy("pair").agg(F.count_if("deep").alias("deep"))
    size = cut["a"].groupBy("pair").agg(F.count("*").alias("n"))
    side = lambda s: pairs.select(F.col("pair").alias("scope"), F.posexplode(T.segments(stripped(F.col(f"text_{s}"))["body"]))).toDF("scope", "q" if s == "a" else "c", "text")
    lex = lexical.compare(side("a"), side("b")).withColumnRenamed("scope", "pair")
    ai = {s: _document_ai(cut[s], options).withColumnRenamed("ai_percent", f"ai_{s}") for s in "ab"}
    out = pairs.select("pair").join(lex, "pair", "left").join(size, "pair", "left").join(deep, "pair", "left").join(ai["a"], "pair", "left").join(ai["b"], "pair", "left")
    return reports.compared(out)


def _always(options: Options) -> Options:
    from dataclasses import replace

    return replace(options, enable_reranker=True)


def _document_ai(chunks: DataFrame, options: Options) -> DataFrame:
    """(pair, ai_percent): mean over the chunks of more than ai_least_chars, zeros included."""
    if not options.enable_ai:
        return chunks.select("pair").distinct().withColumn("ai_percent", F.lit(0.0))
    long = chunks.where(F.length(T.strip("chunk")) > options.ai_least_chars)
    scores = scoring.bigram_ai_scores(long.select((F.col("pair") * PLACES + F.col("chunk_index")).alias("u"), F.col("chunk")), "u", "chunk")
    return scores.groupBy(F.floor(F.col("u") / PLACES).alias("pair")).agg(F.bround(F.avg("ai_score") * 100, 2).alias("ai_percent"))
