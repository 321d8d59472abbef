"""Decisions on fragments, and their roll-ups to documents and sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.functions.text import PERCENT_BANDS, band, percent
from attestra.plans.runtime import ship

COPY, DEEP_SEMANTIC, DEEP_RERANK, DEEP_RERANK_ALONE, AI = 0.75, 0.82, 0.65, 0.75, 0.55


def deep_borrowing(semantic: Column, rerank: Column) -> Column:
    """Semantic and rerank score high, or the rerank score alone very high; without a rerank score, the semantic alone."""
    rr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rerank))
    sem = F.coalesce(semantic, F.lit(0.0))
    return F.when(rerank.isNull(), sem >= DEEP_SEMANTIC).otherwise(((sem >= DEEP_SEMANTIC) & (rr >= DEEP_RERANK)) | (rr >= DEEP_RERANK_ALONE))


def decide(chunks: DataFrame) -> DataFrame:
    """Adds deep, copied, kind (deep wins over copy), ai and risk to rows with semantic_score, rerank_score, copy_score, ai_score.
    Null scores count as 0; exact duplicate rows are kept (drop them before)."""
    score = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    deep = deep_borrowing(F.col("semantic_score"), F.col("rerank_score"))
    out = chunks.withColumn("deep", deep).withColumn("copied", ~F.col("deep") & (F.bround(score("copy_score"), 4) >= COPY))
    kind = F.when(F.col("deep"), "deep_borrow").when(F.col("copied"), "copy").otherwise("original")
    risk = F.when(F.col("deep"), "high").when(F.col("copied"), band(score("copy_score"))).when(score("semantic_score") >= 0.7, "medium").otherwise("none")
    return out.withColumns({"kind": kind, "ai": score("ai_score") >= AI, "risk": risk})


def roll_up(decided: DataFrame, by: str) -> DataFrame:
    """Per document: fragments, shares of copies, deep borrowings and either, mean of the non-zero AI scores, originality and risk."""
    n = decided.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("copied").alias("copies"), F.count_if("deep").alias("deeps"),
        F.avg(F.when(F.col("ai_score") > 0, F.col("ai_score"))).alias("ai_mean"))
    found = percent(F.col("copies") + F.col("deeps"), F.col("total"))
    return n.select(
        by, "total", percent(F.col("copies"), F.col("total")).alias("copy_percent"), percent(F.col("deeps"), F.col("total")).alias("deep_borrow_percent"),
        found.alias("plagiarism_percent"), F.round(F.coalesce(F.col("ai_mean") * 100, F.lit(0.0)), 6).alias("ai_percent"),
        F.bround(F.greatest(F.lit(0.0), 100 - found), 2).alias("originality_percent"), band(found, PERCENT_BANDS).alias("risk_level"))


def by_target(fragments: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """Per group of borrowed fragments: best scores in percent, their number, and the indexes of the first `most`.

    The first fragments are chosen before they are gathered, so a group of any size keeps at most `most` of them.
    """
    held = fragments.where("is_borrowing")
    scores = held.groupBy(*by).agg(
        F.bround(F.max("combined_score") * 100, 2).alias("similarity_percent"), F.bround(F.max("tfidf_score") * 100, 2).alias("copy_percent"), F.count("*").alias("fragments"))
    order = Window.partitionBy(*by).orderBy("segment_index")
    first = held.select(*by, "segment_index").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    first = first.groupBy(*by).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("segment_index")), lambda x: x.cast("string"))).alias("first_segments"))
    return scores.join(first, by)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in order: what upserts leave of an append-only table. An aggregate, so it is partly done before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def target_ids(label: Column) -> Column:
    """The document a label doc_<n> names, else null."""
    return F.regexp_extract(F.coalesce(label, F.lit("")), r"^doc_(\d+)$", 1).try_cast("long")


def ai_score(p: Column, m: Column, size: Column, compressed: Column) -> Column:
    """Machine-likeness in [0, 1] from the share p of tokens ranked up to 50 and m over 1000 by a language model, and
    the text's bytes before and after compression."""
    logistic = lambda x: 1 / (1 + F.exp(-x))
    c = logistic(-15.0 * (compressed / size - 0.45)) * F.least(F.lit(1.0), size / 1000)
    raw = F.sqrt(0.6 * logistic(20.0 * (p - 0.85)) + 0.3 * logistic(-300.0 * (m - 0.01)) + 10.0 * c) / 100
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def bigram_ai_scores(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, ai_score) with a surrogate language model: a token's rank is its place among all tokens seen after the one
    before it, by count and then by token. Texts under 50 characters or of fewer than 2 tokens get 0."""
    import zlib

    from attestra.functions.text import strip, tokens

    ship(df.sparkSession)

    @F.pandas_udf("long")
    def deflated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: len(zlib.compress((t or "").encode("utf-8", "surrogatepass"))))

    base = df.select(F.col(id), strip(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    words = base.where(F.length("t") >= 50).select(id, tokens("t").alias("w"))
    pairs = words.select(id, F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    pairs = pairs.groupBy(id, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("k"))
    counts = pairs.groupBy("a", "b").agg(F.sum("k").alias("n"))
    # only the first 1000 of a word's followers are ranked: the others are cut off by each task before a word's followers meet in one
    ranks = counts.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("rank <= 1000").select("a", "b", "rank")
    seen = pairs.join(ranks, ["a", "b"], "left").groupBy(id).agg(
        (F.sum(F.when(F.col("rank") <= 50, F.col("k")).otherwise(0)) / F.sum("k")).alias("p"), (F.sum(F.when(F.col("rank").isNull(), F.col("k")).otherwise(0)) / F.sum("k")).alias("m"))
    sizes = base.select(id, F.octet_length("t").alias("size"), deflated("t").alias("packed"))
    score = F.when(F.col("p").isNotNull(), ai_score(F.col("p"), F.col("m"), F.col("size"), F.col("packed"))).otherwise(0.0)
    return sizes.join(seen, id, "left").select(id, score.alias("ai_score"))
