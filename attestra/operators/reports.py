"""Results in their fixed forms: assembled analyses, borrowings by target, normalised fragments, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.functions.text import PERCENT_BANDS, band, clamp, percent, risk_label

#: Name of the method, labels of verdicts from their least percent on, least scores of a comparison's verdicts.
ALGORITHM = "tfidf-bm25+vectors"
AI_VERDICTS = ((70.0, "Высокая вероятность генерации ИИ"), (50.0, "Возможно частично сгенерирован ИИ"), (30.0, "Преимущественно человеческий текст"))
HUMAN = "Скорее всего написан человеком"
COMPARED = (
    (0.75, "Высокая лексическая близость — возможное заимствование"), (0.55, "Умеренная лексическая близость — тематическое сходство"), (0.35, "Слабая связь — частичное пересечение терминов"))
UNRELATED, TOO_SHORT = "Тексты лексически не связаны", "Недостаточно текста для сравнения"
EMPTY = "Текст пуст или слишком короткий."
FRAGMENTS = 20


def ai_verdict(p: Column) -> Column:
    out = F.when(p >= AI_VERDICTS[0][0], AI_VERDICTS[0][1])
    for least, text in AI_VERDICTS[1:]:
        out = out.when(p >= least, text)
    return out.otherwise(HUMAN)


def shown(p: Column) -> Column:
    """A percentage as text: as few decimals as it has, at least one."""
    short = F.regexp_replace(F.format_string("%.2f", p), "0$", "")
    return F.when(p.isNull(), "None").otherwise(short)


def summary(originality: Column, deep: Column, copy: Column, ai: Column, total: Column, found: Column) -> Column:
    pieces = (("Оригинальность: ", originality), ("%. Глубокое заимствование: ", deep), ("%. Копирование: ", copy), ("%. ИИ: ", ai))
    parts = [x for label, value in pieces for x in (F.lit(label), shown(value))]
    return F.concat(*parts, F.lit("%. Фрагментов: "), total.cast("string"), F.lit(", совпадений: "), found.cast("string"), F.lit("."))


def lexical_summary(originality: Column, total: Column, borrowed: Column, top_score: Column, top_text: Column, risk: Column) -> Column:
    """What a lexical comparison found, with the fragment most like a source."""
    top = F.when(borrowed > 0, F.concat(
        F.lit(" Наиболее похожий фрагмент (совпадение "), F.format_string("%.0f", top_score * 100), F.lit("%): «"), F.substring(top_text, 1, 80), F.lit("…»."))).otherwise("")
    said = F.concat(
        F.lit("Оригинальность текста: "), F.format_string("%.1f", originality), F.lit("%. Проанализировано фрагментов: "), total.cast("string"),
        F.lit(". Обнаружено потенциальных заимствований: "), borrowed.cast("string"), F.lit("."), top, F.lit(" Общая оценка: "), risk_label(risk), F.lit("."))
    return F.when(total == 0, "Нет данных для анализа.").otherwise(said)


def top_fragment(matches: DataFrame, by: list[str], score: str, text: str, index: str) -> DataFrame:
    """(by, score, text) of each group's fragment with the highest score, the first on ties."""
    best = F.max_by(F.struct(F.col(score), F.col(text)), F.struct(F.col(score), -F.col(index))).alias("_b")
    return matches.groupBy(*by).agg(best).select(*by, "_b.*")


def merged_extraction(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group of extracted files: sums of paragraphs, tables, images_ocr and pages, whether OCR was there for any, and the formats, each once in order.
    Nulls count as 0 or absent."""
    counts = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("paragraphs", "tables", "images_ocr", "pages")]
    # the first place of each format, so that a group keeps as many rows as it has formats
    formats = parts.where("format <> ''").groupBy(*by, "format").agg(F.min(order).alias("at")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "format"))).alias("f"))
    out = parts.groupBy(*by).agg(*counts, F.bool_or(F.coalesce("ocr_available", F.lit(False))).alias("ocr_available"))
    return out.join(formats, by, "left").withColumn("formats", F.coalesce(F.transform("f", lambda x: x["format"]), F.array().cast("array<string>"))).drop("f")


def extraction_note(tables: Column, images: Column, pages: Column) -> Column:
    """What was taken from a document besides text, in words; '' if nothing."""
    part = lambda label, n: F.when(n > 0, F.concat(F.lit(label), n.cast("string")))
    said = F.concat_ws(", ", part("таблиц: ", tables), part("OCR изображений: ", images), part("страниц: ", pages))
    return F.when(said != "", F.concat(F.lit("Из документа извлечено — "), said, F.lit("."))).otherwise("")


def document_ai(chunks: DataFrame, by: str, text: str, score: str, least: int = 100, digits: int = 2) -> DataFrame:
    """(by, ai_percent): mean score of the chunks of more than `least` characters, zeros and nulls (as 0) included; 0 for documents without one."""
    long = F.length(F.trim(text)) > least
    mean = F.avg(F.when(long, F.coalesce(F.col(score), F.lit(0.0))))
    return chunks.groupBy(by).agg(F.bround(F.coalesce(mean, F.lit(0.0)) * 100, digits).alias("ai_percent"))


def match_rows(chunks: DataFrame) -> DataFrame:
    """The fragment form of chunk rows: percentages to one place, scores to four, the combined score being the higher of copy and deep."""
    combined = F.greatest("copy_score", "deep_score")
    return chunks.withColumn("combined", combined).select(
        "doc", F.col("chunk_index").alias("segment_index"), F.col("text").alias("segment_text"), "source_text", "source_label", F.bround("copy_score", 4).alias("tfidf_score"), F.lit(0.0).alias("bm25_score"),
        F.bround("combined", 4).alias("combined_score"), F.bround(F.col("copy_score") * 100, 1).alias("tfidf_percent"), F.lit(0.0).alias("bm25_percent"), F.bround(F.col("combined") * 100, 1).alias("combined_percent"),
        F.bround(F.col("semantic_score") * 100, 1).alias("semantic_percent"), F.bround("semantic_score", 4).alias("semantic_score"), F.bround(F.col("rerank_score") * 100, 1).alias("rerank_percent"),
        (F.col("is_copy") | F.col("is_deep_borrow")).alias("is_borrowing"), "match_type", "risk_level", "risk_label", "is_ai", F.bround(F.col("ai_score") * 100, 1).alias("ai_percent"))


def assembled(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document (doc) from its chunk rows: percentages, counts, risk, summary, AI verdict and the originality of the lexical scores alone.
    A document without chunks is wholly original, and its summary says why."""
    n = chunks.groupBy("doc").agg(
        F.count("*").alias("total_segments"), F.count_if("is_copy").alias("copy_segments"), F.count_if("is_deep_borrow").alias("deep_borrow_segments"),
        F.count_if(F.col("is_copy") | F.col("is_deep_borrow")).alias("borrowed_segments"), F.avg(F.when(F.col("ai_score") > 0, F.col("ai_score"))).alias("ai"),
        (clamp(0.5 * F.avg(F.col("lexical_borrowing").cast("double")) + 0.5 * F.avg(F.when(F.col("lexical_borrowing"), F.col("copy_score")).otherwise(0.0))) * 100).alias("lexical"))
    held = docs.select("doc").join(n, "doc", "left").fillna(0, ["total_segments", "copy_segments", "deep_borrow_segments", "borrowed_segments"])
    share = lambda c: percent(F.col(c), F.col("total_segments"))
    held = held.withColumns({"copy_percent": share("copy_segments"), "deep_borrow_percent": share("deep_borrow_segments"), "plagiarism_percent": share("borrowed_segments"), "ai_percent": F.bround(F.coalesce(F.col("ai") * 100, F.lit(0.0)), 2)})
    held = held.withColumn("originality_percent", F.bround(F.greatest(F.lit(0.0), 100 - F.col("plagiarism_percent")), 2)).withColumn("risk_level", band(F.col("plagiarism_percent"), PERCENT_BANDS))
    said = summary(*[F.col(c) for c in ("originality_percent", "deep_borrow_percent", "copy_percent", "ai_percent", "total_segments", "borrowed_segments")])
    return held.select(
        "doc", "originality_percent", F.col("plagiarism_percent").alias("borrowing_percent"), "plagiarism_percent", "copy_percent", "deep_borrow_percent", "ai_percent", "risk_level", risk_label(F.col("risk_level")).alias("risk_label"),
        "total_segments", "borrowed_segments", "copy_segments", "deep_borrow_segments", F.when(F.col("total_segments") == 0, EMPTY).otherwise(said).alias("summary"),
        ai_verdict(F.col("ai_percent")).alias("ai_verdict"), F.bround(100 - F.col("ai_percent"), 2).alias("human_percent"),
        F.round(F.round(F.greatest(100 - F.coalesce("lexical", F.lit(0.0)), F.lit(0.0)), 6), 1).alias("lexical_originality_percent"))


def compared_verdict(similarity: Column) -> Column:
    """What a comparison's mean similarity (0 to 1) says; null where a side was too short."""
    out = F.when(similarity.isNull(), TOO_SHORT)
    for least, text in COMPARED:
        out = out.when(similarity >= least, text)
    return out.otherwise(UNRELATED)


def compared(held: DataFrame) -> DataFrame:
    """One row per pair from lexical similarity and percentages (null where a side has no segments), n chunks of a, those deep, and AI percentages of both."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    deep = percent(F.coalesce("deep", F.lit(0)), F.coalesce("n", F.lit(0)))
    return held.withColumn("deep_borrow_percent", deep).select(
        "pair", zero("similarity_percent").alias("similarity_percent"), zero("tfidf_percent").alias("tfidf_percent"), zero("bm25_percent").alias("bm25_percent"), compared_verdict(F.col("similarity")).alias("verdict"),
        F.coalesce("originality_percent", F.lit(100.0)).alias("originality_percent"), zero("similarity_percent").alias("copy_percent"), "deep_borrow_percent",
        F.bround(F.greatest(zero("similarity_percent"), "deep_borrow_percent"), 2).alias("plagiarism_percent"), F.bround((zero("ai_a") + zero("ai_b")) / 2, 2).alias("ai_percent"),
        ai_verdict(zero("ai_a")).alias("ai_verdict_a"), ai_verdict(zero("ai_b")).alias("ai_verdict_b"))


def target_ids(labels: DataFrame, known: DataFrame) -> DataFrame:
    """labels (source_label) with target_document_id: the id that known (label, id) has for it, else the number in doc_<n> or doc_<n>:<more>, else null.
    Where known repeats a label, its last id holds."""
    named = known.groupBy(F.col("label").alias("source_label")).agg(F.max("id").alias("named"))
    number = F.regexp_extract(F.coalesce("source_label", F.lit("")), r"^doc_\s*(-?\d+)\s*(:.*)?$", 1).try_cast("long")
    return labels.join(named, "source_label", "left").withColumn("target_document_id", F.coalesce("named", number)).drop("named")


def by_target(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Per document and target: best combined, copy and semantic scores in percent, and the first 20 fragments in order.

    matches: doc and the columns of match_rows; known: label, id. Fragments that are no borrowings or lead to no target are left out. The first fragments
    are chosen before they are gathered.
    """
    held = target_ids(matches.where("is_borrowing"), known).where("target_document_id is not null")
    key = ["doc", "target_document_id"]
    best = lambda c: F.bround(F.max(c) * 100, 2)
    scores = held.groupBy(*key).agg(best("combined_score").alias("similarity_percent"), best("tfidf_score").alias("copy_percent"), best("semantic_score").alias("deep_borrow_percent"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("segment_index"))
    first = held.withColumn("_n", place).where(F.col("_n") <= FRAGMENTS)
    fields = ["segment_index", "segment_text", "source_text", "source_label", "combined_percent", "tfidf_percent", "semantic_percent", "is_borrowing", "match_type", "risk_level", "risk_label"]
    first = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("fragments"))
    return scores.join(first, key).withColumn("algorithm", F.lit(ALGORITHM))


#: A stored fragment; every field may be absent.
FRAGMENT = (
    "segment_index int, segment_text string, source_text string, source_label string, combined_percent double, combined_score double, tfidf_percent double, tfidf_score double, "
    "semantic_percent double, semantic_score double, is_borrowing boolean, match_type string, risk_level string, risk_label string")


def safe_percent(c: Column) -> Column:
    """A number of any kind, or text, rounded to two places; null for what is none."""
    return F.bround(c.cast("string").try_cast("double"), 2)


def normalized_fragments(c: Column) -> Column:
    """The fragments in a JSON text in their fixed form; percentages come from scores where they are absent. What is no JSON list gives none."""
    parsed = F.from_json(c, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in FRAGMENT.split(', '))}>>")
    of = lambda x, name, score: F.bround(F.coalesce(x[f"{name}_percent"], x[f"{score}_score"] * 100), 2)

    def form(x: Column) -> Column:
        text = lambda f: F.coalesce(x[f], F.lit("")).alias(f)
        return F.struct(
            x["segment_index"].alias("segment_index"), text("segment_text"), text("source_text"), text("source_label"), of(x, "combined", "combined").alias("combined_percent"), of(x, "tfidf", "tfidf").alias("copy_percent"),
            of(x, "semantic", "semantic").alias("deep_borrow_percent"), F.coalesce(x["is_borrowing"], F.lit(False)).alias("is_borrowing"), text("match_type"), text("risk_level"), text("risk_label"))

    listed = F.when(F.trim(c).startswith("[") & F.try_parse_json(c).isNotNull(), parsed)
    return F.coalesce(F.transform(F.filter(listed, lambda x: x.isNotNull()), form), F.array().cast("array<struct<segment_index:int,segment_text:string,source_text:string,source_label:string,combined_percent:double,copy_percent:double,deep_borrow_percent:double,is_borrowing:boolean,match_type:string,risk_level:string,risk_label:string>>"))


def borrowings(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """A row per match whose target is known: the target's title and filename, percentages (similarity 0 where unknown), fragments in their fixed form,
    and the place in the source document's list (rank), from the highest similarity down."""
    d = documents.select(F.col("doc_id").alias("target_document_id"), F.col("title").alias("target_title"), F.col("filename").alias("target_filename"))
    out = matches.join(d, "target_document_id").select(
        "id", "source_document_id", "target_document_id", "target_title", "target_filename", F.coalesce(safe_percent(F.col("similarity_percent")), F.lit(0.0)).alias("similarity_percent"),
        safe_percent(F.col("copy_percent")).alias("copy_percent"), safe_percent(F.col("deep_borrow_percent")).alias("deep_borrow_percent"), F.coalesce(F.nullif(F.col("algorithm"), F.lit("")), F.lit(ALGORITHM)).alias("algorithm"),
        normalized_fragments(F.col("matched_fragments")).alias("matched_fragments"))
    order = Window.partitionBy("source_document_id").orderBy(F.desc("similarity_percent"), "id")
    return out.withColumn("rank", F.row_number().over(order))


def status(documents: DataFrame) -> DataFrame:
    """(doc_id, analytics_status, percentages): the status form of documents; pending where none is set."""
    return documents.select(
        "doc_id", F.coalesce(F.nullif(F.col("analytics_status"), F.lit("")), F.lit("pending")).alias("analytics_status"),
        *[safe_percent(F.col(c)).alias(c) for c in ("originality_percent", "copy_percent_ml", "deep_borrow_percent_ml")])
