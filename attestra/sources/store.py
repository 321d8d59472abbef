"""Stored tables: a folder of Parquet versions for each, read as they are and replaced whole, by one writer at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestra.functions.text import strip, word_count
from attestra.operators.scoring import latest
from attestra.plans.runtime import in_order as in_order_of, materialize
from attestra.schemas import SEEDS, TABLES


class Missing(LookupError):
    """A row that was asked for isn't there."""


class Busy(RuntimeError):
    """A document that is being worked on."""


class Store:
    """Tables under one folder of a shared file system. A change writes a new version beside the old one; a reader takes the last complete version, so
    a writer that is lost changes nothing, and a plan that still reads the version before keeps it."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str] | None = None):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas or TABLES

    # ---- versions ----
    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        where, fs = self._files(f"{self.path}/{name}")
        if not fs.exists(where):
            return []
        jvm = self.spark.sparkContext._jvm
        found = [str(s.getPath()) for s in fs.listStatus(where)]
        return sorted(p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        held = self._versions(name)
        if not held:
            raise Missing(f"table {name}")
        return self.spark.read.schema(self.schemas[name]).parquet(held[-1])

    def replace(self, name: str, rows: DataFrame, keep: int = 2) -> None:
        """Write a version with these rows; columns that rows lack are null. Versions before the last `keep` are deleted."""
        held = self._versions(name)
        number = int(held[-1].rsplit("/v", 1)[1].split("-")[0]) + 1 if held else 1
        wanted = self.spark.createDataFrame([], self.schemas[name]).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        rows.select(*columns).write.parquet(f"{self.path}/{name}/v{number:010d}-{uuid.uuid4().hex[:8]}")
        for old in self._versions(name)[:-keep]:
            where, fs = self._files(old)
            fs.delete(where, True)

    def create(self) -> list[str]:
        """Make the tables that are missing, and add the seed rows whose keys are; returns the tables that were made. Running it again changes nothing."""
        made = [n for n in self.schemas if not self.exists(n)]
        for n in made:
            self.replace(n, self.spark.createDataFrame([], self.schemas[n]))
        for n, (key, rows) in SEEDS.items():
            if n not in self.schemas:
                continue
            new = self.spark.createDataFrame([{**r} for r in rows]).join(self.read(n).select(key), key, "left_anti")
            if not new.isEmpty():
                self.append(n, new.withColumn("created_at", F.current_timestamp()))
        return made

    def catalog(self) -> DataFrame:
        """(name, n_rows) of the tables."""
        held = [n for n in sorted(self.schemas) if self.exists(n)]
        counts = [(n, self.read(n).count()) for n in held]
        return self.spark.createDataFrame(counts, "name string, n_rows long")

    # ---- changes ----
    def append(self, name: str, rows: DataFrame, id: str | None = None) -> None:
        """Add rows; with id, rows whose id is null are numbered on from the highest one, in no fixed order."""
        held = self.read(name)
        if id:
            top = held.agg(F.coalesce(F.max(id), F.lit(0))).first()[0]
            if id not in rows.columns:
                rows = rows.withColumn(id, F.lit(None).cast("long"))
            rows = _numbered(rows, id, top)
        self.replace(name, held.unionByName(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in held.schema])))

    def update(self, name: str, changes: DataFrame, key: str) -> None:
        """Set the columns of changes, a row a key, in the rows with that key, also to null; keys that aren't there are ignored."""
        held = self.read(name)
        new = changes.select(F.col(key), F.struct(*[c for c in changes.columns if c != key]).alias("_new"))
        out = held.join(new, key, "left")
        columns = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in held.columns]
        self.replace(name, out.select(*columns))

    # ---- documents ----
    def document(self, id: int) -> DataFrame:
        return self.read("documents").where(F.col("doc_id") == id)

    def add_documents(self, rows: DataFrame) -> None:
        """Add documents (text, and any other columns): the text is stripped, its words are counted, and states start where they do. Rows without text raise."""
        rows = rows.withColumn("text", strip(F.coalesce("text", F.lit(""))))
        if not rows.where("text = ''").isEmpty():
            raise ValueError("a document has no text")
        default = {"status": F.lit("uploaded"), "category": F.lit("lab"), "analytics_status": F.lit("pending"), "upload_date": F.current_timestamp()}
        rows = rows.withColumns({c: (F.coalesce(F.col(c), v) if c in rows.columns else v) for c, v in default.items()} | {"word_count": word_count("text")})
        self.append("documents", rows, "doc_id")

    def set_status(self, ids: DataFrame, status: str, error: str | None = None) -> None:
        """Set the analytics status of the documents in ids (doc_id); no error clears the one before."""
        self.update("documents", ids.select("doc_id", F.lit(status).alias("analytics_status"), F.lit(error).cast("string").alias("analytics_error"), F.current_timestamp().alias("analytics_updated_at")), "doc_id")

    def save_results(self, results: DataFrame, matches: DataFrame, took_ms: int = 0) -> None:
        """Store analyses (doc and percentages) and their matches by target: matches of these documents before are replaced, whether there are new ones or
        not. Run again with the same rows, it leaves the same state."""
        metric = {"originality_percent": "originality_percent", "plagiarism_percent_ml": "plagiarism_percent", "copy_percent_ml": "copy_percent", "deep_borrow_percent_ml": "deep_borrow_percent", "ai_percent_ml": "ai_percent"}
        held = self.read("plagiarism_matches").join(results.select(F.col("doc").alias("source_document_id")), "source_document_id", "left_anti")
        new = matches.select(
            F.col("doc").alias("source_document_id"), "target_document_id", "similarity_percent", "copy_percent", "deep_borrow_percent", F.to_json(_rounded(matches, "fragments")).alias("matched_fragments"),
            "algorithm", F.current_timestamp().alias("created_at"))
        new = latest(new, ["source_document_id", "target_document_id"], [F.col("similarity_percent")])
        top = held.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self.replace("plagiarism_matches", held.unionByName(_numbered(new.withColumn("id", F.lit(None).cast("long")), "id", top).select(*held.columns)))
        done = {"status": F.lit("analyzed"), "analytics_status": F.lit("done"), "analytics_error": F.lit(None).cast("string"), "analytics_updated_at": F.current_timestamp(), "processing_time_ms": F.lit(took_ms)}
        self.update("documents", results.select(F.col("doc").alias("doc_id"), *[F.col(c).alias(n) for n, c in metric.items()], *[v.alias(n) for n, v in done.items()]), "doc_id")

    def save_empty(self, ids: DataFrame) -> None:
        """Documents without others to compare with: wholly original, without matches."""
        nothing = self.spark.createDataFrame([], "doc long, target_document_id long, similarity_percent double, copy_percent double, deep_borrow_percent double, fragments array<struct<segment_index:int,combined_percent:double>>, algorithm string")
        zero = {c: F.lit(0.0) for c in ("plagiarism_percent", "copy_percent", "deep_borrow_percent", "ai_percent")}
        self.save_results(ids.select(F.col("doc_id").alias("doc"), F.lit(100.0).alias("originality_percent"), *[v.alias(c) for c, v in zero.items()]), nothing)

    # ---- corpus ----
    def add_source(self, label: str, filename: str | None, content: str) -> int:
        row = self.spark.createDataFrame([(label, filename, content)], "label string, filename string, content string").withColumns({"chunk_count": F.lit(0), "created_at": F.current_timestamp()})
        self.append("corpus_sources", row, "id")
        return self.read("corpus_sources").agg(F.max("id")).first()[0]

    def index(self, sources: DataFrame, chunk: Callable[[DataFrame], DataFrame], vector: Callable[[Column], Column]) -> None:
        """Chunk and encode sources (id, content), add the chunks, and note on the sources how many there are. chunk gives (id, chunk_index, chunk)."""
        cut = chunk(sources).select(
            F.col("id").alias("source_id"), "chunk_index", F.col("chunk").alias("content"), vector(F.col("chunk")).alias("embedding"), F.expr("uuid()").alias("point_id"), F.current_timestamp().alias("created_at"))
        self.append("corpus_chunks", cut, "id")
        counts = self.read("corpus_chunks").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").cast("int").alias("chunk_count"))
        self.update("corpus_sources", counts.select(F.col("source_id").alias("id"), "chunk_count", F.current_timestamp().alias("indexed_at")), "id")


def _numbered(rows: DataFrame, id: str, top: int) -> DataFrame:
    """Rows without an id get numbers over `top`, and over all ids that rows bring, that no two share."""
    rows = materialize(rows)
    known = rows.where(F.col(id).isNotNull())
    most = max(top, known.agg(F.coalesce(F.max(id), F.lit(0))).first()[0])
    new = in_order_of(rows.where(F.col(id).isNull()), F.xxhash64(*[c for c in rows.columns if c != id]), name="_place")
    return known.unionByName(new.withColumn(id, (F.col("_place") + most + 1).cast("long")).select(*rows.columns))


def _rounded(df: DataFrame, column: str) -> Column:
    """An array of structs with its floating numbers rounded to six places."""
    fields = df.schema[column].dataType.elementType.fields
    return F.transform(column, lambda x: F.struct(*[(F.round(x[f.name], 6) if f.dataType.typeName() in ("double", "float") else x[f.name]).alias(f.name) for f in fields]))


# ---- readers over any frame of documents or sources ----

def others(documents: DataFrame, exclude: int | None = None) -> DataFrame:
    """Documents with text, all but one, and their order, newest first (from 0)."""
    held = documents.where("text is not null and length(trim(text)) > 0")
    held = held if exclude is None else held.where(F.col("doc_id") != exclude)
    return held.orderBy(F.desc_nulls_last("upload_date"), F.desc("doc_id"))


def newest_sources(sources: DataFrame) -> DataFrame:
    return sources.select("id", "label", "filename", "chunk_count", "indexed_at", "created_at").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def in_order(ids: DataFrame, rows: DataFrame, id: str = "id") -> DataFrame:
    """ids (place, id) with their rows, in the order asked for; ids without a row are skipped, and repeated ids come again."""
    return ids.join(rows, id).orderBy("place")
