"""The service's operations over a store: adding and analysing documents, comparing texts, indexing sources, working through tasks."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from attestra.config import Options
from attestra.functions.text import extension, source_ids
from attestra.operators import chunking, pipeline, providers, reports
from attestra.plans.runtime import discard, in_order as ordered, materialize
from attestra.sources import files
from attestra.sources.store import Busy, Missing, Store, in_order, newest_sources, others
from attestra.streaming import tasks


class Engine:
    """store: tables. Analyses take many documents at once; a single one is a set of one. One engine writes to a store at a time."""

    def __init__(self, store: Store, options: Options | None = None, encoder: providers.Encoder | None = None, reranker: providers.Reranker | None = None):
        self.store, self.options, self.encoder, self.reranker = store, options or Options(), encoder or providers.HashEncoder(), reranker

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    # ---- documents ----
    def documents(self, limit: int = 200) -> DataFrame:
        d = self.store.read("documents")
        return d.select("doc_id", "title", "filename", F.length(F.coalesce("text", F.lit(""))).alias("content_length"), "upload_date", "analytics_status").orderBy(F.desc_nulls_last("upload_date"), F.desc("doc_id")).limit(limit)

    def add_document(self, text: str, title: str | None = None, filename: str | None = None, **more) -> int:
        row = {"text": text, "title": title, "filename": filename, **more}
        names = {f.name: f.dataType.simpleString() for f in self.store.read("documents").schema}
        rows = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {names[k]}" for k in row))
        kind = F.nullif(F.expr("substring(x, 2)"), F.lit(""))
        self.store.add_documents(rows.withColumn("x", extension(F.col("filename"))).withColumn("file_format", kind).drop("x"))
        return self.store.read("documents").agg(F.max("doc_id")).first()[0]

    def _one(self, id: int) -> Row:
        row = self.store.document(id).select("doc_id", "title", "text", "analytics_status", "analytics_error").first()
        if row is None:
            raise Missing(f"document {id}")
        return row

    def analyze(self, id: int, wait: bool = True) -> dict:
        """Analyse a document against all others, now or as a task of the highest priority. A document in work, or without text, can't be."""
        row = self._one(id)
        if row["analytics_status"] in ("queued", "processing"):
            raise Busy(f"document {id} is {row['analytics_status']}")
        if not (row["text"] or "").strip():
            raise ValueError(f"document {id} has no text")
        if not wait:
            task = self.submit("analytics", {"document_id": id}, priority=0)
            self.store.set_status(self.store.document(id), "queued")
            return {"document_id": id, "analytics_status": "queued", "task_id": task}
        return self._analyze(id)

    def _analyze(self, id: int) -> dict:
        own = self.store.document(id)
        rest = others(self.store.read("documents"), id)
        if rest.isEmpty():
            self.store.save_empty(own)
            return self._told(id, 0, 0)
        self.store.set_status(own, "processing")
        start = time.perf_counter()
        try:
            corpus = materialize(ordered(rest.select("doc_id", "text", "upload_date"), F.desc_nulls_last("upload_date"), F.desc("doc_id"), name="source").drop("upload_date"))
            labelled = corpus.select("source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("label"), "text")
            results, chunks = pipeline.analyze_corpus(own.select(F.col("doc_id").alias("doc"), "text"), labelled, self.options, self.encoder, self.reranker)
            known = corpus.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("label"), F.col("doc_id").alias("id"))
            matches = materialize(reports.by_target(reports.match_rows(chunks), known))
            took = int((time.perf_counter() - start) * 1000)
            self.store.save_results(materialize(results), matches, took)
            count = matches.count()
            discard(corpus)
            return self._told(id, count, took)
        except Exception as x:
            self.store.set_status(self.store.document(id), "failed", str(x)[:2000])
            raise

    def _told(self, id: int, matches: int, took: int) -> dict:
        metrics = ("originality_percent", "plagiarism_percent_ml", "copy_percent_ml", "deep_borrow_percent_ml", "ai_percent_ml")
        row = self.store.document(id).select(*[reports.safe_percent(F.col(c)).alias(c) for c in metrics]).first()
        return {"document_id": id, "analytics_status": "done", **row.asDict(), "borrowings_count": matches, "processing_time_ms": took, "algorithm": reports.ALGORITHM}

    def status(self, id: int) -> dict:
        self._one(id)
        held = reports.status(self.store.document(id)).first().asDict()
        return {"document_id": held.pop("doc_id"), **held}

    def borrowings(self, id: int) -> list[dict]:
        """A document's matches, most similar first."""
        self._one(id)
        held = self.store.read("plagiarism_matches").where(F.col("source_document_id") == id)
        return [r.asDict(recursive=True) for r in reports.borrowings(held, self.store.read("documents")).orderBy("rank").collect()]

    # ---- corpus ----
    def index(self, content: str, label: str, filename: str | None = None) -> int:
        id = self.store.add_source(label, filename, content)
        o = self.options
        self.store.index(
            self.store.read("corpus_sources").where(F.col("id") == id), lambda s: chunking.chunk_texts(s, "id", "content", o.chunk_size, o.chunk_overlap),
            lambda c: providers.vectors(c, self.encoder, o.encode_batch_size))
        return id

    def sources(self) -> DataFrame:
        return newest_sources(self.store.read("corpus_sources"))

    # ---- tasks ----
    def submit(self, mode: str, payload: dict, filename: str | None = None, priority: int | None = None) -> int:
        if priority is None:
            meta = payload.get("extraction") or {}
            row = self.spark.createDataFrame([(meta.get("images_ocr"), meta.get("tables"), [filename or ""], meta.get("formats") or [])], "i int, t int, n array<string>, f array<string>")
            priority = row.select(tasks.priority(*[F.col(c) for c in "itnf"])).first()[0]
        row = self.spark.createDataFrame([(mode, filename, json.dumps(payload, ensure_ascii=False), priority)], "mode string, filename string, payload string, priority int")
        self.store.append("tasks", row.withColumn("created_at", F.current_timestamp()), "id")
        return self.store.read("tasks").agg(F.max("id")).first()[0]

    def states(self) -> DataFrame:
        return tasks.state(self.store.read("tasks"), self.store.read("task_events"))

    def task(self, id: int) -> dict:
        row = self.states().where(F.col("id") == id).first()
        if row is None:
            raise Missing(f"task {id}")
        position = tasks.positions(self.states()).where(F.col("id") == id).first()
        return {**row.asDict(), "result": json.loads(row["result_json"]) if row["result_json"] else None, "position": position["position"] if position else None}

    def requeue(self) -> None:
        self.store.append("task_events", materialize(tasks.stuck(self.states())))

    def work(self, most: int = 1) -> int:
        """Take up to `most` pending tasks, one after another; returns how many there were. A task that fails is noted as failed."""
        for n in range(most):
            row = tasks.next_pending(self.states()).first()
            if row is None:
                return n
            one = self.spark.createDataFrame([(row["id"],)], "id long")
            self.store.append("task_events", tasks.event(one, "PROCESSING", "started"))
            try:
                result = self._run(row["mode"], json.loads(row["payload"]))
            except Exception as x:  # a worker goes on whatever a task does
                self.store.append("task_events", tasks.event(one, "FAILED", "failed", str(x)[:2000]))
                continue
            done = tasks.event(one, "DONE", "done")
            for name in ("plagiarism", "copy", "deep_borrow", "ai"):
                value = result.get(f"{name}_percent") or result.get(f"{name}_percent_ml")
                done = done.withColumn(f"{name}_pct", F.lit(value).cast("double"))
            self.store.append("task_events", done.withColumn("result_json", F.lit(json.dumps(result, ensure_ascii=False, default=str))))
        return most

    def _run(self, mode: str, payload: dict) -> dict:
        if mode == "analytics":
            return self._analyze(int(payload["document_id"]))
        if mode == "compare":
            pair = self.spark.createDataFrame([(0, payload.get("text") or "", payload.get("reference") or "")], "pair long, text_a string, text_b string")
            return pipeline.analyze_compare(pair, self.options, self.encoder, self.reranker).drop("pair").first().asDict()
        if mode != "corpus":
            raise ValueError(f"unknown mode {mode}")
        text = self.spark.createDataFrame([(0, payload.get("text") or "")], "doc long, text string")
        results, chunks = pipeline.analyze_corpus(text, self._corpus(payload), self.options, self.encoder, self.reranker)
        matches = [r.asDict() for r in reports.match_rows(chunks).drop("doc").orderBy("segment_index").collect()]
        return {"mode": "corpus", **results.drop("doc").first().asDict(), "matches": matches}

    def _corpus(self, payload: dict) -> DataFrame:
        """The corpus of a task: stored sources by id, else given texts, else a pasted collection."""
        if payload.get("source_ids"):
            raw = payload["source_ids"]
            asked = self.spark.createDataFrame([(raw if isinstance(raw, str) else json.dumps(raw),)], "x string").select(F.posexplode(source_ids(F.col("x"))).alias("place", "id"))
            held = in_order(asked, self.store.read("corpus_sources").select("id", "label", F.col("content").alias("text")))
            return held.select(F.col("place").cast("long").alias("source"), "label", "text")
        if payload.get("texts"):
            labels = payload.get("labels") or []
            rows = [(i, labels[i] if i < len(labels) else None, t) for i, t in enumerate(payload["texts"])]
            return self.spark.createDataFrame(rows, "source long, label string, text string")
        raw = self.spark.createDataFrame([(0, payload.get("corpus") or "")], "id long, raw string")
        return files.parse_pasted(raw, "id", "raw").select(F.col("block").cast("long").alias("source"), "label", "text")

