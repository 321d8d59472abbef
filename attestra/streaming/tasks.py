"""Tasks as an append-only log of events: the state of a task is its last event, whatever order events come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.operators.scoring import latest

DOCUMENT_STATES = ("pending", "queued", "processing", "done", "failed")


def state(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """tasks with status, progress and times from their events; a task without events is PENDING. Of events at one time, the later in the alphabet holds.

    started_at is the first time it was PROCESSING since it was last sent back, finished_at the time of the last event if that ended it.
    """
    last = latest(events.select("task_id", "at", "status", "progress", "error_message", "plagiarism_pct", "copy_pct", "deep_borrow_pct", "ai_pct", "result_json"), ["task_id"], [F.col("at"), F.col("status")])
    back = events.where("status = 'PENDING'").groupBy("task_id").agg(F.max("at").alias("back"))
    begun = events.where("status = 'PROCESSING'").join(back, "task_id", "left").where("back is null or at > back").groupBy("task_id").agg(F.min("at").alias("started_at"))
    held = tasks.join(last.withColumnRenamed("task_id", "id"), "id", "left").join(begun.withColumnRenamed("task_id", "id"), "id", "left")
    ended = F.when(F.col("status").isin("DONE", "FAILED"), F.col("at"))
    return held.withColumn("finished_at", ended).withColumn("status", F.coalesce("status", F.lit("PENDING"))).withColumn("progress", F.coalesce("progress", F.lit(""))).drop("at")


def next_pending(states: DataFrame, n: int = 1) -> DataFrame:
    """The n tasks to be taken next: lowest priority number first, then the oldest, then the lowest id."""
    return states.where("status = 'PENDING'").orderBy("priority", "created_at", "id").limit(n)


def counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"))


def positions(states: DataFrame) -> DataFrame:
    """(id, position): how many pending tasks were made no later, itself included; priorities don't count.

    Tasks are counted by day first; only days are in one window, and each day's tasks in another."""
    p = states.where("status = 'PENDING'").select("id", "created_at", F.to_date("created_at").alias("day"))
    days = p.groupBy("day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.count("*").over(Window.partitionBy("day").orderBy("created_at").rangeBetween(Window.unboundedPreceding, 0))
    return p.withColumn("within", within).join(days.select("day", before.alias("before")), "day").select("id", (F.col("before") + F.col("within")).alias("position"))


def priority(images: Column, tables: Column, filenames: Column, formats: Column) -> Column:
    """2 for tasks with scanned images, tables, or pdf or docx files (by name or by format), else 1; nulls count as none."""
    rich = F.exists(F.coalesce(filenames, F.array().cast("array<string>")), lambda n: F.coalesce(F.lower(n).rlike(r"[^/]\.(pdf|docx)$"), F.lit(False)))
    kinds = F.exists(F.coalesce(formats, F.array().cast("array<string>")), lambda f: F.coalesce(f.isin("pdf", "docx"), F.lit(False)))
    return F.when((F.coalesce(images, F.lit(0)) > 0) | (F.coalesce(tables, F.lit(0)) > 0) | rich | kinds, 2).otherwise(1)


def completed(results: DataFrame) -> DataFrame:
    """Events that end tasks (task_id, at, and percentages): a percentage of 0 counts as absent, as does a null; then the stored one (_ml), if any, holds."""
    pick = lambda name: F.coalesce(F.nullif(F.col(f"{name}_percent"), F.lit(0.0)), F.col(f"{name}_percent_ml") if f"{name}_percent_ml" in results.columns else F.lit(None).cast("double")).alias(f"{name}_pct")
    return results.select("task_id", "at", F.lit("DONE").alias("status"), F.lit("done").alias("progress"), F.lit(None).cast("string").alias("error_message"), *[pick(n) for n in ("plagiarism", "copy", "deep_borrow", "ai")], F.to_json(F.struct(*[c for c in results.columns if c not in ("task_id", "at")])).alias("result_json"))


def event(ids: DataFrame, status: str, progress: str = "", error: str | None = None) -> DataFrame:
    """Events of one kind for tasks (id), now."""
    none = [F.lit(None).cast("double").alias(c) for c in ("plagiarism_pct", "copy_pct", "deep_borrow_pct", "ai_pct")]
    return ids.select(F.col("id").alias("task_id"), F.current_timestamp().alias("at"), F.lit(status).alias("status"), F.lit(progress).alias("progress"), F.lit(error).cast("string").alias("error_message"), *none, F.lit(None).cast("string").alias("result_json"))


def stuck(states: DataFrame) -> DataFrame:
    """Events that send tasks in work back to be taken again."""
    return event(states.where("status = 'PROCESSING'"), "PENDING")
