"""Session helpers: reading tables, cutting lineage, making the package importable on workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows of a written table that are sent to every task to be joined, at most; more are joined by shuffling both sides.
SENT_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started elsewhere."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, but only if all of Spark runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="attestra-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and the rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestra-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestra_path = path
    _written[path] = spark
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized frame; only for frames that nothing reads any more."""
    path = getattr(df, "_attestra_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def discard_all() -> None:
    """Delete the files of all materialized frames of this process: once their results are written. Also done when it ends."""
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended, or its gateway is gone
            _written.pop(path, None)


atexit.register(discard_all)


def join_few(large: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """large joined with few, which is materialized and has short rows. large, which may hold texts, is shuffled only where few has more than SENT_ROWS rows."""
    return large.join(F.broadcast(few) if few.count() <= SENT_ROWS else few, on)


def in_order(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df with the place of each row in the order, from 0. Rows are range-sorted and counted by partition, so no task sees more than its part."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id())
    laid = materialize(laid.withColumns({"_p": F.shiftright("_k", 33), "_r": F.col("_k").bitwiseAND((1 << 33) - 1)}).drop("_k"))
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return laid.join(sizes.select("_p", before.alias("_b")), "_p").withColumn(name, F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")
