"""Writing results: idempotent by partition, and upserts over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.operators.scoring import latest


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite just the partitions that df has rows for; running it twice leaves the same files' rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """old with rows of new in place of those with equal keys; of equal keys in new the latest version holds."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.col("_new"), F.col(version)]).drop("_new").select(*old.columns)
