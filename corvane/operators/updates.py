"""Index updates: what changed, unsaved buffers, fingerprints of declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff_index(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed, by path and content hash."""
    both = current.select("path", F.col("content_hash").alias("_new")).join(indexed.select("path", F.col("content_hash").alias("_old")), "path", "full")
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("_new") != F.col("_old"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def overlay(files: DataFrame, buffers: DataFrame) -> DataFrame:
    """Files (path, content) with unsaved buffers in place of what is saved; buffers of new files are added."""
    b = buffers.select("path", F.col("content").alias("_buffer"), F.lit(True).alias("_unsaved"))
    out = files.join(b, "path", "full")
    return out.withColumn("content", F.when(F.col("_unsaved"), F.col("_buffer")).otherwise(F.col("content"))).withColumn("unsaved", F.coalesce("_unsaved", F.lit(False))).drop("_buffer", "_unsaved")


def declaration_fingerprints(declarations: DataFrame) -> DataFrame:
    """(path, n_declarations, fingerprint) of declarations (path, declaration): the same for the same declarations in any order and at any lines."""
    h = F.xxhash64("declaration").cast("decimal(38,0)")
    return declarations.groupBy("path").agg(F.count("*").alias("n_declarations"), F.sum(h).cast("string").alias("fingerprint"))


def latest_versions(files: DataFrame) -> DataFrame:
    """The newest version of each path; an older one that comes late never wins."""
    rest = [c for c in files.columns if c != "path"]
    return files.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("_f")).select("path", "_f.*")


def write_index(df: DataFrame, path: str, partition: str = "project") -> None:
    """Write the index; only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
