"""Tables written on the way, so that iterative work has a short lineage and outlives lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-corvane-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets one of its own and
    any other an error: its executors share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir(spark.sparkContext.applicationId)


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop sees them: whatever store Spark can write to."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """An address in the shared folder that nothing has used; what is written there is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    found, store = hadoop_path(spark, path)
    store.deleteOnExit(found)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
