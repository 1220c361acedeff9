"""The driver's tables as stand-ins for the core tables, so that every operator runs on data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.hierarchy import ancestors
from corvane.operators.intervals import intervals, label
from corvane.operators.tables import saved

HOUR = 3_600_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def symbols(spark, sf) -> DataFrame:
    """Parts as symbols."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("module"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))


def asset_refs(spark, sf) -> DataFrame:
    """Order lines as references of assets to symbols."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("asset_path"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("ref_kind"), F.col("l_linenumber").alias("line"))


def assets(spark, sf) -> DataFrame:
    """Orders as assets; the customer's number is the parent type."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_path"), F.col("o_custkey").alias("parent_path"), F.col("o_orderpriority").alias("asset_kind"))


def redirects(spark, sf) -> DataFrame:
    """k is now k + 1 where k ends in 1 or 2: chains of two."""
    return table(spark, sf, "part").where(F.col("p_partkey") % 10 != 0).where(F.col("p_partkey") % 10 <= 2).select(F.col("p_partkey").alias("old_name"), (F.col("p_partkey") + 1).alias("new_name"))


def inherits(spark, sf) -> DataFrame:
    """A tree over the parts: the parent is a third of the number."""
    return table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child_id"), F.expr("p_partkey div 3").alias("parent_id"))


_STORED: dict[tuple, object] = {}


def _once(spark, sf, name: str, make):
    """What make gives, made once a session for each state of its input (files by name, time and size)."""
    written = spark.read.parquet(f"{sf}/part.parquet").agg(F.max("_metadata.file_modification_time"), F.max("_metadata.file_path"), F.sum("_metadata.file_size"), F.count("*")).first()
    key = (name, spark.sparkContext.applicationId, sf, *written)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def type_ancestors(spark, sf) -> DataFrame:
    """The closure of the type tree, stored. `type_ancestors` itself is always computed anew."""
    return _once(spark, sf, "ancestors", lambda: saved(ancestors(inherits(spark, sf)), "type-ancestors"))


def inherits_more(spark, sf) -> DataFrame:
    """The tree of `inherits`, and interfaces: a fifth of the number too, where the number leaves 3 when divided by 7."""
    p = table(spark, sf, "part").where("p_partkey > 0 and p_partkey % 7 = 3")
    more = p.select(F.col("p_partkey").alias("child_id"), F.expr("p_partkey div 5").alias("parent_id"), F.lit(True).alias("is_interface"))
    return inherits(spark, sf).withColumn("is_interface", F.lit(False)).unionByName(more)


def type_labels(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The labels of `inherits_more`, its extra parents and the intervals of types that need several, stored."""

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        labels, extra = label(inherits_more(spark, sf))
        return labels, extra, intervals(labels, extra)

    return _once(spark, sf, "labels", make)


def types(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("type_id"))


def includes(spark, sf) -> DataFrame:
    """A graph over the parts with shared targets: half and a third of the number."""
    p = table(spark, sf, "part").where("p_partkey > 0")
    return p.select(F.col("p_partkey").alias("path"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("resolved_path"))


def asset_texts(spark, sf) -> DataFrame:
    """Documents as texts of assets."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("asset_path"), F.col("source").alias("asset_kind"), F.col("lang").alias("text_kind"), "text")


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def functions(spark, sf) -> DataFrame:
    """Parts as functions: each belongs to the type of its number, is named by its kind, and its name is the signature."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("function_id"), F.col("p_partkey").alias("type_id"), F.col("p_type").alias("name"), F.lit("").alias("signature"), F.lit(True).alias("is_virtual"),
        (F.col("p_size") % 7 == 0).alias("is_final"), (F.col("p_size") % 11 == 0).alias("is_deprecated"), (F.col("p_size") % 2 == 0).alias("is_native_event"),
    )


def members(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("member_id"), F.col("p_partkey").alias("type_id"), F.col("p_type").alias("name"), F.lit("").alias("signature"), F.when(F.col("p_size") % 3 == 0, "private").when(F.col("p_size") % 3 == 1, "protected").otherwise("public").alias("access"))


def scopes(spark, sf) -> DataFrame:
    """Views as scopes of value hours, in microseconds."""
    e = events(spark, sf).where("event_type = 'view'")
    start = F.unix_micros("ts")
    return e.select(F.col("user_id").alias("path"), start.alias("line"), (start + F.floor("value") * HOUR).alias("end_line"), F.col("event_id").alias("scope_id"))


def points(spark, sf) -> DataFrame:
    e = events(spark, sf).where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("point_id"), F.col("user_id").alias("path"), F.unix_micros("ts").alias("line"))


def heartbeats(spark, sf) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").alias("session"), "ts")
