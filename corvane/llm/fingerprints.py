"""Document fingerprints: a canonical exact digest.

A text is brought to one canonical form (Unicode NFKC, case folding, runs of white space to one blank, none at the
ends) and hashed with 128-bit xxhash. Rows with equal digests are then compared byte for byte, so a clash of digests
never joins two documents. Only buckets of several rows are compared: their canonical texts are packed and grouped with their
digests, with partial aggregation, so a group that holds a third of all rows costs one row a task.

Null texts count as empty; empty texts all share one fingerprint. Repeated rows stay repeated. A column of the input
that has the name of a result column is replaced by the result.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import maybe_among, saved, scratch, shuffle_partitions, small_batches, table, text_of, trimmed


def canonical(text: str) -> str:
    """NFKC, case folded, normalised again (folding can undo it), white space runs as one blank."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


@F.pandas_udf(T.StringType())
def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: digest(canonical(t)))


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    """The canonical texts, compressed: equal if and only if these are."""
    codec = pa.Codec("zstd", 3)
    return texts.map(lambda t: codec.compress(canonical(t).encode("utf-8", "surrogatepass"), asbytes=True))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The input with the canonical digest (32 hex digits) of each whole text."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, _digests(text_of(text)))


def buckets(docs: DataFrame) -> DataFrame:
    """(fingerprint, packed, group_id, group_size, variants), written, for every canonical text of the rows whose digests occur more than once.

    docs: doc_id, text, without nulls in text. group_id: the smallest id; variants: different texts with that digest, 1 unless digests clash.
    """
    with scratch(docs.sparkSession) as save:
        keyed = docs.select("doc_id", "text", _digests("text").alias("fingerprint"))
        several = save(keyed.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "several")
        packed = maybe_among(keyed, several, "fingerprint").select("doc_id", "fingerprint", _packed("text").alias("packed"))
        groups = save(packed.groupBy("fingerprint", "packed").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")), "groups")
        variants = groups.groupBy("fingerprint").agg(F.count("*").alias("variants"), F.sum("group_size").alias("n")).where("n > 1").drop("n")
        clash = save(variants.where("variants > 1"), "clashes")
        alone = groups.where("group_size > 1").select("fingerprint", F.lit(None).cast("binary").alias("packed"), "group_id", "group_size", F.lit(1).cast("long").alias("variants"))
        if clash.isEmpty():
            return saved(alone, "buckets")
        return saved(alone.join(clash, "fingerprint", "left_anti").unionByName(groups.join(clash, "fingerprint").select(alone.columns)), "buckets")


def _with_groups(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (doc_id, text, fingerprint, ...) with group_id and group_size out of buckets; texts are compared where digests clash."""
    out = rows.join(found.where("variants = 1").select("fingerprint", "group_id", "group_size"), "fingerprint", "left")
    clash = found.where("variants > 1").select("fingerprint", "packed", F.col("group_id").alias("_id"), F.col("group_size").alias("_size"))
    if not clash.isEmpty():
        out = out.withColumn("packed", _packed("text")).join(clash, ["fingerprint", "packed"], "left").withColumn("group_id", F.coalesce("_id", "group_id")).withColumn("group_size", F.coalesce("_size", "group_size"))
    return out.withColumn("group_id", F.coalesce("group_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1)))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, group_id (smallest id with the same canonical bytes), group_size.

    Digests deal the rows; canonical bytes are compared inside buckets. Null ids are passed over by group_id unless all are null.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return _with_groups(docs.withColumn("fingerprint", _digests("text")), buckets(docs)).select("doc_id", "fingerprint", "group_id", "group_size")


def _cuts_below(x: Column, cuts: list[int]) -> Column:
    """How many of the cuts (ascending) are x or less: the stretch of cuts that x falls in is found first, so about 2 sqrt(n) are compared."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts))
    stretches = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    count = lambda known: F.size(F.filter(known, lambda c: c <= x))
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    at = count(longs([s[0] for s in stretches]))
    return F.when(at == 0, 0).otherwise((at - 1) * width + count(F.get(F.array(*[longs(s) for s in stretches]), at - 1)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each document beside the next one by ascending id; after the last comes the first.

    The ids are cut into ranges at approximate quantiles, each range is sorted in its own task, and the first row of
    each range is also sent to the range before it. Only the range bounds and first keys (one per range) pass through
    the driver. Null ids come first; equal ids are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    cuts = sorted({int(q) for q in keyed.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    part = _cuts_below(F.col("doc_id"), cuts)
    keyed = keyed.select("*", F.when(F.col("doc_id").isNull(), 0).otherwise(part).alias("part"), F.xxhash64("text").alias("h"))
    heads = sorted((r["part"], r["head"]) for r in keyed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h")).alias("head")).collect())
    if not heads:
        return keyed.select("doc_id", "text", F.col("text").alias("next_text"))
    to = [(head["doc_id"], head["h"], heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    ids = spark.createDataFrame(to, "head_id long, h long, part int")  # one row per range
    tails = keyed.drop("part").join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("head_id")) & (keyed["h"] == ids["h"]))
    both = keyed.select("part", F.lit(0).alias("tail"), "doc_id", "h", "text").union(tails.select("part", F.lit(1).alias("tail"), "doc_id", keyed["h"], "text"))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "h")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids, texts, nexts, held = [], [], [], 0
            for p, tail, i, t in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
                if last and last[0] == p:
                    ids.append(last[1]), texts.append(last[2]), nexts.append(t)
                    held += len(last[2]) + len(t)
                last = None if tail else (p, i, t)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(nexts, pa.string())], ["doc_id", "text", "next_text"])
                    ids, texts, nexts, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(nexts, pa.string())], ["doc_id", "text", "next_text"])

    return dealt.drop("h").mapInArrow(trimmed(pair), "doc_id long, text string, next_text string")


@F.pandas_udf(T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]))
def _likeness(texts: pd.Series, edited: pd.Series, nexts: pd.Series) -> pd.DataFrame:
    rows = []
    for t, e, n in zip(texts, edited, nexts, strict=True):
        t, e, n = canonical(t), canonical(e), canonical(n)
        a, b = digest(t), digest(e)
        # equal digests count only if the canonical texts are equal too
        rows.append((a, b, float(a == b and t == e), float(a == digest(n) and t == n)))
    return pd.DataFrame(rows, columns=["fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op6_fingerprints(spark, sf_dir) -> DataFrame:
    """Fingerprint of every document and of its edited text, with its group of equal fingerprints; an exact digest's likeness is 1 or 0."""
    docs = table(spark, sf_dir, "documents")
    pairs = with_next(docs)
    n = F.length("text").cast("long")
    cut = F.floor(n / 2)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut.cast("int")))
    pairs = pairs.select("doc_id", n.alias("n_chars"), "text", edited.alias("edited"), "next_text")
    rows = pairs.select("doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _likeness("text", "edited", "next_text").alias("f")).select("doc_id", "text", "n_chars", "edited_sha256", "f.*")
    grouped = _with_groups(rows, buckets(docs.select("doc_id", text_of().alias("text"))))
    return grouped.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")
