"""A training corpus from raw documents: toxic documents and near duplicates go, repeated passages are cut out, sources are
mixed to their weights, and what is left is encoded.

Every stage takes (spark, docs, sf_dir), with docs read from the Parquet files that the stage before has written, and
works on all of it. All stages but the last return the columns of `documents`.

Nulls: null texts count as empty throughout (never toxic, no near duplicate, nothing to cut, size 0, no ids); a null
id is kept by every stage and never linked; null sources form a source of their own. Rows that share an id count as
one document in the near-duplicate stage, which keeps one of them. Empty tables give empty tables. Columns beyond those of
documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, minhash, mixing, suffix, toxicity
from corvane.llm.common import new_folder, saved, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Repeated passages of so many words and more are cut out. The fewest bytes that so many words take: one each, and one between.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1
#: Bytes of text that a task gives to Python at once, in every stage: less than elsewhere, as executors still hold what earlier stages left.
BATCH_BYTES = 1 << 20
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below the threshold. It learns from the labels of rows in docs."""
    small_batches(spark, BATCH_BYTES)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(COLUMNS), model, out="_score").where(F.col("_score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of rows that share it, the smallest."""
    small_batches(spark, BATCH_BYTES)
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("doc_id", "row.*").select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; every document stays, if only with an empty text.

    A passage is PASSAGE_WORDS or more whole words in a row, whatever white space lies between them.
    """
    small_batches(spark, BATCH_BYTES)
    cut = suffix.without_repeats(docs.select(COLUMNS), PASSAGE_WORDS, unit="word")
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document appears as often as the mix takes it."""
    return mixing.mixed(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_chars): token ids of each document of the mix, and the length of what they decode to."""
    path = bpe.vocabulary_path()
    # written in between, so a task has one Python worker at a time
    back = bpe.decode(saved(bpe.encode(docs, path, block=BATCH_BYTES), "ids"), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("text").cast("long").alias("n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
