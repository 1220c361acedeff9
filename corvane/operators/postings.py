"""Text search over stored posting lists, for a corpus that is searched more often than it changes.

An index folder holds, as generations under one manifest (so readers see a batch of updates whole or not at all):
- texts: (text_id, version, deleted, text), dealt over partitions by id; the newest version of each;
- grams: (gram, text_ids, versions) for each different run of two and of three characters, without case: the texts among some SLICE characters of a task's texts that have it. Dealt by gram and sorted by it, so a reader skips what isn't asked for.
  An update only adds rows; texts of versions that have gone are dropped when they meet the texts, and `compact` writes the grams anew from the texts;
- counts of each gram over all that was added, for choosing the rarest.

A query of two characters is a gram; of a longer one, the RAREST rarest three-character grams are looked up and intersected, and the texts left are checked in full.
Null and short texts have no grams and hold no query. A gram of nearly all texts is a long list, but many rows with an array of one slice's texts each. Grams are cut by numpy in tasks: a slice's characters are numbered, and runs with their texts are sorted as whole numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401, pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.search import _grams, matches
from corvane.operators.tables import saved
from corvane.operators.updates import latest_versions
from corvane.streaming import generations

#: Partitions of each table; grams of a query that are looked up.
PARTITIONS, RAREST = 32, 3
#: Characters (bytes, more exactly) of texts whose grams are sorted at once.
SLICE = 4 << 20


def _dealt(key: str, partitions: int):
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def _runs(texts: list[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different runs of n characters of some texts, the offsets of each one's list, and the numbers of the texts in these."""
    letter = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    text = np.repeat(np.arange(len(texts), dtype="int32"), [len(t) for t in texts])
    letters, code = np.flatnonzero(np.bincount(letter)), np.zeros(0x110000, "int64")
    code[letters] = np.arange(len(letters))
    each, size = code[letter], max(len(letters), 1)
    whole = text[n - 1 :] == text[: max(len(text) - n + 1, 0)]
    key = np.zeros(len(whole), "int64")
    for k in range(n):
        key = key * size + each[k : len(whole) + k]
    key = key[whole] * len(texts) + text[: len(whole)][whole]
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    run, of = np.divmod(key, max(len(texts), 1))
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
    told = letters[np.stack([run[starts] // size**k % size for k in reversed(range(n))], axis=1)] if len(starts) else np.zeros((0, n))
    joined = told.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + n] for i in range(0, len(joined), n)], np.append(starts, len(of)).astype("int32"), of


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """Neighbours among texts (binary) of `most` bytes together, or a single longer one, with the place of the first; fewer if they have so many letters that runs and texts can't be numbered."""
    size = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        cut = [x.decode("utf-8", "replace") for x in texts[at:until].to_pylist()]
        while len(cut) > 1 and (128 + len(set().union(*(x for x in cut if not x.isascii())))) ** 3 * len(cut) >= 1 << 63:
            cut = cut[: len(cut) // 2]
        yield at, cut
        at += len(cut)


def _posting(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (text_id, version, low) become (gram, text_ids, versions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column("low"), most):
                for n in (2, 3):
                    grams, offsets, of = _runs(texts, n)
                    lists = [pa.ListArray.from_arrays(pa.array(offsets), batch.column(c).take(pa.array(of + at))) for c in ("text_id", "version")]
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *lists], ["gram", "text_ids", "versions"])

    return run


def _posted(texts: DataFrame, partitions: int, most: int = SLICE) -> DataFrame:
    """(gram, text_ids, versions, part) of texts."""
    rows = texts.where("not deleted and text is not null").select("text_id", "version", F.lower("text").cast("binary").alias("low"))
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(texts.sparkSession.conf.get(batch).rstrip("b")) > SLICE:
        texts.sparkSession.conf.set(batch, str(SLICE))  # so that a task holds one slice of texts at a time
    kind, number = (rows.schema[c].dataType.simpleString() for c in ("text_id", "version"))
    lists = rows.mapInArrow(_posting(most), f"gram string, text_ids array<{kind}>, versions array<{number}>")
    return lists.withColumn("part", _dealt("gram", partitions))


def _single(lists: DataFrame) -> DataFrame:
    """(gram, text_id, version): a row for each text of the lists. Indexes of earlier versions of this library hold such rows."""
    return (lists if "text_id" in lists.columns else lists.selectExpr("gram", "inline(arrays_zip(text_ids, versions)) as (text_id, version)")).select("gram", "text_id", "version")


def update_postings(texts: DataFrame, index: str, partitions: int = PARTITIONS) -> None:
    """Put texts (text_id, text, version, deleted) into an index, new or not. The newest version of an id counts; a batch put in again changes nothing."""
    spark = texts.sparkSession
    have = generations.read_manifest(spark, index)
    if have and have["partitions"] != partitions:
        raise ValueError(f"the index has {have['partitions']} partitions")
    new = latest_versions(texts.select(F.col("text_id").alias("path"), "version", "deleted", "text")).withColumnRenamed("path", "text_id").withColumn("part", _dealt("text_id", partitions))
    old = generations.table_of(spark, index, have, "texts")
    if old is not None:
        new = new.join(old.select("text_id", F.col("version").alias("_have")), "text_id", "left").where("_have is null or version > _have").drop("_have")
    new = saved(new, "accepted")
    touched = [r[0] for r in new.select("part").distinct().collect()]
    if not touched:
        return
    current = generations.table_of(spark, index, have, "texts", touched)
    whole = new if current is None else new.unionByName(current.join(new.select("text_id"), "text_id", "left_anti"))
    posted = saved(_posted(new, partitions), "postings")
    counts = posted.groupBy("gram", "part").agg(F.sum(F.size("text_ids")).alias("n"))
    before = generations.table_of(spark, index, have, "counts")
    if before is not None:
        counts = counts.unionByName(before).groupBy("gram", "part").agg(F.sum("n").alias("n"))
    every = list(range(partitions))
    level = 0 if not have else 1 + max((int(n.removeprefix("grams")) for n in have["tables"] if n.startswith("grams")), default=-1)
    generations.commit(spark, index, have, uuid.uuid4().hex, {"texts": (whole, touched), f"grams{level}": (posted, every), "counts": (counts, every)}, partitions, sort="gram")


def compact(spark: SparkSession, index: str) -> None:
    """One table of grams in place of all that updates have added, with the grams of current versions only, and exact counts."""
    have = generations.read_manifest(spark, index)
    partitions, every = have["partitions"], list(range(have["partitions"]))
    posted = saved(_posted(generations.table_of(spark, index, have, "texts"), partitions), "postings")
    counts = posted.groupBy("gram", "part").agg(F.sum(F.size("text_ids")).alias("n"))
    kept = have | {"tables": {n: t for n, t in have["tables"].items() if not n.startswith("grams")}}
    generations.commit(spark, index, kept, uuid.uuid4().hex, {"grams0": (posted, every), "counts": (counts, every)}, partitions, sort="gram")


def _all_grams(spark: SparkSession, index: str, have: dict, parts: list[int] | None = None, only: list[str] | None = None) -> DataFrame:
    """(gram, text_id, version) of all that updates have added, or of some partitions and grams; grams reach the scan, which skips by their order."""
    tables = [generations.table_of(spark, index, have, n, parts) for n in have["tables"] if n.startswith("grams")]
    return reduce(DataFrame.unionByName, [_single(t if only is None else t.where(F.col("gram").isin(only))) for t in tables])


def search_postings(spark: SparkSession, index: str, queries: DataFrame, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """(query_id, query, text_id, text): the texts that hold each query (query_id, query; two characters at least)."""
    have = generations.read_manifest(spark, index)
    asked = queries.where(F.length("query") >= 2).select("query_id", "query")
    low = F.lower("query")
    grams = asked.select("query_id", "query", F.explode(F.when(F.length(low) == 2, F.array(low)).otherwise(_grams(low, 3))).alias("gram"))
    counted = grams.join(generations.table_of(spark, index, have, "counts").select("gram", "n"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = Window.partitionBy("query_id", "query").orderBy("n", "gram")
    chosen = saved(counted.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= RAREST).select("query_id", "query", "gram"), "chosen")
    wanted = chosen.groupBy("query_id", "query").agg(F.count("*").alias("_wanted"))
    keys = chosen.select("gram").distinct()
    parts = [r[0] for r in keys.select(_dealt("gram", have["partitions"]).alias("p")).distinct().collect()]  # at most `partitions` numbers
    few = [r[0] for r in keys.limit(257).collect()]
    posted = _all_grams(spark, index, have, parts, few if len(few) <= 256 else None)
    met = posted.join(chosen, "gram").groupBy("query_id", "query", "text_id", "version").agg(F.count("*").alias("_met")).join(wanted, ["query_id", "query"]).where("_met = _wanted")
    texts = generations.table_of(spark, index, have, "texts").where("not deleted").select("text_id", "version", "text")
    found = met.select("query_id", "query", "text_id", "version").join(texts, ["text_id", "version"])
    return found.where(matches("text", F.col("query"), match_case, whole_word)).select("query_id", "query", "text_id", "text")
