"""Tables that change together: generations of partitions, and manifests that name the current ones.

<index>/<table>/generation=<g>/part=<p> holds what a batch wrote for a partition; <index>/manifest/<number>.json says, for each table, which generation each
partition is read from, and the table's schema. The manifest with the highest number counts. It is written under another name and then
renamed, which file systems do as a whole; where another writer has taken the number, the rename fails and so does the batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.tables import hadoop_path


def _names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder has; nothing if it isn't there."""
    path, store = hadoop_path(spark, folder)
    return [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []


def _numbers(spark: SparkSession, index: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{index}/manifest") if n.endswith(".json") and not n.startswith("."))


def read_manifest(spark: SparkSession, index: str, number: int | None = None) -> dict | None:
    """The last manifest, or that of the number; None for an index without any."""
    numbers = _numbers(spark, index)
    if not numbers:
        return None
    number = numbers[-1] if number is None else number
    path, store = hadoop_path(spark, f"{index}/manifest/{number:010d}.json")
    stream = store.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": number}
    finally:
        stream.close()


def table_of(spark: SparkSession, index: str, manifest: dict | None, name: str, parts: list[int] | None = None) -> DataFrame | None:
    """A table as the manifest says, with its column part, or those partitions of it; None where there is no such table yet."""
    if not manifest or name not in manifest["tables"]:
        return None
    told = manifest["tables"][name]
    schema = T.StructType.fromJson(told["schema"])
    wanted = {p: g for p, g in told["parts"].items() if parts is None or int(p) in parts}
    if not wanted:
        return spark.createDataFrame([], schema)
    paths = [f"{index}/{name}/generation={g}/part={p}" for p, g in sorted(wanted.items())]
    return spark.read.schema(schema).option("basePath", f"{index}/{name}").parquet(*paths).select(*schema.names)


def write_partitions(rows: DataFrame, folder: str, sort: str | None = None) -> None:
    """One task a partition number, so that each folder gets one file; sorted by a column if the table has it."""
    rows = rows.repartition("part")
    rows = rows.sortWithinPartitions("part", sort) if sort in rows.columns else rows
    rows.write.mode("overwrite").partitionBy("part").parquet(folder)


def put_manifest(spark: SparkSession, index: str, told: dict, number: int) -> None:
    made, store = hadoop_path(spark, f"{index}/manifest/.{uuid.uuid4().hex}")
    out = store.create(made, False)
    try:
        out.write(bytearray(json.dumps(told).encode()))
    finally:
        out.close()
    final, _ = hadoop_path(spark, f"{index}/manifest/{number:010d}.json")
    if store.exists(final) or not store.rename(made, final):
        store.delete(made, False)
        raise RuntimeError("another batch was put in at the same time")


def commit(spark: SparkSession, index: str, have: dict | None, generation: str, tables: dict[str, tuple[DataFrame, list[int]]], partitions: int, sort: str | None = None) -> None:
    """Write the new rows (with part) of some partitions of each table as a generation, then the manifest that replaces `have`."""
    told = {"partitions": partitions, "tables": json.loads(json.dumps(have["tables"])) if have else {}}
    for name, (rows, parts) in tables.items():
        own = told["tables"].setdefault(name, {"parts": {}, "schema": rows.schema.jsonValue()})
        own["schema"] = rows.schema.jsonValue()
        for p in parts:
            own["parts"].pop(str(p), None)
        if not parts:
            continue
        folder = f"{index}/{name}/generation={generation}"
        write_partitions(rows, folder, sort)
        for n in _names(spark, folder):
            if n.startswith("part="):
                own["parts"][n.removeprefix("part=")] = generation
    put_manifest(spark, index, told, have["number"] + 1 if have else 0)


def vacuum(spark: SparkSession, index: str, keep: int = 2) -> int:
    """Delete manifests but for the last `keep`, and generations that none of these reads; gives the number of generations deleted. Not while a batch is put in."""
    numbers = _numbers(spark, index)
    kept = [read_manifest(spark, index, n) for n in numbers[-keep:]]
    gone = 0
    for n in numbers[:-keep]:
        path, store = hadoop_path(spark, f"{index}/manifest/{n:010d}.json")
        store.delete(path, False)
    for name in {t for m in kept for t in m["tables"]}:
        used = {g for m in kept for g in m["tables"].get(name, {"parts": {}})["parts"].values()}
        for n in _names(spark, f"{index}/{name}"):
            if n.startswith("generation=") and n.removeprefix("generation=") not in used:
                path, store = hadoop_path(spark, f"{index}/{name}/{n}")
                store.delete(path, True)
                gone += 1
    return gone
