"""Structured Streaming jobs: incremental index, debounced edits, live hangs, slow operations."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from corvane.operators.logs import REPORT_SECONDS, SLOW_MS
from corvane.operators.tables import saved, shared_dir
from corvane.operators.updates import declaration_fingerprints, latest_versions
from corvane.streaming import generations

#: Index files are dealt over this many partitions by path, so a batch rewrites only those that its paths fall in.
PARTITIONS = 64
#: Keys of the state of live hangs, over which sessions are dealt.
BUCKETS = 512


def update_index(batch: DataFrame, index: str, extract: Callable[[DataFrame], DataFrame], partitions: int = PARTITIONS) -> None:
    """Put a batch of files (path, content, version, deleted) into an index of files and declarations below `index`.

    The newest version of each path counts, also against what the index has; a deleted path leaves its row in `files`, so a late
    older version stays out. Only partitions that the batch falls in are read and written, and declarations only in those where
    some path declares something else than before (by fingerprint). What is written is a new generation; one manifest names the generation of
    each partition of both tables, and takes effect as a whole when it gets its name. So readers never see half a batch, a batch that fails anywhere leaves the
    index as it was, and a batch put in again changes nothing.
    """
    spark = batch.sparkSession
    have = generations.read_manifest(spark, index)
    part = F.pmod(F.xxhash64("path"), F.lit(partitions)).cast("int")
    if have and have["partitions"] != partitions:
        raise ValueError(f"the index has {have['partitions']} partitions")
    new = latest_versions(batch).withColumn("part", part)
    old_files = generations.table_of(spark, index, have, "files")
    if old_files is not None:
        new = new.join(old_files.select("path", F.col("version").alias("_have")), "path", "left").where("_have is null or version > _have").drop("_have")
    new = saved(new, "accepted")
    touched = [r[0] for r in new.select("part").distinct().collect()]  # at most `partitions` numbers
    if not touched:
        return
    decls = saved(extract(new.where("not deleted").select("path", "content")).withColumn("part", part), "extracted")
    prints = declaration_fingerprints(decls).select("path", "fingerprint")
    files = new.select("path", "version", "deleted", "part").join(prints, "path", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("0")))
    changed = files.select("path", "fingerprint", "part")
    if old_files is not None:
        before = old_files.where(F.col("part").isin(touched)).select("path", F.when(F.col("deleted"), "0").otherwise(F.col("fingerprint")).alias("_fp"))
        changed = changed.join(before, "path", "left").where("not fingerprint <=> coalesce(_fp, '0')")
    else:
        changed = changed.where("fingerprint <> '0'")
    stale = [r[0] for r in changed.select("part").distinct().collect()]
    generation = uuid.uuid4().hex
    paths = new.select("path")
    told = {}
    for name, rows, parts in (("files", files, touched), ("declarations", decls.where(F.col("part").isin(stale)), stale)):
        old = generations.table_of(spark, index, have, name, parts)
        if old is not None:
            rows = rows.unionByName(old.join(paths, "path", "left_anti"), allowMissingColumns=True)
        told[name] = (rows, parts)
    generations.commit(spark, index, have, generation, told, partitions)


def read_declarations(spark: SparkSession, index: str) -> DataFrame:
    """The declarations of the last whole batch."""
    found = generations.table_of(spark, index, generations.read_manifest(spark, index), "declarations")
    if found is None:
        raise FileNotFoundError(f"no batch has been put into {index}")
    return found.drop("part")


def stream_index(files: DataFrame, index: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str, partitions: int = PARTITIONS) -> StreamingQuery:
    """Keep an index up to date from a stream of file versions; each batch is put in once more without harm if it is repeated."""
    return files.writeStream.foreachBatch(lambda b, _: update_index(b, index, extract, partitions)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounce(edits: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(path, start, end, n_edits): one row per burst of edits (path, ts); a pause longer than the gap ends it."""
    e = edits.withWatermark("ts", late) if edits.isStreaming else edits
    return e.groupBy("path", F.session_window("ts", gap)).agg(F.count("*").alias("n_edits")).select("path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_edits")


def slow_operations(ops: DataFrame, window: str = "1 hour", slow_ms: int = SLOW_MS, late: str = "10 minutes") -> DataFrame:
    """(op, start, n, slowest_ms): operations (ts, op, ms) of slow_ms or more per tumbling window."""
    o = ops.withWatermark("ts", late) if ops.isStreaming else ops
    return o.where(F.col("ms") >= slow_ms).groupBy("op", F.window("ts", window)).agg(F.count("*").alias("n"), F.max("ms").alias("slowest_ms")).select("op", F.col("window.start").alias("start"), "n", "slowest_ms")


class _Hangs(StatefulProcessor):
    """Beats of a bucket of sessions: those that the watermark has passed are walked in order, all sessions at once, the others wait. State: rows (session, us, told), as Arrow tables of up to CHUNK rows; told is
    the last report told of a session's last sign of life, or WAITS for a beat that waits. The bucket NONE holds the beats of no session."""

    CHUNK, WAITS, NONE = 1 << 16, -1, -1

    def __init__(self, seconds: float, reports: tuple):
        self.least, self.reports = round(seconds * 1_000_000), sorted(set(reports))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield self._walked(key, [f[["session", "us"]].assign(told=np.int32(self.WAITS)) for f in rows], timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._walked(key, [], timerValues)

    def _walked(self, key: tuple, new: list[pd.DataFrame], timers: TimerValues) -> pd.DataFrame:
        passed = timers.getCurrentWatermarkInMs() * 1000
        all_ = pd.concat([*(pa.ipc.open_stream(x[0]).read_pandas() for x in self.kept.get()), *new], ignore_index=True)
        code, sessions = pd.factorize(all_["session"], use_na_sentinel=False)
        us, told = all_["us"].to_numpy("int64"), all_["told"].to_numpy("int32")
        is_last = told != self.WAITS
        last = np.full(len(sessions), np.iinfo("int64").min)
        last[code[is_last]] = us[is_last]
        rows = np.flatnonzero(is_last | (us > last[code]))
        rows = rows[np.lexsort((us[rows], code[rows]))]
        code, us, told = code[rows], us[rows], told[rows]
        first = np.ones(len(us), bool)
        first[1:] = (code[1:] != code[:-1]) | (us[1:] != us[:-1])
        code, us, told = code[first], us[first], told[first]
        waits = us > passed
        waiting = (code[waits], us[waits], told[waits])
        code, us, told = code[~waits], us[~waits], np.maximum(told[~waits], 0)
        ends = np.ones(len(us), bool)
        ends[:-1] = code[1:] != code[:-1]
        until = np.where(ends, passed, np.append(us[1:], 0))
        gap = until - us
        hung = ~ends & (gap > self.least)
        found = [(code[hung], us[hung], gap[hung] / 1_000_000, None)]
        now = told.copy()
        for r in self.reports:
            due = (told < r) & (gap >= r * 1_000_000)
            found.append((code[due], us[due], np.full(due.sum(), float(r)), r))
            now[due] = r
        self._keep(sessions, *(np.concatenate(x) for x in zip((code[ends], us[ends], now[ends]), waiting, strict=True)))
        # one timer for what is due first, a beat that waits or a report that is still to come; it fires once the watermark has reached it, so not in the batch that sets it, which would take it away again
        dues = [us[ends & (now < r)] + r * 1_000_000 for r in self.reports] + [waiting[1]]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if any(len(x) for x in dues):
            self.handle.registerTimer(-(-int(min(x.min() for x in dues if len(x))) // 1000))
        frames = [pd.DataFrame({"session": pd.Series(sessions).take(c).array if key[0] != self.NONE else np.full(len(c), None), "us": t, "seconds": s, "report_at": pd.array([r] * len(c), "Int32")}) for c, t, s, r in found]
        return pd.concat(frames, ignore_index=True)

    def _keep(self, sessions, code: np.ndarray, us: np.ndarray, told: np.ndarray) -> None:
        chunks = []
        for at in range(0, len(us), self.CHUNK):
            part = slice(at, at + self.CHUNK)
            table = pa.table({"session": pa.Array.from_pandas(pd.Series(sessions).take(code[part])), "us": us[part], "told": told[part]})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            chunks.append((sink.getvalue().to_pybytes(),))
        self.kept.put(chunks) if chunks else self.kept.clear()

    def close(self) -> None:
        pass


def stream_hangs(beats: DataFrame, seconds: float = 1.0, reports: tuple = REPORT_SECONDS, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(session, ts, seconds, report_at) from heartbeats (session, ts), whatever order they come in: a row with report_at null for each time without one that is longer than
    `seconds`, once a beat has ended it, and a row for each report, as soon as the watermark says that the session has been silent for so long, ended or not.

    Beats wait in the state until the watermark passes them, so those that come late by less than `late` are put in their place. Sessions (numbers, strings or other plain values) are dealt over `buckets`
    keys of the state, each read, walked and written as a whole: a batch costs calls in proportion to buckets, not to sessions. More sessions than some millions want more buckets; their number can't change
    once the stream has a checkpoint. Needs the state store that keeps timers and lists; it is set for the session where none is chosen.
    """
    store = "spark.sql.streaming.stateStore.providerClass"
    spark = beats.sparkSession
    if "RocksDB" not in spark.conf.get(store, ""):
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = beats.schema["session"].dataType.simpleString()
    bucket = F.when(F.col("session").isNull(), _Hangs.NONE).otherwise(F.pmod(F.xxhash64("session"), F.lit(buckets))).cast("int")
    # no nulls among whole numbers, which pandas would turn into doubles
    session = F.coalesce("session", F.lit(0).cast(kind)) if isinstance(beats.schema["session"].dataType, T.IntegralType) else F.col("session")
    rows = beats.select("session", "ts").where("ts is not null").withWatermark("ts", late).select(bucket.alias("bucket"), session.alias("session"), "ts", F.unix_micros("ts").alias("us"))
    told = rows.groupBy("bucket").transformWithStateInPandas(_Hangs(seconds, reports), f"session {kind}, us long, seconds double, report_at int", "Append", "EventTime")
    return told.select("session", F.timestamp_micros("us").alias("ts"), "seconds", "report_at")


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and read what it gave: for tests and for batch use of a streaming job."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{base}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The driver's events as a stream. A pattern stands for the table, which may be one file or a folder of files."""
    batch = spark.read.parquet(f"{folder}/events.parquet")
    return spark.readStream.schema(batch.schema).parquet(f"{folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
