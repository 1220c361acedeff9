"""Session and hang logs: gaps, steps, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.scans import line_block, scan, time_block

#: Seconds at which a lasting hang is written, and the shortest slow operation in milliseconds.
REPORT_SECONDS, SLOW_MS = (5, 15, 60, 300), 300
GIGABYTE = 1 << 30


def detect_hangs(heartbeats: DataFrame, seconds: float = 1.0) -> DataFrame:
    """(session, ts, until, seconds): times without a heartbeat for longer than the threshold; ts is the last sign of life."""
    gap = (F.unix_micros("until") - F.unix_micros("ts")) / 1_000_000
    beats = scan(heartbeats.select("session", "ts"), ["session"], ["ts"], time_block("ts"), nexts={"until": F.col("ts")})
    return beats.withColumn("seconds", gap).where(F.col("seconds") > seconds)


def hang_reports(hangs: DataFrame, at: tuple = REPORT_SECONDS) -> DataFrame:
    """hangs with one row for each report that a hang lasted long enough for."""
    return hangs.withColumn("report_at", F.explode(F.filter(F.array(*[F.lit(x) for x in at]), lambda x: x <= F.col("seconds"))))


def retain_sessions(sessions: DataFrame, n: int = 5, group: tuple = (), order: tuple = ("session_date", "session_time", "pid")) -> DataFrame:
    """The newest n sessions (of each group); without a group a sorted limit, which each task cuts first."""
    if not group:
        return sessions.orderBy(*[F.desc(c) for c in order]).limit(n)
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return sessions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def cap_log(lines: DataFrame, most: int = 20 << 20, group: str = "session", order: str = "n", text: str = "message") -> DataFrame:
    """The lines of each session until its file would grow beyond `most` bytes."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    return scan(lines, [group], [order], line_block(order), sums={"bytes_so_far": size.cast("long")}).where(F.col("bytes_so_far") <= most)


def memory_steps(samples: DataFrame, step: int = GIGABYTE) -> DataFrame:
    """(session, ts, bytes): samples written, i.e. the first one and each that differs from the last written one by step or more.

    What was last written depends on all before, so it is a fold over each session's samples in order of time: Spark sorts them within
    partitions (on disk, if need be), and a task holds one batch and the last value that was written.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, first = None, 0, True
        for batch in batches:
            keep = []
            for i, (session, b) in enumerate(zip(batch.column("session").to_pylist(), batch.column("bytes").to_pylist(), strict=True)):
                if first or session != now or abs(b - last) >= step:
                    now, last, first = session, b, False
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    samples = samples.select("session", "ts", "bytes").where("bytes is not null")
    return samples.repartition("session").sortWithinPartitions("session", "ts", "bytes").mapInArrow(fold, samples.schema)


def log_summary(ops: DataFrame, hangs: DataFrame, slow_ms: int = SLOW_MS) -> DataFrame:
    """(session, n_ops, n_slow, slowest_ms, n_hangs, longest_hang) of operations (session, ms) and hangs (session, seconds)."""
    o = ops.groupBy("session").agg(F.count("*").alias("n_ops"), F.count_if(F.col("ms") >= slow_ms).alias("n_slow"), F.max("ms").alias("slowest_ms"))
    h = hangs.groupBy("session").agg(F.count("*").alias("n_hangs"), F.max("seconds").alias("longest_hang"))
    return o.join(h, "session", "full").na.fill(0, ["n_ops", "n_slow", "n_hangs"])


def build_memory(lines: DataFrame) -> DataFrame:
    """(session, heap_bytes, working_set_bytes): the largest figures that `memory:` lines of a session give."""
    number = lambda name: F.try_to_number(F.nullif(F.regexp_extract("message", rf"{name}[ =:]+(\d+)", 1), F.lit("")), F.lit("9999999999999999")).cast("long")
    return lines.where(F.col("message").contains("memory:")).groupBy("session").agg(F.max(number("heap")).alias("heap_bytes"), F.max(number("working set")).alias("working_set_bytes"))


def implementation_plan(functions: DataFrame) -> DataFrame:
    """Missing definitions (def_line null) with the definitions of the neighbours before and after in the class: where a new one belongs."""
    # of a row without a definition, the last up to it is the last before it
    f = scan(functions, ["type_id"], ["line", "function_id"], line_block("line"), lasts={"after_line": F.col("def_line")}, afters={"before_line": F.col("def_line")})
    return f.where("def_line is null").select("type_id", "function_id", "after_line", "before_line")


def outline(symbols: DataFrame) -> DataFrame:
    """symbols (path, line, symbol_id, ...) with their place in the file's outline."""
    return scan(symbols, ["path"], ["line", "symbol_id"], line_block("line"), sums={"outline_pos": F.lit(1)}).withColumn("outline_pos", F.col("outline_pos").cast("int"))


