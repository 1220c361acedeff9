"""Work in proportion to the input: queries on tables with large groups, under a limit of time, and the operators behind them beside plainer ones."""

import contextlib
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import intervals, logs, postings, resolve
from corvane.plans.catalog import QUERIES
from corvane.streaming import generations, jobs
from tests.compare import rows


@contextlib.contextmanager
def within(spark, seconds):
    """Jobs that take longer are cancelled, which fails the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_counted_property_matches_equal_the_pairs(spark):
    draw = random.Random(3)
    names = ["a", "b", "c", "d", None]
    refs = spark.createDataFrame([(draw.choice([1, 2, 3, 4, None]), draw.choice([*names, "e"])) for _ in range(60)], "asset_path long, target_name string")
    symbols = spark.createDataFrame([(draw.choice([*range(9), None]), draw.choice([*names, "f"])) for _ in range(30)], "symbol_id long, name string")
    pairs = resolve.match_property_names(refs, symbols).groupBy("target_name").agg(F.count("*").alias("n_matches"), F.count_distinct("asset_path").alias("n_assets"))
    got = sorted(map(tuple, resolve.count_property_matches(refs, symbols).collect()))
    assert got and got == sorted(map(tuple, pairs.collect()))


@pytest.mark.parametrize("name", ["property_matches", "whole_property_matches"])
def test_a_name_of_very_many_symbols_and_assets(spark, tmp_path, name):
    """4 * 10^10 pairs, which are counted and not made."""
    n = 200_000
    ids = spark.range(n)
    ids.select(F.col("id").alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit("m").alias("p_brand"), F.lit("k").alias("p_type"), F.lit(1).alias("p_size")).write.parquet(f"file://{tmp_path}/part.parquet")
    ids.select((F.col("id") % (n // 2)).alias("l_orderkey"), F.col("id").alias("l_partkey")).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    with within(spark, 60):
        got = QUERIES[name](spark, f"file://{tmp_path}").collect()
    assert [tuple(r) for r in got] == [("bolt", n // 2 * n, n // 2)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_live_hangs_of_many_sessions(spark, tmp_path, kind):
    """20,000 sessions, whose numbers a double can't hold, and beats of none beside them: what the batch operators tell, in a time that doesn't follow the sessions."""
    n, big = 20_000, 2**53 + 1
    name = F.expr(f"cast(case when id % {n + 1} < {n} then {big} + id % {n + 1} end as {kind})")
    beats = spark.range(6 * (n + 1)).select(name.alias("session"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id").cast("long") * 1000 + F.pmod(F.xxhash64("id"), F.lit(20_000_000))).alias("ts"), "id")
    for i in range(3):
        beats.where(F.col("id").between(i * 2 * (n + 1), (i + 1) * 2 * (n + 1) - 1)).drop("id").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(f"session {kind}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    with within(spark, 60):
        got = jobs.finished(jobs.stream_hangs(stream, late="30 seconds"), "append").withColumn("session", F.col("session").cast("string")).toPandas()
    everything = beats.select(F.col("session").cast("string").alias("session"), "ts")
    seen = everything.agg(F.date_trunc("millisecond", F.max("ts")) - F.expr("interval 30 seconds")).first()[0]
    passed = everything.where(F.col("ts") <= F.lit(seen))
    ends = passed.select("session").distinct().withColumn("ts", F.lit(seen))
    hangs = logs.detect_hangs(passed).toPandas()
    reports = logs.hang_reports(logs.detect_hangs(passed.unionByName(ends).distinct())).select("session", "ts", "report_at").toPandas()
    assert len(hangs) > n and rows(got[got.report_at.isna()][["session", "ts", "seconds"]]) == rows(hangs[["session", "ts", "seconds"]])
    assert len(reports) > n and rows(got[got.report_at.notna()][["session", "ts", "report_at"]].astype({"report_at": int})) == rows(reports.astype({"report_at": int}))


def test_posting_lists_equal_a_loop(spark):
    """Slices of one text and of many; a character of two halves in UTF-16, a zero, letters without case, and lower cases that are longer than the capitals."""
    draw = random.Random(8)
    some = [None, "", "x", "ab"] + ["".join(draw.choice("aAbB \0é漢İ😀") for _ in range(draw.randint(0, 30))) for _ in range(40)]
    texts = spark.createDataFrame([(f"t{i}", i * 10, False, t) for i, t in enumerate(some)] + [("gone", 1, True, "abc")], "text_id string, version long, deleted boolean, text string")
    want = set()
    for r in texts.select("text_id", "version", F.lower("text").alias("low")).where("text_id <> 'gone' and low is not null").collect():
        want |= {(r.low[i : i + n], r.text_id, r.version) for n in (2, 3) for i in range(len(r.low) - n + 1)}
    for most in (1, 100, 1 << 20):
        got = sorted(map(tuple, postings._single(postings._posted(texts, 3, most)).collect()))
        assert got == sorted(want)


def test_texts_of_very_many_letters_are_numbered_apart():
    """40,000 letters in each of 200,000 texts' slice would give numbers beyond 63 bits: such a slice is halved."""
    many = "".join(map(chr, range(0x20000, 0x20000 + 40_000)))
    texts = pa.array([many.encode()] + [b"abc"] * 200_000, pa.binary())
    cuts = [(at, len(t)) for at, t in postings._slices(texts, 1 << 30)]
    assert len(cuts) > 1 and sum(n for _, n in cuts) == 200_001 and all(at == sum(n for _, n in cuts[:i]) for i, (at, _) in enumerate(cuts))
    grams, offsets, of = postings._runs([many, many[:3], ""], 3)
    assert grams[:2] == [many[:3], many[1:4]] and offsets.tolist()[:3] == [0, 2, 3] and of.tolist()[:3] == [0, 1, 0] and len(grams) == 39_998


def test_an_index_has_a_row_a_gram_and_slice(spark, tmp_path):
    """3,000 texts with the same 20 grams or more: a list for each gram, not a row for each text of it."""
    texts = spark.range(3000).select(F.col("id").alias("text_id"), F.lit("the same text").alias("text"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted")).coalesce(1)
    index = f"file://{tmp_path}/postings"
    postings.update_postings(texts, index, partitions=3)
    have = generations.read_manifest(spark, index)
    n = postings._all_grams(spark, index, have).count()
    assert n >= 3000 * 20 and generations.table_of(spark, index, have, "grams0").count() <= n / 500
    assert generations.table_of(spark, index, have, "counts").agg(F.sum("n")).first()[0] == n
    queries = spark.createDataFrame([(1, "SAME"), (2, "xt"), (3, "none")], "query_id int, query string")
    assert {(r.query_id, r["count"]) for r in postings.search_postings(spark, index, queries).groupBy("query_id").count().collect()} == {(1, 3000), (2, 3000)}


@pytest.mark.parametrize("hot", [40, 1 << 20])
def test_assets_of_types_with_several_parents_equal_walks(spark, monkeypatch, hot):
    """An asset with a third of all references, in batches of a few rows, counted by one task and (beyond HOT) dealt by type."""
    monkeypatch.setattr(intervals, "HOT", hot)
    draw = random.Random(12)
    edges = [(i, i // 3) for i in range(1, 300)] + [(i, i // 5) for i in range(1, 300) if i % 7 == 3]
    refs = [(draw.randrange(310), draw.choice([f"a{draw.randrange(60)}", f"b{draw.randrange(300)}", "hot"])) for _ in range(900)]
    up = {}
    for c, p in sorted(edges):
        up.setdefault(c, {c}).update(up.setdefault(p, {p}))
    for c, p in sorted(edges):
        up[c] |= up[p]
    want = {}
    for s, a in refs:
        for t in up.get(s, {s}):
            want.setdefault(t, set()).add(a)
    labels, extra = intervals.label(spark.createDataFrame(edges, "child_id long, parent_id long"))
    outer = intervals.intervals(labels, extra)
    key, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        got = {r.symbol_id: r.n_assets for r in intervals.usage_with_derived(spark.createDataFrame(refs, "symbol_id long, asset_path string"), labels, outer).collect()}
    finally:
        spark.conf.set(key, was)
    assert got == {t: len(a) for t, a in want.items()}


def test_types_and_assets_are_told_apart_in_tasks(monkeypatch):
    """Batches that cut an asset in two, tables of counts that are handed on before the end."""
    monkeypatch.setattr(intervals, "PAIRS", 20)
    draw = random.Random(4)
    rows_ = sorted((draw.randrange(50), [draw.randrange(30) for _ in range(draw.randint(0, 6))]) for _ in range(400))
    want = {}
    for a, ats in rows_:
        for t in ats:
            want.setdefault(t, set()).add(a)
    for size in (1, 9, 400):
        batches = (pa.record_batch({"asset_path": [f"a{a}" for a, _ in rows_[i : i + size]], "ats": pa.array([t for _, t in rows_[i : i + size]], pa.list_(pa.int32()))}) for i in range(0, 400, size))
        got = {}
        for b in intervals._distinct_counts(batches):
            for at, n in zip(b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True):
                got[at] = got.get(at, 0) + n
        assert got == {t: len(a) for t, a in want.items()}
    assert sum(b.num_rows for b in intervals._distinct_counts(iter([]))) == 0
