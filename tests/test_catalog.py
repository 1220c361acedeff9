import pytest

from corvane.plans.catalog import ORACLE_SQL, QUERIES
from tests.compare import oracle, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        same(got, oracle(ORACLE_SQL[name], sf))


def test_memory_steps_match_a_loop(spark, sf):
    from corvane.operators.logs import GIGABYTE
    from corvane.plans import standins

    got = {(r.session, r.ts_us) for r in QUERIES["memory_steps"](spark, sf).collect()}
    want = set()
    e = standins.events(spark, sf).selectExpr("user_id", "unix_micros(ts) t", f"cast(value * {GIGABYTE} / 10 as long) b").toPandas()
    for session, own in e.groupby("user_id"):
        last = None
        for r in own.sort_values(["t", "b"]).itertuples():
            if last is None or abs(r.b - last) >= GIGABYTE:
                want.add((session, r.t))
                last = r.b
    assert got == want


def test_wait_cycles_match_a_walk(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey a", "l_partkey % 100 b").where("a <> b").distinct().toPandas()
    out = {}
    for a, b in li.itertuples(index=False):
        out.setdefault(a, set()).add(b)
    want = {}
    for start in out:
        seen, now, n = set(), {start}, 0
        while now:
            n += 1
            now = {y for x in now for y in out.get(x, ())} - seen
            if start in now:
                want[start] = n
                break
            seen |= now
    assert {r.thread: r.cycle_length for r in QUERIES["wait_cycles"](spark, sf).collect()} == want


def test_whole_token_counts_read_every_document(spark, tmp_path):
    rows = [(1, "en", 'say "not these" but it\'s // gone\n#include x 12 y'), (2, "en", None), (3, "de", "äpfel ist 3x")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.lang: (r.n_documents, r.n_words) for r in QUERIES["whole_token_counts"](spark, f"file://{tmp_path}").collect()}
    assert got == {"en": (2, 6), "de": (1, 2)}


def test_whole_wait_cycles_match_a_walk(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey a", "l_partkey % 100 b").where("a <> b").distinct().toPandas()
    out = {}
    for a, b in li.itertuples(index=False):
        out.setdefault(a, set()).add(b)
    want = {}
    for start in out:
        seen, now, n = set(), {start}, 0
        while now:
            n += 1
            now = {y for x in now for y in out.get(x, ())} - seen
            if start in now:
                want[start] = n
                break
            seen |= now
    assert {r.thread: r.cycle_length for r in QUERIES["whole_wait_cycles"](spark, sf).collect()} == want
