"""The stages one by one on planted cases, and the whole run against brute force where it can be."""

import random
import re

import corpus_pipeline as pipeline
from corvane.llm import minhash, mixing, toxicity
from tests.llm.cases import ROWS, documents, empty
from tests.llm.test_operators import brute_components, brute_spans


def labels(spark, tmp_path, rows=()):
    spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_hard_rows_and_nothing_go_through_all_stages(spark, tmp_path):
    folder = labels(spark, tmp_path)
    for start in (documents(spark), empty(spark)):
        docs = start.withColumn("kept", start.doc_id).withColumn("size", start.doc_id)
        for i, (_, stage) in enumerate(pipeline.STAGES):
            path = f"{tmp_path}/{start.count()}-{i}"
            stage(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
            if i < len(pipeline.STAGES) - 1:
                assert docs.columns == pipeline.COLUMNS


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    draw = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(200)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :]), None, None, 0) for i in range(50, 80)] + [(i, " ".join(draw.choice(words) for _ in range(50)), None, None, 0) for i in range(200, 220)]
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, documents(spark, rows + ROWS), "").collect()}
    want = {least for _, least in brute_components(rows + ROWS, 5, minhash.PERCENT).values()} | {None}
    assert got == want


def test_repeated_passages_are_cut(spark):
    draw = random.Random(6)
    words = [f"wörd{i}" for i in range(900)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    fill = lambda: " ".join(draw.choice(words) for _ in range(30))
    rows = [(i, f"{fill()} {passage} {fill()}" if i < 5 else fill(), None, None, 0) for i in range(10)] + [(99, None, None, None, None)]
    got = {r.doc_id: r for r in pipeline.cut_repeats(spark, documents(spark, rows), "").collect()}
    assert len(got) == len(rows) and got[99].text is None
    for (i, text, *_), (_, spans, _) in zip(rows, brute_spans([r[1] for r in rows], pipeline.PASSAGE_BYTES), strict=True):
        if text is not None:
            assert bool(spans) == (i < 5) and (passage[5:-5] in text) == (i < 5) and passage[5:-5] not in got[i].text
            assert got[i].n_chars == len(got[i].text) and (spans or got[i].text == text)


def test_passages_count_by_words_however_short(spark):
    draw = random.Random(8)
    words = [f"wörd{i}" for i in range(900)]
    short = lambda n: " ".join(draw.choice("abcdefgé") for _ in range(n))
    fill = lambda: " ".join(draw.choice(words) for _ in range(30))
    long, least, under, ones, others = " ".join(draw.choice(words) for _ in range(50)), short(51), short(50), short(30), short(30)
    assert len(least.encode()) < 240 < len(long.encode())
    # the chain of two repeats of 30 words is a run of 60 repeated words, but no 51 of them are found elsewhere
    parts = [least, least, under, under, long, long, ones, others, f"{ones} {others}"]
    rows = [(i, f"{fill()} {p} {fill()}", None, None, 0) for i, p in enumerate(parts)]
    # within a document, and from its first word to its last
    rows += [(20, f"{(x := short(55))} {fill()} {x}", None, None, 0), (21, y := short(70), None, None, 0), (22, y, None, None, 0)]
    got = {r.doc_id: r for r in pipeline.cut_repeats(spark, documents(spark, rows), "").collect()}
    want = {i: text.replace(least, "") if i < 2 else text for i, text, *_ in rows} | {20: rows[9][1].replace(x, ""), 21: "", 22: ""}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def brute_passages(texts):
    """Texts without the windows of 51 words that occur more than once."""
    seen = {}
    for d, text in enumerate(texts):
        own = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
        for a, b in zip(own, own[50:], strict=False):
            seen.setdefault(text[a[0] : b[1]], []).append((d, a[0], b[1]))
    gone = [set() for _ in texts]
    for d, a, b in (p for x in seen.values() if len(x) > 1 for p in x):
        gone[d].update(range(a, b))
    return ["".join(c for i, c in enumerate(text) if i not in g) for text, g in zip(texts, gone, strict=True)]


def test_passages_match_a_count_of_all_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.where("text is not null").collect()
    got = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, docs, sf).collect() if r.text is not None}
    assert got == dict(zip([r.doc_id for r in rows], brute_passages([r.text for r in rows]), strict=True))


def test_toxic_documents_go_and_clean_ones_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, docs, sf).collect()}
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept == {r.doc_id for r in toxicity.scored(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}


def test_run_agrees_with_its_stages(spark, sf):
    ran = {}
    for r in pipeline.run(spark, sf).collect():
        ran.setdefault(r.doc_id, []).append((r.n_tokens, tuple(r.ids), r.n_chars))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    assert {k: len(x) for k, x in ran.items()} == {k: n for k, n in plan.items() if n}
    from tokenizers import Tokenizer

    from corvane.llm import bpe

    t = Tokenizer.from_file(bpe.vocabulary_path())
    text = {r.doc_id: r.text for r in docs.collect()}
    for k, rows in ran.items():
        ids = t.encode(text[k], add_special_tokens=False).ids
        assert all(x == (len(ids), tuple(ids), len(text[k])) for x in rows)


def test_stages_hand_small_batches_to_python(spark, tmp_path):
    key, folder = "spark.sql.execution.arrow.maxBytesPerBatch", labels(spark, tmp_path)
    before = spark.conf.get(key)
    try:
        for name, stage in pipeline.STAGES:
            spark.conf.set(key, str(64 << 20))
            stage(spark, documents(spark), folder)
            if name != "mixing":  # no Python there
                assert int(spark.conf.get(key).rstrip("b")) <= 1 << 20, name
    finally:
        spark.conf.set(key, before)
