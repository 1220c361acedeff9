"""Alignment against whole texts encoded by both libraries and plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import alignment
from corvane.llm.bpe import pieces, vocabulary_path
from corvane.llm.queries import QUERIES
from tests.llm.cases import ROWS, documents, empty

A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes, b_bytes = pieces(A).to_pylist(), [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b.id_to_piece(i) for i in range(b.get_piece_size()))]
    grouped = []
    for text in texts:
        groups, whole = [], (" " + (text or "")).encode()
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(a_bytes[i] for i in x) == whole == b"".join(b_bytes[i] for i in y):
                i = j = p = q = 0
                left, right = [], []
                while i < len(x) or j < len(y):
                    if p <= q and i < len(x):
                        p += len(a_bytes[x[i]])
                        left.append(x[i])
                        i += 1
                    else:
                        q += len(b_bytes[y[j]])
                        right.append(y[j])
                        j += 1
                    if p == q and left and right:
                        groups.append((left, right))
                        left, right = [], []
        grouped.append(groups)
    held = Counter()
    for groups in grouped:
        held.update({(i, j) for x, y in groups for i in x for j in y})
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    out = []
    for groups in grouped:
        links = [(i, j) for x, y in groups for i in x for j in y]
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(held[k] == highest[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(told.encode()).hexdigest() if groups else "", told))
    return out


HARD = [(100 + i, t, "en", "a", 0) for i, t in enumerate([
    "a▁b", "▁", "plain text with ▁ in it", " ", "  ", " a", "a ", "a  b   c    d", "\n\n", "a\n b\n\n  c", "\t x\ty", "a  b c", "　 x 　", "x  y", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00\x01", "漢字かな交じり文 " * 20,
    "👩‍👩‍👧 family", "a" * 5000, "ab" * 3000 + " c", "ﬁne ½ ²", "é é", "�", "it's don't I'LL", "12345678901234567890", "....!!!???" * 30, "\r\n a\r\n", "same words here", "same words here", "\u0085 x\u0085 y", "मनीष कुमार", "\x7f x",
])]


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.mark.parametrize("settings", [{}, {"block": 100, "radix": 7, "fan": 2, "pairs": 40}, {"block": 3000, "fan": 3, "segment": 1}])
def test_sums_match_plain_counting(spark, settings):
    rows = ROWS + HARD
    docs = documents(spark, rows).withColumn("docs", F.lit("clash")).withColumn("run", F.lit(1)).repartition(3)
    want = sorted(str((r[0], *t[:7])) for r, t in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert rows_of(alignment.aligned(docs, A, B, **settings)) == want


def test_groups_match_whole_texts(spark):
    rows = ROWS + HARD
    got = alignment.alignments(documents(spark, rows).repartition(2), A, B, block=1000).collect()
    assert sorted(str((r.doc_id, r.groups)) for r in got) == sorted(str((r[0], t[7])) for r, t in zip(rows, brute([r[1] for r in rows]), strict=True))


def test_op13_matches_plain_counting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(str((d.doc_id, *t[:7])) for d, t in zip(docs, brute([d.text for d in docs]), strict=True))
    assert rows_of(QUERIES["op13_alignment"](spark, sf)) == want


def test_nothing_gives_nothing(spark):
    assert alignment.aligned(empty(spark), A, B).collect() == [] and alignment.alignments(empty(spark), A, B).collect() == []
    bare = alignment.aligned(documents(spark, [(1, None, None, None, None), (2, "▁", None, None, None)]), A, B)
    assert rows_of(bare) == [str((i, 0, 0, 0, 0, 0, 0, "")) for i in (1, 2)]


def test_merging_matches_counters():
    """Runs hold sums of pairs; packed columns come back as they were."""
    draw = np.random.default_rng(1)
    columns = [draw.integers(-5, 1 << 40, n) for n in (0, 1, 1000)]
    assert all((x == y).all() for x, y in zip(alignment._columns(alignment._squeezed(*columns)), columns, strict=True))
    runs = []
    for _ in range(9):
        codes = np.unique(draw.integers(0, 5000, 300))
        runs.append([codes, draw.integers(1, 9, len(codes))])
    want = Counter()
    for codes, counts in runs:
        want.update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    pairs, sums = alignment._summed(runs, 50)
    assert dict(zip(pairs.tolist(), sums.tolist(), strict=True)) == want and (np.diff(pairs) > 0).all()
    best = defaultdict(int)
    for code, n in want.items():
        best[code // 50] = max(best[code // 50], n)
    for above in (None, [sums, np.array([want[c] == best[c // 50] for c in pairs.tolist()]).astype(np.int64)]):
        for (codes, _), back in zip(runs, alignment._returned(runs, 50, above), strict=True):
            told = alignment._columns(back)
            assert told[0].tolist() == [want[c] for c in codes.tolist()] and told[1].tolist() == [want[c] == best[c // 50] for c in codes.tolist()]
