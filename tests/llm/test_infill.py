"""Fill-in-middle against plain cutting of strings."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import infill
from tests.llm.cases import ROWS, documents, empty

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+$", "sentence": r"(?s).*?[.!?](?=[ \t\n\v\f\r]|\Z)|.+\Z"}


def plain(doc_id, text, unit="line", seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(m in text for m in infill.MARKERS) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def many(n=150):
    draw = random.Random(4)
    said = ["ab", "é漢😀", "\n", " ", ".", "x!", "\n\n", "\t", "\r\n", "<", ">", "P>", "<S", "。", "a.b ", "\x0b", "ß?"]
    return [(100 + i, "".join(draw.choices(said, k=draw.randrange(60))), "en", "a", 0) for i in range(n)] + [(90, "a<P>b\nc", "en", "a", 0), (91, "<M>", "en", "a", 0), (92, "no end", "en", "a", 0), (93, "line\n" * 5_000 + "é" * 5_000, "en", "a", 0)]


@pytest.mark.parametrize("unit", sorted(infill.UNITS))
@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 0)])
def test_parts_match_plain_cutting(spark, unit, percent, spm):
    rows = ROWS + many()
    docs = documents(spark, rows).withColumn("output", F.lit("clash")).withColumn("form", F.lit(1))
    got = infill.fill_in_middle(docs, unit=unit, percent=percent, spm_percent=spm).withColumn("back", infill.restored())
    out = got.collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out))) == sorted(str((r[0], *plain(r[0], r[1], unit, percent=percent, spm=spm))) for r in rows)
    assert sorted(str((r.doc_id, r.back)) for r in out) == sorted(str((r[0], r[1] or "")) for r in rows)
    assert {r.form for r in out} == ({"plain", "psm"} if spm == 0 else {"plain", "psm", "spm"})


def test_nothing_and_other_markers(spark):
    assert infill.fill_in_middle(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(documents(spark), markers=("<<", "<S>", "<M>"))
    other = ("[pre|", "{suf.", "(mid*")
    got = infill.fill_in_middle(documents(spark, many()), markers=other).withColumn("back", infill.restored(markers=other)).collect()
    assert sorted((r.doc_id, r.back) for r in got) == sorted((r[0], r[1]) for r in many())


def test_ids_of_any_type(spark):
    got = infill.fill_in_middle(documents(spark, ROWS[:2]).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))).collect()
    assert {r.doc_id for r in got} == {"k1", "k2"}


def test_ranks_and_places_match_counts():
    draw = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        codes = draw.integers(0, 8, n).astype(np.uint8)
        matrix, at = infill.WaveletMatrix(codes), np.arange(n + 1)
        for c in range(8):
            assert (matrix.rank(c, at) == np.concatenate([[0], np.cumsum(codes == c)])).all()
        some = np.isin(codes, (1, 6))
        wanted = np.arange(1, some.sum() + 1)
        assert (matrix.locate((1, 6), wanted, np.zeros(len(wanted), np.int64), np.full(len(wanted), n)) == np.flatnonzero(some) + 1).all()
