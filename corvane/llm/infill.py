"""Fill-in-middle examples: a wavelet matrix over character classes finds both cuts.

The texts of a batch stand one after the other as UTF-8 bytes, and each byte has one of eight classes (what it is, and whether it
ends a word). A wavelet matrix of three levels answers how many bytes of a class lie before a place (rank). Units (lines, words,
sentences, code points) end at bytes of certain classes, so the ranks of those classes add up to the number of unit ends before a
place, and bisection on that sum finds the place where the k-th unit ends. Ranks of continuation bytes turn places in bytes into
numbers of code points. All documents of a batch are answered together; a document of any length is one row.

Where a document is cut and in which order its parts stand follows from a hash of seed and id, so reruns and retried tasks agree.

Null and empty texts are plain, with no units. Texts that hold a marker stay plain, so `restored` is exact. A null id hashes as an empty one. Repeated
rows give equal rows. Columns of the input other than id and text are left out, so none can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import _IS_SPACE, slices, small_batches, table, text_bytes, text_of, trimmed

#: Classes of bytes: inside of a word, or its last byte; continuation bytes of UTF-8 apart.
INNER, INNER_MORE, LAST, LAST_MORE, NEWLINE, BLANK, MARK = range(7)
LEVELS = 3
#: What a unit ends with. A unit takes all up to and including its end; what follows the last end is a unit too.
UNITS = {"line": (NEWLINE,), "word": (LAST, LAST_MORE, MARK), "sentence": (MARK,)}
MARKERS = ("<P>", "<S>", "<M>")


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte; rows end at offsets."""
    space = _IS_SPACE[data]
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    code = np.where(last, LAST, INNER).astype(np.uint8) + ((data & 0xC0) == 0x80)
    code[last & np.isin(data, np.frombuffer(b".!?", np.uint8))] = MARK
    code[space] = BLANK
    code[data == 10] = NEWLINE
    return code


class WaveletMatrix:
    """Rank of small codes: per level the codes' bit at every place, packed, with counts before each word of 64 bits."""

    def __init__(self, codes: np.ndarray, levels: int = LEVELS):
        self.levels = []
        for level in reversed(range(levels)):
            bits = (codes >> level) & 1
            packed = np.zeros(len(codes) // 64 + 1, np.uint64)
            packed.view(np.uint8)[: (len(codes) + 7) // 8] = np.packbits(bits, bitorder="little")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((level, packed, before, len(codes) - int(before[-1])))
            codes = np.concatenate([codes[bits == 0], codes[bits == 1]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many of the code lie before each place."""
        start = np.zeros(1, np.int64)
        for level, packed, before, zeros in self.levels:
            ones = [before[x >> 6] + np.bitwise_count(packed[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))) for x in (start, at)]
            if code >> level & 1:
                start, at = zeros + ones[0], zeros + ones[1]
            else:
                start, at = start - ones[0], at - ones[1]
        return at - start

    def count(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of any of the codes lie before each place."""
        return sum(self.rank(c, at) for c in codes)

    def locate(self, codes: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first places between low and high before which `wanted` of the codes lie, by bisection on the counts."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(codes, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def cuts(data: np.ndarray, offsets: np.ndarray, draw: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row its number of units, the places (bytes) of both cuts, and the code points of prefix and middle. draw: two numbers a row."""
    matrix = WaveletMatrix(classes(data, offsets))
    ends, first, last = UNITS[unit], offsets[:-1], offsets[1:]
    base = matrix.count(ends, first)
    full = matrix.count(ends, last) - base
    closed = matrix.count(ends, np.maximum(last - 1, first)) < base + full  # the last byte ends a unit
    n = full + ((last > first) & ~closed)
    drawn = np.sort(draw % (n + 1)[:, None], axis=1)
    places = [np.where(k > full, last, np.where(k > 0, matrix.locate(ends, base + k, first, last), first)) for k in drawn.T]
    more = [matrix.count((INNER_MORE, LAST_MORE), p) for p in (first, *places)]
    chars = [places[0] - first - (more[1] - more[0]), places[1] - places[0] - (more[2] - more[1])]
    return n, np.stack(places, axis=1), *chars


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, markers: tuple[str, str, str] = MARKERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text cut in three and put in the order of its form.

    n: units. form: plain (the text as it is), psm (prefix, suffix, middle) or spm, each part behind its marker. percent of the documents
    are transformed, spm_percent of these to spm. No marker's first character may occur in a marker again.
    """
    if any(len(m) < 2 or any(m[0] in x[1:] for x in markers) for m in markers) or len(set(markers)) < 3:
        raise ValueError("markers must differ, and their first characters may not occur within them")
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    t = text_of(text)
    held = F.lit(False)
    for m in markers:
        held |= F.contains(t, F.lit(m))
    form = F.when((t == "") | held | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            draw = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
            n, at, prefix, middle = cuts(data, offsets, draw, unit)
            forms, raw, out = batch.column("form").to_pylist(), memoryview(data), []
            for form, (a, b), start, end in zip(forms, at.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if form == "plain":
                    out.append(bytes(raw[start:end]))
                elif form == "psm":
                    out.append(b"".join((p, raw[start:a], s, raw[b:end], m, raw[a:b])))
                else:
                    out.append(b"".join((s, raw[b:end], p, raw[start:a], m, raw[a:b])))
            plain = np.array([f == "plain" for f in forms])
            columns = [batch.column("doc_id"), pa.array(n), batch.column("form"), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column = "output", form: str | Column = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "|".join(map(re.escape, markers)))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op11_fill_in_middle(spark, sf_dir) -> DataFrame:
    """Every document cut at lines, and the text that its output gives back."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS us, sha256('7:' || doc_id) AS h FROM documents
), c AS (
  SELECT doc_id, t, us, len(us) AS n, ('0x' || h[1:8])::BIGINT % (len(us) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(us) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, array_to_string(us[1:least(x, y)], '') AS pre, array_to_string(us[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(us[greatest(x, y) + 1:], '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
