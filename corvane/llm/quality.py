"""Quality rules, line first: lines that fail are taken out, then documents that lose too much of their text are rejected.

A line fails if it is long and ends without punctuation, if it is mostly signs, if it is navigation (short items between separators, or
nothing but words of menus), or if it is boilerplate (notices of sites and licences). Lines without a word are neither
counted nor removed. A document is kept if it passes the base rules (enough words, few of them in repeated windows) and its failed lines hold no more than
MOST_LOST percent of its word characters.

A task works on the lines and words of a batch at once, whole texts however long; repeats are found by exact numbers of lines and
of windows within a text, not by hashes. There is no shuffle: every rule is about one document.

Null and empty texts have no words and fail the base rules; their cleaned text is empty. Repeated rows give equal rows. Columns of the input other than id and text are left
out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import _IS_SPACE, binary_array, slices, small_batches, table, text_bytes, text_of, trimmed, word_spans

#: Base rules: fewest words, and most words in repeated windows (percent), of so many words each.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: A document may lose so many percent of its word characters with its failed lines.
MOST_LOST = 50
#: A line of more words than this ends in punctuation.
LONG_LINE = 8
SYMBOLS = "#*$%&|<>"
# What lines are told by, as patterns that RE2 reads.
ENDS = r"""[.!?…。！？:;"”»’')\]]\s*$"""
NAVIGATION = r"(?i)^\s*[\w ]{1,24}(\s*[|»›>•·/]\s*[\w ]{1,24}){2,}\s*$|^\s*((home|menu|search|login|log in|sign in|sign up|register|next|previous|back|share|print|contact|about|help|faq|sitemap|top)\s*){2,}$"
BOILERPLATE = r"(?i)all rights reserved|cookie (policy|settings|notice)|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|subscribe to our newsletter|licensed under the|\bcopyright (\(c\)|©|\d{4})"


def _spans_of_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line that has a byte (without its line end), and the row of each."""
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[:-1]] = True
    cut[np.flatnonzero(data == 10) + 1] = True
    starts = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = ends - (data[ends - 1] == 10)
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number per pair of numbers, equal for equal pairs only."""
    if not len(first):
        return np.zeros(0, np.int64)
    return np.unique(first.astype(np.int64) * (int(second.max()) + 1) + second, return_inverse=True)[1]


def repeated_words(codes: np.ndarray, before: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per row, the words that lie in a window that its text has twice or more. codes: number of every word; before: words before each row."""
    rows = np.repeat(np.arange(len(before) - 1), np.diff(before))
    n = len(codes) - window + 1
    out = np.zeros(len(before) - 1, np.int64)
    if n < 1:
        return out
    ids = codes[:n].astype(np.int64)
    for j in range(1, window):
        ids = _numbered(ids, codes[j : j + n])
    inside = rows[:n] == rows[window - 1 :]
    at = np.flatnonzero(inside)
    _, number, count = np.unique(_numbered(ids[at], rows[at]), return_inverse=True, return_counts=True)
    hit = at[count[number] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    np.add.at(out, rows[covered], 1)
    return out


def failing(lines: pa.Array, words: np.ndarray, word_bytes: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Which lines fail a rule. words, word_bytes, signs: per line its words, their bytes, and signs among these."""
    text = lines.cast(pa.string())
    match = lambda p: pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False)
    return ((words > LONG_LINE) & ~match(ENDS)) | (3 * signs > word_bytes) | match(NAVIGATION) | match(BOILERPLATE)


def _sums(mark: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks lie in each span."""
    before = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return before[ends] - before[starts]


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines, lost_chars, kept, cleaned) of every row.

    n_lines and n_failed_lines count lines with a word, lost_chars is the word characters of those that failed, and cleaned is the text without them.
    """
    small_batches(docs.sparkSession)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            rows = len(offsets) - 1
            starts, ends, before = word_spans(data, offsets)
            char = ((data & 0xC0) != 0x80) & ~_IS_SPACE[data]
            own = lambda mark: _sums(mark, offsets[:-1], offsets[1:])
            codes = binary_array(data, starts, ends).dictionary_encode().indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
            at, to, row = _spans_of_lines(data, offsets)
            words = np.searchsorted(starts, to) - np.searchsorted(starts, at)
            at, to, row, words = (x[words > 0] for x in (at, to, row, words))
            per_row = lambda x: np.bincount(row, x, rows).astype(np.int64)
            repeats, lost, failed = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(len(at), bool)
            if len(at):
                lines = binary_array(data, at, to)
                ids = _numbered(lines.dictionary_encode().indices.to_numpy(), row)
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                failed = failing(lines, words, _sums(~_IS_SPACE[data], at, to), _sums(symbol[data], at, to))
                repeats, lost = per_row(~first), per_row(np.where(failed, _sums(char, at, to), 0))
            gone = np.zeros(len(data) + 1, np.int8)
            gone[at[failed]] += 1
            gone[np.minimum(to[failed] + 1, offsets[row[failed] + 1])] -= 1  # with its line end
            stay = np.cumsum(gone[:-1], dtype=np.int8) == 0
            kept_ends = np.concatenate([[0], np.cumsum(stay)])[offsets]
            values = [np.diff(before), own(char), own(symbol[data]), repeats, repeated_words(codes, before), per_row(np.ones(len(at))), per_row(failed), lost]
            cleaned = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(kept_ends.astype(np.int32)), pa.py_buffer(data[stay])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, values), cleaned], ["doc_id", *counts, "cleaned"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    told = rows.mapInArrow(trimmed(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", cleaned string")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars"))
    return told.select("doc_id", *counts[:5], failed.alias("base_failed"), *counts[5:], kept.alias("kept"), "cleaned")


def op12_quality_rules(spark, sf_dir) -> DataFrame:
    """The rules' counts and verdict on every document."""
    return quality(table(spark, sf_dir, "documents")).drop("cleaned")


OP12_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(list_zip(ws, ws[2:], ws[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3])[:len(ws) - 2]) AS three FROM w WHERE len(ws) >= 3
), k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM g
), r AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM k, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id
), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w
), f AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS packed FROM l
), v AS (
  SELECT doc_id, line, length(packed) AS chars,
    (nw > {LONG_LINE} AND NOT regexp_matches(line, '{ENDS.replace("'", "''")}')) OR 3 * (length(packed) - length(regexp_replace(packed, '[{SYMBOLS}]', '', 'g'))) > strlen(packed)
    OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{BOILERPLATE}') AS failed FROM f WHERE nw > 0
), s AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, count(*)::BIGINT AS n_lines, (count(*) FILTER (failed))::BIGINT AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS lost_chars FROM v GROUP BY doc_id
), a AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
), b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_lines, lost_chars, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM b
"""
