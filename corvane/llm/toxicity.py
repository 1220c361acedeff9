"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words (letters and digits, lower case) and their first 4 and 5 characters, hashed into DIM
buckets; each counts once a text. The score is the logistic of bias + sum of weights + sum over pairs of terms of the inner
product of their factors, so a pair can say what neither term says alone (an insult beside the mention of a group).
The model is fitted on at most SAMPLE labelled rows, the ones with the smallest hash of their id. Of the buckets that at least LEAST rows of
the sample have, it takes those that tell of the label alone (chi-square of TELLING) and those that tell of it in pairs: of the PAIRED
most frequent buckets, a and b count if among the rows with a the ones with b differ in their labels, and among the rows with b
those with a (chi-square of TELLING_PAIR each), whatever either says alone. So the model has a bounded size whatever the corpus, and it is sent to all tasks.

Null and empty texts have no terms and get the bias alone. Labels that are null are ignored; an id with several labels or texts
counts with each. Without labels of both kinds the score is the same for all rows. Ids may be null or repeated.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import binary_array, give_back, held_out, slices, small_batches, table, text_bytes, text_of, trimmed, word_spans

DIM = 1 << 22
SAMPLE, LEAST = 16_384, 4
#: Terms count whose chi-square with the label reaches this in the sample; or, in pairs of the PAIRED most frequent, within each other's rows.
TELLING, TELLING_PAIR, PAIRED = 12.0, 25.0, 2_048
PREFIXES = (4, 5)
FACTORS, EPOCHS, BATCH, RATE, L1, L2, SEED = 4, 15, 256, 0.15, 1e-4, 1e-3, 7
THRESHOLD = 0.3
_PART = re.compile(r"[^\W_]+").findall


def word_terms(word: str) -> set[int]:
    """The hashed terms of one word."""
    out = set()
    for part in _PART(word.lower()):
        out.add(xxhash.xxh3_64_intdigest(f"w:{part}") % DIM)
        out.update(xxhash.xxh3_64_intdigest(f"{n}:{part[:n]}") % DIM for n in PREFIXES if len(part) >= n)
    return out


def text_terms(column: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of every text, one after the other, and the offsets of the texts. known: sorted terms; then only
    these count, and their places in it are given."""
    data, offsets = text_bytes(column)
    starts, ends, before = word_spans(data, offsets)
    rows = len(column)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    coded = binary_array(data, starts, ends).dictionary_encode()
    distinct = len(coded.dictionary)
    sizes, held = np.zeros(distinct, np.int64), array("i")
    for i, word in enumerate(coded.dictionary):
        own = word_terms(word.as_py().decode("utf-8", "replace"))
        sizes[i] = len(own)
        held.extend(own)
    terms = np.frombuffer(held, np.int32).astype(np.int64)
    width = DIM
    if known is not None:
        width = max(1, len(known))
        at = np.searchsorted(known, terms)
        found = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == terms) if len(known) else np.zeros(len(terms), bool)
        owner = np.repeat(np.arange(distinct), sizes)[found]
        terms, sizes = at[found], np.bincount(owner, minlength=distinct)
    first = np.concatenate([[0], np.cumsum(sizes)])
    codes = coded.indices.to_numpy().astype(np.int64)
    keep = sizes[codes] > 0
    row = np.repeat(np.arange(rows), np.diff(before))[keep]
    pairs = np.unique(row * distinct + codes[keep])
    row, code = pairs // distinct, pairs % distinct
    n = sizes[code]
    place = np.repeat(first[code] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
    both = np.unique(np.repeat(row, n) * width + terms[place])
    return both % width, np.searchsorted(both, np.arange(rows + 1) * width)


@dataclass
class FactorizationMachine:
    """terms: sorted buckets; weights and factors have one more entry, the last, for the bias that every text has."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        index, starts = _with_bias(places, offsets, len(self.terms))
        v = self.factors[index]
        s = np.add.reduceat(v, starts, axis=0)
        linear = np.add.reduceat(self.weights[index], starts)
        return (linear + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), starts))) if rows else np.zeros(0)


def _with_bias(places: np.ndarray, offsets: np.ndarray, bias: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's places with the bias before them, and where rows start: no row is empty then."""
    rows = len(offsets) - 1
    starts = offsets[:-1] + np.arange(rows)
    index = np.full(len(places) + rows, bias, np.int64)
    rest = np.ones(len(index), bool)
    rest[starts] = False
    index[rest] = places
    return index, starts


def _known(row: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The places in terms (sorted) of those of a row's terms that are in it."""
    if not len(terms):
        return row[:0]
    at = np.searchsorted(terms, row)
    return at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == row)]


def telling_in_pairs(flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Which of the terms tell of the label in some pair. Two tables of len(terms) squared are held; rows are counted, and the tables read, in blocks."""
    n = len(terms)
    both, hits = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for at in range(0, len(labels), 512):
        block = np.zeros((min(512, len(labels) - at), n), np.float32)
        for i in range(len(block)):
            block[i, _known(flat[offsets[at + i] : offsets[at + i + 1]], terms)] = 1
        toxic = block[labels[at : at + 512] > 0]
        for a in range(0, n, 256):
            both[a : a + 256] += block[:, a : a + 256].T @ block
            hits[a : a + 256] += toxic[:, a : a + 256].T @ toxic
    tells = np.zeros((n, n), bool)
    for a in range(0, n, 256):
        own = both[a : a + 256]
        rows = np.maximum(np.diag(both)[a : a + 256], 1)[:, None]
        rate = np.diag(hits)[a : a + 256, None] / rows  # among the rows with the first of the pair
        spread = own * rate * (1 - rate) * (1 - own / rows)
        tells[a : a + 256] = ((hits[a : a + 256] - own * rate) ** 2 >= TELLING_PAIR * spread) & (spread > 0)
    return (tells & tells.T).any(axis=1)


def fit(flat: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> FactorizationMachine:
    """Adaptive gradient steps on the logistic loss, weights drawn to zero by L1 and factors by L2.

    flat, offsets: the terms of all rows, one row after the other. Terms are counted in pieces, so nothing as long as flat is made beside it.
    """
    size = len(labels)
    prior = min(max(labels.mean(), 1e-9), 1 - 1e-9) if size else 0.5
    counts, hits = np.zeros(DIM, np.int32), np.zeros(DIM, np.int32)
    for a in range(0, size, 512):
        b = min(size, a + 512)
        part, own = flat[offsets[a] : offsets[b]], np.repeat(labels[a:b] > 0, np.diff(offsets[a : b + 1]))
        np.add.at(counts, part, 1)
        np.add.at(hits, part[own], 1)
    terms = np.flatnonzero(counts >= LEAST)
    seen, hit = counts[terms].astype(float), hits[terms]
    alone = terms[(hit - seen * prior) ** 2 >= TELLING * seen * prior * (1 - prior)]
    frequent = np.sort(terms[np.lexsort((terms, -seen))[:PAIRED]])
    del counts, hits, seen, hit
    terms = np.union1d(alone, frequent[telling_in_pairs(flat, offsets, labels, frequent)])
    n = len(terms)
    draw = np.random.default_rng(SEED)
    model = FactorizationMachine(terms, np.zeros(n + 1), draw.normal(0, 0.01, (n + 1, FACTORS)))
    model.factors[n] = 0
    positive = labels.sum()
    model.weights[n] = np.log((positive + 1) / (len(labels) - positive + 1))
    if positive in (0, len(labels)):
        return model
    small = np.min_scalar_type(n)
    own = [_known(flat[offsets[i] : offsets[i + 1]], terms).astype(small) for i in range(size)]
    gw, gv = np.full(n + 1, 1e-6), np.full((n + 1, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = draw.permutation(size)
        for b in range(0, len(order), BATCH):
            part = order[b : b + BATCH]
            sizes = np.array([len(own[i]) for i in part])
            index, starts = _with_bias(np.concatenate([own[i] for i in part]), np.concatenate([[0], np.cumsum(sizes)]), n)
            v = model.factors[index]
            s = np.add.reduceat(v, starts, axis=0)
            y = np.add.reduceat(model.weights[index], starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), starts))
            error = np.repeat((1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) / len(part), sizes + 1)
            seen, inverse = np.unique(index, return_inverse=True)
            dw = np.bincount(inverse, error, len(seen))
            inner = error[:, None] * (np.repeat(s, sizes + 1, axis=0) - v)
            dv = np.stack([np.bincount(inverse, inner[:, k], len(seen)) for k in range(FACTORS)], axis=1) + L2 * model.factors[seen]
            dv[seen == n] = 0  # the bias takes part in no pair
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            step = RATE / np.sqrt(gw[seen])
            w = model.weights[seen] - step * dw
            model.weights[seen] = np.where(seen == n, w, np.sign(w) * np.maximum(np.abs(w) - step * L1, 0))
            model.factors[seen] -= 0.3 * RATE / np.sqrt(gv[seen]) * dv
    return model


def in_order(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, offsets and labels of all rows of (doc_id, toxic, terms), by doc_id. The batches are taken off the list one by
    one and let go, so the terms are held once."""
    ids, labels = (np.concatenate([b.column(c).to_numpy() for b in batches] or [np.zeros(0, np.int64)]) for c in ("doc_id", "toxic"))
    sizes = np.concatenate([pc.list_value_length(b.column("terms")).to_numpy().astype(np.int64) for b in batches] or [np.zeros(0, np.int64)])
    order = np.argsort(ids, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(sizes[order])])
    place = np.empty(len(ids), np.int64)
    place[order] = offsets[:-1]
    flat = np.empty(offsets[-1], np.int32)
    row = len(ids)
    while batches:
        lists = batches.pop().column("terms")
        row -= len(lists)
        held, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, at in enumerate(place[row : row + len(lists)].tolist()):
            flat[at : at + ends[i + 1] - ends[i]] = held[ends[i] : ends[i + 1]]
        del lists, held, ends
        give_back()
    return flat, offsets, labels[order].astype(float)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on labelled rows that aren't held out. The driver gets the hashed terms of at most `sample` labelled ids."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            terms, offsets = text_terms(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(terms.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), lists], ["doc_id", "toxic", "terms"])

    model = fit(*in_order(both.mapInArrow(trimmed(run), "doc_id long, toxic int, terms array<int>").toArrow().to_batches()))
    give_back()  # the driver's Python stays as small as before
    return model


def scored(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "score") -> DataFrame:
    """The input with the score of each whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the terms of SAMPLE rows
    clean = docs.drop(out).withColumn("_text", text_of(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "_text"):
            y = m.margins(*text_terms(b.column("_text"), m.terms))
            kept = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(1 / (1 + np.exp(-np.clip(y, -500, 500))))], [*kept, out])

    return clean.mapInArrow(trimmed(run), docs.drop(out).withColumn(out, F.lit(0.0)).schema)


def op10_toxicity(spark, sf_dir) -> DataFrame:
    """The score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
