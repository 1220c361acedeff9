"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Two recurrent layers read the UTF-8 bytes of a window forwards and backwards; at every position their states give the
probabilities of the languages. A document's probabilities are the mean over all positions of all its windows (the
whole text is cut into windows of WINDOW bytes). Training is backpropagation through time on at most about SAMPLE
windows of labelled rows, drawn evenly over languages by a hash of the id; the windows stand at hashed places of the
whole text. Text and lang are all that is learned from, text is all that is predicted from.

Texts that are null or without a letter are `und` with score 0. Null labels are ignored. Without labelled rows all is
`und`. Ids may be null or repeated. Ties go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import held_out, slices, small_batches, table, text_bytes, text_of

HIDDEN, WINDOW = 10, 128
SAMPLE, TRAIN_WINDOW, STEPS, BATCH, RATE, SEED = 6_000, 48, 220, 192, 0.02, 5
ROWS = 2_048


@dataclass
class Network:
    """Per direction: rows of input per byte (update, reset, new), recurrent weights; then the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(x: np.ndarray, table_: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States at all positions of windows x (row per window), and what going back needs."""
    h = np.zeros((len(x), u.shape[0]), np.float32)
    k = u.shape[0]
    states, kept = np.empty((x.shape[1], *h.shape), np.float32), []
    for t in range(x.shape[1]):
        g, a = table_[x[:, t]], h @ u
        zr = _sigmoid(g[:, : 2 * k] + a[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(g[:, 2 * k :] + r * a[:, 2 * k :])
        kept.append((h, z, r, n, a[:, 2 * k :]))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(x: np.ndarray, d_states: np.ndarray, kept: list, table_: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input rows and the recurrent weights."""
    dt, du = np.zeros_like(table_), np.zeros_like(u)
    d = np.zeros_like(d_states[0])
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, n, a = kept[t]
        d = d + d_states[t]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * a * r * (1 - r)
        through = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ through
        np.add.at(dt, x[:, t], np.concatenate([dz, dr, dn], axis=1))
        d = d * z + through @ u.T
    return dt, du


def train(windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """windows: bytes, row per window, padded; sizes: bytes that count; labels: index of the language."""
    draw = np.random.default_rng(SEED)
    k, c = HIDDEN, len(languages)
    params = [draw.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (256, 3 * k)), (0.3, (256, 3 * k)), (0.3, (k, 3 * k)), (0.3, (k, 3 * k)), (0.3, (2 * k, c)), (0.0, (c,)))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_language = [np.flatnonzero(labels == i) for i in range(c)]
    at = np.arange(windows.shape[1])
    for step in range(STEPS):
        rows = np.concatenate([draw.choice(x, BATCH // c + 1) for x in by_language if len(x)])
        x, size, y = windows[rows], sizes[rows], labels[rows]
        real = at < size[:, None]
        back = np.where(real, size[:, None] - 1 - at, at)
        xb = np.take_along_axis(x, back, 1)
        f, kf = _forward(x, params[0], params[2])
        b, kb = _forward(xb, params[1], params[3])
        lanes = np.arange(len(rows))[:, None]
        both = np.concatenate([f.transpose(1, 0, 2), b[back, lanes]], axis=2)
        logits = both @ params[4] + params[5]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[np.arange(len(rows))[:, None], at, y[:, None]] -= 1
        p *= (real / max(1, real.sum()))[:, :, None]
        d_both = p @ params[4].T
        d_b = np.zeros_like(b)
        d_b[back, lanes] = d_both[:, :, k:]
        tf, uf = _backward(x, d_both[:, :, :k].transpose(1, 0, 2), kf, params[0], params[2])
        tb, ub = _backward(xb, d_b, kb, params[1], params[3])
        grads = [tf, tb, uf, ub, np.einsum("btk,btc->kc", both, p), p.sum(axis=(0, 1))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / STEPS))
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Network(languages, params[:2], params[2:4], params[4], params[5])


def _logits(x: np.ndarray, table_: np.ndarray, u: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Output of one direction at all positions (position, window, language); halved gates save work."""
    k = u.shape[0]
    half = np.concatenate([np.full(2 * k, 0.5), np.ones(k)]).astype(np.float32)
    table_, u = table_ * half, u * half
    h = np.zeros((x.shape[0], k), np.float32)
    got = np.empty((x.shape[1], x.shape[0], out.shape[1]), np.float32)
    steps = np.ascontiguousarray(x.T)
    for t in range(x.shape[1]):
        g = np.take(table_, steps[t], axis=0)
        a = h @ u
        g[:, : 2 * k] += a[:, : 2 * k]
        zr = np.tanh(g[:, : 2 * k])
        zr += 1
        zr *= 0.5
        a = a[:, 2 * k :] * zr[:, k:]
        a += g[:, 2 * k :]
        n = np.tanh(a)
        h -= n
        h *= zr[:, :k]
        h += n
        np.matmul(h, out, out=got[t])
    return got


def positions(net: Network, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probabilities at every position of the windows: (position, window, language); 0 beyond a window's size."""
    k = net.out.shape[0] // 2
    at = np.arange(x.shape[1])
    forward = _logits(x, net.tables[0], net.recurrent[0], net.out[:k])
    if (sizes == x.shape[1]).all():
        backward = _logits(np.ascontiguousarray(x[:, ::-1]), net.tables[1], net.recurrent[1], net.out[k:])[::-1]
        real = None
    else:
        real = at < sizes[:, None]
        back = np.where(real, sizes[:, None] - 1 - at, at)
        backward = _logits(np.take_along_axis(x, back, 1), net.tables[1], net.recurrent[1], net.out[k:])[back.T, np.arange(len(x))]
    forward += backward
    forward += net.bias
    forward -= forward.max(axis=2, keepdims=True)
    np.exp(forward, out=forward)
    forward /= forward.sum(axis=2, keepdims=True)
    return forward if real is None else forward * real.T[:, :, None]


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all bytes of every text (0 for empty texts)."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[owner] + within * WINDOW
    size = np.minimum(WINDOW, offsets[owner + 1] - starts)
    out = np.zeros((len(sizes), len(net.languages)))
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    for group in (np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)):
        for i in range(0, len(group), ROWS):
            w = group[i : i + ROWS]
            x = padded[starts[w][:, None] + np.arange(WINDOW)]
            np.add.at(out, owner[w], positions(net, x, size[w]).sum(axis=0, dtype=np.float64))
    return out / np.maximum(1, sizes)[:, None]


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Train on labelled rows that aren't held out. The driver gets about `sample` windows, and one count per language."""
    rows = docs.where(~held_out()).where("text is not null and lang is not null").select("doc_id", "lang", F.col("text").cast("binary").alias("b")).where(F.octet_length("b") > 0)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(sample / len(counts) / v))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    place = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.lit(1), F.octet_length("b") - TRAIN_WINDOW + 1))
    got = rows.where(drawn < F.element_at(share, F.col("lang"))).select("doc_id", "lang", F.substring(F.col("b"), (place + 1).cast("int"), F.lit(TRAIN_WINDOW)).alias("w")).limit(2 * sample).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    languages = sorted(set(got["lang"].to_pylist()))
    if not languages:
        return None
    raw = got["w"].to_pylist()
    windows = np.frombuffer(b"".join(w.ljust(TRAIN_WINDOW, b"\0") for w in raw), np.uint8).reshape(-1, TRAIN_WINDOW)
    labels = np.array([languages.index(x) for x in got["lang"].to_pylist()])
    return train(windows, np.array([len(w) for w in raw]), labels, languages)


def identified(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The input with `lang_pred` and `score`, the pooled probability of that language."""
    clean = docs.drop("lang_pred", "score")
    schema = clean.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    if net is None:
        return clean.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            told = pooled(shared.value, *text_bytes(b.column("_text")))
            best = told.argmax(axis=1)
            letters = b.column("_letters").to_numpy(zero_copy_only=False)
            names = [shared.value.languages[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
            score = np.where(letters, np.clip(told[np.arange(len(best)), best], 0, 1), 0.0)
            kept = [n for n in b.schema.names if n not in ("_text", "_letters")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return clean.withColumn("_text", text_of(text)).withColumn("_letters", F.col("_text").rlike(r"\p{L}")).mapInArrow(run, schema)


def op4_language_id(spark, sf_dir) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    net = learn(docs)
    return identified(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
