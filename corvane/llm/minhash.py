"""Near duplicates: universal hash minima in bands, verification, connected components.

1. A pass over the texts makes each document's set of word shingles and keeps its size, a 128-bit digest of the set
   and, of 512 minima of universal hashes over the set, the low bytes (the signature) and the band keys.
2. Documents with equal sets form a class; its smallest id stands for it. Only classes go on.
3. 32 bands of the first 128 minima, 4 each, give bucket keys. Sets of similarity 0.8 meet in some bucket but for one in 10 million pairs.
4. In each bucket every class is paired with the smallest one (a star, so a bucket of n classes gives n - 1 pairs). Pairs
   whose sizes or signatures rule out the threshold go; the rest are confirmed on the full sets, made from the texts.
5. Confirmed links are merged by large-star and small-star. Buckets that still hold several components have their members
   of different components compared by signature, each pair in the first band that they share, and what those find is
   confirmed and merged too. So a link that isn't to a bucket's smallest class is found as well.
6. Buckets of over DIRECT classes of several components (texts with much in common, but less than the threshold) are not compared
   in pairs, so a class has a bounded number of direct pairs. Their classes are dealt anew by their rarest shingles. Of two sets of similarity t or more, with |A| <= |B|,
   the common part has 2t / (1 + t) |A| elements at least, so one of the |A| - 2t / (1 + t) |A| + 1 rarest of A is among the |B| - t |B| + 1 rarest of B: this loses no link.
   What a family has in common is rare for none of its members, and texts that keep too little of their own rare part for the threshold never meet. Nor are texts compared whose rarest shared shingle stands so late in
   both that what comes behind it is too little for the threshold.

The first confirmation takes the best pair of each class only; the other pairs count only while they join components.

Null and empty texts have empty sets and no links. With fewer words than a shingle takes, all words form one. Rows that share
an id are one node, linked by each of their texts: all classes of an id are one component, and its empty rows belong to it.
A null id can't be linked: its component is null and the row is kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, binary_array, lower_ascii, maybe_among, saved, scratch, slices, small_batches, table, text_bytes, text_of, trimmed, word_spans
from corvane.llm.components import components

BANDS, ROWS, MINIMA, SEED = 32, 4, 512, 20240917
#: Similarity in hundredths. SLACK: how far below it a signature's estimate may be (four and a half standard deviations).
PERCENT, SLACK = 80, 0.08
#: Members of a bucket up to which all are compared with each other; members of a rare shingle that one task compares with as many others.
DIRECT, BLOCK = 32, 2_000
_CHUNK = 1 << 16


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one after the other, and the offsets of the texts."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets)
    rows = len(column)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    coded = binary_array(data, starts, ends).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = own[coded.indices.to_numpy()]
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled[: n - j if j else n] = rolled[: n - j if j else n] * factor + hashes[j:]
    rolled = _mix(rolled)
    parts, sizes = [], np.zeros(rows, np.int64)
    for i in range(rows):
        a, b = before[i], before[i + 1]
        if b - a >= words:
            one = np.unique(rolled[a : b - words + 1])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = h * factor + x
            one = _mix(np.array([h]))
        else:
            continue
        parts.append(one)
        sizes[i] = len(one)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def minima(hashes: np.ndarray, offsets: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """The n minima of each text with a set, under a x + b modulo 2^32 (rows follow the texts; empty sets have the largest value)."""
    a, b = _coefficients(n)
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(offsets[full], offsets[full[at]] + _CHUNK)))
        rows = full[at:to]
        x = (hashes[offsets[rows[0]] : offsets[rows[-1] + 1]] >> np.uint64(32)).astype(np.uint32)
        starts = offsets[rows] - offsets[rows[0]]
        for k in range(n):
            out[rows, k] = np.minimum.reduceat(x * a[k] + b[k], starts)
        at = to
    return out


def band_keys(minima_: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row of minima."""
    keys = np.zeros((len(minima_), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            h = np.full(len(minima_), band + 1, np.uint64)
            for r in range(ROWS):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + minima_[:, band * ROWS + r])
            keys[:, band] = h
    return keys


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Equally long binary values as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def estimate(same: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal signature bytes; one byte in 256 is equal by chance."""
    return (same - 1 / 256) / (1 - 1 / 256)


def sketches(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, signature) of every row; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, offsets = shingle_hashes(batch.column("text"), words)
            sizes = np.diff(offsets)
            least = minima(hashes, offsets)
            keys, signatures = band_keys(least), (least & 0xFF).astype(np.uint8)
            sets = [xxhash.xxh3_128_digest(hashes[i:j].tobytes()) if j > i else None for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            banded, signed = ([x[i].tobytes() if n else None for i, n in enumerate(sizes)] for x in (keys, signatures))
            columns = [batch.column("doc_id"), pa.array(sizes), *(pa.array(x, pa.binary()) for x in (sets, banded, signed))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "bands", "signature"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, set_id binary, bands binary, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, node) for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = matrix(batch.column("bands"), np.int64, BANDS)
                nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "bands").mapInArrow(trimmed(run), "key long, node long")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, estimate): the pairs whose signatures agree in at least that share of their minima."""
    c = classes.select("node", "n_shingles", "signature")
    p = pairs.join(c.toDF("b", "nb", "sb"), "b").join(c.toDF("a", "na", "sa"), "a")
    p = p.where(F.least("na", "nb") >= F.greatest("na", "nb") * (least + SLACK - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (matrix(batch.column(s), np.uint8, MINIMA) for s in ("sa", "sb"))
                same = estimate((x == y).mean(axis=1))
                keep = np.flatnonzero(same >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(same[keep])], ["a", "b", "estimate"])

    return p.select("a", "b", "sa", "sb").mapInArrow(trimmed(run), "a long, b long, estimate double")


_FIND = re.compile(WORD).findall
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text: str, words: int) -> set[str]:
    """The full set of a text's shingles, as strings."""
    found = _FIND(text.translate(_FOLD))
    if len(found) < words:
        return {" ".join(found)} if found else set()
    return {" ".join(found[i : i + words]) for i in range(len(found) - words + 1)}


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                if last is None or not ta.as_buffer().equals(last):
                    last, mine = ta.as_buffer(), shingle_set(ta.as_py(), words)
                other = shingle_set(tb.as_py(), words)
                both = len(mine & other)
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["u", "v"])

    t = pairs.select("a", "b").join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return t.select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "u long, v long")


def _components_of(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (key, node) with the component of each."""
    return members.join(labels.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _mixed(own: DataFrame) -> DataFrame:
    """(key, n) of the buckets that hold several components and, where members may be indexed, one that is."""
    told = own.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), *([F.max("indexed").alias("indexed")] if "indexed" in own.columns else []))
    return told.where("lo < hi").where("indexed" if "indexed" in own.columns else "true").select("key", "n")


def _first_shared(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], percent: int) -> int | None:
    """The smallest key of both that one is indexed by, if what they may have in common from their rarest shared one on can reach the threshold.

    a, b: sorted keys, whether they are indexed, how many shingles come behind each in the order of rarity, and the least size of the sets.
    """
    keys, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    most, sizes = 1 + np.minimum(a[2][i], b[2][j]), a[3][i] + b[3][j]
    hit = np.flatnonzero(a[1][i] | b[1][j])
    return int(keys[hit[0]]) if len(hit) and ((100 + percent) * most >= percent * sizes).any() else None


def _across(own: DataFrame, mixed: DataFrame, classes: DataFrame, least: float, banded: bool) -> DataFrame:
    """(a, b): pairs of different components that share a bucket and whose signatures allow a link.

    A bucket of over BLOCK members is cut into blocks; each pair of blocks is one group, so groups are bounded
    and a pair is given only if its signatures agree. banded: keys are bands, and a pair belongs to the first that it shares; else it belongs to the smallest
    key that both have and one is indexed by.
    """
    sized = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = own.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    rows = rows.join(classes.select("node", "n_shingles", "bands", "signature"), "node")
    if not banded:  # the keys of a node, which are as many as its text has rare shingles
        rows = rows.join(own.join(mixed.select("key"), "key", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "indexed", "rest", "size"))).alias("keys")), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    percent = round(100 * (least + SLACK))

    def run(t: pa.Table) -> pa.Table:
        node, part, size, block = (t[c].to_numpy() for c in ("node", "component", "n_shingles", "block"))
        signed, keys = matrix(t["signature"], np.uint8, MINIMA), matrix(t["bands"], np.int64, BANDS)
        i, j, key = t["i"][0].as_py(), t["j"][0].as_py(), t["key"][0].as_py()
        band = int((keys[0] == key).argmax()) if banded else 0
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        indexed = None if banded else t["indexed"].to_numpy()
        told = {} if banded else {x: tuple(np.array([k[c] for k in v]) for c in ("key", "indexed", "rest", "size")) for x, v in zip(node.tolist(), t["keys"].to_pylist(), strict=True)}
        first = lambda x, y: _first_shared(told[x], told[y], percent) == key
        a, b = [], []
        for x in left:
            others = right if banded or indexed[x] else right[indexed[right]]
            y = others[(part[others] != part[x]) & (np.minimum(size[others], size[x]) >= (least + SLACK - 1e-9) * np.maximum(size[others], size[x]))]
            if i == j:
                y = y[node[y] > node[x]]
            if len(y) and band:
                y = y[~(keys[y, :band] == keys[x, :band]).any(axis=1)]  # an earlier bucket has this pair
            if len(y):
                y = y[estimate((signed[y] == signed[x]).mean(axis=1)) >= least]
                if not banded:
                    y = y[[first(int(node[x]), int(node[z])) for z in y]] if len(y) else y
                a += [node[x]] * len(y)
                b += node[y].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = rows.select("key", "i", "j", "block", "node", "component", "n_shingles", "bands", "signature", *([] if banded else ["indexed", "keys"])).groupBy("key", "i", "j").applyInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rare_shingles(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, node, indexed, rest, size) for the rarest shingles of every text: rest of them are more frequent, size is that of the set. texts: node, text.

    As many as any smaller set of that similarity must share one of; indexed are those that any larger one must share one of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, offsets = shingle_hashes(batch.column("text"), words)
            sizes = np.diff(offsets)
            nodes = batch.column("node").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            own = np.array([xxhash.xxh3_64_intdigest(t.as_buffer()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([nodes, pa.array(np.repeat(own, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(hashes.view(np.int64))], ["node", "own", "size", "key"])

    shingles = texts.select("node", "text").mapInArrow(trimmed(run), "node long, own long, size long, key long")
    spread = shingles.join(shingles.groupBy("key").agg(F.count("*").alias("n")), "key")
    rarest = Window.partitionBy("node", "own").orderBy("n", "key")
    # whole numbers: a quotient in floating point could round a length down
    upto = lambda share, of: F.expr(f"size - (size * {share} + {of - 1}) div {of} + 1")
    ranked = spread.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= upto(percent, 100))
    return ranked.withColumn("indexed", F.col("rank") <= upto(2 * percent, 100 + percent)).groupBy("key", "node").agg(F.max("indexed").alias("indexed"), F.max(F.col("size") - F.col("rank")).alias("rest"), F.min("size").alias("size"))


def _texts_of(docs: DataFrame, ids: DataFrame, save) -> DataFrame:
    """(doc_id, text): the different texts of the given ids (doc_id)."""
    ids = save(ids.distinct(), "ids")
    own = maybe_among(docs, ids, "doc_id").join(ids, "doc_id", "left_semi")
    return save(own.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.max("text").alias("text")).select("doc_id", "text"), "texts")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs: its component's smallest id, and whether it is that."""
    small_batches(docs.sparkSession)
    least = percent / 100 - SLACK
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    with scratch(docs.sparkSession) as save:
        sketch = save(sketches(docs, words), "sketches")
        linked = sketch.where("doc_id is not null and set_id is not null")
        classes = save(linked.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
        buckets = _buckets(classes)
        centres = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
        members = save(buckets.join(centres, "key"), "buckets")
        stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        stars = save(_estimated(stars, classes, least), "stars")
        members = members.select("key", "node")

        best = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
        texts = _texts_of(docs, stars.select(F.col("a").alias("doc_id")).union(stars.select("b")), save)
        links = save(_confirmed(best, texts, words, percent), "links")
        ids = classes.select("set_id", "node")
        several = linked.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("doc_id")
        nodes = save(linked.join(several, "doc_id", "left_semi").join(ids, "set_id").select("doc_id", "node").distinct(), "nodes-of-ids")
        links = links.unionByName(nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("v")), "doc_id").select(F.col("node").alias("u"), "v"))
        labels = components(links, save)

        side = lambda n: labels.select(F.col("u").alias(n), F.col("v").alias(f"of_{n}"))
        crossing = lambda pairs: pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        more = save(_confirmed(crossing(stars), texts, words, percent), "links")
        labels = labels if more.isEmpty() else components(labels.unionByName(more), save)

        own = save(_components_of(members, labels), "members")
        mixed = save(_mixed(own), "mixed-buckets")
        across = save(_across(own, mixed.where(F.col("n") <= DIRECT), classes, least, banded=True), "across")
        large = mixed.where(F.col("n") > DIRECT)
        if not large.isEmpty():
            wide = own.join(large.select("key"), "key", "left_semi").select(F.col("node").alias("doc_id"))
            rare = save(_components_of(rare_shingles(_texts_of(docs, wide, save).withColumnRenamed("doc_id", "node"), words, percent), labels), "rare-shingles")
            across = save(across.unionByName(_across(rare, _mixed(rare), classes, least, banded=False)).distinct(), "across")
        if not across.isEmpty():
            texts = _texts_of(docs, across.select(F.col("a").alias("doc_id")).union(across.select("b")), save)
            more = save(_confirmed(across, texts, words, percent), "links")
            labels = labels if more.isEmpty() else components(labels.unionByName(more), save)

        out = sketch.select("doc_id", "n_shingles", "set_id").join(ids, "set_id", "left")
        empty = sketch.where("doc_id is not null and set_id is null").select("doc_id")
        if not empty.isEmpty():  # an empty row of an id that has other rows is in their component
            named = linked.join(empty, "doc_id", "left_semi").join(ids, "set_id").groupBy("doc_id").agg(F.min("node").alias("_node"))
            out = out.join(named, "doc_id", "left").withColumn("node", F.coalesce("node", "_node"))
        out = out.join(labels.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left")
        return saved(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "node", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")


def op3_minhash(spark, sf_dir) -> DataFrame:
    """Near duplicates of all documents by shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w
), n AS (SELECT w.doc_id, count(g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON x = doc_id
"""
