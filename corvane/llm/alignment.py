"""Alignment of two tokenizers by bytes, with corpus-wide counts of linked ids by external spill counting.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes, a blank and the text. Offsets where tokens of both end cut them into groups; tokens of a group are linked.
The cuts that both vocabularies make before a blank that follows a character are ends of groups, so a text is a row of words that are aligned on their own:
a task encodes and aligns each distinct word of a block (about BLOCK bytes of text) once, and documents are sums over their words.

Counting. A task adds up, for each pair of ids, the documents that hold it linked; a sum over some blocks is a segment, which is spilled when it is full.
1. Spill: a segment's pairs are dealt by the low digits of their A id (RADIX parts) and written, sorted side-major (A id first), as zstd-packed runs.
2. Merge: a task merges the runs of one part by a heap of their next A ids, and adds up the counts of equal pairs. As pairs come side-major, an A id's
   highest count is known when the heap moves on; then the counts, and whether they are the highest, are streamed back to the runs, in each run's order.
   Over FAN runs are first merged in groups, and what comes back from above is handed down in the same way, so a task never holds more than some FAN runs of a part.
3. Return: what comes back to a segment meets its documents' pairs (packed, by position in the segment's sorted pairs), which gives each document's sums.

Texts are read once and never shuffled; a pair travels once a segment, however many documents hold it, so a frequent pair or A id is no hot key.
A lost executor costs its tasks only: spilled runs and packed documents are a written table.

Null and empty texts, and texts whose A or B bytes aren't those of a blank and the text (U+2581 in a text, say), have no tokens: zeros and an empty digest. Each row is a document of its own, so repeated rows
count each. A text of any length is one row of its block. Columns of the input other than id and text are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import pieces, vocabulary_path, words_of
from corvane.llm.common import give_back, saved, scratch, slices, small_batches, table, text_bytes, trimmed

BLOCK = 3 << 20
#: Parts of the A ids; runs that a task merges at once; pairs and bytes of text that fill a segment.
RADIX, FAN, PAIRS, SEGMENT = 256, 1024, 1 << 20, 128 << 20
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True
_HASHED = 1 << 20  # words whose groups are written out at once
_AT_ONCE = 1 << 13  # words that are encoded at once: the encoder's own results are much larger than the ids


def _squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, as zstd over their bytes by place."""
    c = zstandard.ZstdCompressor(3)
    packed = [c.compress(np.ascontiguousarray(x.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes()) for x in columns]
    return np.array([len(packed), *map(len, packed)], np.int64).tobytes() + b"".join(packed)


def _columns(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(data, np.int64, n, 8), 8 + 8 * n, []
    for size in sizes.tolist():
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size])
        out.append(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(-1))
        at += size
    return out


def _falls(x: np.ndarray) -> np.ndarray:
    """Differences, from 0 on: small numbers for a sorted column; np.cumsum takes them back."""
    return np.diff(x, prepend=0)


@lru_cache(1)
def piece_bytes(path: str) -> pa.Array:
    """The bytes of every piece by id: U+2581 is a blank, <0xHH> the byte HH."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return pa.array([bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())], pa.binary())


@lru_cache(1)
def _encoders(bytes_path: str, pieces_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bytes_path)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    if any("▁" in b.id_to_piece(i).lstrip("▁") for i in range(b.get_piece_size())):
        raise ValueError("a piece goes over a blank, so words can't be cut apart")
    return a, b, b.piece_to_id("▁")


def _ids(words: list[str], bytes_path: str, pieces_path: str) -> tuple[list[list[int]], list[list[int]]]:
    """Token ids of words that begin with a blank; B adds that blank itself."""
    a, b, blank = _encoders(bytes_path, pieces_path)
    left, right = [], []
    for at in range(0, len(words), _AT_ONCE):
        some = words[at : at + _AT_ONCE]
        left += [e.ids for e in a.encode_batch_fast(some, add_special_tokens=False)]
        right += [x or [blank] for x in b.encode([w[1:] for w in some], num_threads=1)]
    return left, right


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return np.fromiter((i for x in lists for i in x), np.int64, int(ends[-1])), ends


class Words:
    """The distinct words of a block, aligned: per word its tokens, groups, links and linked pairs.

    `good` words have the same bytes in A and B as in the text; others have nothing here.
    """

    def __init__(self, words: pa.Array, bytes_path: str, pieces_path: str):
        told = words.to_pylist()
        width = self.width = len(piece_bytes(pieces_path))
        sides = []
        good = np.ones(len(told), bool)
        for lists, vocabulary in zip(_ids([w.decode() for w in told], bytes_path, pieces_path), (pieces(bytes_path), piece_bytes(pieces_path)), strict=True):
            flat, ends = _flat(lists)
            data, offsets = text_bytes(vocabulary.take(pa.array(flat)))
            cuts = offsets[ends]
            raw = data.tobytes()
            good &= np.fromiter((raw[i:j] == w for i, j, w in zip(cuts[:-1].tolist(), cuts[1:].tolist(), told, strict=True)), bool, len(told))
            sides.append((flat, np.diff(offsets), np.repeat(np.arange(len(told)), np.diff(ends))))
        (a, a_size, a_word), (b, b_size, b_word) = ([x[good[side[2]]] for x in side] for side in sides)
        self.good, n = good, len(told)
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        a_cut, b_cut = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        group_word = a_word[a_cut]
        groups = len(group_word)
        per_word = lambda at, weight=None: np.bincount(at, weight, n).astype(np.int64)
        in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        self.n_a, self.n_b, self.n_groups, self.n_links = per_word(a_word), per_word(b_word), per_word(group_word), per_word(group_word, in_a * in_b)
        # distinct ids of each group, so that a long group costs what its different ids cost
        (ga, na), (gb, nb) = (np.unique(g * (1 << 20) + x, return_counts=True) for g, x in ((a_group, a), (b_group, b)))
        a_at, b_at = ga >> 20, gb >> 20
        many = np.bincount(b_at, minlength=groups)
        first = np.cumsum(many) - many
        times = many[a_at]
        left = np.repeat(np.arange(len(ga)), times)
        right = first[a_at[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        code = (ga[left] & 0xFFFFF) * width + (gb[right] & 0xFFFFF)
        self.pairs, pair = np.unique(code, return_inverse=True)
        key, place = np.unique(group_word[a_at[left]] * max(1, len(self.pairs)) + pair, return_inverse=True)
        self.pair_times = np.bincount(place, na[left] * nb[right], len(key)).astype(np.int64)
        self.pair_at = key % max(1, len(self.pairs))
        self.pair_ends = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, len(self.pairs)), minlength=n))])
        listed = [pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), pa.array(x).cast(pa.string())), ",") for k, x in ((in_a, a), (in_b, b))]
        told_groups = pc.binary_join_element_wise(pa.array([""] * groups), pc.binary_join_element_wise(*listed, "|"), ";") if groups else pa.array([], pa.string())
        #: A semicolon and its text for every group of a word.
        self.text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.n_groups)]).astype(np.int32)), told_groups), "")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.concat(F.lit(" "), F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text) != "", whole).otherwise("").alias("text"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int, bytes_path: str, pieces_path: str) -> Iterator[tuple]:
    """(batch, words, number of each word of the texts, words before each row) of each block; texts that can't be aligned have no words."""
    for batch in slices(batches, "text", size):
        coded, before = words_of(*text_bytes(batch.column("text")), _BLANK)
        coded = coded.dictionary_encode()
        codes = coded.indices.to_numpy()
        words = Words(coded.dictionary, bytes_path, pieces_path)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(before))
        bad = np.zeros(batch.num_rows, bool)
        bad[rows[~words.good[codes]]] = True
        stay = ~bad[rows]
        yield batch, words, codes[stay], np.concatenate([[0], np.cumsum(stay)])[before]


def _group_texts(words: Words, codes: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, memoryview]]:
    """(row, piece of its groups' text) in order; the text of a row begins with a semicolon."""
    for at in range(0, len(codes), _HASHED):
        data, offsets = text_bytes(words.text.take(pa.array(codes[at : at + _HASHED])))
        raw = memoryview(data)
        for row in range(int(np.searchsorted(before, at, side="right")) - 1, int(np.searchsorted(before, at + len(offsets) - 1, side="left"))):
            low, high = max(int(before[row]) - at, 0), min(int(before[row + 1]) - at, len(offsets) - 1)
            if high > low:
                yield row, raw[offsets[low] : offsets[high]]


def alignments(docs: DataFrame, byte_vocabulary: str, piece_model: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, groups): each text's groups, `a1,a2|b1;a3|b2,b3` with the ids in order."""
    small_batches(docs.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, codes, before in _blocks(batches, block, byte_vocabulary, piece_model):
            out = [[] for _ in range(batch.num_rows)]
            for row, piece in _group_texts(words, codes, before):
                out[row].append(bytes(piece))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b"".join(x)[1:] for x in out], pa.string())], ["doc_id", "groups"])

    return _texts(docs, doc_id, text).mapInArrow(trimmed(run), "doc_id long, groups string")


def _spilled(docs: DataFrame, bytes_path: str, pieces_path: str, block: int, radix: int, pairs: int, segment: int) -> DataFrame:
    """(run, part, data, docs): the runs of each segment (part, data), and its packed documents (docs), a block a row."""
    schema = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("docs", pa.binary()), ("digest", pa.binary())])

    def row(**told) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: told.get(n) for n in schema.names}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        known, counts, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def spill() -> Iterator[pa.RecordBatch]:
            part = known // width % radix
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(radix + 1))
            for p in range(radix):
                own = order[ends[p] : ends[p + 1]]
                if len(own):
                    yield row(run=number, part=p, data=_squeezed(_falls(known[own]), counts[own]))

        for batch, words, codes, before in _blocks(batches, block, bytes_path, pieces_path):
            width, rows = words.width, batch.num_rows
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[codes])])[before]) for x in (words.n_a, words.n_b, words.n_groups, words.n_links)]
            digests = {}
            for r, piece in _group_texts(words, codes, before):
                if r in digests:
                    digests[r].update(piece)
                else:
                    digests[r] = hashlib.sha256(piece[1:])
            digest = b"".join(digests[r].digest() if r in digests else bytes(32) for r in range(rows))
            # each word of a document once, then each pair of these once
            key, n = np.unique(np.repeat(np.arange(rows), np.diff(before)) * max(1, len(words.good)) + codes, return_counts=True)
            doc, word = key // max(1, len(words.good)), key % max(1, len(words.good))
            many = (words.pair_ends[1:] - words.pair_ends[:-1])[word]
            at = np.repeat(words.pair_ends[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
            key, place = np.unique(np.repeat(doc, many) * max(1, len(words.pairs)) + words.pair_at[at], return_inverse=True)
            times = np.bincount(place, words.pair_times[at] * np.repeat(n, many), len(key)).astype(np.int64)
            doc, pair = key // max(1, len(words.pairs)), key % max(1, len(words.pairs))
            here = np.bincount(pair, minlength=len(words.pairs))  # documents of this block
            used = here > 0
            place = np.cumsum(used) - 1
            known, inverse = np.unique(np.concatenate([known, words.pairs[used]]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, here[used]]), len(known)).astype(np.int64)
            first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
            gaps = np.where(first, place[pair], np.diff(place[pair], prepend=0))
            yield row(run=number, doc_id=batch.column("doc_id").to_pylist(), digest=digest, docs=_squeezed(*sums, np.bincount(doc, minlength=rows), gaps, times, _falls(words.pairs[used])))
            held += int(batch.column("text").nbytes)
            del words
            if len(known) >= pairs or held >= segment:
                yield from spill()
                number, known, counts, held = number + 1, known[:0], counts[:0], 0
        if len(known):
            yield from spill()
        _encoders.cache_clear()
        give_back()

    return docs.mapInArrow(trimmed(run), "run long, part int, data binary, doc_id array<long>, docs binary, digest binary")


def _merged(runs: list[list[np.ndarray]], width: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By A id: the spans of the runs that hold it (run, from, to), its pairs in order, the place of each run's pairs in these (one array for all spans), and the other columns, strung together.

    runs: sorted pair codes and further columns of each run. A heap holds each run's next A id.
    """
    cuts = []
    for codes, *_ in runs:
        ids = codes // width
        cuts.append(np.concatenate([np.flatnonzero(np.diff(ids, prepend=-1)), [len(ids)]]).tolist())
    at = [0] * len(runs)
    heap = [(int(r[0][0]) // width, i) for i, r in enumerate(runs) if len(r[0])]
    heapq.heapify(heap)
    while heap:
        now, spans = heap[0][0], []
        while heap and heap[0][0] == now:
            i = heap[0][1]
            low, high = cuts[i][at[i]], cuts[i][at[i] + 1]
            spans.append((i, low, high))
            at[i] += 1
            if high < len(runs[i][0]):
                heapq.heapreplace(heap, (int(runs[i][0][high]) // width, i))
            else:
                heapq.heappop(heap)
        pairs, place = np.unique(np.concatenate([runs[i][0][x:y] for i, x, y in spans]), return_inverse=True)
        yield spans, pairs, place, [np.concatenate([runs[i][c][x:y] for i, x, y in spans]) for c in range(1, len(runs[0]))]


def _unpacked(rows: pa.Table) -> list[list[np.ndarray]]:
    return [[np.cumsum(codes), counts] for codes, counts in map(_columns, rows["data"].to_pylist())]


def _summed(runs: list[list[np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the runs with the sums of their counts."""
    out = [(pairs, np.bincount(place, counts, len(pairs)).astype(np.int64)) for _, pairs, place, (counts,) in _merged(runs, width)]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _returned(runs: list[list[np.ndarray]], width: int, above: list[np.ndarray] | None = None) -> list[bytes]:
    """For each run, its pairs' sums and whether these are their A id's highest, in the run's order. above: sums and marks of all pairs in order, where they are known already."""
    back = [[np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)] for codes, _ in runs]
    passed = 0
    for spans, pairs, place, (counts,) in _merged(runs, width):
        if above:
            sums, best = (x[passed : passed + len(pairs)] for x in above)
            passed += len(pairs)
        else:
            sums = np.bincount(place, counts, len(pairs)).astype(np.int64)
            best = (sums == sums.max()).astype(np.int64)
        start = 0
        for i, low, high in spans:
            own = place[start : start + high - low]
            back[i][0][low:high], back[i][1][low:high] = sums[own], best[own]
            start += high - low
    return [_squeezed(*x) for x in back]


def _given_back(runs: DataFrame, width: int, fan: int, save) -> DataFrame:
    """(run, part, back) for runs (run, part, data) of a written table."""
    groups = -(-runs.select("run").distinct().count() // fan)

    def whole(rows: pa.Table) -> pa.Table:
        told = _returned(_unpacked(rows), width)
        give_back()
        return pa.table({"run": rows["run"], "part": rows["part"], "back": pa.array(told, pa.binary())})

    if groups <= 1:
        return runs.groupBy("part").applyInArrow(whole, "run long, part int, back binary")

    def summed(rows: pa.Table) -> pa.Table:
        pairs, counts = _summed(_unpacked(rows), width)
        return pa.table({"run": rows["group"][:1], "part": rows["part"][:1], "data": pa.array([_squeezed(_falls(pairs), counts)], pa.binary())})

    def handed_down(rows: pa.Table) -> pa.Table:
        upper = pc.is_valid(rows["back"])
        own = rows.filter(pc.invert(upper))
        told = _returned(_unpacked(own), width, _columns(rows.filter(upper)["back"][0].as_py()))
        return pa.table({"run": own["run"], "part": own["part"], "back": pa.array(told, pa.binary())})

    dealt = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
    upper = save(dealt.groupBy("part", "group").applyInArrow(summed, "run long, part int, data binary"), "merged-runs")
    above = _given_back(upper, width, fan, save).withColumnRenamed("run", "group")
    both = dealt.unionByName(above, allowMissingColumns=True)
    return both.groupBy("part", "group").applyInArrow(handed_down, "run long, part int, back binary")


def aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, radix: int = RADIX, fan: int = FAN, pairs: int = PAIRS, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    n_best: links whose pair is held linked by as many documents as any pair of its A id. count_sum: over all links, the documents that hold their pair linked.
    """
    small_batches(docs.sparkSession, block)
    width = len(piece_bytes(piece_model))

    def whole(rows: pa.Table) -> pa.Table:
        """The documents of a segment, with what came back to its runs."""
        _encoders.cache_clear()
        packed = rows.filter(pc.is_valid(rows["docs"]))
        blocks = [_columns(x) for x in packed["docs"].to_pylist()]
        known = np.unique(np.concatenate([np.cumsum(x[7]) for x in blocks]))
        part = known // width % radix
        sums, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        came = rows.filter(pc.is_valid(rows["back"]))
        if came["part"].to_pylist() and len(set(came["part"].to_pylist())) != len(came) or set(came["part"].to_pylist()) != set(np.unique(part).tolist()):
            raise ValueError("a segment and its runs don't fit")
        for p, back in zip(came["part"].to_pylist(), came["back"].to_pylist(), strict=True):
            own = part == p
            sums[own], best[own] = _columns(back)
        out = []
        for ids, digests, (n_a, n_b, n_groups, n_links, many, gaps, times, falls) in zip(packed["doc_id"].to_pylist(), packed["digest"].to_pylist(), blocks, strict=True):
            ends = np.concatenate([[0], np.cumsum(many)])
            run = np.cumsum(gaps)  # gaps begin anew in each document
            base = np.where(many > 0, np.concatenate([[0], run])[ends[:-1]], 0)
            place = np.searchsorted(known, np.cumsum(falls))[run - np.repeat(base, many)] if len(gaps) else gaps
            total = lambda x, t=times, e=ends: np.diff(np.concatenate([[0], np.cumsum(t * x)])[e])
            told = [digests[32 * i : 32 * i + 32].hex() if n else "" for i, n in enumerate(n_groups.tolist())]
            out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": total(best[place]), "count_sum": total(sums[place]), "groups_sha256": told}))
        give_back()
        return pa.concat_tables(out).combine_chunks()

    with scratch(docs.sparkSession) as save:
        told = save(_spilled(_texts(docs, doc_id, text), byte_vocabulary, piece_model, block, radix, pairs, segment), "spilled")
        back = _given_back(told.where("part is not null").select("run", "part", "data"), width, fan, save)
        rows = told.where("docs is not null").select("run", "doc_id", "docs", "digest").unionByName(back, allowMissingColumns=True)
        longs = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
        return saved(rows.groupBy("run").applyInArrow(whole, f"doc_id long, {longs}, groups_sha256 string"), "aligned")


def op13_alignment(spark, sf_dir) -> DataFrame:
    """Every document's alignment of the two vocabularies."""
    return aligned(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
