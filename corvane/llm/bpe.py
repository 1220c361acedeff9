"""Byte-pair encoding and decoding over a table of distinct words.

Encoding: texts are cut at white space that follows a character which surely is none (always a pre-token boundary of
byte-level vocabularies), so a word carries its leading blanks. A block of documents (about BLOCK bytes) becomes the
list of its distinct words and, per document, the positions in that list. Words go to the task that owns their hash, which
holds its share of the corpus's table of distinct words: a word is encoded when it comes first, and its ids return to all its blocks, where
they are joined back by position. So the shuffles carry each word once per block, and the positions once; whole texts are never
shuffled and no table is broadcast. A task holds TABLE words at most, those that come first, the common ones among them: others are encoded once
per block. Words of over LONG bytes, which hardly come again, are encoded wherever they are and not held.

Decoding: ids are joined to their pieces (the vocabulary, whose size is fixed, is on the map side of the join), the bytes
of a row are strung together and read as UTF-8, with U+FFFD for what is none.

The vocabulary is a public file in the format of the tokenizers library; its path is a parameter and it is read where
it is needed. Its special strings inside a text become their special ids, as in that library's defaults.

Null texts count as empty and give no ids. Repeated rows stay repeated; ids may repeat or be null. A text of any length is one
row of its block. Results have their own columns only: doc_id, then ids or text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import binary_array, give_back, shuffle_partitions, slices, small_batches, table, text_bytes, text_of, trimmed

BLOCK = 6 << 20
#: Distinct words that a task holds (some 300 bytes each with their ids), the first that come, but for those of over LONG bytes.
TABLE, LONG = 1 << 16, 256

_CUT = np.zeros(256, bool)  # a cut may come before these
_CUT[[0x20, 9, 10, 13]] = True
_OPEN = np.ones(256, bool)  # and after these: printable ASCII, or the last byte of a longer character (see below)
_OPEN[:0x21] = False
_OPEN[0x7F] = False


#: How columns of a packed table are encoded: sorted words share their beginnings, numbers are split by byte.
_ENCODINGS = {"word": "DELTA_BYTE_ARRAY", "position": "BYTE_STREAM_SPLIT", "ids.list.element": "BYTE_STREAM_SPLIT"}


def _pack(**columns: pa.Array) -> bytes:
    """Columns as one compressed Parquet table in memory."""
    t, sink = pa.table(columns), pa.BufferOutputStream()
    names = [f"{f.name}.list.element" if pa.types.is_list(f.type) else f.name for f in t.schema]
    pq.write_table(t, sink, compression="zstd", use_dictionary=False, write_statistics=False, store_schema=False, column_encoding={n: _ENCODINGS[n] for n in names})
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.Table:
    return pq.read_table(pa.BufferReader(data), use_threads=False).combine_chunks()


def words_of(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray = _CUT) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows, and the number of words before each row (one entry more than rows). blanks: per byte, whether a word may begin with it."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        before = data[:-1]
        cut[1:] = blanks[data[1:]] & _OPEN[before]
        # Unicode white space: C2 85, C2 A0, and characters from E1 9A, E2 80, E2 81, E3 80; no cut after any of these
        late = np.flatnonzero(cut[1:] & (before >= 0x80))
        if len(late):
            two = data[np.maximum(late - 1, 0)]
            three = data[np.maximum(late - 2, 0)]
            blank = (two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & np.isin(two, (0x9A, 0x80, 0x81)))
            cut[late[blank] + 1] = False
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return binary_array(data, starts, np.append(starts[1:], n)) if n else pa.array([], pa.binary()), np.searchsorted(starts, offsets)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """(block, digest, batch, distinct words by falling frequency, positions in them, words before each row)."""
    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 32
    for batch in slices(batches, "text", size):
        words, before = words_of(*text_bytes(batch.column("text")))
        coded = words.dictionary_encode()
        buffers = coded.dictionary.buffers()
        digest = xxhash.xxh3_64_intdigest(buffers[2] or b"", seed=len(words)) >> 1
        codes = coded.indices.to_numpy()
        order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")  # small numbers for common words
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        yield at, digest, batch, coded.dictionary.take(pa.array(order)), pa.array(rank[codes]), before
        at += 1


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def pieces(path: str) -> pa.Array:
    """The bytes of every id, by id; ids without a piece are null."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    out: dict[int, bytes] = {i: bytes(byte_of[c] for c in piece) for piece, i in told["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in told["added_tokens"]}
    return pa.array([out.get(i) for i in range(max(out) + 1)], pa.binary())


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text. block: bytes of text that a task works on at once; smaller ones shuffle more."""
    small_batches(docs.sparkSession, block)
    parts = shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, digest, _, words, _, _ in _blocks(batches, block):
            told = words.to_pylist()
            shares: list[list[int]] = [[] for _ in range(parts)]
            for i in sorted(range(len(told)), key=told.__getitem__):
                shares[xxhash.xxh3_64_intdigest(told[i]) % parts].append(i)
            for p, own in enumerate(shares):
                if own:
                    own = pa.array(own, pa.int32())
                    yield pa.RecordBatch.from_pylist([{"block": at, "digest": digest, "owner": p, "data": _pack(position=own, word=words.take(own))}])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("digest", pa.int64()), ("data", pa.binary()), ("words", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))])
        for at, digest, batch, words, positions, before in _blocks(batches, block):
            columns = [pa.array([x]) for x in (at, digest, _pack(position=positions))] + [pa.array([len(words)], pa.int32()), pa.array([batch.column("doc_id")], pa.list_(pa.int64())), pa.array([before], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def encode_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = _tokenizer(vocabulary), {}
        give_back()  # what reading the vocabulary has taken
        for batch in batches:
            for at, digest, data in zip(*(batch.column(c).to_pylist() for c in ("block", "digest", "data")), strict=True):
                own = _unpack(data)
                words = own["word"].to_pylist()
                new, once = [w for w in words if w not in known], {}
                for w, e in zip(new, t.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                    (known if len(w) <= LONG and len(known) < TABLE else once)[w] = np.array(e.ids, np.int32).tobytes()  # an array takes 100 bytes more
                ids = [known[w] if w in known else once[w] for w in words]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_pylist([{"block": at, "digest": digest, "data": _pack(position=own["position"].chunk(0), ids=lists)}])
        del known
        give_back()

    def assemble(rows: pa.Table) -> pa.Table:
        _tokenizer.cache_clear()  # a worker that has encoded words before needs it no more
        if len(set(rows["digest"].to_pylist())) > 1:
            raise ValueError("the input changed between two reads of it: write it to a table first")
        whole = [i for i, n in enumerate(rows["words"].to_pylist()) if n is not None]
        if len(whole) != 1:
            raise ValueError("a block without documents: write the input to a table first")
        row = rows.slice(whole[0], 1)
        docs, before = row["doc_id"].combine_chunks().flatten(), row["before"].combine_chunks().flatten().to_numpy()
        positions = _unpack(row["data"][0].as_py())["position"].to_numpy()
        if not len(positions):
            return pa.table({"doc_id": docs, "ids": pa.array([[]] * len(docs), pa.list_(pa.int32()))})
        share = pa.concat_tables([_unpack(x) for i, x in enumerate(rows["data"].to_pylist()) if i != whole[0]]).combine_chunks()
        if len(share) != row["words"][0].as_py():
            raise ValueError("a block lacks words: write the input to a table first")
        back = np.empty(len(share), np.int64)
        back[share["position"].to_numpy()] = np.arange(len(share))
        lists = share["ids"].chunk(0).take(pa.array(back[positions]))
        give_back()
        return pa.table({"doc_id": docs, "ids": pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[before]), lists.values)})

    words = docs.mapInArrow(trimmed(split), "block long, digest long, owner long, data binary").repartition(parts, "owner")
    encoded = words.select("block", "digest", "data").mapInArrow(trimmed(encode_once), "block long, digest long, data binary")
    numbered = docs.mapInArrow(trimmed(number), "block long, digest long, data binary, words int, doc_id array<long>, before array<long>")
    return numbered.unionByName(encoded, allowMissingColumns=True).groupBy("block").applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(ids: DataFrame, vocabulary: str) -> DataFrame:
    """The input with `text`, the decoded ids; ids that the vocabulary lacks count as nothing, a null list as empty."""
    shared = ids.sparkSession.sparkContext.broadcast(pieces(vocabulary))  # half a megabyte, whatever the corpus

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizer.cache_clear()
        told = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = pc.fill_null(part.column("ids"), pa.scalar([], part.column("ids").type))
                flat = lists.flatten()
                known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(told)))
                got = pc.fill_null(told.take(pc.if_else(pc.fill_null(known, False), flat, None)), b"")
                data, offsets = text_bytes(got)
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                ends = offsets[np.concatenate([[0], np.cumsum(sizes)])]
                raw = data.tobytes()
                texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)]
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = ids.select(*[c for c in ids.columns if c != "text"], F.lit("").alias("text")).schema
    return ids.mapInArrow(trimmed(join), schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark, sf_dir) -> DataFrame:
    """Every document's ids, and the text that they give."""
    path = vocabulary_path()
    back = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
