"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.tables import hadoop_path, new_folder, saved

#: What counts as white space between words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a `saved` whose tables are deleted at the end of the block; what is returned from it must be saved otherwise."""
    folder = new_folder(spark, "scratch")

    def save(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield save
    finally:
        path, store = hadoop_path(spark, folder)
        store.delete(path, True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Batches to Python workers hold at most so many bytes (or one row); a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4 (a null id: false)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Bits a key of the filter that keeps rows without a partner out of shuffles, and its least and greatest size in bits.
KEY_BITS, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 28


def maybe_among(df: DataFrame, keys: DataFrame, key: str, wanted: bool = True) -> DataFrame:
    """Rows whose key may be (wanted) or surely isn't among keys: a hashed bitmap of KEY_BITS bits a row of keys is broadcast.

    keys is counted first, so give a written table. A bitmap has MOST_BITS (32 MB) at most: beyond 33 million keys it fills up,
    and from some 500 million on nearly all rows pass. It only spares shuffles: rows that pass by chance find no partner in the
    join that follows. Null keys are among nothing.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(size))
    bits = keys.where(F.col(key).isNotNull()).select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits"))
    rows = df.withColumn("_b", place).withColumn("_bucket", F.bitmap_bucket_number("_b")).withColumn("_at", F.bitmap_bit_position("_b"))
    rows = rows.join(F.broadcast(bits), "_bucket", "left")  # at most MOST_BITS / 32768 + 1 rows of 4 KB
    bit = F.expr("pmod(shiftright(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)), 2) = 1")
    is_set = F.coalesce(bit & F.col(key).isNotNull(), F.lit(False))
    return rows.where(is_set if wanted else ~is_set).drop("_b", "_bucket", "_at", "_bits")


def give_back() -> None:
    """Return freed memory to the system: workers are used again and again, and idle ones keep what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function for mapInArrow, with give_back when it has ended and holds nothing any more: idle workers stay small."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each hold at most `most` bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            give_back()
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows in them; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (one entry more than rows)."""
    word = np.concatenate([[False], ~_IS_SPACE[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = np.unique(inner[word[inner + 1] & word[inner]]) if len(inner) else inner  # a word may not run into the next row
    if len(inner):
        starts = np.sort(np.concatenate([starts, inner]))
        ends = np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given spans of `data` (not empty, not overlapping, ascending) as an Arrow binary array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)])])
