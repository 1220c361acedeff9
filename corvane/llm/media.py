"""Media columns: payloads in MPEG transport streams.

`mux` wraps a payload of 8-bit samples into 188-byte transport packets: a program association table, a program map
table, then packetised elementary stream (PES) packets. Each PES packet begins with a random-access flag and carries a
90 kHz presentation time that follows from its sample offset. `demux` finds the stream through both tables, checks
sync bytes, table checksums and continuity counters, reassembles the PES packets and returns the samples with the
times and random-access points. The round trip is lossless.

Null payloads count as empty. An empty payload gives a stream with tables only. A broken stream gives an error text and
a null payload, never an exception. Input columns stay; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import slices, small_batches, table, text_of

# Fixed values of the transport stream format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x0100, 0x0101
PRIVATE_DATA_STREAM, PRIVATE_DATA_TYPE = 0xBD, 0x06
CLOCK = 90_000
#: Samples a second, and the most samples in one PES packet.
RATE, PES_BYTES = 8_000, 16_384

_CRC_TABLE = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC_TABLE[_i] = _c
_CRC_LIST = _CRC_TABLE.tolist()


def section_crc(data: bytes) -> int:
    """The checksum of program tables (CRC-32 with the high bit first)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC_LIST[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = np.frombuffer(
    _table_packet(PAT_PID, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")))
    + _table_packet(PMT_PID, _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")),
    np.uint8,
).reshape(2, PACKET)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    data = np.frombuffer(payload, np.uint8)
    out, counter = [_TABLES], 0
    for at in range(0, len(data), PES_BYTES):
        part = data[at : at + PES_BYTES]
        pts = at * CLOCK // RATE & (1 << 33) - 1
        head = b"\x00\x00\x01" + bytes([PRIVATE_DATA_STREAM]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts)
        pes = np.concatenate([np.frombuffer(head, np.uint8), part])
        n = 1 + max(0, -(-(len(pes) - 182) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter = (counter + n) & 15
        packets[0, 1] |= 0x40
        start = np.full(n, 4)
        left = len(pes) - 182 - 184 * (n - 2) if n > 1 else len(pes)  # what the last packet holds
        if n > 1 and left < 184:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - left
            if left < 183:
                packets[-1, 5] = 0
            start[-1] = PACKET - left
        packets[0, 3] |= 0x20
        packets[0, 4] = 1 if n > 1 else 183 - left
        packets[0, 5] = 0x40  # random access
        start[0] = 6 if n > 1 else PACKET - left
        packets[np.arange(PACKET) >= start[:, None]] = pes
        out.append(packets)
    return np.concatenate(out).tobytes()


def _sections(packets: np.ndarray, pid: int, pids: np.ndarray) -> bytes:
    """The first table section that packets of this pid carry whole, checked."""
    for p in packets[(pids == pid) & (packets[:, 1] & 0x40 > 0)]:
        at = 4 + (1 + int(p[4]) if p[3] & 0x20 else 0)
        at += 1 + int(p[at])
        raw = p[at:].tobytes()
        size = 3 + (int.from_bytes(raw[1:3], "big") & 0x0FFF)
        if size > len(raw) or section_crc(raw[:size]):
            raise ValueError(f"bad table section on pid {pid}")
        return raw[8 : size - 4]
    raise ValueError(f"no table section on pid {pid}")


def demux(media: bytes) -> tuple[bytes, list[int], list[int]]:
    """(samples, presentation times, sample offsets that allow random access); ValueError if the stream is broken."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("sync byte lost")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    body = _sections(packets, PAT_PID, pids)
    program_map = next((int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body), 4) if body[i : i + 2] != b"\0\0"), None)
    if program_map is None:
        raise ValueError("no program")
    body = _sections(packets, program_map, pids)
    at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
    if at + 5 > len(body):
        raise ValueError("no elementary stream")
    own = packets[pids == (int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF)]
    if not len(own):
        return b"", [], []
    counters = own[:, 3] & 15
    if ((counters[1:] - counters[:-1]) & 15 != 1).any():
        raise ValueError("continuity counter jumps")
    field = own[:, 3] & 0x20 > 0
    start = 4 + np.where(field, 1 + own[:, 4].astype(np.int32), 0)
    access = field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    begins = np.flatnonzero(own[:, 1] & 0x40)
    if not len(begins) or begins[0]:
        raise ValueError("stream begins inside a packet")
    bytes_of = own[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(PACKET - start)])
    parts, times, points, offset = [], [], [], 0
    for i, j in zip(begins, [*begins[1:], len(own)], strict=True):
        pes = bytes_of[ends[i] : ends[j]]
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\0\0\x01" or len(pes) != size + 6:
            raise ValueError("broken elementary packet")
        if pes[7] & 0x80:
            p = pes[9:14]
            times.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        if access[i]:
            points.append(offset)
        parts.append(pes[9 + pes[8] :])
        offset += len(parts[-1])
    return b"".join(parts), times, points


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], [*kept, *columns])


def _schema(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name not in more), *(T.StructField(k, v) for k, v in more.items())])


def to_media(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The input, its payload column replaced by `media`, the transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, payload):
            yield _with(b, {"media": pa.array((mux(x or b"") for x in b.column(payload).to_pylist()), pa.binary())}).drop_columns([payload])

    small_batches(df.sparkSession)
    out = _schema(df, media=T.BinaryType())
    return df.mapInArrow(run, T.StructType([f for f in out.fields if f.name != payload]))


def from_media(df: DataFrame, media: str = "media") -> DataFrame:
    """The input with `payload`, `pts` and `access_points` read from its streams, and `error` where one is broken."""

    def one(stream: bytes | None) -> tuple:
        try:
            return (*demux(stream or b""), None)
        except (ValueError, IndexError) as e:
            return None, [], [], str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media):
            payload, pts, points, error = zip(*(one(x) for x in b.column(media).to_pylist()), strict=True)
            yield _with(b, {"payload": pa.array(payload, pa.binary()), "pts": pa.array(pts, pa.list_(pa.int64())), "access_points": pa.array(points, pa.list_(pa.int64())), "error": pa.array(error, pa.string())})

    small_batches(df.sparkSession)
    longs = T.ArrayType(T.LongType())
    return df.mapInArrow(run, _schema(df, payload=T.BinaryType(), pts=longs, access_points=longs, error=T.StringType()))


def op9_media(spark, sf_dir) -> DataFrame:
    """Every document's bytes, padded to a positive multiple of 64, through a transport stream and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().cast("binary").alias("raw"))
    n = F.octet_length("raw").cast("long")
    total = F.greatest(F.lit(1), F.ceil(n / 64)) * 64
    docs = docs.select("doc_id", n.alias("n_bytes"), F.rpad(F.col("raw"), total.cast("int"), F.lit(b"\x00")).alias("payload"))
    back = from_media(to_media(docs))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("pes="), F.size("pts")),
        F.concat(F.lit("access="), F.size("access_points")),
        F.concat(F.lit("first_pts="), F.get("pts", F.lit(0))),
        F.concat(F.lit("last_pts="), F.element_at("pts", -1)),
        F.concat(F.lit("last_access="), F.element_at("access_points", -1)),
        F.concat(F.lit("packets="), F.floor(F.octet_length("media") / PACKET)),
    )
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
