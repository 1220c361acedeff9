"""WARC archives: one gzip member per record, written and read back by tasks.

Writing: each task writes its rows to archives of its own in a shared folder, and only the names that successful
attempts return are read later; what a lost attempt left behind is never read. Of records with equal payloads of at
least MIN_REVISIT bytes the one with the smallest page_id is a `response`, the others are `revisit` records without
the payload. Reading is sequential: pieces of a file go through zlib one after the other, a record's head ends at an empty
line, its block is framed by Content-Length, and block and payload digests are verified. Memory holds one record.

Null payloads and URLs count as empty. Rows with equal page_id and equal payload are the same record: all are
responses if that page_id is the smallest. A null page_id sorts after all others. An empty table gives no archives. Columns
other than those named are not stored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import hadoop_path, new_folder, saved, shuffle_partitions, small_batches, table, text_of

MIN_REVISIT = 100
#: An archive is closed when it has grown to so many bytes.
ARCHIVE_BYTES = 64 << 20
PIECE = 64 << 10
#: Schemes of addresses that tasks can write to.
FILE_SYSTEMS = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")
# Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def record(kind: str, record_id: str, block: bytes, **fields: str) -> bytes:
    """One record as a gzip member. Field names are written with hyphens for underscores."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    head |= {k.replace("_", "-"): v for k, v in fields.items()} | {"Content-Length": str(len(block))}
    lines = b"".join(f"{k}: {' '.join(v.split())}\r\n".encode() for k, v in head.items())
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(b"".join([VERSION, b"\r\n", lines, b"\r\n", block, b"\r\n\r\n"])) + deflate.flush()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a gzipped archive, read piece by piece; ValueError if one is broken."""
    left = b""
    while left or (left := stream.read(PIECE)):
        inflate, plain = zlib.decompressobj(31), bytearray()
        fields, size = None, None
        while not inflate.eof:
            if not left and not (left := stream.read(PIECE)):
                raise ValueError("the archive ends inside a record")
            plain += inflate.decompress(left)
            left = inflate.unused_data if inflate.eof else b""
            if fields is None and (end := plain.find(b"\r\n\r\n")) >= 0:
                version, *lines = bytes(plain[:end]).split(b"\r\n")
                if version != VERSION:
                    raise ValueError("not a record of this version")
                fields = dict(x.decode().split(": ", 1) if b": " in x else (x.decode().rstrip(":"), "") for x in lines)
                size, plain = int(fields["Content-Length"]), plain[end + 4 :]
        if fields is None or len(plain) != size + 4 or plain[size:] != b"\r\n\r\n":
            raise ValueError("a record's length is not its Content-Length")
        block = bytes(plain[:size])
        if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
        yield fields, block


def plan_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Digests are counted before the join, so the table of first ids has a row only for payloads that occur in several
    pages; a hot payload is split by the adaptive join.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), text_of("html").cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    large = p.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    links = large.distinct().join(first, "digest").where("page_id is null or page_id > first_id").where("first_id is not null").select("page_id", "digest", F.col("first_id").alias("refers_to")).alias("l")
    same = F.col("p.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("p.digest") == F.col("l.digest"))
    return p.alias("p").join(links, same, "left").select("p.*", "refers_to")


def write_archives(planned: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned records below `folder`; gives (archive, n_records). A path without a scheme is one of Spark's default file
    system; a file system that Arrow doesn't know is an error at once."""
    if ":/" not in folder:
        path, store = hadoop_path(planned.sparkSession, folder)
        folder = store.makeQualified(path).toString()
    scheme, _, rest = folder.partition(":")
    if scheme not in FILE_SYSTEMS:
        raise ValueError(f"archives can't be written to {folder}: no file system of {', '.join(FILE_SYSTEMS)}")
    folder = f"file:///{rest.lstrip('/')}" if scheme == "file" else folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, count, size, done = None, "", 0, 0, []

        def close() -> None:
            if out:
                out.close()
                done.append({"archive": f"{folder}/{name}", "n_records": count})

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None or size >= most:
                    close()
                    name, count, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields"))
                page_id, payload, first = page_id.as_py(), payload.as_py(), first.as_py()
                fields = {"WARC_Target_URI": url.as_py(), "WARC_Payload_Digest": f"sha256:{digest.as_py()}"}
                if first is None:
                    data = record("response", _page_urn(page_id), HTTP_HEAD + payload, Content_Type="application/http;msgtype=response", **fields)
                else:
                    data = record("revisit", _page_urn(page_id), HTTP_HEAD, Content_Type="application/http;msgtype=response", WARC_Profile=IDENTICAL, WARC_Refers_To=_page_urn(first), **fields)
                out.write(data)
                count, size = count + 1, size + len(data)
        close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("n_records", pa.int64())]))

    small_batches(planned.sparkSession)
    return saved(planned.mapInArrow(write, "archive string, n_records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of all responses and revisits of the named archives."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        row = {"page_id": _page_id(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": told}
                        if row["record_type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if hashlib.sha256(payload).hexdigest() != told:
                                raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
                            row |= {"payload": payload, "payload_bytes": len(payload)}
                        else:
                            row["refers_to"] = _page_id(fields["WARC-Refers-To"])
                        rows.append(row)
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    parts = shuffle_partitions(archives.sparkSession)
    return archives.select("archive").repartition(parts, "archive").mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def resolve_revisits(read: DataFrame) -> DataFrame:
    """The records with payload_bytes of revisits taken from the response that they refer to (null if there is none)."""
    got = read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = got.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("first_bytes")).dropDuplicates()
    return got.join(first, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op8_warc(spark, sf_dir) -> DataFrame:
    """All pages written to archives and read back."""
    archives = write_archives(plan_revisits(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    # the records' payloads are no longer needed; both sides of the join below come from one small table
    return resolve_revisits(saved(read_archives(archives).drop("payload", "url"), "records"))


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(encode(coalesce(html, ''))) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
