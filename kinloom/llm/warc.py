"""Operator 7: WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of WARC 1.1 records, and a
footer: the seek table of the Zstandard seekable format in a skippable frame. The index maps each
record to its bundle, the offset of its frame and its offset in the unpacked frame, so one record
is read by unpacking one frame. Bundles are written and read by tasks with pyarrow's file systems;
each attempt of a task writes a file of its own, and only files named in the index are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.shared import fresh_path

FRAME_BYTES = 1 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame_offset long, frame_bytes long, record_offset long, record_id string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}"


def _one_line(value) -> str:
    return " ".join(str(value or "").split()) or "about:blank"


def warc_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """A response record, or a revisit without the payload if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(page_id)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("X-Refers-To-Page", refers_to)]
    head.append(("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes):
    """(offset, headers, payload) of each record in an unpacked frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = frame[end + 4 : end + 4 + int(head["Content-Length"])]
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + len(block) + 4


class BundleWriter:
    """Frames to a binary file; close() appends the seek table."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.at, self.frames = out, 0, []
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def frame(self, data: bytes) -> tuple[int, int]:
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, packed bytes, unpacked bytes) of each frame, from the footer."""
    file.seek(0, io.SEEK_END)
    size = file.tell()
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def open_file(path: str, mode: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_file(inner)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)  # the bundle is compressed already


def read_record(bundle: str, frame_offset: int, frame_bytes: int, record_offset: int) -> tuple[dict, bytes]:
    """(headers, payload) of one record by its index entry; reads one frame."""
    import zstandard

    with open_file(bundle, "r") as f:
        f.seek(frame_offset)
        frame = zstandard.ZstdDecompressor().decompress(f.read(frame_bytes))
    return next(parse_records(frame[record_offset:]))[1:]


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, first: the page that a record refers to, null for responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).distinct()
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"))
    other = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return slim.join(first, "digest").select("page_id", "digest", F.when(other, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write bundles to path/bundles and the index as Parquet to path/index; return the index.

    pages: page_id, url, html (null: empty). Equal payloads of at least min_bytes share the record
    of their smallest page_id; a null page_id is never that. Rows equal in page_id and payload are
    records of their own with the same record id.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body")).withColumn("digest", F.sha1("body"))
    plan = plan_revisits(pages, min_bytes).withColumnRenamed("page_id", "p").withColumnRenamed("digest", "q").hint("merge")
    # Joined by page, which is even, not by digest, which a common payload would crowd.
    planned = rows.join(plan, rows["page_id"].eqNullSafe(plan["p"]) & (rows["digest"] == plan["q"])).select("page_id", "url", "body", "first")

    def store(batches):
        out = writer = None
        bundle, pending, size, entries = "", [], 0, []

        def flush():
            nonlocal size
            at, packed = writer.frame(b"".join(x for _, x in pending))
            offset = 0
            for page, x in pending:
                entries.append((page, bundle, at, packed, offset, record_id(page)))
                offset += len(x)
            pending.clear()
            size = 0

        for batch in batches:
            for page, url, payload, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if writer is None:
                    bundle = f"{path}/bundles/{uuid.uuid4().hex}.warc.zst"
                    out = open_file(bundle, "w")
                    writer = BundleWriter(out)
                record = warc_record(page, url, payload, first, date)
                pending.append((page, record))
                size += len(record)
                if size >= FRAME_BYTES:
                    flush()
        if writer is not None:
            if pending:
                flush()
            writer.close()
            out.close()
            names = [x.split()[0] for x in INDEX.split(", ")]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), types, strict=True)], names)

    planned.mapInArrow(store, INDEX).write.parquet(f"{path}/index")
    return read_index(pages.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives below path: a row for each record, with its bundle and offsets."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the bundles.

    Responses are checked against their digest and length as they are read.
    """
    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()))  # a task for each bundle: their names are too small to be spread by size

    def load(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                with open_file(bundle, "r") as f:
                    for at, packed, plain in seek_table(f):
                        f.seek(at)
                        rows = []
                        for _, head, payload in parse_records(unpack.decompress(f.read(packed), max_output_size=plain)):
                            digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                            if head["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                                raise ValueError(f"damaged record {head['WARC-Record-ID']} in {bundle}")
                            page, first = head["X-Page-ID"].strip(), head.get("X-Refers-To-Page")
                            rows.append((int(page) if page else None, size, digest, head["WARC-Type"], int(first) if first else None))
                        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                        names = [x.split()[0] for x in RECORD.split(", ")]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return bundles.mapInArrow(load, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back. An empty table gives an empty result."""
    return read_archives(write_archives(pages, fresh_path(spark, "warc")))
