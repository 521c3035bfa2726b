"""WARC records in seekable Zstandard bundles.

A bundle is one binary value, the image of one .warc.zst file: WARC/1.1 records in order, grouped into independent
Zstandard frames, then a skippable frame with the record index, then the seek table of the Zstandard seekable format
(a skippable frame with every frame's compressed and plain size and a footer). The index maps each record id to its frame,
its offset in the plain frame and its length, so one record is read by one frame's decompression.

Bundles are rows of a table in the shared folder: tasks cannot rely on any other file system than Spark's own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import scratch_path

BUNDLES = "part int, seq int, n_records long, image binary"
#: Fixed values of the Zstandard formats.
SEEK_FRAME, INDEX_FRAME, SEEK_FOOTER = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
#: The revisit profile of WARC 1.1 for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """A WARC record: named fields, HTTP fields and what follows them."""

    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def record_id(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response and the payload's digest and length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{record_id(page_id)}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(lines: list[bytes]) -> dict[str, str]:
    return {k.decode(): v.strip().decode("utf-8") for k, _, v in (line.partition(b":") for line in lines)}


def read_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != b"WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = fields_of(lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, fields_of(http.split(b"\r\n")[1:]), payload)


class BundleWriter:
    """Collects records into frames of about ``frame_bytes`` plain bytes."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frame_bytes, self.frames, self.sizes, self.index, self.held, self.held_bytes = frame_bytes, [], [], [], [], 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.held:
            frame = self.compress(b"".join(self.held))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held_bytes))
            self.held, self.held_bytes = [], 0

    def size(self) -> int:
        return sum(c for c, _ in self.sizes)

    def image(self) -> bytes:
        self.close_frame()
        index = self.compress(json.dumps(self.index).encode())
        seek = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_FOOTER)
        return b"".join([*self.frames, struct.pack("<II", INDEX_FRAME, len(index)), index, struct.pack("<II", SEEK_FRAME, len(seek)), seek])


class Bundle:
    """Random access to a bundle image."""

    def __init__(self, image: bytes):
        import zstandard

        self.image, self.decompress = image, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", image[-9:])
        start = len(image) - 9 - 8 * n - 8
        if magic != SEEK_FOOTER or flags or struct.unpack_from("<I", image, start)[0] != SEEK_FRAME:
            raise ValueError("no seek table at the end")
        sizes = np.frombuffer(image, "<u4", 2 * n, start + 8).reshape(n, 2).astype(np.int64)
        self.plain, self.starts = sizes[:, 1], np.concatenate([[0], np.cumsum(sizes[:, 0])])
        kind, length = struct.unpack_from("<II", image, int(self.starts[-1]))
        if kind != INDEX_FRAME:
            raise ValueError("no record index after the frames")
        at = int(self.starts[-1]) + 8
        self.index = [tuple(x) for x in json.loads(self.decompress(image[at : at + length]))]

    def frame(self, i: int) -> bytes:
        return self.decompress(self.image[self.starts[i] : self.starts[i + 1]], max_output_size=int(self.plain[i]))

    def record(self, name: str) -> Record:
        """The first record of that id."""
        _, frame, offset, length = next(x for x in self.index if x[0] == name)
        return read_record(self.frame(frame)[offset : offset + length])

    def records(self) -> Iterator[tuple[str, Record]]:
        """All records in order, each frame decompressed once."""
        now, plain = -1, b""
        for name, frame, offset, length in self.index:
            if frame != now:
                now, plain = frame, self.frame(frame)
            yield name, read_record(plain[offset : offset + length])


def find_revisits(pages: DataFrame, min_bytes: int, salts: int = 16) -> DataFrame:
    """(page_id, digest, refers_to) of every page whose payload a page of smaller id has too.

    A digest that many pages share meets its group in ``salts`` slices of the join.
    """
    keyed = pages.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    groups = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["digest", "salt"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per page; of pages with equal payloads of at least ``min_bytes`` the smallest id is the response.

    The payload is the html in UTF-8, empty for null. Rows that share the smallest id are all responses; a null id is a
    response of its own. The table at ``path`` has a row per bundle (part, seq, n_records, image). A record is never cut,
    so a frame or bundle is exceeded by one record at most. Other columns are ignored; an empty table gives no bundles.
    """
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    named = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    revisits = find_revisits(named, min_bytes)
    ready = named.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        writer = BundleWriter(frame_bytes, level)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(writer.index)], pa.int64()), pa.array([writer.image()], pa.binary())], names=["part", "seq", "n_records", "image"])

        for batch in batches:
            for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(record_id(page_id), write_record(page_id, url, body, refers_to, date))
                if writer.size() >= bundle_bytes:
                    yield row()
                    writer, seq = BundleWriter(frame_bytes, level), seq + 1
        if writer.index:
            yield row()

    ready.mapInArrow(write, BUNDLES).write.option("compression", "none").parquet(path)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row per record, from the archives alone: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from the payload that was read; a revisit has no payload, so from its fields.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for image in batch.column(0).to_pylist():
                rows = []
                for name, record in Bundle(image).records():
                    kind, target = record.fields["WARC-Type"], record.fields.get("WARC-Refers-To")
                    digest = payload_digest(record.payload) if kind == "response" else record.fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = len(record.payload) if kind == "response" else int(record.http["Content-Length"])
                    rows.append((int(name) if name else None, record.fields.get("WARC-Target-URI"), size, digest, kind, int(target[len("<urn:page:") : -1]) if target else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("image").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write the archives of all pages to the shared folder and read their records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc-bundles")
    write_bundles(pages, path, **options)
    return read_bundles(spark.read.schema(BUNDLES).parquet(path))
