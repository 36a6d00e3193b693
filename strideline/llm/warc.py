"""WARC archives as seekable Zstandard bundles.

A bundle holds records in frames that can be decompressed on their own, and ends with a skippable frame that has the
seek table: for each frame its compressed and uncompressed size, then their number, a flag byte and a magic number. An
index maps record identifiers to (bundle, frame, offset in the frame, length), so a record is read by one seek.

Of pages with equal payloads the one with the smallest id is a response record; the others are revisit records that
refer to it and carry no payload, but its digest and size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read, saved, scratch

#: Uncompressed bytes of records in a frame, and of frames in a bundle.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 256 << 20
#: Magic numbers of a skippable frame and of the seek table in it. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit if it refers to another page."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and end of the record that begins at a place."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    return fields, data[end + 4 : end + 4 + size], end + 8 + size


class Bundle:
    """Writes records into frames of a file and keeps their places."""

    def __init__(self, store: fs.FileSystem, path: str, frame_bytes: int = FRAME_BYTES):
        self.store, self.path, self.limit = store, path, frame_bytes
        self.part = f"{path}.{uuid.uuid4().hex}"  # a second attempt of a task doesn't touch the first one's file
        self.out, self.zstd = store.open_output_stream(self.part), zstandard.ZstdCompressor(level=3)
        self.held, self.size, self.table = [], 0, []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length of the record."""
        place = len(self.table), self.size, len(data)
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.limit:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.out.write(frame)
            self.table.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()
        self.store.move(self.part, self.path)


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """Place, compressed and uncompressed size of each frame, from the end of a bundle."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the file has no seek table")
    width = 12 if flags & 128 else 8
    file.seek(size - 9 - n * width)
    body, at, out = file.read(n * width), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", body, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def fetch(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: only its frame is read."""
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{bundle}") as file:
        at, packed, plain = seek_table(file, file.size())[frame]
        file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    return parse(data[offset : offset + length])[:2]


def with_referral(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page (id as text), url, html, sha1 (hex), size, first: the smallest id of the pages with the same payload if
    that is another page and the payload has smallest bytes or more."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    first = rows.where(F.col("size") >= smallest).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written: the join then deals both sides anew, and Spark can split the rows of a payload that is everywhere.
    first = saved(first, "payloads")
    joined = rows.join(first, "sha1", "left")
    return joined.select(F.col("page_id").cast("string").alias("page"), "url", "html", "sha1", "size", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("first"))


def write_archive(pages: DataFrame, folder: str, smallest: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as bundles into a folder that all executors share; returns the index.

    The index has a row a page: page, bundle, frame, at, length. Null html is the empty payload; a page without an id has
    an empty identifier and is a revisit where other pages have its payload. Repeated rows are written each; of rows with
    the smallest id all are responses. A bundle is moved to its name when it is complete; files of failed attempts, which
    no index row names, don't matter.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        bundle, name, total, rows = None, "", 0, []

        def finish() -> pa.RecordBatch:
            bundle.close()
            return pa.RecordBatch.from_pylist([dict(zip(("page", "bundle", "frame", "at", "length"), x, strict=True)) for x in rows], schema=schema)

        schema = pa.schema([("page", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for page, url, html, sha1, size, first in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if bundle is None:
                    name, total, rows = f"{uuid.uuid4().hex}.warc.zst", 0, []
                    bundle = Bundle(store, f"{path}/{name}", frame_bytes)
                data = record(page, url, html.encode(), size, base64.b32encode(bytes.fromhex(sha1)).decode(), first)
                rows.append((page, name, *bundle.add(data)))
                total += len(data)
                if total >= bundle_bytes:
                    yield finish()
                    bundle = None
        if bundle is not None:
            yield finish()

    return saved(with_referral(pages, smallest).mapInArrow(run, "page string, bundle string, frame int, at long, length long"), "warc-index")


def read_archive(index: DataFrame, folder: str, group: int = 64) -> DataFrame:
    """All records of the bundles that an index names: page, payload_bytes, payload_digest, record_type, refers_to.

    Frames are read in groups, a task each. Every payload is checked against its digest, every record against the index.
    """
    frames = index.groupBy("bundle", F.floor(F.col("frame") / group).alias("g")).agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with store.open_input_file(f"{path}/{row['bundle']}") as file:
                    for at, packed, plain in seek_table(file, file.size())[row["a"] : row["b"] + 1]:
                        file.seek(at)
                        data, place = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain), 0
                        while place < len(data):
                            fields, payload, place = parse(data, place)
                            sha1, size, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"]), fields["WARC-Type"]
                            if kind == "response" and (digest(payload) != sha1 or len(payload) != size):
                                raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
                            page, first = (re.fullmatch(r"<urn:page:(.*)>", x)[1] if (x := fields.get(k)) else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
                            out.append((page or None, size, sha1, kind, first))
                if len(out) != row["n"]:
                    raise ValueError(f"{row['bundle']} has {len(out)} records where the index has {row['n']}")
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    # Few small rows stand for much reading: dealt to as many tasks as a shuffle has, which adaptive execution leaves so.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.select("bundle", "a", "b", "n").repartition(tasks, "bundle", "a").mapInArrow(run, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    records = read_archive(write_archive(read(spark, sf_dir, "pages"), folder), folder)
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({v} >> {s}) & 31 AS BIGINT) + 1, 1)"
_FOUR = " || ".join(_CHAR.format(v="v", s=s) for s in (15, 10, 5, 0))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
h AS (SELECT p, sha1(p) AS hex FROM (SELECT DISTINCT p FROM p)),
b AS (SELECT p, string_agg({_FOUR}, '' ORDER BY g) AS d FROM (SELECT p, g, CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) AS v FROM h, (SELECT unnest(generate_series(0, 7)) AS g)) GROUP BY p),
f AS (SELECT p, min(page_id) AS first FROM p GROUP BY p)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p JOIN b USING (p) JOIN f USING (p)
"""
