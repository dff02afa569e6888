"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about frame_bytes; a bundle ends with a footer
in the seekable format (a skippable frame with a table of frame sizes), so a reader seeks to one frame
and decompresses nothing else. An index maps each record identifier to its bundle, frame and offset
within the frame. Records are read back along the index alone: each frame is sought and decompressed once, each
record cut out at its offset and checked against its identifier. Bundles are written by the tasks into the shared
folder through pyarrow.fs, whose schemes are local paths, s3 (also as s3a), gs, abfs and, with libhdfs, hdfs; only
bundles named by the index count, so a task that is run again leaves at most an orphan behind.

Of records with equal payloads of at least min_bytes the one with the largest page_id is a response, the
others are revisits that refer to it and carry no payload. Groups are found by SHA-256 with partial
aggregation. The groups of several records go to the pages by broadcast if their measured number is small, so that
pages are not shuffled; beyond that by a join that Spark can split by skew.

Defined results: null html is an empty payload; null page_ids are the smallest, and a group of such rows
alone is all responses, as are repeated rows of the response's page_id; line ends in urls are escaped as
%0D and %0A; an empty table gives no bundles; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, save, table

#: Production parameters.
MIN_BYTES, FRAME_BYTES, BUNDLE_BYTES, LEVEL = 0, 1 << 18, 1 << 26, 3
#: Bytes of groups up to which they are broadcast; bytes of records that a reading task takes.
BROADCAST_BYTES, TASK_BYTES = 16 << 20, 16 << 20
#: Fixed by the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id bigint, bundle string, frame int, frame_start bigint, frame_size bigint, offset int, length int"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the head of the response, with its payload's length and digest."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset, and where it ends."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    got = dict(x.split(": ", 1) for x in lines)
    start, size = end + 4, int(got["Content-Length"])
    block = data[start : start + size]
    cut = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
    payload, length = block[cut + 4 :], int(http["Content-Length"])
    digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = got["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged payload of {got['WARC-Record-ID']}")
    return {
        "page_id": page_of(got["WARC-Record-ID"]),
        "url": got["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": got["WARC-Type"],
        "refers_to": page_of(got["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }, start + size + 4


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    return fs.FileSystem.from_uri(f"s3://{uri[6:]}" if uri.startswith(("s3a://", "s3n://")) else uri)


class BundleWriter:
    """Writes records into frames and frames into bundles; index rows come with the end of a bundle."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.store, self.root = _store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.codec = zstandard.ZstdCompressor(level=LEVEL)
        self.out = None

    def add(self, page_id: int | None, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out, self.frames, self.at, self.rows = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0, []
            self.open, self.size = [], 0
        self.open.append((page_id, data))
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._frame()
            if self.at >= self.bundle_bytes:
                yield from self.close()

    def _frame(self) -> None:
        raw = b"".join(x for _, x in self.open)
        packed = self.codec.compress(raw)
        offset = 0
        for page_id, data in self.open:
            self.rows.append((page_id, f"{self.folder}/{self.name}", len(self.frames), self.at, len(packed), offset, len(data)))
            offset += len(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.at += len(packed)
        self.open, self.size = [], 0

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        if self.open:
            self._frame()
        footer = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(footer)) + footer)
        self.out.close()
        self.out = None
        yield from self.rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    table, at = [], 0
    for packed, raw in struct.iter_unpack("<II", file.read(8 * n)):
        table.append((at, packed, raw))
        at += packed
    return table


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write archives of pages (page_id, url, html); returns the index."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("sha"))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep")
    groups = save(groups, "warc-groups")
    few = groups.count() * 128 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(groups) if few else groups, "sha", "left").select("page_id", "url", "html", "keep")
    kinds = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_size", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            writer = None
            for batch in batches:
                for page_id, url, payload, keep in zip(*(c.to_pylist() for c in batch.columns)):
                    writer = writer or BundleWriter(folder, frame_bytes, bundle_bytes)
                    revisit = keep is not None and page_id != keep
                    yield from writer.add(page_id, record(page_id, url, payload, keep, revisit))
            if writer:
                yield from writer.close()

        yield from _batches(rows(), kinds, 10_000)

    return save(rows.mapInArrow(put, INDEX), "warc-index")


def _records(index: DataFrame, payload: bool) -> DataFrame:
    """The records of index rows, which lie frame by frame within each task."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            codec, bundle, frame, file, data = zstandard.ZstdDecompressor(), None, None, None, b""
            for batch in batches:
                for x in batch.to_pylist():
                    if x["bundle"] != bundle:
                        if file:
                            file.close()
                        bundle, frame = x["bundle"], None
                        store, path = _store(bundle)
                        file = store.open_input_file(path)
                        table = seek_table(file)
                    if x["frame"] != frame:
                        frame = x["frame"]
                        start, packed, size = table[frame]
                        if (start, packed) != (x["frame_start"], x["frame_size"]):
                            raise ValueError(f"index and seek table of {bundle} differ")
                        file.seek(start)
                        data = codec.decompress(file.read(packed), max_output_size=size)
                    got, end = parse(data, x["offset"])
                    if end != x["offset"] + x["length"] or got["page_id"] != x["page_id"]:
                        raise ValueError(f"no record of page {x['page_id']} at its offset")
                    if not payload:
                        got["payload"] = None
                    yield tuple(got.values())
            if file:
                file.close()

        yield from _batches(rows(), kinds, 1_000)

    return index.mapInArrow(get, RECORD)


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the index, each frame decompressed once."""
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    return _records(index.repartition(max(1, tasks), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset"), payload)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the given page_ids, each read from its frame alone."""
    return _records(index.join(ids.select("page_id"), "page_id").sortWithinPartitions("bundle", "frame", "offset"), True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read(index, payload=False).drop("payload", "url")


SQL = None
