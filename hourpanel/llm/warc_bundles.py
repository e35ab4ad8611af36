"""WARC archives as seekable Zstandard bundles.

Each task writes its rows to bundles of its own.  A bundle is a sequence of
independent Zstandard frames, each of some records (about ``FRAME_BYTES``; a
longer record is a frame alone), and ends with a seek table in a skippable
frame, as the seekable format lays down: reading any frame needs the footer
and that frame only.  A bundle that has reached ``BUNDLE_BYTES`` is closed.
The index maps each record to its bundle, its frame, the place of the frame
in the file and the record's place in the frame.

Payloads of at least ``REVISIT_BYTES`` that are equal (by length and SHA-256)
are stored once: the record of the largest page_id is the response, the
others are revisits that name it.

A bundle's name carries the attempt that wrote it, and the index, written by
Spark, lists only bundles of attempts that finished; what a lost attempt left
behind is never read.

Defined cases: null html is an empty payload; a null url gives a record without
target; control characters in a url are percent-encoded; a null page_id sorts
below every other (alone, such rows are responses that are named ``null``);
rows that repeat the response's page_id and payload are responses too; an empty
table gives no bundle and an empty index; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, ship, store

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
# Magic numbers of the seekable format, and the profile of records that repeat a payload.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("page_id {id}, record_type string, bundle string, frame int, frame_offset long, frame_bytes long, "
         "record_offset long, record_bytes long")


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A WARC/1.1 record of an HTTP response; of a revisit, the HTTP head alone."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_name(page_id)}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub('[\x00-\x20\x7f]', lambda m: quote(m[0], safe=''), url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_name(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _name(page_id) -> str:
    return "null" if page_id is None else str(page_id)


def parse(data: bytes) -> dict:
    """Headers of a record, its HTTP headers and payload; raises if lengths or the payload's digest don't hold."""
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    if first != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError("payload and digest differ")
    return {"fields": fields, "payload": payload, "payload_bytes": int(http["Content-Length"]), "digest": digest.hex()}


class BundleWriter:
    """Writes records to one bundle; ``add`` returns the record's frame number and offset in it."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=3)
        self.held: list[bytes] = []
        self.size = self.at = 0
        self.frames: list[tuple[int, int]] = []  # compressed and full bytes
        self.starts: list[int] = []

    def add(self, data: bytes) -> tuple[int, int]:
        if self.held and self.size + len(data) > FRAME_BYTES:
            self._frame()
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def _frame(self):
        packed = self.zstd.compress(b"".join(self.held))
        self.stream.write(packed)
        self.starts.append(self.at)
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.held, self.size = [], 0

    def close(self):
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Reads single records of a bundle through its footer; keeps the frame read last."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd, self.last = file, zstandard.ZstdDecompressor(), (-1, b"")
        size = file.size()
        count, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table = self._read(size - 9 - 8 * count, 8 * count)
        self.frames, at = [], 0
        for packed, full in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, full))
            at += packed

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, full = self.frames[k]
            self.last = k, self.zstd.decompress(self._read(at, packed), max_output_size=full)
        return self.last[1]

    def record(self, frame: int, offset: int, n: int) -> bytes:
        return self.frame(frame)[offset:offset + n]


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, refers_to, revisit) of each row."""
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    big = F.octet_length(html) >= REVISIT_BYTES
    # small payloads get keys that no group has, spread over the partitions
    key = F.when(big, F.concat(F.octet_length(html).cast("string"), F.lit(":"), F.sha2(html, 256))) \
        .otherwise(F.concat(F.lit("small:"), F.xxhash64(pages[id_col], html).cast("string")))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), html.alias("html"), key.alias("key"))
    groups = rows.where(~F.col("key").startswith("small:")).groupBy("key") \
        .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = store(groups.select(F.col("key").alias("k"), "first"), "warc-groups")
    met = rows.join(groups, F.col("key") == F.col("k"), "left")
    revisit = F.col("k").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return met.select("id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives below ``path``; return their index, stored beside them."""
    rows = with_revisits(pages, id_col, url_col, html_col)
    folder = f"{path.rstrip('/')}/bundles"
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        writer, name, waiting = None, "", []

        def close():
            nonlocal writer
            writer.close()
            cols = [list(c) for c in zip(*[(i, kind, name, f, writer.starts[f], writer.frames[f][0], o, n)
                                           for i, kind, f, o, n in waiting])]
            waiting.clear()
            writer = None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            types = [b.schema.field("id").type, pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            for r in range(len(b)):
                i, url, html, refers, revisit = (b[c][r].as_py() for c in ("id", "url", "html", "refers_to", "revisit"))
                data = record(i, url, html.encode(), refers, revisit)
                if writer is None:
                    name = f"bundle-{uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{top}/{name}", compression=None))
                f, o = writer.add(data)
                waiting.append((i, "revisit" if revisit else "response", f, o, len(data)))
                if writer.at + writer.size >= BUNDLE_BYTES:
                    yield close()
        if writer:
            yield close()

    schema = INDEX.format(id=id_type)
    names = [x.split()[0] for x in schema.split(", ")]
    index = ship(rows).mapInArrow(run, schema)
    index.write.parquet(f"{path.rstrip('/')}/index")
    return open_index(rows.sparkSession, path, id_type)


def open_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    return spark.read.schema(INDEX.format(id=id_type)).parquet(f"{path.rstrip('/')}/index")


def read_records(index: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """The records that rows of the index name, read through their bundles' footers.

    Rows of a bundle stand together in the index, so a frame is read once; any
    other selection or order reads the frames it needs.  ``payload`` adds the
    column of stored payloads (empty for revisits).
    """
    folder = f"{path.rstrip('/')}/bundles"
    id_type = index.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        reader, name = None, None
        for b in batches:
            rows = []
            for bundle, frame, at, o, n in zip(*(b[c].to_pylist() for c in ("bundle", "frame", "frame_offset", "record_offset", "record_bytes"))):
                if bundle != name:
                    reader, name = BundleReader(fs.open_input_file(f"{top}/{bundle}")), bundle
                if reader.frames[frame][0] != at:
                    raise ValueError("index and seek table differ")
                got = parse(reader.record(frame, o, n))
                fields = got["fields"]
                rows.append((_id(fields["WARC-Record-ID"]), got["payload_bytes"], got["digest"], fields["WARC-Type"],
                             _id(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), got["payload"]))
            cols = [list(c) for c in zip(*rows)] or [[] for _ in range(7)]
            ids = b.schema.field("page_id").type
            out = [pa.array(cols[0], pa.string()).cast(ids), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                   pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()).cast(ids), pa.array(cols[5], pa.string())]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
            if payload:
                out, names = [*out, pa.array(cols[6], pa.binary())], [*names, "payload"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, url string"
    return ship(index).mapInArrow(run, schema + ", payload binary" * payload)


def _id(urn: str | None) -> str | None:
    name = urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else name


def new_archive(spark: SparkSession) -> str:
    return shared_path(spark, "warc")
