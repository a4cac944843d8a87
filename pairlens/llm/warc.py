"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle ends with a seek table in a skippable frame (the
published seekable format: sizes of each frame, their number, a magic number), so any reader of Zstandard reads a bundle
whole, and one that knows the table goes straight to a frame. The index, a table, maps record identifiers to bundle, frame
and the record's place in the decompressed frame.

Tasks write bundles themselves, under names of their own, into the shared folder; the index names those of successful
attempts only, so what a lost executor left behind is never read.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import settle, shuffle_width, slices
from pairlens.session import scratch

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 30
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def classify(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Add payload (binary), record_type and refers_to to ``pages(page_id, url, html)``.

    Of payloads of at least ``least_bytes`` that are equal, the row with the largest page_id is the response and the others
    revisit it. Rows that repeat that page_id with that payload are responses too; rows with a null page_id revisit, or
    are responses if no equal payload has an id. A null html is an empty payload; shorter payloads are all responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("_key", F.when(F.length("payload") >= least_bytes, F.sha2("payload", 256)))
    groups = keyed.where("_key is not null").groupBy("_key").agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _keep is not null").drop("_n")
    # the groups are written, so that the join can be split at a payload that many pages share, and shorter pages, which
    # meet none, are dealt by their own identity and not all to one task
    own = F.coalesce("_key", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = keyed.withColumn("_key", own).join(settle(groups, "warc-groups"), "_key", "left")
    revisit = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_keep")).alias("refers_to"))


def _record_id(page: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}'.encode() + digest).digest()[:16], version=8 if hasattr(uuid, 'uuid8') else 5)}>"


def record(page: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """A record and its identifier. A revisit holds the HTTP header of the payload, not the payload."""
    digest = hashlib.sha1(payload).digest()
    name = _record_id(page, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", uri or f"urn:page:{page}"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Type", "application/http;msgtype=response"),
    ]
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if url is None:
        fields.append(("X-No-URI", "1"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match")
    return fields, rest[:size]


class BundleWriter:
    """One bundle: frames of about ``frame_bytes``, then the seek table. A larger record has a frame of its own."""

    def __init__(self, store: fs.FileSystem, path: str, frame_bytes: int = FRAME_BYTES):
        self._out, self._most = store.open_output_stream(path, compression=None), frame_bytes
        self._compress = zstandard.ZstdCompressor(level=3).compress
        self._held, self._size, self._sizes, self.written = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame."""
        if self._held and self._size + len(data) > self._most:
            self._flush()
        place = len(self._sizes), self._size
        self._held.append(data)
        self._size += len(data)
        return place

    def _flush(self) -> None:
        if self._held:
            frame = self._compress(b"".join(self._held))
            self._out.write(frame)
            self._sizes.append((len(frame), self._size))
            self.written += len(frame)
            self._held, self._size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._out.close()


class BundleReader:
    """Frames of one bundle by number; the last one read is kept."""

    def __init__(self, store: fs.FileSystem, path: str):
        self._file = store.open_input_file(path)
        size = self._file.size()
        frames, _, magic = struct.unpack("<IBI", self._file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = self._file.read_at(8 * frames, size - 9 - 8 * frames)
        self._spots, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self._spots.append((at, packed, plain))
            at += packed
        self._decompress, self._last = zstandard.ZstdDecompressor().decompress, (-1, b"")

    def __len__(self) -> int:
        return len(self._spots)

    def frame(self, number: int) -> bytes:
        if self._last[0] != number:
            at, packed, plain = self._spots[number]
            self._last = number, self._decompress(self._file.read_at(packed, at), max_output_size=plain)
        return self._last[1]

    def close(self) -> None:
        self._file.close()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write ``classify``'d rows as bundles below ``folder``, one or more a task; returns the written index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        bundle, name = None, ""
        for batch in slices(batches, "payload"):
            out = []
            for page, url, payload, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                if bundle and bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
                if not bundle:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(store, f"{root}/{name}")
                    info = b"software: seekable bundles\r\nformat: WARC File Format 1.1\r\n"
                    bundle.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                key, data = record(page, url, payload, kind, refers, date)
                frame, offset = bundle.add(data)
                out.append((key, page, name, frame, offset, len(data)))
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return settle(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` rows name: identifiers, type, digest (hex) and length from the headers, and the payload.

    Frames, not bundles, are dealt over tasks, and a frame is decompressed once in its task. A revisit's payload is null.
    """
    width = shuffle_width(index.sparkSession)
    dealt = index.repartition(width, "bundle", F.expr("frame div 8")).sortWithinPartitions("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        reader, opened = None, None
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            out, held = [], 0
            for name, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                if name != opened:
                    if reader:
                        reader.close()
                    reader, opened = BundleReader(store, f"{root}/{name}"), name
                fields, block = parse(reader.frame(frame)[offset : offset + length])
                head, _, payload = block.partition(b"\r\n\r\n")
                full = int(re.search(rb"Content-Length: (\d+)", head)[1])
                page, refers = (int(fields[f]) if f in fields else None for f in ("X-Page-ID", "X-Refers-To-Page"))
                kind = fields["WARC-Type"]
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                out.append((fields["WARC-Record-ID"], page, None if "X-No-URI" in fields else fields["WARC-Target-URI"], kind, refers, digest, full, payload if kind == "response" else None))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if reader:
            reader.close()

    return dealt.select("bundle", "frame", "offset", "length").mapInArrow(run, RECORD_SCHEMA)


def archive_folder(spark) -> str:
    """A new folder for bundles in the shared folder of the session."""
    return scratch(spark, "warc")
