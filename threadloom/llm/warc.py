"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is its
frames followed by a seek table in a skippable frame (the public seekable
format), so any Zstandard tool reads it whole and a reader with the index
fetches one record by decompressing one frame. The index maps each record
identifier to frame, offset within the frame and length.

Bundles and their index are rows of a Parquet table in the shared folder: Spark
commits them, so a lost executor or a task run twice leaves one copy. ``export``
writes them as ``.warc.zst`` files.

Of records with equal payloads the one with the largest page_id is a response,
the others revisit it; they carry headers only. Groups are found over
digests and lengths; payloads move only if the table of groups is too large to be
broadcast, which Spark decides by its size on disk.

Defined cases: a null html is an empty payload, a null url an empty target;
control characters of a url are percent-encoded; a null page_id never is the
response of others if any id is not null, and its identifier says ``null``;
rows that share the largest id are all responses; very long payloads are records of a frame of their own; other columns,
whatever their names, are ignored; an empty table makes no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Kept, keep

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 16 << 20, 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_URN = "urn:threadloom:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENTRY = [("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
BUNDLES = "bundle_id string, archive binary, entries array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<{_URN}{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    tail = identifier.strip("<>").removeprefix(_URN)
    return None if tail == "null" else int(tail)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; a revisit keeps the HTTP head, whose Content-Length is that of the payload."""
    target = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record that begins at an offset."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return fields, data[start : start + size], start + size + 4


class BundleWriter:
    def __init__(self):
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.entries: list[dict] = []
        self.bytes = 0
        self._raw, self._codec = bytearray(), zstandard.ZstdCompressor(level=LEVEL)

    def add(self, identifier: str, record: bytes) -> None:
        self.entries.append({"record_id": identifier, "frame": len(self.frames), "offset": len(self._raw), "length": len(record)})
        self._raw += record
        if len(self._raw) >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._raw:
            self.frames.append(self._codec.compress(bytes(self._raw)))
            self.sizes.append(len(self._raw))
            self.bytes += len(self.frames[-1])
            self._raw = bytearray()

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        table += struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    width = 12 if flags & 0x80 else 8
    begin = len(archive) - 9 - width * count
    if magic != _SEEKABLE or struct.unpack("<II", archive[begin - 8 : begin]) != (_SKIPPABLE, width * count + 9):
        raise ValueError("no seek table")
    out, at = [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", archive, begin + width * k)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(archive: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=size)


def read_record(archive: bytes, entry: dict) -> tuple[dict[str, str], bytes]:
    """One record by its index entry; decompresses its frame only."""
    data = read_frame(archive, seek_table(archive)[entry["frame"]])
    fields, block, end = parse_record(data, entry["offset"])
    if end - entry["offset"] != entry["length"] or fields["WARC-Record-ID"] != entry["record_id"]:
        raise ValueError("the index does not fit the archive")
    return fields, block


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Kept:
    """The table of bundles over all pages; payloads shorter than ``min_bytes`` are never revisited."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("key", F.concat_ws("-", F.sha2("payload", 256), F.length("payload").cast("string")))
    groups = rows.filter(F.length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null").select("key", "response")
    groups = keep(groups, "groups")
    typed = rows.join(groups, "key", "left").select("page_id", "url", "payload", "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def bundle() -> pa.RecordBatch:
            cells = [pa.array([f"{part:06d}-{made:06d}"]), pa.array([writer.finish()], pa.binary()), pa.array([writer.entries], pa.list_(pa.struct(_ENTRY)))]
            return pa.RecordBatch.from_arrays(cells, names=["bundle_id", "archive", "entries"])

        for b in batches:
            for page_id, url, payload, response in zip(*b.columns, strict=True):
                page_id, response = page_id.as_py(), response.as_py()
                revisit = response is not None and page_id != response
                writer.add(record_id(page_id), make_record(page_id, url.as_py(), payload.as_py(), response, revisit, date))
                if writer.bytes >= BUNDLE_BYTES:
                    yield bundle()
                    made, writer = made + 1, BundleWriter()
        if writer.entries:
            yield bundle()

    return Kept(typed.mapInArrow(run, BUNDLES), "warc")


def read_archives(bundles: DataFrame) -> DataFrame:
    """Every record read back through the seek tables; digests are checked against payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for k in range(b.num_rows):
                archive, entries = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                at = 0
                for number, frame in enumerate(seek_table(archive)):
                    data, rows = read_frame(archive, frame), []
                    while at < len(entries) and entries[at]["frame"] == number:
                        fields, block, end = parse_record(data, entries[at]["offset"])
                        if end - entries[at]["offset"] != entries[at]["length"]:
                            raise ValueError("the index does not fit the archive")
                        rows.append(_row(fields, block))
                        at += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)
                if at != len(entries):
                    raise ValueError("the index names frames that the archive lacks")

    return bundles.select("archive", "entries").mapInArrow(run, RECORDS)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(fields["WARC-Record-ID"]), size, digest, kind, refers


def export(bundles: DataFrame, uri: str) -> DataFrame:
    """Write each bundle as ``<bundle_id>.warc.zst`` below a URI that all executors reach; bundle_id and path.

    A file appears under its name only when whole, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for b in batches:
            paths = []
            for name, archive in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = f"{root}/{name}.warc.zst"
                part = f"{path}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as f:
                    f.write(archive.as_buffer())
                store.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], names=["bundle_id", "path"])

    return bundles.select("bundle_id", "archive").mapInArrow(run, "bundle_id string, path string")
