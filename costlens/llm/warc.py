"""WARC archives in seekable Zstandard bundles.

Every page becomes a WARC record.  Of records with equal payloads of
``LEAST_SHARED`` bytes or more, the one with the smallest page id is a
``response``, the others are ``revisit`` records that name it and carry no
payload.  A task groups its records into frames of about ``FRAME`` bytes,
compresses each frame by itself and appends it to a bundle file; a bundle ends
with a seek table (a skippable frame with the compressed and full size of
every frame, and a footer).  The index maps each record to its bundle, frame
and the offset inside the frame's content, so one record is read by
decompressing one frame.

Bundles go to a shared folder through ``pyarrow.fs`` (any store it knows).  A
task names its bundles afresh, and only a task that ended adds rows to the
index, so retried and lost tasks leave files that nothing refers to.

Defined cases: a null html is an empty payload; a null url leaves the header
out, control characters in a url are percent-encoded; a page without id is
never referred to, and revisits an equal payload that has an id; equal rows
with the smallest id are all responses; pages of any length are one record each;
columns other than those named are not read, so their names cannot clash; an
empty table writes no bundle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_folder, importable, written

LEAST_SHARED = 100
#: Content of a frame, and compressed bytes of a bundle, after which the next one begins.
FRAME, BUNDLE = 256 << 10, 128 << 20
#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame) -> DataFrame:
    """``pages`` with ``payload_digest``, ``record_type`` and ``refers_to``."""
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sized = sized.withColumn("payload_digest", F.sha2("html", 256))
    shared = (sized.where(F.octet_length("html") >= LEAST_SHARED).groupBy("payload_digest")
              .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
              .where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n"))
    other = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return sized.join(shared, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("refers_to")).alias("refers_to"))


def _record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:sha256:{digest}>"


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record."""
    block = HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record at the start of ``data``."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4:end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4:]


class BundleWriter:
    """Appends frames to a stream and ends with their seek table."""

    def __init__(self, stream):
        self.stream, self.sizes, self.written = stream, [], 0
        self.compress = zstandard.ZstdCompressor(level=3).compress

    def frame(self, content: bytes) -> None:
        packed = self.compress(content)
        self.stream.write(packed)
        self.sizes.append((len(packed), len(content)))
        self.written += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.stream.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        stream.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", stream.read(8 * count)))
        self.at, start = [], 0
        for packed, full in sizes:
            self.at.append((start, packed, full))
            start += packed

    def frame(self, number: int) -> bytes:
        start, packed, full = self.at[number]
        self.stream.seek(start)
        return zstandard.ZstdDecompressor().decompress(self.stream.read(packed), max_output_size=full)


def write_bundles(planned_pages: DataFrame, folder: str, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Write the archives; the index ``(record_id, page_id, bundle, frame, offset, length)`` as a written table."""
    importable(planned_pages.sparkSession)
    kind = planned_pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        names = ["record_id", "page_id", "bundle", "frame", "offset", "length"]
        writer, name, content, rows = None, "", bytearray(), []

        def close_frame() -> None:
            if content:
                writer.frame(bytes(content))
                content.clear()

        for batch in batches:
            for page_id, url, html, digest, what, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                data = record(page_id, url, html, digest, what, refers_to)
                rows.append((_record_id(page_id, digest), page_id, name, len(writer.sizes), len(content), len(data)))
                content += data
                if len(content) >= frame:
                    close_frame()
                if writer.written >= bundle:
                    close_frame()
                    writer.close()
                    writer = None
            types = [pa.string(), batch.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            rows = []
        if writer is not None:
            close_frame()
            writer.close()

    return written(planned_pages.select("page_id", "url", F.col("html").cast("binary"), "payload_digest", "record_type", "refers_to")
                   .mapInArrow(run, f"record_id string, page_id {kind}, bundle string, frame int, offset bigint, length bigint"),
                   "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` as the archives hold them.

    A payload whose hash is not the recorded one raises an error.  A revisit
    takes the payload's size from the response that it names.
    """
    importable(index.sparkSession)
    kind = index.schema["page_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        store, root = pa.fs.FileSystem.from_uri(folder)
        path = f"{root}/{group.column('bundle')[0].as_py()}"
        out, number, content = [], -1, b""
        with store.open_input_file(path) as stream:
            reader = BundleReader(stream, stream.size())
            for row in group.sort_by([("frame", "ascending"), ("offset", "ascending")]).to_pylist():
                if row["frame"] != number:
                    number, content = row["frame"], reader.frame(row["frame"])
                head, payload = parse(content[row["offset"]:row["offset"] + row["length"]])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Record-ID"] != row["record_id"]:
                    raise ValueError(f"{path}: the index names another record")
                response = head["WARC-Type"] == "response"
                if response and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: payload of {row['record_id']} is damaged")
                out.append((head["WARC-Record-ID"], head.get("X-Page-Id"), len(payload) if response else None, digest,
                            head["WARC-Type"], head.get("WARC-Refers-To")))
        names = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_record"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    read = written(index.groupBy("bundle").applyInArrow(
        run, "record_id string, page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to_record string"),
        "warc-read")
    named = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.max("payload_bytes").alias("full_bytes"))
    wanted = read.where("record_type = 'revisit'").select("refers_to_record").distinct()
    named = named.join(wanted, "refers_to_record", "left_semi")
    return read.join(named, "refers_to_record", "left").select(
        F.col("page_id").cast(kind).alias("page_id"), F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"),
        "payload_digest", "record_type",
        F.regexp_extract("refers_to_record", "^<urn:page:(.*):sha256:", 1).cast(kind).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive every page, then read the archives back."""
    folder = fresh_folder(pages.sparkSession, "warc")
    return read_bundles(write_bundles(planned(pages), folder), folder)
