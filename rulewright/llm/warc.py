"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames of whole records, about ``FRAME`` bytes of records each, and a footer in a
skippable frame: the compressed and plain size of every frame (the public seekable format). The index maps each
record to (path, frame, offset in the frame, length), so one record is read by decompressing one frame.

Of records with equal payloads of at least ``LEAST`` bytes the one with the smallest page id is a response and the others
refer to it. A null payload is empty; a null page id is never referred to and is always a response; repeated
rows of the smallest id are all responses. An empty table gives no bundle and an empty result. Sizes in the seek table have
32 bits, as in the public format, so a record of 4 GiB or more is an error (ValueError).
Tasks write to names of their own, and only files in the written index are read, so repeated tasks do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.shared import file_system, new_path, written

LEAST, FRAME, LEVEL = 100, 1 << 20, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:16]}>"


def page_of(record: str) -> int | None:
    number = record.split(":")[2]
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, which holds no payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = HTTP + (payload if refers_to is None else b"")
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, payload) of the records of one frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        yield head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + int(head["Content-Length"]) + 4


class BundleWriter:
    def __init__(self, sink):
        import zstandard

        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frame, self.size, self.table = [], 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        if self.size + len(record) >= 1 << 32:
            raise ValueError(f"a record of {len(record)} bytes is too long for the seek table")
        place = len(self.table), self.size, len(record)
        self.frame.append(record)
        self.size += len(record)
        if self.size >= FRAME:
            self.flush()
        return place

    def flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.sink.write(packed)
            self.table.append((len(packed), self.size))
            self.frame, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE))


class BundleReader:
    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.size()
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        source.seek(end - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", source.read(8 * n)):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.source.seek(at)
        return self.zstd.decompress(self.source.read(packed), max_output_size=plain)


def with_references(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Only slim rows meet by digest, after map-side minima."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = written(rows.where(F.octet_length("payload") >= LEAST).select("page_id", "digest"), "digests")
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = long.join(written(firsts, "first-pages"), "digest").where("page_id <> refers_to").distinct()
    return rows.join(written(revisits, "revisits"), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_bundles(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes (page_id, url, payload, digest, refers_to) and returns the index (record, path, frame, offset, length)."""
    folder = folder or new_path(records.sparkSession, "warc")

    def run(batches):
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.zst"
        path = name if store.type_name == "local" else folder + name[len(root) :]
        sink = writer = None
        for batch in batches:
            if batch.num_rows and writer is None:
                sink = store.open_output_stream(name, compression=None)
                writer = BundleWriter(sink)
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256).to_pydict()
                out = []
                for page, url, payload, digest, refers in zip(*(rows[c] for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    out.append((record_id(page, digest), path, *writer.add(record_bytes(page, url, payload.encode(), digest, refers))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["record", "path", "frame", "offset", "length"])
        if writer is not None:
            writer.close()
            sink.close()

    return written(records.mapInArrow(run, "record string, path string, frame int, offset long, length long"), "warc-index")


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record of the bundles.

    A response's digest and length come from the payload that was read and must agree with its header.
    """
    paths = written(index.select("path").distinct(), "warc-paths")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]

    def row(head: dict, payload: bytes) -> tuple:
        digest, size, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"]), head["WARC-Type"]
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
        return (page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind, refers) + ((payload,) if with_payload else ())

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = file_system(path)
                with store.open_input_file(name) as source:
                    bundle = BundleReader(source)
                    for k in range(len(bundle.frames)):
                        rows = [row(*x) for x in parse_records(bundle.frame(k))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return paths.repartition(max(1, paths.count())).mapInArrow(run, schema)


def read_record(path: str, frame: int, offset: int, length: int) -> tuple[dict, bytes]:
    """(headers, payload) of one record by its place in the index: one frame is read."""
    store, name = file_system(path)
    with store.open_input_file(name) as source:
        return next(parse_records(BundleReader(source).frame(frame)[offset : offset + length]))
