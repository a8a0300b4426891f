"""Operator 4: WARC archives, written and read back sequentially.

``write_archives`` turns page rows into rolled ``.warc.gz`` files, one gzip member
a record, in a folder all executors share.  ``read_archives`` walks the files in
order: incremental zlib decompression finds each member's end, content-length
framing finds the block, and both SHA-1 digests are verified (``verified``; a revisit's
payload is not there, so its block digest alone is).  Payloads are equal where
their SHA-256 is.

Defined results: null html is an empty payload; null url is written as an empty
target; rows that share the largest page_id of a payload are all responses; a null
page_id never becomes a referred-to record unless the whole group has none (then
all its rows are responses).  An empty table gives no archives and no rows.  Other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload binary, verified boolean"
)
CHUNK = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:siftmark:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    digits = urn.rstrip(">").rpartition(":")[2]
    return int(digits) if digits else None


def encode_record(page_id, url, payload: bytes, refers_to=None, revisit=False, level: int = 6) -> bytes:
    """One WARC/1.1 record as one gzip member."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    # a header line can't hold line ends
    target = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.insert(4, f"WARC-Refers-To: {_urn(refers_to)}")
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed step by step."""
    left = b""
    while True:
        if not left:
            left = stream.read(CHUNK)
            if not left:
                return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not left:
                left = stream.read(CHUNK)
                if not left:
                    raise ValueError("the archive ends within a gzip member")
            parts.append(unpack.decompress(left))
            left = unpack.unused_data if unpack.eof else b""
        yield b"".join(parts)


def decode_record(raw: bytes) -> dict:
    """Headers, block and digests of one record; a wrong length or digest raises."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError("content length and record end disagree")
    if fields.get("warc-block-digest") != f"sha1:{sha1_base32(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("payload digest or length differs")
    refers = fields.get("warc-refers-to")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(refers) if refers else None,
        "payload": payload if kind == "response" else None,
        "verified": kind == "response",
    }


def _with_references(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Add ``_keeper``: the page_id whose record holds the payload, null where it stands alone."""
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_body"))
    # the archives' digests are SHA-1, but which payloads are equal is not left to it
    pages = pages.withColumn("_sha", F.sha2("_body", 256))
    shared = (
        pages.filter(F.octet_length("_body") >= min_bytes)
        .groupBy("_sha")
        .agg(F.count("*").alias("_n"), F.max("page_id").alias("_keeper"))
        .filter("_n > 1")
        .select("_sha", "_keeper")
    )
    # the table's true size is known once it is stored: the planner broadcasts it only
    # below its own threshold and otherwise runs a sort-merge join whose skew AQE splits
    return pages.join(stored(shared, "shared"), "_sha", "left")


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write one record a row; returns the manifest (path, records, bytes), already stored.

    Payloads of ``min_bytes`` or more that repeat are written once, as the response
    with the largest page_id, and revisited by the others.  A retried task writes
    files of other names, and only files in the manifest are read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, done, run = None, [], uuid.uuid4().hex
        for batch in batches:
            keys, urls, bodies, keepers = (batch.column(c) for c in ("page_id", "url", "_body", "_keeper"))
            for i in range(batch.num_rows):
                page, keeper = keys[i].as_py(), keepers[i].as_py()
                revisit = keeper is not None and keeper != page
                record = encode_record(page, urls[i].as_py(), bodies[i].as_py(), keeper, revisit, level)
                if out is None or done[-1][2] + len(record) > roll_bytes and done[-1][1]:
                    if out is not None:
                        out.close()
                    done.append([f"{root}/{run}-{len(done):05d}.warc.gz", 0, 0])
                    out = files.open_output_stream(done[-1][0])
                out.write(record)
                done[-1][1] += 1
                done[-1][2] += len(record)
        if out is not None:
            out.close()
            paths, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    rows = _with_references(pages, min_bytes)
    manifest = rows.select("page_id", "url", "_body", "_keeper").mapInArrow(write, MANIFEST)
    manifest = stored(manifest, "manifest")
    manifest._siftmark_folder = folder
    return manifest


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``manifest``, in file order, digests verified."""
    files = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with store.open_input_stream(path) as stream:
                    for raw in members(stream):
                        row = decode_record(raw)
                        size += row["payload_bytes"] if keep_payload else 200
                        row["payload"] = row["payload"] if keep_payload else None
                        rows.append(row)
                        seen += 1
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{path} holds {seen} records; {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_()),
    ])
    return manifest.select("path", "records").repartition(max(1, files)).mapInArrow(read, RECORDS)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    manifest = write_archives(pages, min_bytes=min_bytes)
    return read_archives(pages.sparkSession, manifest, manifest._siftmark_folder, keep_payload)
