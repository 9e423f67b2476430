"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of a group of whole WARC/1.1 records, and a seek table
in the skippable frame that the Zstandard seekable format puts last.  The manifest maps every record to its
bundle, frame and offset within the frame, so one record is read by decompressing one frame.

Records with equal payloads: the one with the largest id is a `response`, the others are `revisit` records that
keep the HTTP head (with the payload's length) and its digest, but not the payload.  Payloads below `min_bytes`
are always responses.

Payloads are shuffled once, by digest, to meet the id that revisits refer to; rows of a digest that has more than
1/HOT of all rows are dealt out by id instead.  A bundle's name holds the attempt that wrote it, so a second attempt
never replaces what a committed manifest points into; bundles of lost attempts are in no manifest.  Reading takes the
frames from the bundles' seek tables and deals them to tasks by size.

Null html is an empty payload; a null url leaves out WARC-Target-URI; a null id is written as `null` and, among
equal payloads, loses to any other.  Rows with the same id and payload as the largest are all responses.  A payload
of any length is one record of one frame.  Empty tables give no bundles and no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import HOT, Replacing, arrow_schema, filesystem, join_hot, new_folder, read_range, rows_of, to_table

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: Unpacked bytes that one task reads back.
READ_BYTES = 16 << 20
# fixed values of the Zstandard seekable format: magic of the skippable frame that holds the table, and of its footer
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

MANIFEST = "page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint, offset bigint, length bigint"
FRAMES = "bundle string, frame int, frame_start bigint, frame_bytes bigint, raw_bytes bigint"
DIGESTS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(null|-?\d+)>", urn)[1]
    return None if found == "null" else int(found)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset of a frame, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    start, length = end + 4, int(head["Content-Length"])
    http, _, payload = data[start : start + length].partition(b"\r\n\r\n")
    revisit = head["WARC-Type"] == "revisit"
    return {
        "page_id": _id(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": head["WARC-Type"],
        "refers_to": _id(head["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }, start + length + 4


class BundleWriter:
    """Frames of about FRAME_BYTES, then the seek table."""

    def __init__(self, uri: str):
        import zstandard

        self.uri, self.out, self.packer = uri, Replacing(uri), zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.pending, self.size, self.frames, self.start, self.entries, self.raw = [], 0, [], 0, [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.entries.append((page_id, len(self.frames), self.size, len(record)))
        self.pending.append(record)
        self.size += len(record)
        self.raw += len(record)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            data = self.packer.compress(b"".join(self.pending))
            self.out.write(data)
            self.frames.append((self.start, len(data), self.size))
            self.start += len(data)
            self.pending, self.size = [], 0

    def close(self) -> list[tuple]:
        """Rows of the manifest."""
        self._flush()
        table = b"".join(struct.pack("<II", packed, raw) for _, packed, raw in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return [(p, self.uri, k, *self.frames[k][:2], at, n) for p, k, at, n in self.entries]


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """`(start, packed bytes, raw bytes)` of a bundle's frames, from its last bytes alone."""
    files, path = filesystem(uri)
    size = files.get_file_info(path).size
    count, _, magic = struct.unpack("<IBI", read_range(uri, size - 9, 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError(f"{uri} has no seek table")
    table, out, at = read_range(uri, size - 9 - 8 * count, 8 * count), [], 0
    for k in range(count):
        packed, raw = struct.unpack_from("<II", table, 8 * k)
        out.append((at, packed, raw))
        at += packed
    return out


def read_frame(uri: str, start: int, packed: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(read_range(uri, start, packed))


def read_one(uri: str, start: int, packed: int, offset: int) -> dict:
    return parse_record(read_frame(uri, start, packed), offset)[0]


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the bundles and returns their manifest.  The manifest is itself written, so the bundles are written once."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.unhex(F.sha1(body))
    rows = pages.select("page_id", "url", body.alias("html"), digest.alias("digest"))
    firsts = to_table(pages.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{folder}/firsts")
    hot = firsts.filter(F.col("n") * HOT > pages.count())
    joined = join_hot(rows, firsts.select("digest", "first"), hot.select("digest", "first"), "digest", F.col("page_id")).select("page_id", "url", "html", "first")

    def write(batches):
        from pyspark import TaskContext

        task, number, bundle, schema = TaskContext.get(), 0, None, arrow_schema(MANIFEST)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        manifest = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for page_id, url, html, first in rows_of(batch, "page_id", "url", "html", "first"):
                payload = html.encode()
                revisit = first is not None and first != page_id and len(payload) >= min_bytes
                bundle = bundle or BundleWriter(f"{folder}/{name}-{number:04d}.warc.zst")
                bundle.add(page_id, to_record(page_id, url, payload, first, revisit))
                if bundle.raw >= BUNDLE_BYTES:
                    yield manifest(bundle.close())
                    bundle, number = None, number + 1
        if bundle:
            yield manifest(bundle.close())

    return to_table(joined.mapInArrow(write, MANIFEST), f"{folder}/manifest")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles (rows with `bundle`, repeated ones once), frame by frame; frames, not files, are dealt out to tasks."""

    def frames(batches):
        schema = arrow_schema(FRAMES)
        for batch in batches:
            for (uri,) in rows_of(batch, "bundle"):
                yield pa.RecordBatch.from_pylist([{"bundle": uri, "frame": k, "frame_start": at, "frame_bytes": packed, "raw_bytes": raw} for k, (at, packed, raw) in enumerate(seek_table(uri))], schema=schema)

    def read(batches):
        schema = arrow_schema(RECORDS)
        for batch in batches:
            for uri, start, packed in rows_of(batch, "bundle", "frame_start", "frame_bytes"):
                data, at, out = read_frame(uri, start, packed), 0, []
                while at < len(data):
                    record, at = parse_record(data, at)
                    out.append(record)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = bundles.select("bundle").distinct().mapInArrow(frames, FRAMES)
    size = found.agg(F.sum("raw_bytes")).first()[0] or 0
    return found.repartition(max(1, min(-(-size // READ_BYTES), 100_000))).mapInArrow(read, RECORDS)


def op10_warc_bundles(spark, sf_dir: str) -> DataFrame:
    manifest = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    records = read_bundles(manifest)

    def check(batches):
        for batch in batches:
            for digest, payload in rows_of(batch, "payload_digest", "payload"):
                if payload is not None and digest32(payload) != digest:
                    raise ValueError("a payload differs from its digest")
            yield batch.select(DIGESTS.replace(", ", " ").split()[::2])

    return records.mapInArrow(check, DIGESTS)


OP10_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex, strlen(coalesce(html, '')) as n,
         max(page_id) over (partition by sha1(coalesce(html, ''))) as first
  from pages
), h as (
  select *, [instr('0123456789abcdef', hex[i]) - 1 for i in range(1, 41)] || [0] as v from p
)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((v[(5 * i) // 4 + 1] * 16 + v[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31 as bigint) + 1, 1) for i in range(0, 32)], '') as payload_digest,
       case when coalesce(page_id, -1) = coalesce(first, -1) then 'response' else 'revisit' end as record_type,
       case when coalesce(page_id, -1) = coalesce(first, -1) then null else first end as refers_to
from h
"""
