"""BAM as a source: files are split between tasks at any byte, and a region is read through the index alone.

A split begins with the first record that starts in one of its blocks.  Blocks are found by their header; a record's
start is known from the file's header, from the index, or by testing each place for a record whose every field is
possible (sizes, names, references, operations that add up to the sequence).  A record that goes on into further blocks
is read to its end by the task that began it.  With regions the .bai names the chunks of blocks that may hold them, and
nothing else is opened.  Files are opened by pyarrow: paths, file:, hdfs:, s3: and gs: URIs.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 32 << 20
#: Records are handed on in batches of so many rows or bases at most.
ROWS, BASES = 4096, 8 << 20
_LETTERS = "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _LETTERS for b in _LETTERS]
_TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_SCHEMA = "read_name string, flag int, chrom string, ref_start bigint, mapq int, cigar array<struct<op:int,len:int>>, seq string, md string, file string, at bigint"


def _filesystem(uri: str):
    from pyarrow import fs

    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _block_size(head: bytes) -> int | None:
    """Bytes of the block that begins here, None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Blocks:
    """The decompressed bytes of a file from one of its blocks on; `opened` lists the blocks that were read."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.next = file, size, start
        self.data, self.starts, self.dropped, self.opened = bytearray(), [], 0, []  # starts: (place in all data, block's offset)

    def more(self) -> bool:
        if self.next >= self.size:
            return False
        self.file.seek(self.next)
        head = self.file.read(min(1 << 10, self.size - self.next))
        n = _block_size(head)
        if n is None:
            raise ValueError(f"no block at byte {self.next}")
        self.file.seek(self.next)
        raw = self.file.read(n)
        skip = 12 + struct.unpack_from("<H", raw, 10)[0]
        self.starts.append((self.dropped + len(self.data), self.next))
        self.opened.append(self.next)
        self.data += zlib.decompress(raw[skip:-8], -15)
        self.next += n
        return True

    def need(self, upto: int) -> bool:
        """Whether there are data up to a place, after reading on."""
        while self.dropped + len(self.data) < upto:
            if not self.more():
                return False
        return True

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.dropped : at - self.dropped + n])

    def virtual(self, at: int) -> int:
        """Offset of the block that holds a place, and the place within it, as one number."""
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        return self.starts[0][1] << 16 | at - self.starts[0][0]

    def drop(self, before: int) -> None:
        if before - self.dropped > 1 << 20:
            del self.data[: before - self.dropped]
            self.dropped = before


def header(blocks: Blocks) -> tuple[list[str], int]:
    """Names of the references, and where the records begin."""
    if not blocks.need(12) or blocks.get(0, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack("<i", blocks.get(4, 4))[0]
    blocks.need(at + 4)
    names, n = [], struct.unpack("<i", blocks.get(at, 4))[0]
    at += 4
    for _ in range(n):
        blocks.need(at + 4)
        size = struct.unpack("<i", blocks.get(at, 4))[0]
        blocks.need(at + 8 + size)
        names.append(blocks.get(at + 4, size - 1).decode())
        at += 8 + size
    return names, at


def _possible(blocks: Blocks, at: int, n_refs: int) -> bool:
    """Whether a record may begin at a place."""
    if not blocks.need(at + 36):
        return False
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack("<iiiBBHHHiiii", blocks.get(at, 36))
    if not (32 <= size < 1 << 28 and -1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and l_name and 0 <= l_seq and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size):
        return False
    if not blocks.need(at + 36 + l_name + 4 * n_cigar):
        return False
    name = blocks.get(at + 36, l_name)
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return False
    ops = struct.unpack(f"<{n_cigar}I", blocks.get(at + 36 + l_name, 4 * n_cigar))
    return all(x & 15 <= 8 for x in ops) and (not ops or not l_seq or sum(x >> 4 for x in ops if x & 15 in (0, 1, 4, 7, 8)) == l_seq)


def _tag(data: bytes, at: int, wanted: bytes) -> str | None:
    """The text of a tag."""
    while at + 3 <= len(data):
        name, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if name == wanted:
                return data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + _TAG_SIZE[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += _TAG_SIZE[kind]
    return None


def _record(data: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    seq = "".join(map(_PAIRS.__getitem__, data[at : at + (l_seq + 1) // 2]))[:l_seq] or None
    md = _tag(data, at + (l_seq + 1) // 2 + l_seq, b"MD")
    return data[32 : 31 + l_name].decode(), flag, names[ref] if ref >= 0 else "*", pos if not flag & 4 else None, mapq, [{"op": x & 15, "len": x >> 4} for x in ops], seq, md


def _bins(begin: int, end: int) -> set[int]:
    """fixed values: bins of the index that overlap a region, by the format's five levels."""
    out = {0}
    for first, shift in ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)):
        out.update(range(first + (begin >> shift), first + ((end - 1) >> shift) + 1))
    return out


def chunks(index: bytes, regions: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Virtual offsets (from, to) of all that may hold records of regions (reference's number, start, end), joined where they touch."""
    at, refs = 8, []
    for _ in range(struct.unpack_from("<i", index, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        n, at = struct.unpack_from("<i", index, at)[0], at + 4
        for _ in range(n):
            number, k = struct.unpack_from("<Ii", index, at)
            flat = struct.unpack_from(f"<{2 * k}Q", index, at + 8)
            bins[number], at = list(zip(flat[::2], flat[1::2], strict=True)), at + 8 + 16 * k
        n = struct.unpack_from("<i", index, at)[0]
        refs.append((bins, struct.unpack_from(f"<{n}Q", index, at + 4)))
        at += 4 + 8 * n
    found = []
    for ref, begin, end in regions:
        bins, linear = refs[ref]
        least = linear[min(begin >> 14, len(linear) - 1)] if linear else 0
        found += [(max(a, least), b) for number in _bins(begin, end) for a, b in bins.get(number, []) if b > least]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Part(InputPartition):
    path: str
    begin: int  # virtual offset of a record, or a byte of the file << 16 where `exact` is false
    end: int
    exact: bool


class Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.split = int(options.get("split", SPLIT))
        self.regions = [(c, int(a), int(b)) for c, a, b in (re.fullmatch(r"(.+):(\d+)-(\d+)", x).groups() for x in filter(None, options.get("regions", "").split(",")))]
        self.pruned = "regions" in options

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            fs, name = _filesystem(path)
            size = fs.get_file_info(name).size
            with fs.open_input_file(name) as file:
                blocks = Blocks(file, size, 0)
                names, first = header(blocks)
                blocks.need(first + 1)
                first = blocks.virtual(first) if blocks.starts else 0
            if self.pruned:
                with fs.open_input_file(f"{name}.bai") as file:
                    index = file.read()
                out += [Part(path, a, b, True) for a, b in chunks(index, [(names.index(c), a, b) for c, a, b in self.regions if c in names and b > a])]
                continue
            cuts = [*range(0, size, self.split), size]
            out += [Part(path, first if not a else a << 16, b << 16, not a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # where there is no part at all
            return
        fs, name = _filesystem(part.path)
        size = fs.get_file_info(name).size
        cigar = pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))
        schema = pa.schema([("read_name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("ref_start", pa.int64()), ("mapq", pa.int32()), ("cigar", cigar), ("seq", pa.string()), ("md", pa.string()), ("file", pa.string()), ("at", pa.int64())])
        with fs.open_input_file(name) as file:
            names = header(Blocks(file, size, 0))[0]
            rows, held = [], 0
            for record, at in records(file, size, part, names):
                row = _record(record, names)
                if self.pruned and not self._wanted(row):
                    continue
                rows.append((*row, part.path, at))
                held += len(record)
                if len(rows) == ROWS or held > BASES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _wanted(self, row: tuple) -> bool:
        if row[3] is None:
            return False
        end = row[3] + (sum(x["len"] for x in row[5] if x["op"] in (0, 2, 3, 7, 8)) or 1)
        return any(c == row[2] and row[3] < b and end > a for c, a, b in self.regions)


def records(file, size: int, part: Part, names: list[str], opened: list | None = None) -> Iterator[tuple[bytes, int]]:
    """`(record, virtual offset)` of all that begin in a part."""
    start = part.begin >> 16
    if not part.exact:
        start = _next_block(file, size, start)
    if start >= size or start << 16 >= part.end:
        return
    blocks = Blocks(file, size, start)
    at = part.begin & 0xFFFF if part.exact else 0
    blocks.need(at + 1)
    if not part.exact:
        while not _possible(blocks, at, len(names)):
            at += 1
            if not blocks.need(at + 36) or blocks.virtual(at) >= part.end:
                return
    while blocks.need(at + 4) and blocks.virtual(at) < part.end:
        n = struct.unpack("<i", blocks.get(at, 4))[0]
        if not blocks.need(at + 4 + n):
            raise ValueError("the file ends within a record")
        yield blocks.get(at + 4, n), blocks.virtual(at)
        at += 4 + n
        blocks.drop(at)
    if opened is not None:
        opened += blocks.opened


def _next_block(file, size: int, start: int) -> int:
    """Offset of the first block at or after a byte: one whose next block, if any, is one too."""
    file.seek(start)
    data = file.read(min(size - start, 3 << 16))
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n = _block_size(data[at : at + (1 << 10)])
        if n and (start + at + n == size or _block_size(data[at + n : at + n + (1 << 10)])):
            return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lacuna_bam"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_bam(spark: SparkSession, path: str, read_type: str, regions: list[tuple[str, int, int]] | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files (several by commas), unmapped ones too, with the columns of `files.read_sam`.

    With regions (chrom, start, end) only mapped records that overlap one of them, through `path.bai`; a record in two
    regions comes once.  aln_no numbers a read's records in the order of the file, of those that are read.
    """
    from lacuna.shipping import ship
    from lacuna.sources.files import aligned_columns

    ship(spark)
    spark.dataSource.register(Bam)
    reader = spark.read.format("lacuna_bam").option("path", path).option("split", str(split))
    if regions is not None:
        reader = reader.option("regions", ",".join(f"{c}:{a}-{b}" for c, a, b in regions))
    rows, flag = reader.load(), F.col("flag")
    named = rows.select(
        "read_name", F.lit(read_type).alias("read_type"), "flag", "chrom", "ref_start", "mapq", "cigar", "seq", "md",
        flag.bitwiseAND(4).cast("boolean").alias("is_unmapped"), flag.bitwiseAND(256).cast("boolean").alias("is_secondary"), flag.bitwiseAND(2048).cast("boolean").alias("is_supplementary"),
        F.row_number().over(Window.partitionBy("read_name").orderBy("file", "at")).alias("aln_no"),
    )
    return aligned_columns(named)
