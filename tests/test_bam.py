"""BAM files written here, record by record, are read back at any split and by region through their index."""

import random
import struct
import zlib

import pytest

from lacuna.sources import bam

REFS = [("chr1", 300_000), ("chr2", 50_000)]


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(a, b):
    for first, shift in ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26)):
        if a >> shift == (b - 1) >> shift:
            return first + (a >> shift)
    return 0


def write_bam(path, rows, piece):
    """rows (name, flag, ref, pos, mapq, ops, seq, md) in order; piece is the bytes of a block."""
    head = b"@HD\tVN:1.6\n"
    data = bytearray(b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(REFS)))
    for name, size in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    spans = []
    for name, flag, ref, pos, mapq, ops, seq, md in rows:
        end = pos + sum(n for op, n in ops if op in (0, 2))
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, bin_of(max(pos, 0), max(end, 1)), len(ops), flag, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for op, n in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + b"\xff" * len(seq)
        body += b"NMi" + struct.pack("<i", 1) + b"ZZBc" + struct.pack("<i", 2) + b"\1\2" + (b"MDZ" + md.encode() + b"\0" if md else b"")
        spans.append((len(data), len(data) + 4 + len(body), ref, pos, end))
        data += struct.pack("<i", len(body)) + body
    out, places = bytearray(), []
    for at in range(0, len(data), piece):
        places.append(len(out))
        out += block(bytes(data[at : at + piece]))
    places.append(len(out))
    out += block(b"")
    path.write_bytes(bytes(out))
    virtual = lambda at: places[at // piece] << 16 | at % piece
    index = bytearray(b"BAI\x01" + struct.pack("<i", len(REFS)))
    for k, (_, size) in enumerate(REFS):
        bins, linear = {}, [0] * (size // 16384 + 1)
        for a, b, ref, pos, end in spans:
            if ref == k:
                bins.setdefault(bin_of(pos, end), []).append((virtual(a), virtual(b)))
                for w in range(pos >> 14, (end - 1 >> 14) + 1):
                    linear[w] = min(linear[w] or virtual(a), virtual(a))
        index += struct.pack("<i", len(bins))
        for number, found in bins.items():
            index += struct.pack("<Ii", number, len(found)) + b"".join(struct.pack("<QQ", *x) for x in found)
        index += struct.pack("<i", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
    (path.parent / f"{path.name}.bai").write_bytes(bytes(index))


def planted(n):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        ref, size = rng.choice([(0, 290_000), (0, 290_000), (1, 40_000)]), rng.choice([1, 50, 151, 4000])
        seq = "".join(rng.choices("ACGTN", k=size))
        ops = [(4, size // 3), (0, size - size // 3), (2, 5)] if size > 3 else [(0, 1)]
        rows.append((f"r{k % (n - 5)}", rng.choice([0, 16, 256, 2048]), ref[0], rng.randrange(ref[1]), rng.randrange(61), ops, seq if k % 7 else "", f"{size}A3" if k % 2 else None))
    rows.sort(key=lambda r: (r[2], r[3]))
    return rows + [(f"u{k}", 4, -1, -1, 0, [], "ACGTA", None) for k in range(20)]


@pytest.mark.parametrize("piece, split", [(1 << 14, 1 << 25), (700, 5000), (60_000, 1500)])
def test_every_record_is_read_once_at_any_split(spark, tmp_path, piece, split):
    rows = planted(400)
    write_bam(tmp_path / "x.bam", rows, piece)
    got = [(r["read_name"], r["flag"], r["chrom"], r["ref_start"], r["mapq"], [tuple(x) for x in r["cigar"]], r["seq"], r["md"]) for r in bam.read_bam(spark, str(tmp_path / "x.bam"), "hifi", split=split).collect()]
    names = {0: "chr1", 1: "chr2", -1: "*"}
    want = [(n, f, names[c], p if not f & 4 else None, q, ops, s or None, md) for n, f, c, p, q, ops, s, md in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_regions_open_only_their_blocks(spark, tmp_path):
    rows, path = planted(600), tmp_path / "x.bam"
    write_bam(path, rows, 2000)
    regions = [("chr1", 100_000, 110_000), ("chr1", 105_000, 112_000), ("chr2", 0, 10), ("chrX", 0, 5)]
    got = sorted((r["read_name"], r["chrom"], r["ref_start"], r["ref_end"]) for r in bam.read_bam(spark, str(path), "hifi", regions).collect())
    names = {0: "chr1", 1: "chr2", -1: "*"}
    end = lambda r: r[3] + sum(n for op, n in r[5] if op in (0, 2))
    want = sorted((r[0], names[r[2]], r[3], end(r)) for r in rows if any(names[r[2]] == c and r[3] < b and end(r) > a for c, a, b in regions))
    assert got == want and 5 < len(got) < 60
    opened, total = [], 0
    with open(path, "rb") as file:
        size = path.stat().st_size
        for a, b in bam.chunks((tmp_path / "x.bam.bai").read_bytes(), [(0, 100_000, 112_000)]):
            list(bam.records(file, size, bam.Part(str(path), a, b, True), ["chr1", "chr2"], opened))
        every = bam.Blocks(file, size, 0)
        while every.more():
            total += 1
    assert 0 < len(set(opened)) < total / 4
    assert bam.read_bam(spark, str(path), "hifi", []).count() == 0
