"""Token ids as canonical length-limited Huffman files.

1. Documents are range-partitioned by id; every partition is tokenised, each distinct match of the tokenizer's pattern
   once for PORTION_BYTES of text, and its ids are spooled to the shared folder, one file each, together with the
   partition's counts per id.
2. The global counts (one row per vocabulary entry at most) give code lengths by package-merge, at most MAX_BITS,
   and canonical codes follow from the lengths alone.
3. Every spool file becomes one output file: header, code lengths, document table, checkpoints, bits.  The bits are
   cut into blocks of BLOCK ids; a checkpoint is the bit offset at which a block starts, so blocks decode
   independently.  A decoder advances LOCKSTEP blocks together, one table look-up per id, and reads only their bytes.

A file is all that its decoder needs.  Files are in ascending order of id, and so are documents within a file (null
first; equal ids by hash of the text, then text), so `start` is a running sum over the files' headers (one row for
each FILE_BYTES of text, in one task) and then documents.

Null text counts as empty and has the end id alone.  An added token's string in a text is that token, as the
library has it by default.  Repeated rows are all kept; rows of one id may spread over files, rows that also have
equal texts share one.  A text of any length is encoded whole, and decoded in pieces.  An empty table gives no files
and no rows.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.workspace import Replacing, arrow_schema, filesystem, new_folder, portions, release, rows_of, to_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
MAX_BITS = 20
BLOCK = 1024
#: Blocks that advance together.
LOCKSTEP = 1024
#: Bytes of text that make one file.
FILE_BYTES = 24 << 20
#: Texts, and bytes of text, that are encoded together.
PORTION_ROWS, PORTION_BYTES = 20_000, 24 << 20
#: Bytes of text that are cut into matches together, and what follows until a text or a word in ASCII ends.
CUT_BYTES = 1 << 20
#: Matches that the library takes at a time.
WORDS = 4096
MAGIC = b"LHUF0002"

SPOOL = "part int, spool string, ids array<int>, counts array<bigint>"
FILES = "part int, path string"
HEADS = "part int, path string, n_tokens bigint"
DOCS = "part int, number bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


# --- codes ---------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most `most` bits for the symbols with a count; 0 for the others."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} symbols need more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    packages, from_leaf = np.empty(0, np.int64), []
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        from_leaf.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    taken, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(from_leaf):
        chosen = int(is_leaf[:taken].sum())
        lengths[:chosen] += 1
        taken = 2 * (taken - chosen)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of a table of lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        size = np.int64(1) << (self.bits - self.lengths[order].astype(np.int64))
        first = np.cumsum(size) - size
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (first >> (self.bits - self.lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.symbol[: size.sum()] = np.repeat(order, size)
        self.step = np.ones(1 << self.bits, np.int64)
        self.step[: size.sum()] = np.repeat(self.lengths[order], size)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, most significant first, and the bit offset of each block."""
        out, checkpoints, at, held = [], [], 0, 0
        for k in range(0, len(ids), BLOCK * 512):
            part = ids[k : k + BLOCK * 512]
            size = self.lengths[part].astype(np.int64)
            start = np.cumsum(size) - size
            checkpoints.append(at + start[::BLOCK])
            start = start + (at & 7)
            word, room = start >> 5, 64 - (start & 31) - size
            wide = self.codes[part] << room.astype(np.uint64)  # 64 bits from the word's start; codes have at most 32
            cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            summed = np.bitwise_or.reduceat(wide, cut)
            total = int(start[-1] + size[-1])
            words = np.zeros((total >> 5) + 2, np.uint32)
            words[word[cut]] |= (summed >> np.uint64(32)).astype(np.uint32)
            words[word[cut] + 1] |= (summed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            data = bytearray(words.astype(">u4").tobytes())
            data[0] |= held
            at = (at & ~7) + total
            whole = total >> 3
            held = data[whole] if total & 7 else 0
            out.append(bytes(data[:whole]))
        if at & 7:
            out.append(bytes([held]))
        return b"".join(out), np.concatenate(checkpoints) if checkpoints else np.empty(0, np.int64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of whole blocks that start at the given bit offsets."""
        return np.concatenate([np.empty(0, np.uint32), *(self._together(bits, checkpoints[k : k + LOCKSTEP], min(n - k * BLOCK, LOCKSTEP * BLOCK)) for k in range(0, len(checkpoints), LOCKSTEP))])

    def _together(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        at = np.array(checkpoints, np.int64)
        first = int(at[0]) >> 3
        end = min(len(bits), (int(at[-1]) + BLOCK * self.bits >> 3) + 1)
        raw = np.frombuffer(bits[first:end] + bytes(8), np.uint8)
        window = np.zeros(len(raw) - 3, np.uint32)
        for k in range(4):
            window <<= 8
            window |= raw[k : len(raw) - 3 + k]
        at -= 8 * first
        last, mask = len(window) - 1, np.int64((1 << self.bits) - 1)
        block = np.empty((min(BLOCK, n), len(at)), np.uint32)
        for j in range(len(block)):
            index = (window[np.minimum(at >> 3, last)].astype(np.int64) >> (32 - self.bits - (at & 7))) & mask
            block[j] = self.symbol[index]
            at += self.step[index]
        out = np.zeros((len(at), BLOCK), np.uint32)
        out[:, : len(block)] = block.T
        return out.ravel()[:n]


# --- tokenising ----------------------------------------------------------------------------------------------


# fixed values: the letters that byte-level vocabularies write for bytes, printable ones for themselves and the others in order from 256 on
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _printable} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _printable)}


def _gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray, at_once: int = 500_000) -> np.ndarray:
    """The pieces of flat, whose sizes are given, in the order of index."""
    first, each = np.cumsum(sizes) - sizes, sizes[index]
    upto = np.r_[0, np.cumsum(each)]
    out = np.empty(int(upto[-1]), flat.dtype)
    for k in range(0, len(index), at_once):
        end = min(k + at_once, len(index))
        some = np.arange(upto[k], upto[end])
        some += np.repeat(first[index[k:end]] - upto[k:end], each[k:end])
        out[upto[k] : upto[end]] = flat[some]
    return out


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts (and the last ends), and the bytes of all."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets or bytes(8), np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return bounds - bounds[0], np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]


OTHER, LETTER, NUMBER, SPACE = range(4)
_between_words = re.compile(rb"[A-Za-z] (?=[A-Za-z])").search  # where a text may be cut, as the pattern ends a match there


class Kinds:
    """What the library's splitting takes code points for (regular expressions elsewhere may follow another version of Unicode); asked once for each 2048 in use.

    Neighbours of one kind are one piece, or are white space; between a letter and a number, twice the same character tells its kind.
    """

    SAID = {(3, 1): LETTER, (1, 3): NUMBER, (1, 2, 1): OTHER, (1, 1, 1, 1): SPACE}

    def __init__(self, split):
        self.split, self.table, self.asked = split, np.full(0x110000, OTHER, np.uint8), np.zeros(0x220, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        for k in np.flatnonzero((np.bincount(points >> 11, minlength=0x220) > 0) & ~self.asked).tolist():
            at = k << 11
            for _, (a, b) in self.split(np.arange(at, at + 0x800, dtype="<u4").tobytes().decode("utf-32-le")):
                self.table[at + a : at + b] = self.SAID[tuple(d - c for _, (c, d) in self.split(f"a{chr(at + b - 1) * 2}1"))]
            self.table[32], self.asked[k] = SPACE, True  # a space goes with what follows it
        return self.table[points]


def match_starts(data: np.ndarray, bounds: np.ndarray, kinds: Kinds) -> np.ndarray:
    """The bytes at which the matches of the byte-level pattern begin in the texts between bounds, which are UTF-8 one after the other.

    A match is a run of one kind, with these exceptions: of white space before another run of the same text the last character is
    apart, and goes with that run if it is a space; ' with s, t, m, d, re, ve or ll is a match where ' begins one and is a run alone.
    """
    if not len(data):
        return np.empty(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n, where, kind = len(points), np.flatnonzero((data & 0xC0) != 0x80), kinds(points)
    edge = np.zeros(n + 3, bool)  # texts begin or end before the character
    edge[np.searchsorted(where, bounds)] = edge[n:] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    starts = run.copy()
    last = np.flatnonzero((kind == SPACE) & run[1 : n + 1] & ~edge[1 : n + 1])
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & starts[:n] & run[1 : n + 1] & ~edge[1 : n + 1])
    one, two = points[quote + 1], np.where(edge[quote + 2], 0, points[np.minimum(quote + 2, n - 1)])
    short = np.isin(one, [*b"stmd"])
    size = np.where(short, 2, np.where(np.isin(one, [*b"rv"]) & (two == 101) | (one == 108) & (two == 108), 3, 0))
    quote, size = quote[size > 0], size[size > 0]
    starts[quote + 1] = False
    starts[quote + size] = True
    return where[np.flatnonzero(starts[:n])]


class _Encoder:
    """The tokenizer, for many texts at once where its splitting allows matches of the pattern to go apart.

    Texts are cut into matches as arrays, Arrow numbers these, and the library's model takes the distinct ones, many in a call;
    nothing in Python is called for each match, and nothing is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path) as f:
            said = json.load(f)
        split, model = said.get("pre_tokenizer") or {}, said["model"]
        self.apart = said.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        # the tokens of a match are told by their lengths, so they have to be its bytes and nothing else
        self.apart = self.apart and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and all(x in model["vocab"] for x in _BYTE_LETTERS.values()) and not said.get("truncation") and not said.get("padding")
        self.tool = Tokenizer.from_file(path)
        self.added = [t["content"] for t in said.get("added_tokens") or []]  # texts that hold one are encoded as a whole
        self.size = self.tool.get_vocab_size()
        if self.apart:
            self.kinds = Kinds(self.tool.pre_tokenizer.pre_tokenize_str)
            self.words = Tokenizer(self.tool.model)  # the same merges; takes matches, written in byte letters, with spaces between
            self.words.pre_tokenizer = WhitespaceSplit()
            self.n_bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            self.n_bytes[list(model["vocab"].values())] = list(map(len, model["vocab"]))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self.tool.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _tokenize(self, matches: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of matches of the pattern, from the tokenizer's own merges, and how many each match has."""
        bounds, data = _text_bytes(matches)
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(matches), WORDS):
            ends = bounds[k + 1 : k + WORDS + 1] - bounds[k]
            apart = np.insert(data[bounds[k] : bounds[k] + ends[-1]], ends[:-1], 0xFF)  # UTF-8 has no byte FF
            letters = apart.tobytes().decode("latin-1").translate(_BYTE_LETTERS | {0xFF: " "})
            ids.append(np.array(self.words.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4"))
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids[-1]]), ends) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _by_matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds, data = _text_bytes(texts)
        starts, at = [np.empty(0, np.int64)], 0
        while at < len(data):
            stop = int(bounds[np.searchsorted(bounds, min(at + CUT_BYTES, len(data)))])
            word = _between_words(memoryview(data), at + CUT_BYTES, stop)
            end = word.start() + 1 if word else stop
            inner = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, end)] - at
            starts.append(at + match_starts(data[at:end], np.r_[0, inner, end - at], self.kinds))
            at = end
        starts = np.concatenate(starts)
        numbered = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(data)].astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        ids, sizes = self._tokenize(numbered.dictionary)
        index = numbered.indices.to_numpy()
        return _gather(ids, sizes, index), np.diff(np.r_[0, np.cumsum(sizes[index])][np.searchsorted(starts, bounds)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (little-endian, unsigned, 32 bits) of all texts, and how many each text has."""
        if not self.apart:
            return self._plain(texts.to_pylist())
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._by_matches(texts)
        parts = self._by_matches(texts.filter(pa.array(~holds))), self._plain(texts.filter(pa.array(holds)).to_pylist())
        ids, sizes = map(np.concatenate, zip(*parts, strict=True))
        place = np.empty(len(texts), np.int64)
        place[np.r_[np.flatnonzero(~holds), np.flatnonzero(holds)]] = np.arange(len(texts))
        return _gather(ids, sizes, place), sizes[place]


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _pack(uri: str, doc_ids: list, lengths: np.ndarray, body: list[bytes], more: bytes = b"", book: bytes = b"") -> None:
    """Header, code lengths, table of documents, `more`, body."""
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    table = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes() + valid.tobytes(), 1)
    packed = zlib.compress(book, 1)
    out = Replacing(uri)
    out.write(MAGIC + struct.pack("<QQQQQQ", len(doc_ids), int(lengths.sum()), len(packed), len(table), len(more), sum(map(len, body))) + packed + table + more)
    for part in body:
        out.write(part)
    out.close()


class TokenFile:
    """A file of tokens (or of spooled ids): its header and tables; ids are read on demand."""

    HEAD = 8 + 6 * 8

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.stream = files.open_input_file(path)
        head = self.stream.read(self.HEAD)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.n_docs, self.n_tokens, *self.parts = struct.unpack("<QQQQQQ", head[8:])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def tables(self) -> None:
        n, (book, table, more, _) = self.n_docs, self.parts
        self.stream.seek(self.HEAD)
        self.book = np.frombuffer(zlib.decompress(self.stream.read(book)), np.uint8)
        raw = zlib.decompress(self.stream.read(table))
        self.sizes, valid = np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)
        self.doc_ids = [i if v else None for i, v in zip(np.frombuffer(raw, "<i8", n).tolist(), valid.tolist(), strict=True)]
        self.more = self.stream.read(more)

    def body(self, start: int, length: int) -> bytes:
        self.stream.seek(self.HEAD + sum(self.parts[:3]) + start)
        return self.stream.read(length)

    def ids(self, code: Codebook, first: int = 0, last: int | None = None):
        """Arrays of the ids of blocks first to last (all if None), LOCKSTEP blocks at a time; only their bytes are read."""
        checkpoints = np.frombuffer(self.more, "<i8")
        last = len(checkpoints) if last is None else last
        for k in range(first, last, LOCKSTEP):
            at = checkpoints[k : min(k + LOCKSTEP, last)]
            start, end = int(at[0]) >> 3, int(checkpoints[k + len(at)] >> 3) + 1 if k + len(at) < len(checkpoints) else self.parts[3]
            yield code.decode(self.body(start, end - start), at - 8 * start, min(self.n_tokens - k * BLOCK, len(at) * BLOCK))


def _spool(docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        import zstandard

        part, schema, tool = TaskContext.get().partitionId(), arrow_schema(SPOOL), encoder(tokenizer)
        kind = "<u2" if max(tool.size, end_id + 1) <= 1 << 16 else "<u4"
        counts, doc_ids, lengths, body = np.zeros(max(tool.size, end_id + 1), np.int64), [], [], []
        squeeze = zstandard.ZstdCompressor(level=1).compressobj()
        for batch in batches:
            for k, n in portions(batch.column(1), PORTION_ROWS, PORTION_BYTES):
                some = batch.slice(k, n)
                flat, sizes = tool(some.column(1).fill_null(""))
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                counts += np.bincount(flat, minlength=len(counts))
                doc_ids += some.column(0).to_pylist()
                lengths.append(sizes + 1)
                body.append(squeeze.compress(flat.astype(kind).tobytes()))
        if doc_ids:
            body.append(squeeze.flush())
            uri, used = f"{folder}/spool/part-{part:06d}", np.flatnonzero(counts)
            _pack(uri, doc_ids, np.concatenate(lengths), body, kind.encode())
            yield pa.RecordBatch.from_pylist([{"part": part, "spool": uri, "ids": used, "counts": counts[used]}], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = narrow.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return to_table(ranged.select("doc_id", "text").mapInArrow(run, SPOOL), f"{folder}/spooled")


def _summed(batches):
    """The counts of a task's partitions, added up before they are shuffled."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids, counts in rows_of(batch, "ids", "counts"):
            ids = np.array(ids)
            if ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64)])
            total[ids] += counts
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes the files of docs (doc_id, text) below folder; returns their table (part, path)."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    spooled = _spool(docs, folder, tokenizer, end_id, max(1, -(-size // FILE_BYTES)))
    total = spooled.select("ids", "counts").mapInArrow(_summed, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per entry of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in total), default=0) + 1, np.int64)
    for r in total:
        counts[r["id"]] = r["n"]
    book = code_lengths(counts).tobytes()

    def run(batches):
        import zstandard

        release(_encoders)
        code, schema = Codebook(np.frombuffer(book, np.uint8)), arrow_schema(FILES)
        for batch in batches:
            for part, uri in rows_of(batch, "part", "spool"):
                with TokenFile(uri) as spool:
                    spool.tables()
                    ids = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(spool.body(0, spool.parts[3])), spool.more.decode())
                    bits, checkpoints = code.encode(ids)
                    path = f"{folder}/tokens-{part:06d}.huf"
                    _pack(path, spool.doc_ids, spool.sizes, [bits], checkpoints.astype("<i8").tobytes(), book)
                yield pa.RecordBatch.from_pylist([{"part": part, "path": path}], schema=schema)

    todo = spooled.select("part", "spool").repartition(max(1, min(spooled.count(), 10_000)))
    return to_table(todo.mapInArrow(run, FILES), f"{folder}/files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document: file number, place in it, id, ids before it in all files, its number of ids and their crc32; all from the files."""
    tasks = max(1, min(files.count(), 10_000))

    def heads(batches):
        schema = arrow_schema(HEADS)
        for batch in batches:
            for part, path in rows_of(batch, "part", "path"):
                with TokenFile(path) as f:
                    yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_tokens": f.n_tokens}], schema=schema)

    def run(batches):
        release(_encoders)
        schema = arrow_schema(DOCS)
        for batch in batches:
            for part, path, first in rows_of(batch, "part", "path", "first"):
                with TokenFile(path) as f:
                    f.tables()
                    starts, sums, at, number = first + np.cumsum(f.sizes) - f.sizes, np.zeros(f.n_docs, np.int64), 0, 0
                    left = f.sizes.tolist()
                    for ids in f.ids(Codebook(f.book)):
                        raw, at = ids.astype("<u4").tobytes(), 0
                        while at < len(raw):  # every document has an end, so none is empty
                            n = min(4 * left[number], len(raw) - at)
                            sums[number] = zlib.crc32(raw[at : at + n], int(sums[number]))
                            left[number] -= n // 4
                            at += n
                            number += not left[number]
                    yield pa.RecordBatch.from_arrays([pa.array(x, g.type) for x, g in zip(([part] * f.n_docs, range(f.n_docs), f.doc_ids, starts, f.sizes, sums), schema, strict=True)], schema=schema)

    found = files.select("part", "path").repartition(tasks).mapInArrow(heads, HEADS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, and the running sum needs them in order
    placed = found.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint").alias("first"))
    return placed.repartition(tasks).mapInArrow(run, DOCS)


def read_document(path: str, number: int) -> np.ndarray:
    """The ids of one document, from the blocks that hold it alone."""
    with TokenFile(path) as f:
        f.tables()
        first = int(f.sizes[:number].sum())
        size = int(f.sizes[number])
        a, b = first // BLOCK, -(-(first + size) // BLOCK)
        ids = np.concatenate(list(f.ids(Codebook(f.book), a, b)))
        return ids[first - a * BLOCK : first - a * BLOCK + size]


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), new_folder(spark, "huffman"))
    return read_tokens(files).select("doc_id", "start", "n_tokens", "ids_crc32")
