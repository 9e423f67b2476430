"""Byte-level BPE encoding and decoding inside Spark tasks.

Each partition's texts are cut into chunks at single spaces between non-spaces, where the pattern always ends a
match; distinct chunks are matched against the pattern once, and distinct matches that are no token themselves are
contracted many at a time, as arrays: in each step every word contracts its leftmost pair of least rank, only the ranks
of the pairs beside it are looked up anew, and words leave when no pair is left.  Decoding takes the pieces of all ids
from the vocabulary into one buffer and cuts it by document.  Both run map-side: no shuffle, and memory is bounded by an
Arrow batch, LIMIT_CACHE remembered chunks and LIMIT_BYTES of words.

A step looks at all that is left of a word, which would be quadratic in a word's length.  Words of more
than LONG_WORD bytes, one at a time, take a recursive DuckDB query that keeps the state by key, and contracts in one
step all places of the least rank up to the first whose contraction makes a pair of lower rank: the same order of
contractions, so the same ids.

Null text counts as empty: no ids, and decoding gives no bytes.  Ties in rank go to the leftmost pair.  Repeated rows
are encoded one by one; an empty table gives an empty result; texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import portions, release

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIMIT_CACHE = 150_000
#: Bytes of words that are contracted together.
LIMIT_BYTES = 500_000
LONG_WORD = 512
#: Longest chunk, in characters, that is remembered.
LONGEST = 64
DECODE_ROWS = 300_000
#: Texts that are encoded together.
PORTION = 2000
# fixed values: the characters of Unicode's White_Space property, which is what \s means in the pattern
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# the state of one word: a row for each byte, of which those contracted away have id -1
LONG_SQL = """
with recursive tokens(key, id) using key (key) as (
  select key, id from word_bytes
  union
  (with live as (
     select key, id, row_number() over w as n, lead(key) over w as next_key, lead(id) over w as next_id, lag(id) over w as before, lead(id, 2) over w as after
     from recurring.tokens where id >= 0 window w as (order by key)
   ), pairs as (
     select live.*, rank from live join merges on id = l and next_id = r
   ), least as (  -- neighbouring places, as in aaaa, share an island
     select *, n - row_number() over (order by n) as island from pairs where rank = (select min(rank) from pairs)
   ), apart as (
     select * from (select *, row_number() over (partition by island order by n) as k from least) where k % 2 = 1
   ), chosen as (
     select key, next_key, rank, after, case when lag(n) over (order by n) = n - 2 then rank else before end as before from apart
   ), lower as (
     select min(key) as key from chosen left join merges a on a.l = chosen.before and a.r = chosen.rank left join merges b on b.l = chosen.rank and b.r = chosen.after
     where a.rank < chosen.rank or b.rank < chosen.rank
   ), now as (
     select chosen.* from chosen, lower where lower.key is null or chosen.key <= lower.key
   )
   select key, cast(rank as integer) from now union all select next_key, -1 from now)
)
select id from tokens where id >= 0 order by key
"""
#: Rank of what is no pair.
NONE = np.iinfo(np.int32).max


#: White space of any kind beside a space (or the mark that the cutting uses): such texts are cut one by one.
_ANY = "[" + re.sub(r"\\[xu]([0-9a-f]+)", r"\\x{\1}", WHITE) + r"\x1c-\x1f]"
ODD_SPACE = f"{_ANY} | {_ANY}|\\x00"
_near_space = re.compile(r"\s | \s").search
_cuts = re.compile(r"(?<=\S) (?=\S)").split


def chunks(text: str) -> list[str]:
    """Pieces of a text that the pattern treats apart: cut before every single space between non-spaces."""
    parts = _cuts(text) if _near_space(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def matcher(pattern: str):
    """findall of the pattern, with \\s as Unicode's White_Space."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall


def remembered(texts: pa.Array, known: dict[str, bytes], learn) -> list[bytes]:
    """The ids (4 bytes each) of each text's chunks, joined.  learn(new chunks) adds to known those that aren't there.

    Arrow cuts the texts and numbers the distinct chunks, so Python sees each of these once per call.
    """
    out: list[bytes | None] = [None] * len(texts)
    odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(odd).tolist()
    cut = {i: chunks(texts[i].as_py()) for i in rest}
    plain = texts.filter(pa.array(~odd))
    lists = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
    numbered = lists.flatten().dictionary_encode()
    names, index = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
    learn({c for c in names if c not in known}.union(*({c for c in cs if c not in known} for cs in cut.values())))
    found = list(map(known.__getitem__, names))
    size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(found), "<i4")
    each = size[index]
    ends = np.cumsum(each)
    ids = flat[np.repeat(first[index] - (ends - each), each) + np.arange(int(each.sum()))]
    bounds = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
    for i, a, b in zip(np.flatnonzero(~odd).tolist(), bounds[:-1], bounds[1:], strict=True):
        out[i] = ids[a:b].tobytes()
    for i, cs in cut.items():
        out[i] = b"".join([known[c] for c in cs])
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """One worker's tables and remembered chunks."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.known, self.past = load_ranks(path), {}, {}
        self.plain_letters = pattern == public_tokenizers.PATTERN
        self.match = matcher(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = np.array([(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks], np.int64)
        self.merges = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.pairs = self.merges[:, 0] << 32 | self.merges[:, 1]
        self.pair_ranks = self.merges[:, 2].astype(np.int32)
        self.of_bytes = self._rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            pieces[r] = t
        self.pieces = pa.array(pieces, pa.large_binary())

    @cached_property
    def db(self):
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        db.register("given", pa.table({"l": self.merges[:, 0].astype(np.int32), "r": self.merges[:, 1].astype(np.int32), "rank": self.merges[:, 2]}))
        db.execute("create table merges as select * from given")
        db.unregister("given")
        return db

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or NONE."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)

    def _contract(self, words: list[bytes]) -> dict[bytes, bytes]:
        """ids (int32, little-endian) of words that are no tokens."""
        out = {w: self._contract_long(w) for w in words if len(w) > LONG_WORD}
        rest = sorted((w for w in words if len(w) <= LONG_WORD), key=len)
        upto, at = np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest))), 0
        while at < len(rest):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LIMIT_BYTES, "right")))
            self._contract_together(rest[at:end], out)
            at = end
        return out

    def _contract_together(self, words: list[bytes], out: dict[bytes, bytes]) -> None:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        number, ids = np.arange(len(words)), self.of_byte[flat]
        rank = np.full(len(ids), NONE, np.int32)  # of the pair that begins at a place
        rank[:-1] = self.of_bytes[flat[:-1].astype(np.int64) << 8 | flat[1:]]
        rank[np.cumsum(lens) - 1] = NONE
        while len(lens):
            first = np.cumsum(lens) - lens
            least = np.minimum.reduceat(rank, first)
            if (done := least == NONE).any():
                gone = np.repeat(done, lens)
                whole, ends = ids[gone].astype("<i4").tobytes(), 4 * np.cumsum(lens[done])
                out |= {words[w]: whole[a:b] for w, a, b in zip(number[done].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
                ids, rank, lens, number, least = ids[~gone], rank[~gone], lens[~done], number[~done], least[~done]
                first = np.cumsum(lens) - lens
            if not len(lens):
                break
            found = np.flatnonzero(rank == np.repeat(least, lens))
            at = found[np.searchsorted(found, first)]  # the leftmost of each word
            ids[at] = least
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at + 1)
            shift, lens = np.arange(len(at)), lens - 1
            at, first = at - shift, first - shift
            inner, after = at[at < first + lens - 1], at[at > first]
            rank[at] = NONE
            rank[inner] = self._rank(ids[inner], ids[inner + 1])
            rank[after - 1] = self._rank(ids[after - 1], ids[after])

    def _contract_long(self, word: bytes) -> bytes:
        self.db.register("word_bytes", pa.table({"key": np.arange(len(word), dtype=np.int64), "id": self.of_byte[np.frombuffer(word, np.uint8)]}))
        ids = self.db.execute(LONG_SQL).fetchnumpy()["id"]
        self.db.unregister("word_bytes")
        return np.asarray(ids, "<i4").tobytes()

    def _recall(self, new: set[str]) -> None:
        again = {c: self.past[c] for c in new & self.past.keys()}
        self.known |= again
        self.known |= self.learn(new - again.keys())

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """ids of chunks; one that is letters alone, perhaps after a space, is one match of the pattern."""
        matched = {c: [c.encode()] if self.plain_letters and (c[1:] if c[:1] == " " else c).isalpha() else [m.encode() for m in self.match(c)] for c in chunks}
        distinct = {m for ms in matched.values() for m in ms}
        ids = {m: self.ranks[m].to_bytes(4, "little") for m in distinct if m in self.ranks}
        ids |= self._contract([m for m in distinct if m not in ids])
        return {c: ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms]) for c, ms in matched.items()}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """int32 ids of each text, little-endian.  Chunks in use are remembered, those of long ago are forgotten."""
        if len(self.known) > LIMIT_CACHE:
            self.known, self.past = {}, self.known
        out = remembered(texts, self.known, self._recall)
        for c in [c for c in self.known if len(c) > LONGEST]:
            del self.known[c]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        if not ids:
            return []
        pieces = self.pieces.take(pa.array(np.concatenate(ids), pa.int32()))
        _, ends, data = pieces.buffers()
        cuts = np.frombuffer(ends, np.int64)[np.cumsum([0, *map(len, ids)])].tolist()
        whole = data.to_pybytes() if data else b""
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`(id, ids array<int>)` for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tools = codec(path, pattern)
        for batch in batches:
            for k, n in portions(batch.column(1), PORTION):
                part = batch.slice(k, n)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(tools.encode(part.column(1).fill_null("")))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def _in_portions(arrays: list[np.ndarray], most: int):
    """Slices of neighbours of about `most` elements together."""
    start, size = 0, 0
    for k, x in enumerate(arrays):
        size += len(x)
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(arrays):
        yield start, len(arrays)


def _ids_of(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`(id, ids, bytes)` for rows `(id, ids)`."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        tools = codec(path, pattern)
        for batch in batches:
            ids = _ids_of(batch.column(1))
            for a, b in _in_portions(ids, DECODE_ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(tools.decode(ids[a:b]), pa.binary())], ["id", "ids", "bytes"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`(id, n_tokens, ids_sha256, decoded_sha256)`: encoding and decoding of every row, by one worker with one set of tables."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        release()
        tools, names = codec(path, pattern), {}
        for batch in batches:
            for k, n in portions(batch.column(1), PORTION):
                part = batch.slice(k, n)
                ids = [np.frombuffer(x, "<i4") for x in tools.encode(part.column(1).fill_null(""))]
                texts = [hashlib.sha256(x).hexdigest() for a, b in _in_portions(ids, DECODE_ROWS) for x in tools.decode(ids[a:b])]
                sums = [hashlib.sha256(" ".join([names.get(i) or names.setdefault(i, str(i)) for i in x.tolist()]).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
