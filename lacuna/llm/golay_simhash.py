"""SimHash near-duplicates found through Golay codes.

A fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the text's
word shingles.  Two fingerprints are linked if they differ in at most `max_bits` (up to 5) bits.

Candidate keys.  The fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect binary Golay code (23, 12, 7).  A segment's keys are the codewords that it and its neighbours at distance
1 decode to: one key if the word lies within 2 of its codeword, else six at most.  Two words that differ in at
most 2 bits share a key, since a word halfway between them is a neighbour of both.  With at most 5 differing bits
two of the three segments differ in at most 2 bits each (three bits in each of two segments would make six), so
the fingerprints share a key pair, 24 bits, in at least one of the three pairs of segments.  Nothing is missed.

Equal fingerprints are one class from the start, so copies are never paired.  Rows of a key are compared in one
task, which hands on a spanning forest of the links it finds, not all pairs; keys with more than CELL members are
dealt into cells, each pair of cells being one task's work.  Components then come from star contraction.  A class
has about 80 keys of 24 bits, so of n unrelated classes a key holds about n / 630,000: comparisons grow with the
square of n from some 10^9 classes on, where more bits in a key (four segments) would be needed.

Rows of a fingerprint or a key that has more than 1/HOT of all are dealt out by id where the others are joined.

Null text counts as empty: fingerprint zero.  Rows with the same id are all kept, each with its own fingerprint.
Long texts are hashed whole.  An empty table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import HOT, cut_lineage, join_hot, new_folder, rows_of, to_table
from lacuna.operators.components import connected_components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a key that are compared in one task.
CELL = 4096
#: Classes whose keys one task works out.
EXPANDED = 4000
#: Runs up to this size are compared position by position, longer ones by search from member to member.
SHORT_RUN = 6
# fixed value: generator polynomial of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0xAE3

_decoder = None


def golay_codewords() -> np.ndarray:
    """The 4096 codewords; index i has the information bits i."""
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        part = GENERATOR << bit
        words[(np.arange(4096) >> bit) & 1 == 1] ^= np.uint32(part)
    return words


def golay_decoder() -> np.ndarray:
    """Nearest codeword's index for each of the 2^23 words; the code is perfect, so it is unique."""
    global _decoder
    if _decoder is None:
        errors = [0] + [1 << i for i in range(23)]
        errors += [1 << i | 1 << j for i in range(23) for j in range(i)]
        errors += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
        table, words, index = np.zeros(1 << 23, np.uint16), golay_codewords(), np.arange(4096, dtype=np.uint16)
        for e in errors:
            table[words ^ np.uint32(e)] = index
        _decoder = table
    return _decoder


def segment_keys(segment: np.ndarray, width: int) -> np.ndarray:
    """(n, 6): the distinct codeword indices of each word and its neighbours, padded with -1."""
    decoder = golay_decoder()
    near = np.empty((len(segment), width + 1), np.int16)
    near[:, 0] = decoder[segment]
    for j in range(width):
        near[:, j + 1] = decoder[segment ^ np.uint32(1 << j)]
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(fresh)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(fresh.sum(1)) - fresh.sum(1), fresh.sum(1))
    out = np.full((len(segment), 6), -1, np.int32)
    out[row, rank] = near[row, col]
    return out


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows for unsigned 64-bit fingerprints."""
    parts = [segment_keys(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32), width) for at, width in SEGMENTS]
    keys, owners = [], []
    for tag, (s, t) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = parts[s][:, :, None], parts[t][:, None, :]
        both = (a >= 0) & (b >= 0)
        key = (np.int64(tag) << 24) | (a.astype(np.int64) << 12) | b.astype(np.int64)
        keys.append(key[both])
        owners.append(np.broadcast_to(fps[:, None, None], both.shape)[both])
    return np.concatenate(keys), np.concatenate(owners)


def simhash(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text's words."""
    import xxhash

    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - 1 - np.fromiter(map(len, words), np.int64, n))[: n - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """`(id, fp)` with the fingerprint as a signed long; the scan's only Python, no shuffle."""

    def run(batches):
        for batch in batches:
            ids, fps = [], []
            for i, t in rows_of(batch, "id", "text"):
                ids.append(i)
                fps.append(simhash((t or "").encode().lower().split(), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, out = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            f = front.pop()
            near = np.bitwise_count(left ^ f) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                out += [(f, x) for x in found]
                front += list(found)
    return out


def _links(keys: DataFrame, max_bits: int) -> DataFrame:
    """Links among rows `(key, cell, fp)` that share key and cell; rows arrive sorted, in runs."""

    def run(batches):
        def compare(key: np.ndarray, fp: np.ndarray):
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[cut, len(key)])
            size_of = np.repeat(sizes, sizes)
            run_of = np.repeat(np.arange(len(cut)), sizes)
            a, b = [], []
            short = np.flatnonzero((size_of > 1) & (size_of <= SHORT_RUN))
            for d in range(1, SHORT_RUN):
                i, j = short[:-d], short[d:]
                hit = (run_of[i] == run_of[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits)
                a.append(fp[i[hit]])
                b.append(fp[j[hit]])
            for k in np.flatnonzero(sizes > SHORT_RUN):
                if edges := _forest(np.unique(fp[cut[k] : cut[k] + sizes[k]]), max_bits):
                    x, y = zip(*edges, strict=True)
                    a.append(np.array(x, np.uint64))
                    b.append(np.array(y, np.uint64))
            a, b = np.concatenate([np.empty(0, np.uint64), *a]).view(np.int64), np.concatenate([np.empty(0, np.uint64), *b]).view(np.int64)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held_key, held_fp = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate([held_key, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)])
            fp = np.concatenate([held_fp, batch.column(2).to_numpy().view(np.uint64)])
            last = np.flatnonzero((key != key[-1]).any(axis=1)) if len(key) else []
            end = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            if end:
                yield compare(key[:end], fp[:end])
            held_key, held_fp = key[end:], fp[end:]
        if len(held_key):
            yield compare(held_key, held_fp)

    return keys.mapInArrow(run, "a bigint, b bigint")


def candidate_keys(classes: DataFrame) -> DataFrame:
    """`(key, fp)` rows of distinct fingerprints."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fps), 2000):
                key, fp = fingerprint_keys(fps[k : k + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], ["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key bigint, fp bigint")


def links(classes: DataFrame, folder: str, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """Edges `(a, b)` that join all fingerprints (distinct rows `fp`) within max_bits of each other into components."""
    if not 0 <= max_bits <= 5:
        raise ValueError("the keys find links of up to 5 bits")
    spread = classes.select("fp").repartition(max(1, min(-(-classes.count() // EXPANDED), 100_000)))
    keys = to_table(candidate_keys(spread), f"{folder}/keys")
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).select("key", "n", F.ceil(F.col("n") / cell).cast("int").alias("cells"))
    crowded = cut_lineage(counted)
    hot = crowded.filter(F.col("n") * HOT > keys.count()).select("key", "cells")
    marked = join_hot(keys, crowded.select("key", "cells"), hot, "key", F.col("fp"))
    mine = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    other = F.when(F.col("cells").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))
    dealt = marked.withColumn("mine", mine).withColumn("other", F.explode(other)).select(
        "key",
        F.when(F.col("cells").isNull(), F.lit(0)).otherwise(F.least("mine", "other") * F.col("cells") + F.greatest("mine", "other")).cast("long").alias("cell"),
        "fp",
    )
    sorted_ = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return _links(sorted_, max_bits).distinct()


def near_duplicates(docs: DataFrame, folder: str, max_bits: int = MAX_BITS, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id", cell: int = CELL) -> DataFrame:
    """`(id, fp, component_id)` for every row of docs; component_id is the least id that links lead to.  Tables go below folder."""
    prints = to_table(fingerprints(docs, text, id_col, shingle), f"{folder}/prints")
    classes = to_table(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), f"{folder}/classes")
    roots = connected_components(links(classes, folder, max_bits, cell), cut_lineage)
    linked = roots.join(classes, roots["node"] == classes["fp"]).select("fp", "rep", "root")
    linked = to_table(linked, f"{folder}/linked")
    least = to_table(linked.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size")), f"{folder}/least")  # one row per component of several fingerprints
    large = least.filter(F.col("size") * HOT > linked.count())
    grouped = join_hot(linked, least.select("root", "least"), large.select("root", "least"), "root", F.col("fp"))
    named = classes.join(grouped.select("fp", "least"), "fp", "left").select("fp", "n", F.coalesce("least", "rep").alias("component_id"))
    of_class = to_table(named, f"{folder}/components")
    hot = of_class.filter(F.col("n") * HOT > prints.count())
    out = join_hot(prints, of_class.select("fp", "component_id"), hot.select("fp", "component_id"), "fp", F.col("id"))
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def op8_golay_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "simhash"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
