"""Near copies by Jaccard similarity of word shingles: groups of texts linked at a similarity of 0.8 or more.

A text's set holds the XXH64 hashes (seed 42) of its five-word shingles; a text of fewer words is one shingle, one
without words (or null) has the empty set.  Texts of equal sets are one class from the start, so copies are never paired.

Fingerprints.  Op8's method, SimHash with Golay keys (`golay_simhash`), over the hashes of a set: classes whose
fingerprints differ in MAX_BITS of 64 bits or fewer are linked, as op8 links them.  The empty set has none.

Candidates for the similarity.  MinHash of BANDS * ROWS functions; classes that agree on all ROWS of a band share a key.  A pair of
similarity s shares none with probability (1 - s^ROWS)^BANDS: 4.7e-8 at 0.8, less above.  Fingerprints alone
don't serve there: at 0.8 two of 64 bits differ in 10 bits on average.  Classes of a key are joined if their signatures
agree in ROUGH of all places, which a pair at 0.8 misses with probability 7e-8; that gives rough components.

Links.  Within a rough component sets are compared exactly, whole texts being read once more; what is linked there
makes the groups.  Both steps are `crowds.components`: they hand on forests, not all pairs, and work in chunks that are
bounded in members and bytes.  A class is named by 128 bits of hash, so that no two sets share a name at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import crowds, golay_simhash
from lacuna.llm.workspace import cut_lineage, new_folder, rows_of, to_table
from lacuna.operators.components import connected_components

SEED = 42
SHINGLE = 5
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 4
ROUGH = 0.6
_draw = np.random.default_rng(SEED)
_MULTIPLY = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= shingle:
        return np.array([digest(b" ".join(words), SEED)] if n else [], np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: n - shingle + 1].tolist()
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each MinHash function over a set that isn't empty."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[k : k + 512] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)).min(axis=1), out=least)
    return least


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes: the bits that over half of them have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _prints(docs: DataFrame) -> DataFrame:
    """`(id, h, cls, fp, bands, sig)` from rows (id, h, text): class, fingerprint, band keys and a byte of each MinHash value; only a class for empty sets."""

    def run(batches):
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            cls, fps, bands, sigs = [], [], [], []
            for (t,) in rows_of(batch, "text"):
                hashes = shingle_set(t)
                cls.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
                fps.append(fingerprint(hashes) if len(hashes) else None)
                least = signature(hashes).astype("<u4") if len(hashes) else None
                bands.append([] if least is None else [signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)])
                sigs.append(None if least is None else (least & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(cls, pa.binary()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "h", "cls", "fp", "bands", "sig"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h bigint, cls binary, fp bigint, bands array<bigint>, sig binary")


def alike(signatures: list[bytes]):
    """near() for signatures that agree in ROUGH of their places."""
    sigs = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    return lambda i, others: (sigs[others] == sigs[i]).mean(axis=1) >= ROUGH


def similar(texts: list[str | None]):
    """near() for texts whose sets have the similarity, exactly."""
    sets = [shingle_set(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts, (up, down), mark = np.r_[0, np.cumsum(sizes)], SIMILARITY, np.zeros(len(names), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = flat[cuts[i] : cuts[i + 1]]
        fits = (np.minimum(sizes[others], sizes[i]) * down >= np.maximum(sizes[others], sizes[i]) * up)
        mark[own] = True
        common = np.array([np.count_nonzero(mark[flat[cuts[j] : cuts[j + 1]]]) if fit else 0 for j, fit in zip(others, fits, strict=True)], np.int64)
        mark[own] = False
        return fits & (common * down >= (sizes[others] + sizes[i] - common) * up)

    return near


def fingerprint_links(classes: DataFrame, folder: str) -> DataFrame:
    """Edges `(a, b)` among classes (cls, fp) that join those of equal or near fingerprints into components."""
    named = classes.filter("fp is not null").select("cls", "fp")
    first = to_table(named.groupBy("fp").agg(F.min("cls").alias("first")), f"{folder}/fingerprints")
    found = to_table(golay_simhash.links(first, folder), f"{folder}/links")
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_cls")) for c in "ab")
    near = found.join(a, "a").join(b, "b").select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))
    return near.unionByName(named.join(first, "fp").select(F.col("cls").alias("a"), F.col("first").alias("b")).filter("a <> b"))


def first_of_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", cell: int = crowds.CELL) -> DataFrame:
    """`(id, h)` of one row for each group: that of the least id, and then of the least hash h = xxhash64(text)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    folder = new_folder(docs.sparkSession, "near")
    classes = to_table(_prints(rows).groupBy("cls").agg(F.min(F.struct("id", "h")).alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), f"{folder}/classes")
    keys = classes.select(F.explode("bands").alias("key"), "cls")
    rough = crowds.components(keys, alike, f"{folder}/rough", cell, whats=classes.select("cls", F.col("sig").alias("what"))).select(F.col("node").alias("cls"), F.col("root").alias("key"))
    named = to_table(rough.join(classes.select("cls", "rep.*"), "cls"), f"{folder}/named")
    found = rows.join(named, ["id", "h"]).select("key", "cls", F.col("text").alias("what")).dropDuplicates(["key", "cls"])
    members = to_table(found, f"{folder}/members")
    alike_ = crowds.components(members, similar, f"{folder}/exact", cell).select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = to_table(alike_.unionByName(fingerprint_links(classes, f"{folder}/golay")), f"{folder}/both")
    roots = connected_components(links, cut_lineage).select(F.col("node").alias("cls"), "root")
    return classes.select("cls", "rep").join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("group")).agg(F.min("rep").alias("rep")).select("rep.*")
