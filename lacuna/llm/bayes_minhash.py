"""MinHash near-duplicates with sequential Bayesian verification.

A text's set holds the XXH64 hashes (seed 42) of its distinct SHINGLE-word shingles; a text of fewer words is one shingle.
Two texts are linked if 100 times their common shingles are at least PERCENT times those of both.

Candidates.  BANDS * ROWS MinHash functions; classes of equal sets that agree on all ROWS of a band share a key, which a
pair at 0.85 misses with probability (1 - 0.85^5)^28 = 7.4e-8.

Verification.  Candidates compare their signatures BATCH functions at a time.  With a uniform prior the similarity, after
m of n agreements, has the posterior Beta(m + 1, n - m + 1), and the probability that it is PERCENT or more is that of m
or fewer heads in n + 1 throws of a coin of that bias.  A pair is dropped as soon as it is under MISS; a byte of each
MinHash value is kept, so unequal values agree once in 256 and the bound errs to the side of keeping.  Pairs whose sizes
alone rule out a link are dropped before.  Whatever survives all batches is verified on the full sets.

Survivors aren't written as pairs: those of a key become the edges of a forest (`crowds.components`), the components of these
hold whatever can be linked, and within each of them links are settled again, now with the sets of the whole texts,
which are read once more for classes that have a candidate.

Null texts and texts without words have the empty set: n_shingles 0, linked with nothing.  Repeated rows are linked with
each other.  Rows without an id are linked as others, never name a component (if no row of theirs has an id, it is null)
and are not kept.  Rows with equal ids are all kept if one is.  Very long texts are hashed whole.  An empty table gives no rows.
Only id and text are read, so no column can clash.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import crowds
from lacuna.llm.near_copies import shingle_set
from lacuna.llm.workspace import HOT, join_hot, new_folder, rows_of, to_table

SHINGLE = 3
PERCENT = 85
BANDS, ROWS = 28, 5
BATCH = 20
MISS = 1e-9
SEED = 42
_PLACES = BANDS * ROWS
_draw = np.random.default_rng(SEED)
_MULTIPLY = _draw.integers(0, 1 << 63, _PLACES, np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, _PLACES, np.uint64)
_HEAD = 4 + _PLACES


def posterior(m: int, n: int, similarity: float) -> float:
    """Probability that the similarity is at least the given one after m agreements of n."""
    return sum(comb(n + 1, k) * similarity**k * (1 - similarity) ** (n + 1 - k) for k in range(m + 1))


def least_agreements(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """`(n, m)` after each batch: fewer than m agreements of n drop a pair."""
    return [(n, next(m for m in range(n + 1) if posterior(m, n, percent / 100) >= miss)) for n in range(BATCH, _PLACES + 1, BATCH)]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each MinHash function over a set that isn't empty."""
    least = np.full(_PLACES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[k : k + 512] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)).min(axis=1), out=least)
    return least


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """`(id, h, cls, n, bands, sig)` of rows (id, h, text): class, set size, band keys, and the size and a byte of each MinHash value; no keys for empty sets."""

    def run(batches):
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            cls, sizes, bands, sigs = [], [], [], []
            for (t,) in rows_of(batch, "text"):
                hashes = shingle_set(t, shingle)
                cls.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                least = signature(hashes).astype("<u4") if len(hashes) else None
                bands.append([] if least is None else [signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)])
                sigs.append(None if least is None else np.uint32(len(hashes)).tobytes() + (least & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "h", "cls", "n", "bands", "sig"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h bigint, cls binary, n bigint, bands array<bigint>, sig binary")


def unpruned(percent: int = PERCENT, miss: float = MISS):
    """The relation of pairs that sizes and sequential batches leave, over the beginnings of members."""
    least = least_agreements(percent, miss)

    def relation(what: list[bytes]):
        heads = np.frombuffer(b"".join(w[:_HEAD] for w in what), np.uint8).reshape(len(what), _HEAD)
        sizes, sigs = heads[:, :4].copy().view("<u4")[:, 0].astype(np.int64), heads[:, 4:]

        def near(i: int, others: np.ndarray) -> np.ndarray:
            alive = np.flatnonzero(100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))
            agreed = np.zeros(len(alive), np.int64)
            for n, m in least:
                agreed += (sigs[others[alive], n - BATCH : n] == sigs[i, n - BATCH : n]).sum(axis=1)
                fit = agreed >= m
                alive, agreed = alive[fit], agreed[fit]
            mask = np.zeros(len(others), bool)
            mask[alive] = True
            return mask

        return near

    return relation


def verified(percent: int = PERCENT, shingle: int = SHINGLE, miss: float = MISS):
    """The relation of pairs that are linked by their full sets, looked at only where batches leave a pair; members are a beginning and a text."""
    rough = unpruned(percent, miss)

    def relation(what: list[bytes]):
        sets = [shingle_set(w[_HEAD:].decode(), shingle) for w in what]
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        cuts, mark, likely = np.r_[0, np.cumsum(sizes)], np.zeros(len(names), bool), rough(what)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            mask = likely(i, others)
            own = flat[cuts[i] : cuts[i + 1]]
            mark[own] = True
            for k in np.flatnonzero(mask):
                j = others[k]
                common = np.count_nonzero(mark[flat[cuts[j] : cuts[j + 1]]])
                mask[k] = 100 * common >= percent * (sizes[i] + sizes[j] - common)
            mark[own] = False
            return mask

        return near

    return relation


def near_duplicates(docs: DataFrame, folder: str, percent: int = PERCENT, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id", cell: int = crowds.CELL) -> DataFrame:
    """`(id, n_shingles, component_id, kept)` of every row of docs.  Tables go below folder."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    prints = to_table(_prints(rows, shingle), f"{folder}/prints")
    filled = prints.filter("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = to_table(filled.select("cls", "rep.id", "rep.h", "rows", "bands", "sig"), f"{folder}/classes")
    keys = classes.select(F.explode("bands").alias("key"), "cls")
    rough = crowds.components(keys, unpruned(percent), f"{folder}/rough", cell, whats=classes.select("cls", F.col("sig").alias("what"))).select(F.col("node").alias("cls"), F.col("root").alias("key"))
    wanted = to_table(rough.join(classes.select("cls", "id", "h", "sig"), "cls"), f"{folder}/wanted")
    named = wanted.select(F.struct("id", "h").alias("r"), "key", "cls", "sig")  # a struct meets its equal though the id is null
    found = rows.select(F.struct("id", "h").alias("r"), "text").join(named, "r").select("key", "cls", F.concat("sig", F.encode("text", "utf-8")).alias("what"))
    members = to_table(found.dropDuplicates(["key", "cls"]), f"{folder}/members")
    roots = crowds.components(members, verified(percent, shingle), f"{folder}/exact", cell).select(F.col("node").alias("cls"), "root")
    linked = to_table(roots.join(classes.select("cls", "id"), "cls"), f"{folder}/linked")
    least = to_table(linked.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), f"{folder}/least")
    large = least.filter(F.col("n") * HOT > linked.count())
    grouped = join_hot(linked, least.select("root", "least"), large.select("root", "least"), "root", F.col("cls")).select("cls", "least")
    of_class = to_table(classes.select("cls", "id", "rows").join(grouped, "cls", "left").select("cls", "rows", F.coalesce("least", "id").alias("component")), f"{folder}/components")
    hot = of_class.filter(F.col("rows") * HOT > prints.count()).select("cls", "component")
    met = join_hot(prints.select("id", "cls", "n"), of_class.select("cls", "component"), hot, "cls", F.col("id"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return met.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op11_bayes_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "minhash"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Pairs share one of the rarest shingles of either: with 15 % of the larger set and one more left out, nothing at 85 % is missed.
OP11_SQL = f"""with recursive
  d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
          else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from d),
  n as (select doc_id, count(*) as n from s group by doc_id),
  f as (select g, count(*) as f from s group by g having count(*) > 1),
  k as (select doc_id, g, n, row_number() over (partition by doc_id order by coalesce(f, 1), g) as r from s join n using (doc_id) left join f using (g)),
  c as (select distinct a.doc_id as a, b.doc_id as b from k a join k b on a.g = b.g and a.doc_id < b.doc_id and a.r <= a.n - (85 * a.n + 99) // 100 + 1 and b.r <= b.n - (85 * b.n + 99) // 100 + 1
        where 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
  i as (select a, b, count(*) as i from c join s x on x.doc_id = a join s y on y.doc_id = b and x.g = y.g group by a, b),
  l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
  e as (select a, b from l union all select b, a from l),
  walk as (select doc_id, doc_id as root from n union select e.b, walk.root from walk join e on e.a = walk.doc_id),
  m as (select doc_id, min(root) as component_id from walk group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from documents left join n using (doc_id) left join m using (doc_id)"""
