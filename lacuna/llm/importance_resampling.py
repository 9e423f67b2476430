"""Target-distribution importance resampling over hashed word n-grams.

Features are the runs of 1 to ORDER consecutive words of a text (A-Z lower-cased, a word is a run of digits, a-z and
characters above 0x7F), each hashed to one of BUCKETS buckets by the CRC-32 of its UTF-8 bytes.  The corpus is kept as
a sparse document-by-bucket count matrix: a table in the shared folder whose rows are CSR blocks of BLOCK_ROWS
documents or BLOCK_BYTES of text at most.  Column sums of the blocks give the distribution of the corpus, those of the
target's blocks the wanted one; each bucket has a gain, the scaled logarithm of the ratio of both, and a product of the
matrix with the gains gives the weights.  With Gumbel noise by a hash of the id the highest scores are a draw without
replacement in proportion to the weights, the same at any layout and size.

What reaches the driver: one number for each bucket, and the number of documents for each score (scores are integers
within +-2^17, so at most 2^18 rows), from which each score's first rank follows.  Within a score ranks are a window.

Null texts have no words, and empty ones none: no features, weight 0, never drawn.  Long texts are read whole.  Ties go
to the smaller id, then to the smaller weight and number of features.  Repeated rows are all drawn or not on their own;
rows without an id take their noise from the empty name and lose ties.  An empty target has no counts, so gains only
undo the corpus; an empty table gives no rows.  Other columns are not looked at, so none can clash.
"""

from __future__ import annotations

import re
import zlib
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.workspace import new_folder, portions, rows_at_once, to_table

BUCKETS = 10_000
ORDER = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: Blocks that are in memory at once, and bytes of a group of the matrix's rows on disk.
BLOCKS, GROUP_BYTES = 8, 8 << 20
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets_of(text: str | None, order: int = ORDER, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature, repeats included."""
    words = _word.findall((text or "").encode().lower())
    spaced, now = [b" " + w for w in words], list(map(zlib.crc32, words))
    found = list(now)
    for n in range(1, order):  # the CRC of a longer run goes on from that of its beginning
        now = list(map(zlib.crc32, spaced[n:], now))
        found += now
    return len(words), np.array(found, np.int64) % n_buckets


def count_matrix(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id", order: int = ORDER, n_buckets: int = BUCKETS) -> DataFrame:
    """Table of CSR blocks `(ids, n_words, n_features, starts, buckets, counts)`: a block's row k has the entries starts[k] to starts[k + 1]."""

    def run(batches):
        for batch in batches:
            for at, n in portions(batch.column(1), BLOCK_ROWS, BLOCK_BYTES):
                words, features, starts, columns, counts = [], [], [0], [], []
                for t in batch.column(1).slice(at, n).to_pylist():
                    m, found = buckets_of(t, order, n_buckets)
                    column, count = np.unique(found, return_counts=True)
                    words.append(m)
                    features.append(len(found))
                    starts.append(starts[-1] + len(column))
                    columns.append(column)
                    counts.append(count)
                block = [batch.column(0).slice(at, n).to_pylist(), words, features, starts, np.concatenate(columns).astype("<u4").tobytes(), np.concatenate(counts).astype("<u4").tobytes()]
                kinds = [pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block, kinds, strict=True)], ["ids", "n_words", "n_features", "starts", "buckets", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    blocks = narrow.mapInArrow(run, f"ids array<{kind}>, n_words array<bigint>, n_features array<bigint>, starts array<bigint>, buckets binary, counts binary")
    return to_table(blocks, folder, compression="zstd", group_bytes=GROUP_BYTES)


def _entries(batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    view = lambda name: np.frombuffer(batch.column(name)[k].as_buffer(), "<u4").astype(np.int64)
    return view("buckets"), view("counts")


def column_sums(blocks: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences in each bucket; a task hands on one row for each bucket at most."""

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                np.add.at(total, *_entries(batch, k))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    with rows_at_once(blocks.sparkSession, BLOCKS):
        sums = blocks.select("buckets", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect()
    for bucket, n in sums:
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) for each bucket."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([floor(1000 * log(float(target[k] + 1) * all_corpus / (float(corpus[k] + 1) * all_target))) for k in range(n)], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """`(id, n_words, n_features, weight)`: the floored mean gain of each document's features, 0 without any."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                column, count = _entries(batch, k)
                starts, features = np.array(batch.column("starts")[k].as_py()), np.array(batch.column("n_features")[k].as_py(), np.int64)
                upto = np.concatenate([[0], np.cumsum(gains[column] * count)])
                weight = (upto[starts[1:]] - upto[starts[:-1]]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("n_words")[k].values, pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def drawn(weighted: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """weighted with `score` and `rank`: of the rows with min_words words the given percentage of highest scores has a rank, from 1."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighted.withColumn("score", (F.col("weight") + noise).cast("bigint")).withColumn("__fit", F.col("n_words") >= min_words)
    before, first = 0, {}
    by_score = sorted(scored.filter("__fit").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    take = percent * sum(r["n"] for r in by_score) // 100
    for score, n in by_score:
        if before < take:
            first[score] = before
        before += n
    known = weighted.sparkSession.createDataFrame(list(first.items()), "score bigint, __before bigint")
    order = Window.partitionBy("score", "__fit").orderBy(F.asc_nulls_last("id"), "weight", "n_features", "n_words")
    placed = scored.join(F.broadcast(known), "score", "left").withColumn("__at", F.col("__before") + F.row_number().over(order))
    rank = F.when(F.col("__fit") & (F.col("__at") <= take), F.col("__at")).cast("bigint")
    return placed.withColumn("rank", rank).drop("__fit", "__before", "__at")


def resampled(docs: DataFrame, target: DataFrame, folder: str, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, text: str = "text", id_col: str = "doc_id", target_text: str = "text") -> DataFrame:
    """`(id, n_words, n_features, weight, score, rank)` of every row of docs; the matrices are tables below folder."""
    matrix = count_matrix(docs, f"{folder}/corpus", text, id_col)
    wanted = count_matrix(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), f"{folder}/target", "text", "id")
    gains = gains_of(column_sums(matrix), column_sums(wanted))
    with rows_at_once(matrix.sparkSession, BLOCKS):
        weighted = to_table(weights(matrix, gains), f"{folder}/weights")
    return drawn(weighted, percent, min_words, seed).withColumnRenamed("id", id_col)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target, new_folder(spark, "resampling")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CRC-32 by its polynomial, a byte's 256 remainders first, and only once for each distinct feature.
OP12_SQL = f"""with
  r as (select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by b) as t
        from (select cast(unnest(range(0, 256)) as bigint) as b)),
  d as (select doc_id, {_WORDS.format("text")} as ws from documents), b as (select {_WORDS.format("text")} as ws from benchmark),
  pairs as (select doc_id, unnest(ws || list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) as f from d),
  wanted as (select unnest(ws || list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) as f from b),
  names as (select f, hex(encode(f)) as h from (select f from pairs union select f from wanted)),
  crc as (select f, xor(list_reduce([cast(4294967295 as bigint)] || list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint)),
            lambda a, x: xor(t[xor(a & 255, x) + 1], a >> 8)), 4294967295) % 10000 as k from names, r),
  c as (select doc_id, k, count(*) as n from pairs join crc using (f) group by doc_id, k),
  s as (select k, sum(n) as s from c group by k), t as (select k, count(*) as t from wanted join crc using (f) group by k),
  g as (select k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select sum(s) from s) + 10000)::double / ((s + 1)::double * ((select coalesce(sum(t), 0) from t) + 10000)::double)))::bigint as g from s left join t using (k)),
  w as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * g)::double / sum(n))::bigint as weight from c join g using (k) group by doc_id),
  p as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(ws) as n_words,
          (coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))))::bigint as score from d left join w using (doc_id)),
  q as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r from p)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 25 * (select count(*) from p where n_words >= 20) // 100 then r end as rank, n_words::bigint as n_words from q"""
