"""Ranked lexical search over an inverted index of the whole corpus.

The index is a table in the shared folder: a task cuts its documents into shards of SHARD_CHARS characters and SHARD_DOCS
documents at most, and writes a shard's documents (ids and lengths, sorted by id) and, for each term, the places of its
documents in that order as differences, and its occurrences in them, both in a variable number of bytes.  Building
shuffles nothing.  A search takes the queries in blocks of QUERY_BYTES of text: the postings of a block's terms are
picked out of the index by a broadcast of these terms, their document counts are summed over all shards, and each
shard is then worked on by one task.

Within a shard a query's postings are merged document-at-a-time: a heap holds the query's terms by their next document,
all terms whose next document lies in the run of RUN documents from the least one on are taken off, add their parts
there, and go back with the document that comes next.  Scores of a run are then whole, and enter the query's bounded
heap, keyed by score and then id.  A task keeps one such list for each query over all its shards; the lists of all tasks
are merged by a window that cuts them within tasks first.

A shard's postings and a block's queries bound a task's memory; nothing else depends on the corpus.  A term that all
documents hold is in each shard as one row of the shard's size.

Null texts have no terms.  Documents without terms don't count and are never found.  Equal scores are in order of id,
rows without id last; repeated rows are found one by one.  Repeated queries are answered one by one; queries without
known terms have no rows.  Very long texts are read whole, as a shard of their own if need be.  Empty tables give no
rows.  Only id and text are read, so no column can clash.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.workspace import new_folder, rows_of, to_table

SHARD_CHARS, SHARD_DOCS = 16 << 20, 1 << 16
QUERY_BYTES = 4 << 20
RUN = 4096
TOP = 50
_term = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    return _term.findall((text or "").encode().lower())


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte form of numbers under 2^35 (seven bits a byte, the last one marked), and the number of bytes of each."""
    sizes = 1 + sum((values >> np.int64(7 * k) > 0).astype(np.int64) for k in range(1, 5))
    out, ends = np.empty(int(sizes.sum()), np.uint8), np.cumsum(sizes)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[ends[has] - 1 - k] = (values[has] >> np.int64(7 * k)) & 127
    out[ends - 1] |= 128
    return out, sizes


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw & 128)
    sizes = np.diff(ends, prepend=-1)
    out = np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[has] |= (raw[ends[has] - k] & np.int64(127)) << np.int64(7 * k)
    return out


class Shard:
    """Documents that become one shard."""

    def __init__(self):
        self.ids, self.lengths, self.size = [], [], 0
        self.terms: dict[bytes, int] = {}
        self.term_of, self.doc_of, self.times = array("q"), array("q"), array("q")

    def add(self, id_, text: str | None) -> None:
        found = terms_of(text)
        self.size += len(text or "")
        if not found:
            return
        terms, counts = self.terms, Counter(found)
        self.term_of.extend([terms.setdefault(t, len(terms)) for t in counts])
        self.doc_of.extend([len(self.ids)] * len(counts))
        self.times.extend(counts.values())
        self.ids.append(id_)
        self.lengths.append(len(found))

    def rows(self, shard: int):
        """`(shard, term, df, n_terms, docs, times, ids)`: first the documents, under no term, then the terms in order."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k]) if self.ids[k] is not None else (True, 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        yield shard, None, len(order), int(lengths.sum()), b"", packed(lengths)[0].tobytes(), [self.ids[k] for k in order]
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        term, doc, times = rank[np.array(self.term_of)], place[np.array(self.doc_of)], np.array(self.times)
        by = np.lexsort((doc, term))
        term, doc, times = term[by], doc[by], times[by]
        first = np.r_[True, term[1:] != term[:-1]]
        steps, sizes = packed(np.where(first, doc, np.diff(doc, prepend=0)))
        counts, widths = packed(times)
        begin = np.flatnonzero(first)
        df = np.diff(begin, append=len(term))
        at, of = (np.r_[0, np.cumsum(x)][np.r_[begin, len(term)]].tolist() for x in (sizes, widths))
        steps, counts = steps.tobytes(), counts.tobytes()
        for k, (name, n) in enumerate(zip(names, df.tolist(), strict=True)):
            yield shard, name.decode(), n, None, steps[at[k] : at[k + 1]], counts[of[k] : of[k + 1]], None


def build_index(docs: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The index as a table `(shard, term, df, n_terms, docs, times, ids)`; a shard's documents are the row without a term."""

    def run(batches):
        from pyspark import TaskContext

        number, now, kind = TaskContext.get().partitionId() << 32, Shard(), None

        def flush():
            nonlocal number
            kinds, part = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(kind)], []
            for row in now.rows(number):
                part.append(row)
                if len(part) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
                    part = []
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
            number += 1

        names = ["shard", "term", "df", "n_terms", "docs", "times", "ids"]
        for batch in batches:
            kind = batch.schema.field("id").type
            for i, t in rows_of(batch, "id", "text"):
                now.add(i, t)
                if now.size >= SHARD_CHARS or len(now.ids) >= SHARD_DOCS:
                    if now.ids:
                        yield from flush()
                    now = Shard()
        if now.ids:
            yield from flush()

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    rows = narrow.mapInArrow(run, f"shard bigint, term string, df bigint, n_terms bigint, docs binary, times binary, ids array<{kind}>")
    return to_table(rows, folder, compression="zstd")


def merged(cursors: list[tuple[np.ndarray, np.ndarray]], n_docs: int, heap: list, top: int, floor_: int = 0) -> list:
    """The bounded heap of (score, -document) after merging postings (documents, parts of the score), both in order of the document.

    Only scores above floor_ enter, and a full heap takes only higher ones: documents come in order, so ties are decided.
    """
    ahead = [(int(docs[0]), k, 0) for k, (docs, _) in enumerate(cursors) if len(docs)]
    heapq.heapify(ahead)
    run = np.zeros(min(RUN, n_docs), np.int64)
    while ahead:
        start = ahead[0][0]
        run[:] = 0
        while ahead and ahead[0][0] < start + len(run):
            _, k, at = heapq.heappop(ahead)
            docs, parts = cursors[k]
            end = at + int(np.searchsorted(docs[at:], start + len(run)))
            run[docs[at:end] - start] += parts[at:end]
            if end < len(docs):
                heapq.heappush(ahead, (int(docs[end]), k, end))
        least = max(floor_, heap[0][0] if len(heap) == top else 0)
        found = np.flatnonzero(run > least)
        if len(found) > top:
            found = found[np.lexsort((found, -run[found]))[:top]]
        for j in found.tolist():
            entry = (int(run[j]), -(start + j))
            if len(heap) < top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return heap


def _blocks(queries: DataFrame, id_col: str, text: str):
    """One after the other, lists of `(row number, id, distinct terms)` of about QUERY_BYTES of text."""
    items = queries.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // QUERY_BYTES))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(n)) == k)
        yield [(f"{k}:{j}", i, sorted({x.decode() for x in terms_of(t)})) for j, (i, t) in enumerate(part.collect())]


def _order(entry) -> tuple:
    score, id_ = entry
    return (-score, id_ is None, id_) if id_ is not None else (-score, True, 0)


def search(index: DataFrame, queries: DataFrame, folder: str, top: int = TOP, id_col: str = "doc_id", query_id: str = "item_id", text: str = "text") -> DataFrame:
    """`(query id, rank, id, score)`: each query's best documents of the index, `top` at most."""
    spark, found = index.sparkSession, []
    total = index.filter("term is null").agg(F.sum("df"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    kind, query_kind = index.schema["ids"].dataType.elementType.simpleString(), queries.schema[query_id].dataType.simpleString()
    for k, items in enumerate(_blocks(queries, query_id, text)):
        known = spark.createDataFrame(sorted({(t,) for _, _, ts in items for t in ts}), "term string")
        postings = index.filter("term is not null").join(F.broadcast(known), "term", "left_semi")
        weight = {t: floor(1000 * log(float(2 * n_docs + 2) / float(2 * df + 1))) for t, df in postings.groupBy("term").agg(F.sum("df")).collect()}
        sent = spark.sparkContext.broadcast([(no, [(t, weight[t]) for t in ts if t in weight]) for no, _, ts in items])

        def run(batches, sent=sent):
            best: dict[str, list] = {}
            ids, norm, held = [], None, {}

            def settle():
                for no, terms in sent.value:
                    cursors = [(held[t][0], held[t][1] * w) for t, w in terms if t in held]
                    if not cursors:
                        continue
                    old = best.get(no, [])
                    least = old[-1][0] - 1 if len(old) == top else 0  # ties with other shards are decided by id
                    new = [(score, ids[-j]) for score, j in merged(cursors, len(ids), [], top, max(least, 0))]
                    best[no] = sorted(old + new, key=_order)[:top]

            for batch in batches:
                for at in range(batch.num_rows):
                    term = batch.column("term")[at].as_py()
                    if term is None:
                        if held:
                            settle()
                        ids, held = batch.column("ids")[at].as_py(), {}
                        norm = 100 - 50 + (50 * unpacked(batch.column("times")[at].as_py()) * n_docs) // n_terms
                        continue
                    docs, times = np.cumsum(unpacked(batch.column("docs")[at].as_py())), unpacked(batch.column("times")[at].as_py())
                    held[term] = (docs, 1_000_000_000 * times // (1000 * times + 20 * norm[docs]))
            if held:
                settle()
            rows = [(no, i, score) for no, entries in best.items() for score, i in entries]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), kinds, pa.int64()), strict=True)], ["no", "id", "score"])

        from pyspark.sql.pandas.types import to_arrow_type

        kinds = to_arrow_type(index.schema["ids"].dataType.elementType)
        needed = index.filter("term is null").unionByName(postings.select(*index.columns)).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
        lists = needed.mapInArrow(run, f"no string, id {kind}, score bigint")
        order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(no, i) for no, i, _ in items], f"no string, query {query_kind}")
        found.append(to_table(ranked.join(F.broadcast(names), "no").select(F.col("query").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"), f"{folder}/{k}"))
        sent.destroy()
    for part in found[1:]:
        found[0] = found[0].unionByName(part)
    return found[0]


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs, queries = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    folder = new_folder(spark, "lexical")
    return search(build_index(docs, f"{folder}/index"), queries, f"{folder}/found")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""with
  p as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by doc_id, term),
  d as (select doc_id, sum(tf)::bigint as n from p group by doc_id), a as (select count(*) as n_docs, sum(n)::bigint as n_terms from d),
  q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
  w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, a group by term, n_docs),
  s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::bigint as score
        from q join w using (term) join p using (term) join d using (doc_id), a group by item_id, doc_id),
  r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50"""
