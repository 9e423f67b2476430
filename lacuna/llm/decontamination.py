"""Benchmark decontamination by pigeonhole edit matching.

An item's normal form (its words in lower case, one space between) may differ from a run of whole words of a document's
by up to `budget` edits, RATE of its length; what lies within a word is no match.  Cut into budget + 1 pieces, at least one piece is untouched, so every match contains
an exact hit of a piece at its place.  Hits of all pieces come from one Aho-Corasick pass over the document; the
regions around an item's hits are merged, so that none is read twice, and Myers' bit-parallel algorithm finds the
ends of all parts of the region within the budget; from those that end a word it goes back to where words begin.

The items of the benchmark go to the tasks by broadcast, in blocks of at most about BLOCK_BYTES of text; a larger
benchmark takes one pass over the documents for each block, and one block is alive at a time: what its pass found is
written before the next is read.  There is no shuffle and no pairing of rows.

Null or empty texts and items without words match nothing.  Equal items and repeated rows are all reported.  Ids of
documents and items may be of any type, and null.  Long texts are searched whole.  Empty tables give no matches, and
without matches all documents stay, with all their columns; no column is added, so no name can clash.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import new_folder, portions, rows_of, to_table

RATE = 0.05
BLOCK_BYTES = 16 << 20
_word = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return " ".join(_word.findall(text)).lower()


def budget_of(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces as (offset, text), their lengths at most one apart."""
    n = min(budget + 1, len(item))
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(masks: dict[str, int], m: int, text: str, budget: int) -> list[int]:
    """Ends of the parts of text within budget of a pattern of m characters."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, ends = full, 0, m, []
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(xh | up)), up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full  # a match may start anywhere, so no carry comes in
        up, down = minus | (full & ~(xv | plus)), plus & xv
        if score <= budget:
            ends.append(at)
    return ends


class Matcher:
    """The items of one block, compiled."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            form = normal(text or "")
            if not form:
                continue
            budget = budget_of(len(form), rate)
            for at, piece in pieces(form, budget):
                places.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, form, budget, masks_of(form), masks_of(form[::-1])))
        self.find = ahocorasick.Automaton()
        for piece, where in places.items():
            self.find.add_word(piece, (len(piece), where))
        if places:
            self.find.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's best match, offsets in the text as given."""
        if not self.items or not text:
            return []
        form = normal(text)
        regions: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.find.iter(form):
            for k, at in where:
                _, item, budget, _, _ = self.items[k]
                begin = last - length + 1 - at - budget
                a, b = max(0, begin), min(len(form), begin + len(item) + 2 * budget)
                own = regions.setdefault(k, [])
                if own and own[-1][0] <= a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        out, spans = [], None
        for k, own in sorted(regions.items()):
            item_id, item, budget, masks, backward = self.items[k]
            own.sort()
            merged = [own[0]]
            for a, b in own[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                for end in myers(masks, len(item), form[a:b], budget):
                    if a + end == len(form) or form[a + end] == " ":
                        found = _to_word_start(backward, len(item), form, a + end, budget)
                        best = min(filter(None, (best, found)), default=None)
            if best is None:
                continue
            distance, end, begin = best
            if spans is None:
                spans = _word_spans(text)
            out.append((item_id, distance, *_outside(spans, begin, end)))
        return out


def _to_word_start(masks: dict[str, int], m: int, form: str, end: int, budget: int) -> tuple[int, int, int] | None:
    """(distance, end, begin) of the part of form up to end that begins with a word and is nearest to the whole pattern, if within budget; of equals the longest."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for begin in range(end - 1, max(0, end - m - budget) - 1, -1):
        eq = masks.get(form[begin], 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(xh | up)), up & xh
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(xv | plus)), plus & xv
        if score <= budget and (not begin or form[begin - 1] == " ") and (best is None or score <= best[0]):
            best = (score, end, begin)
    return best


def _word_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end) of each word in the normal form and in the text."""
    out, at = [], 0
    for m in _word.finditer(text):
        n = len(m[0].lower())
        out.append((at, at + n, m.start(), m.end()))
        at += n + 1
    return out


def _outside(spans: list[tuple[int, int, int, int]], begin: int, end: int) -> tuple[int, int]:
    """The span in the text of all words that a span of the normal form touches."""
    touched = [s for s in spans if s[0] < end and s[1] > begin]
    return (touched[0][2], touched[-1][3]) if touched else (0, 0)


#: The block that this worker compiled last.
_matchers: list[tuple[list, float, Matcher]] = []


def _blocks(benchmark: DataFrame):
    """One after the other, `(item_id, text)` lists of about BLOCK_BYTES of text, and whether one is the last."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()], k == n - 1


def _matcher(items: list, rate: float) -> Matcher:
    if not _matchers or _matchers[0][0] is not items or _matchers[0][1] != rate:
        _matchers.clear()
        _matchers.append((items, rate, Matcher(items, rate)))
    return _matchers[0][2]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, item_id, distance, start, end)`: the best match of every item in every document that has one."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"{id_col} {kind}, item_id {item_type.simpleString()}, distance int, start bigint, `end` bigint"
    narrow, folder, found = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")), new_folder(spark, "matches"), []
    types = (to_arrow_type(item_type), pa.int32(), pa.int64(), pa.int64())
    for k, (items, last) in enumerate(_blocks(benchmark)):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            match = _matcher(sent.value, rate)
            for batch in batches:
                out = [(i, *hit) for i, t in rows_of(batch, "id", "text") for hit in match(t or "")]
                ids, *columns = zip(*out, strict=True) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], [id_col, "item_id", "distance", "start", "end"])

        part = narrow.mapInArrow(run, schema)
        if not last:
            part = to_table(part, f"{folder}/{k}")
            sent.destroy()
        found.append(part)
    for part in found[1:]:
        found[0] = found[0].unionByName(part)
    return found[0]


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns: one pass for each block, no shuffle."""
    at, folder = docs.columns.index(text), new_folder(docs.sparkSession, "without")
    for k, (items, last) in enumerate(_blocks(benchmark)):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            match = _matcher(sent.value, rate)
            for batch in batches:
                keep = [not match(t or "") for a, n in portions(batch.column(at), 256) for t in batch.column(at).slice(a, n).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = to_table(docs, f"{folder}/{k}")
            sent.destroy()
    return docs


def op3_pigeonhole_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
