"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit for each rule that
failed.  A policy is a named mask over those bits, so judging a corpus under another policy, or asking what a
rule contributes, reads the ledger and never the texts.  Only DataFrame functions are used.

Null or empty text has no words and fails `few_words`.  Repeated rows are judged alike; long texts are measured
whole.  Other columns are carried along; where one has a measurement's name, it is returned as given_<name>.  An empty
table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import free_name

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule name -> condition of failing, over the measurements.  The position is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "capitals": "100 * n_capitals > 30 * word_chars",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Version -> mask.  Old versions stay, so that earlier verdicts can be reproduced.
POLICIES = {1: BASE, 2: (1 << len(RULES)) - 1}
CURRENT = 2
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES to docs.  Everything is computed within the row: no shuffle, whatever the skew."""
    body, words, hashes, runs, kept = (free_name(docs, n) for n in ("__body", "__words", "__hashes", "__runs", "__lines"))
    df = docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(body, SPACE), ""))
    w, n = F.col(words), F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    # 64-bit hashes find the texts without a repeated window; only the others sort the windows themselves
    df = df.withColumn(hashes, F.transform(at, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))
    window = lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn(
        runs,
        F.when(repeated, F.sort_array(F.transform(at, lambda i: F.struct(F.get(hashes, i - 1).alias("h"), window(i).alias("s"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,s:string,i:int>>")),
    )
    r = F.col(runs)
    same = lambda x, k: (F.get(r, k)["h"] == x["h"]) & (F.get(r, k)["s"] == x["s"])
    twice = F.filter(r, lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | F.coalesce(same(x, k - 1), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(_without(x, SPACE_CHARS)) > 0)
    df = df.withColumn(kept, lines)
    size = F.length(body)
    measures = F.struct(
        n.cast("long").alias("n_words"),
        F.length(_without(F.col(body), SPACE_CHARS)).cast("long").alias("word_chars"),
        (size - F.length(_without(F.col(body), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
        F.when(F.size(r) == 0, F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size(kept).cast("long").alias("n_lines"),
        (size - F.length(_without(F.col(body), CAPITALS))).cast("long").alias("n_capitals"),
    )
    # a generator of one row: filters on the measurements stay above it, so nothing is worked out anew for them
    return df.select(*[df[f"`{c}`"] for c in docs.columns], F.inline(F.array(measures)))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of docs (all if None), the measurements and `failure_bits`."""
    narrow = docs if keep is None else docs.select(*dict.fromkeys([*keep, text]))
    clash = {c: free_name(docs, f"given_{c}") for c in narrow.columns if c.lower() in [*MEASURES, "failure_bits"]}
    narrow, text, keep = narrow.withColumnsRenamed(clash), clash.get(text, text), keep and [clash.get(c, c) for c in keep]
    measured = measure(narrow, text)
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    out = measured.withColumn("failure_bits", bits)
    return out if keep is None else out.select(*keep, *MEASURES, "failure_bits")


def passes(bits: Column, version: int = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: how many rows it fails, fails alone, and how many would pass without it.

    One pass over the ledger; the rows that come out are as many as there are rules.
    """
    mask = POLICIES[version]
    active = [name for name in RULES if BITS[name] & mask]
    masked = F.col("failure_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(masked == 0).alias("passing")]
    for name in active:
        sums += [F.count_if(masked.bitwiseAND(F.lit(BITS[name]).cast("long")) != 0).alias(f"any_{name}"), F.count_if(masked == BITS[name]).alias(f"only_{name}")]
    one = book.agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit"), F.col(f"any_{name}").alias("failed"), F.col(f"only_{name}").alias("failed_alone"), (F.col("passing") + F.col(f"only_{name}")).alias("passing_without"), F.col("n").alias("n_rows"))
        for name in active
    ])
    return one.select(F.inline(rows))


def op7_quality_ledger(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    book = ledger(docs, keep=["doc_id"])
    failed = ~passes(F.col("failure_bits"), 1)
    return book.select("doc_id", *MEASURES, "failure_bits", failed.alias("base_failed"), (~failed & passes(F.col("failure_bits"))).alias("kept"))


def ledger_ablations(spark, sf_dir: str) -> DataFrame:
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]))


OP7_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(text, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) as l
  from d
), t as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as tri
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)
), c as (
  select rid, count(distinct p) as n_repeat_words
  from (select rid, unnest([i, i + 1, i + 2]) as p from (select rid, i, count(*) over (partition by rid, tri) as n from t) where n >= 2)
  group by rid
), m as (
  select doc_id, cast(len(w) as bigint) as n_words,
         cast(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
         cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(len(l) as bigint) as n_lines,
         cast(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint) as n_capitals
  from w left join c using (rid)
), b as (
  select *, cast((n_words < 50)::int + (100 * n_repeat_words > 50 * n_words)::int * 2 + (100 * n_symbols > 10 * n_words)::int * 4
       + (100 * n_dup_lines > 30 * n_lines)::int * 8 + (n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words))::int * 16
       + (100 * n_capitals > 30 * word_chars)::int * 32 as bigint) as failure_bits
  from m
)
select *, (failure_bits & 3) <> 0 as base_failed, failure_bits = 0 as kept from b
"""

ABLATIONS_SQL = OP7_SQL.replace("select *, (failure_bits & 3) <> 0 as base_failed, failure_bits = 0 as kept from b", "") + """, r(rule, bit) as (
  values """ + ", ".join(f"('{name}', cast({bit} as bigint))" for name, bit in BITS.items()) + """
)
select rule, bit, count(*) filter (failure_bits & bit <> 0) as failed, count(*) filter (failure_bits = bit) as failed_alone,
       count(*) filter (failure_bits = 0 or failure_bits = bit) as passing_without, count(*) as n_rows
from b, r group by rule, bit
"""
