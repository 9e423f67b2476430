"""Cleaning pipeline over `documents`: quality rules, quality classifier, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), reads all that the stage before kept, and returns a DataFrame; `run` writes
it as Parquet in the shared folder and reads it again for the next one.  All stages but the last return the columns
of their input.

Rows are judged one by one except for near-duplicates, where one row of each group stays: that with the least
doc_id, and of rows with equal doc_id the first by hash of the text.  Rows of different groups never compete, whatever
their ids.  Rows without a doc_id belong to no group and stay.  Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import byte_bpe, decontamination, near_copies, quality_ledger, quality_mil
from lacuna.llm.workspace import free_name, new_folder, to_table
from lacuna.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy."""
    boxed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    book = quality_ledger.ledger(boxed, keep=["row"])
    return book.filter(quality_ledger.passes(F.col("failure_bits"))).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model predicts to be of quality 1.

    The model learns from the labelled rows of the raw documents: what the rules left has hardly any of label 0.
    """
    ship(spark)
    raw, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    name = free_name(docs, "__score")
    scored = quality_mil.with_score(docs, quality_mil.train(raw, labels), name=name)
    return scored.filter(F.col(name) >= quality_mil.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by op8's method (SimHash with Golay keys) or at a Jaccard similarity of 0.8, both of five-word shingles."""
    ship(spark)
    h, named = free_name(docs, "__h"), docs.filter("doc_id is not null")
    kept = near_copies.first_of_groups(named.select("doc_id", "text")).select(F.col("id").alias("doc_id"), F.col("h").alias(h))
    met = named.withColumn(h, F.xxhash64("text")).join(kept, ["doc_id", h], "left_semi")  # one row of a group, and rows equal to it
    return met.dropDuplicates(["doc_id", h]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    ship(spark)
    return decontamination.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    ship(spark)
    return byte_bpe.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: A trained classifier isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = to_table(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
