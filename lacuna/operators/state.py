"""Status of gaps over rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "filled_pending", "filled_complete", "filled_partial", "unfillable", "failed", "needs_polish")


def latest(log: DataFrame) -> DataFrame:
    """`(gap_id, status)` of each gap's last entry (by ts, then seq_no); one aggregation, no sort."""
    return log.groupBy("gap_id").agg(F.max_by("status", F.struct("ts", "seq_no")).alias("status"))


def latest_by_haplotype(log: DataFrame) -> DataFrame:
    """`(hap, gap_id, status)` of each haplotype's last entry for a gap."""
    return log.groupBy("hap", "gap_id").agg(F.max_by("status", F.struct("ts", "seq_no")).alias("status"))


def loaded(log: DataFrame) -> DataFrame:
    """Statuses of older logs: unknown ones and filled_pending become failed."""
    known = F.col("status").isin(*STATUSES) & (F.col("status") != "filled_pending")
    return log.withColumn("status", F.when(known, F.col("status")).otherwise("failed"))


def summary(log: DataFrame) -> DataFrame:
    return latest(log).groupBy("status").agg(F.count(F.lit(1)).alias("n_gaps"))


def history(log: DataFrame) -> DataFrame:
    """`(gap_id, statuses)` in order."""
    return log.groupBy("gap_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq_no", "status"))), lambda x: x["status"]).alias("statuses"))


def after_round(state: DataFrame, results: DataFrame) -> DataFrame:
    """State (gap_id, status) with a round's results (gap_id, success, complete, validated, triage) merged in."""
    new = F.when(F.col("success") & F.col("validated") & F.col("complete"), "filled_complete").when(F.col("success") & F.col("validated"), "filled_partial").when(~F.col("success") & (F.col("triage") == "unfillable"), "unfillable").otherwise("failed")
    return state.join(results.select("gap_id", new.alias("new")), "gap_id", "full").select("gap_id", F.coalesce("new", "status").alias("status"))
