"""Verdicts on fills and on the flanks of gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import coverage


def validate_complete(aln: DataFrame, fills: DataFrame) -> DataFrame:
    """Fills as regions (region_id, chrom, r_start, r_end): 1 spanning read below 1 kb, else 2, and mean coverage 2."""
    stats = coverage.region_stats(aln, fills).join(fills.select("region_id", (F.col("r_end") - F.col("r_start")).alias("fill_length")), "region_id")
    needed = F.when(F.col("fill_length") < 1000, 1).otherwise(2)
    valid = (F.col("spanning_reads") >= needed) & (F.col("avg_coverage") >= 2.0)
    score = coverage.confidence(F.col("spanning_reads"), F.col("avg_coverage"), F.col("zero_coverage_ratio"), (F.col("left_clip_ratio") + F.col("right_clip_ratio")) / 2)
    return stats.select("region_id", "spanning_reads", "avg_coverage", valid.alias("valid"), F.round(score, 6).alias("confidence"), F.when(valid, "filled_complete").otherwise("failed").alias("status"))


def validate_partial(aln: DataFrame, fills: DataFrame) -> DataFrame:
    """Partial fills (fill_id, chrom, gap_start, gap_end, new_start, new_end): each filled side by its junction and its bases."""
    left = fills.filter("new_start > gap_start").select(F.concat("fill_id", F.lit("/l")).alias("side_id"), "chrom", F.col("gap_start").alias("pos"), F.col("gap_start").alias("r_start"), F.col("new_start").alias("r_end"))
    right = fills.filter("gap_end > new_end").select(F.concat("fill_id", F.lit("/r")).alias("side_id"), "chrom", F.col("gap_end").alias("pos"), F.col("new_end").alias("r_start"), F.col("gap_end").alias("r_end"))
    sides = left.unionByName(right)
    junction = coverage.junction_coverage(aln, sides.withColumnRenamed("side_id", "point_id"))
    stats = coverage.region_stats(aln, sides.withColumnRenamed("side_id", "region_id"))
    judged = junction.join(stats, F.col("point_id") == F.col("region_id")).select(
        F.substring_index("point_id", "/", 1).alias("fill_id"),
        F.substring_index("point_id", "/", -1).alias("side"),
        (F.expr("junction_coverage >= 5 and avg_coverage >= 5 and zero_coverage_ratio <= 0.05")).alias("ok"),
    )
    verdict = judged.groupBy("fill_id").agg(F.bool_or(F.when(F.col("side") == "l", F.col("ok"))).alias("left_valid"), F.bool_or(F.when(F.col("side") == "r", F.col("ok"))).alias("right_valid"))
    out = fills.select("fill_id").join(verdict, "fill_id", "left")
    valid = F.coalesce("left_valid", F.lit(False)) | F.coalesce("right_valid", F.lit(False))
    return out.select("fill_id", "left_valid", "right_valid", valid.alias("valid"), F.when(valid, "filled_partial").otherwise("failed").alias("status"))


def flanks_of(gaps: DataFrame, size: int = coverage.FLANK) -> DataFrame:
    """(flank_id, gap_id, chrom, f_start, f_end) of both sides of each gap."""
    left = F.struct(F.concat("gap_id", F.lit("/l")).alias("flank_id"), F.greatest(F.col("gap_start") - size, F.lit(0)).alias("f_start"), F.col("gap_start").alias("f_end"))
    right = F.struct(F.concat("gap_id", F.lit("/r")).alias("flank_id"), F.col("gap_end").alias("f_start"), (F.col("gap_end") + size).alias("f_end"))
    return gaps.select("gap_id", "chrom", F.inline(F.array(left, right)))


def triage(aln: DataFrame, gaps: DataFrame, otherwise: str = "unfillable") -> DataFrame:
    """needs_polish where a flank of the gap has an issue; else `unfillable` after a failure, `pending` before a first try."""
    flanks = flanks_of(gaps)
    bad = coverage.flank_analysis(aln, flanks.drop("gap_id")).join(flanks.select("flank_id", "gap_id"), "flank_id").groupBy("gap_id").agg(F.bool_or("has_issue").alias("bad"))
    return bad.select("gap_id", F.when(F.col("bad"), "needs_polish").otherwise(otherwise).alias("status"))


def pre_assess(aln: DataFrame, gaps: DataFrame) -> DataFrame:
    return triage(aln, gaps, "pending")
