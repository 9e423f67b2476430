"""Coverage, boundary and clip measurements over regions of the assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.intervals import depth_segments, overlap_join
from lacuna.operators.reads import mapped

FETCH = 500
ZONE = 100
HALF_JUNCTION = 50
FLANK = 1000
CLIP_READS = 5
MAX_DENSITY = 0.05


def primary(aln: DataFrame) -> DataFrame:
    return mapped(aln).filter(~F.col("is_secondary") & ~F.col("is_supplementary"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def region_stats(aln: DataFrame, regions: DataFrame) -> DataFrame:
    """Eight measurements per region (region_id, chrom, r_start, r_end) from the primary alignments around it."""
    windows = regions.select("region_id", "chrom", "r_start", "r_end", F.greatest(F.col("r_start") - FETCH, F.lit(0)).alias("w_start"), (F.col("r_end") + FETCH).alias("w_end"))
    met = overlap_join(primary(aln), windows)
    ends, starts = F.col("ref_end").between(F.col("r_start") - ZONE, F.col("r_start") + ZONE), F.col("ref_start").between(F.col("r_end") - ZONE, F.col("r_end") + ZONE)
    counts = met.groupBy("region_id").agg(
        F.count_if(F.expr("ref_start <= r_start and ref_end >= r_end")).alias("spanning_reads"),
        F.count_if(F.expr("ref_start < r_start and r_start < ref_end")).alias("left_boundary_reads"),
        F.count_if(F.expr("ref_start < r_end and r_end < ref_end")).alias("right_boundary_reads"),
        _ratio(F.count_if(ends & (F.col("rclip") > 0)), F.count_if(ends)).alias("left_clip_ratio"),
        _ratio(F.count_if(starts & (F.col("lclip") > 0)), F.count_if(starts)).alias("right_clip_ratio"),
    )
    pieces = met.select("region_id", F.greatest("ref_start", "r_start").alias("p_start"), F.least("ref_end", "r_end").alias("p_end"))
    width = F.col("seg_end") - F.col("seg_start")
    depth = depth_segments(pieces, regions.filter("r_end > r_start"), ["region_id"]).groupBy("region_id").agg(
        (F.sum(F.col("depth") * width) / F.sum(width)).alias("avg_coverage"),
        F.min("depth").cast("bigint").alias("min_coverage"),
        (F.sum(F.when(F.col("depth") == 0, width).otherwise(0)) / F.sum(width)).alias("zero_coverage_ratio"),
    )
    out = regions.select("region_id").join(counts, "region_id", "left").join(depth, "region_id", "left")
    return out.na.fill(1.0, ["zero_coverage_ratio"]).na.fill(0)


def junction_coverage(aln: DataFrame, points: DataFrame) -> DataFrame:
    """`(point_id, junction_coverage)`: mean depth of primary alignments within HALF_JUNCTION of (point_id, chrom, pos)."""
    windows = points.select("point_id", "chrom", F.greatest(F.col("pos") - HALF_JUNCTION, F.lit(0)).alias("w_start"), (F.col("pos") + HALF_JUNCTION).alias("w_end"))
    covered = F.least("ref_end", "w_end") - F.greatest("ref_start", "w_start")
    sums = overlap_join(primary(aln), windows).groupBy("point_id").agg(F.sum(covered).alias("bases"))
    return windows.join(sums, "point_id", "left").select("point_id", (F.coalesce("bases", F.lit(0)) / (F.col("w_end") - F.col("w_start"))).alias("junction_coverage"))


def clip_histogram(aln: DataFrame, flanks: DataFrame) -> DataFrame:
    """`(flank_id, pos, n_reads)`: primary alignments soft-clipped at each place within a flank (flank_id, chrom, f_start, f_end)."""
    met = overlap_join(primary(aln), flanks, window=("f_start", "f_end"))
    at = F.array_compact(F.array(F.when(F.col("lclip") > 0, F.col("ref_start")), F.when(F.col("rclip") > 0, F.col("ref_end"))))
    places = met.select("flank_id", "f_start", "f_end", F.explode(at).alias("pos"))
    return places.filter("pos >= f_start and pos < f_end").groupBy("flank_id", "pos").agg(F.count(F.lit(1)).alias("n_reads"))


def mismatch_density(aln: DataFrame, flanks: DataFrame) -> DataFrame:
    """`(flank_id, mismatches, aligned, density)` from the MD tags of primary alignments that have one."""
    met = overlap_join(primary(aln).filter("md is not null"), flanks, window=("f_start", "f_end"))
    sums = met.groupBy("flank_id").agg(F.sum(F.regexp_count("md", F.lit("[ACGT]"))).cast("bigint").alias("mismatches"), F.sum("read_len").cast("bigint").alias("aligned"))
    return sums.withColumn("density", _ratio(F.col("mismatches"), F.col("aligned")))


def flank_analysis(aln: DataFrame, flanks: DataFrame) -> DataFrame:
    """Per flank: the most reads clipped at one place, the mismatch density, and whether either is an issue."""
    clips = clip_histogram(aln, flanks).groupBy("flank_id").agg(F.max("n_reads").alias("max_clips"))
    density = mismatch_density(aln, flanks).select("flank_id", "density")
    out = flanks.select("flank_id").join(clips, "flank_id", "left").join(density, "flank_id", "left").na.fill(0)
    return out.withColumn("has_issue", (F.col("max_clips") >= CLIP_READS) | (F.col("density") > MAX_DENSITY))


def confidence(spanning: Column, coverage: Column, zero_ratio: Column, clip_ratio: Column) -> Column:
    """Sum of four stepwise components, 1.0 at most."""
    return F.least(
        F.when(spanning >= 5, 0.4).when(spanning >= 2, 0.3).when(spanning >= 1, 0.2).otherwise(0.0)
        + F.when(coverage >= 10, 0.3).when(coverage >= 5, 0.2).when(coverage >= 2, 0.1).otherwise(0.0)
        + F.when(zero_ratio == 0, 0.2).when(zero_ratio < 0.02, 0.1).otherwise(0.0)
        + F.when(clip_ratio < 0.1, 0.1).when(clip_ratio < 0.2, 0.05).otherwise(0.0),
        F.lit(1.0),
    )
