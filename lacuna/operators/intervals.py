"""Interval joins with equi-keys: every interval is dealt to the fixed-width bins that it touches.

A pair that meets in several bins is kept in one of them, the later of the two first bins, so nothing has to be
made distinct afterwards.  The join is on (chrom, bin) and stays a hash or sort-merge join at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 10_000


def _first(start: Column, width: int) -> Column:
    return F.floor(start / width).cast("bigint")


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width).cast("bigint")
    return df.withColumn("__bin", F.explode(F.sequence(_first(F.col(start), width), last)))


def overlap_join(reads: DataFrame, windows: DataFrame, read: tuple[str, str] = ("ref_start", "ref_end"), window: tuple[str, str] = ("w_start", "w_end"), width: int = BIN) -> DataFrame:
    """Pairs of a read and a window of the same chrom that share a base: start < w_end and end > w_start.

    Column names must differ but for chrom.
    """
    a, b = _binned(reads, *read, width), _binned(windows, *window, width)
    first = F.greatest(_first(F.col(read[0]), width), _first(F.col(window[0]), width))  # worked out after the shuffle
    met = (F.col("__bin") == first) & (F.col(read[0]) < F.col(window[1])) & (F.col(read[1]) > F.col(window[0]))
    return a.join(b, ["chrom", "__bin"]).filter(met).drop("__bin")


def depth_segments(pieces: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, seg_start, seg_end, depth)` over each region (keys, r_start, r_end) from its pieces (keys, p_start, p_end).

    Sweep line: +1 and -1 at the ends of pieces clipped to the region, 0 at the region's ends.
    """
    from pyspark.sql import Window

    marks = regions.select(*keys, F.explode(F.array("r_start", "r_end")).alias("pos"), F.lit(0).alias("step"))
    inside = pieces.filter("p_start < p_end")
    steps = inside.select(*keys, F.inline(F.array(F.struct(F.col("p_start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("p_end").alias("pos"), F.lit(-1).alias("step")))))
    summed = marks.unionByName(steps).groupBy(*keys, "pos").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*keys).orderBy("pos")
    return (
        summed.withColumn("depth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("seg_end", F.lead("pos").over(order))
        .filter("seg_end is not null")
        .select(*keys, F.col("pos").alias("seg_start"), "seg_end", "depth")
    )
