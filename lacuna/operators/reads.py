"""Classification of alignments against gaps.

Alignments: chrom, read_name, aln_no (file order), read_type, ref_start, ref_end, read_len, mapq, is_secondary,
is_supplementary, lclip, rclip and, where there are any, is_unmapped with null coordinates.  Gaps: gap_id, chrom,
gap_start, gap_end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.intervals import overlap_join

MIN_MAPQ = 20
MIN_LENGTH = 500
REACH = 1000
FLANK = 500
CLIP = 100


def mapped(aln: DataFrame) -> DataFrame:
    return aln.filter(~F.col("is_unmapped")) if "is_unmapped" in aln.columns else aln


def near(aln: DataFrame, gaps: DataFrame, before: int, after: int, at: str = "gap") -> DataFrame:
    """Alignments that overlap a window around the gap (`gap`), its start (`start`) or its end (`end`)."""
    first, last = {"gap": ("gap_start", "gap_end"), "start": ("gap_start", "gap_start"), "end": ("gap_end", "gap_end")}[at]
    windows = gaps.select("gap_id", "chrom", "gap_start", "gap_end", F.greatest(F.col(first) - before, F.lit(0)).alias("w_start"), (F.col(last) + after).alias("w_end"))
    return overlap_join(mapped(aln), windows).drop("w_start", "w_end")


def _one(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def spanning_direct(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Reads that one alignment carries over the whole gap."""
    fit = aln.filter(~F.col("is_secondary") & (F.col("mapq") >= min_mapq) & (F.col("read_len") >= MIN_LENGTH))
    return near(fit, gaps, 100, 100).filter("ref_start <= gap_start and ref_end >= gap_end")


def spanning_linked(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Reads with one alignment that ends near the gap's start and one that starts near its end.

    Of several such alignments of a read the last in file order counts, at either end.
    """
    linked = _linked(_spanning(aln, gaps, min_mapq, False))
    return linked.select("gap_id", "read_name", "chrom", "l.read_type", "gap_start", "gap_end", "l.left_end", "l.left_len", "r.right_start", "r.right_len", "read_len")


def _around(at: str, reach: int) -> str:
    return f"ref_start < {at} + {reach} and ref_end > greatest({at} - {reach}, 0)"


def _spanning(aln: DataFrame, gaps: DataFrame, min_mapq: int, with_direct: bool) -> DataFrame:
    """What carries a read over a gap: (gap_id, read_name, chrom, gap_start, gap_end) with its last records `l` and `r` at either end and, if asked for, its first `direct` one.

    One join with the widest window for all of them; rows that are neither aren't shuffled again.
    """
    fit = aln.filter(F.col("mapq") >= min_mapq)
    met = near(fit, gaps, REACH, REACH)
    left = F.expr(f"{_around('gap_start', REACH)} and abs(ref_end - gap_start) <= {REACH}")
    right = F.expr(f"{_around('gap_end', REACH)} and abs(ref_start - gap_end) <= {REACH}")
    direct = F.expr(f"not is_secondary and read_len >= {MIN_LENGTH} and ref_start <= gap_start and ref_end >= gap_end") if with_direct else F.lit(False)
    last = lambda what, ok: F.max_by(what, F.when(ok, F.col("aln_no")))
    found = [
        last(F.struct("read_type", F.col("ref_end").alias("left_end"), F.col("read_len").alias("left_len")), left).alias("l"),
        last(F.struct(F.col("ref_start").alias("right_start"), F.col("read_len").alias("right_len")), right).alias("r"),
    ]
    if with_direct:
        found.append(F.min_by(F.struct("read_type", "read_len"), F.when(direct, F.col("aln_no"))).alias("direct"))
    return met.filter(left | right | direct).groupBy("gap_id", "read_name", "chrom", "gap_start", "gap_end").agg(*found)


def _linked(spans: DataFrame) -> DataFrame:
    """Rows of _spanning that two alignments link, with `read_len`."""
    size = F.when(F.col("l.left_len") > 0, F.col("l.left_len")).otherwise(F.col("r.right_len"))
    return spans.filter("l is not null and r is not null").withColumn("read_len", size).filter(F.col("read_len") >= MIN_LENGTH)


def spanning_all(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Both methods, each read once per gap: directly spanning first."""
    size = F.when(F.col("l.left_len") > 0, F.col("l.left_len")).otherwise(F.col("r.right_len"))
    linked = F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & (size >= MIN_LENGTH), F.struct(F.col("l.read_type").alias("read_type"), size.alias("read_len"), F.lit("linked").alias("method")))
    direct = F.when(F.col("direct").isNotNull(), F.struct("direct.read_type", "direct.read_len", F.lit("direct").alias("method")))
    return _spanning(aln, gaps, min_mapq, True).select("gap_id", "read_name", F.coalesce(direct, linked).alias("x")).filter("x is not null").select("gap_id", "read_name", "x.*")


def _flank(aln: DataFrame, gaps: DataFrame, side: str, min_mapq: int) -> DataFrame:
    found = near(aln.filter(~F.col("is_secondary")), gaps, FLANK, FLANK, "start" if side == "left" else "end")
    first = _one(found, ["gap_id", "read_name"], "aln_no")
    if side == "left":
        reach = f"abs(ref_end - gap_start) <= {FLANK}"
        kind = f"({reach} and rclip > 0) or (ref_start < gap_start and gap_start < ref_end and ref_end < gap_end) or (is_supplementary and {reach})"
    else:
        reach = f"abs(ref_start - gap_end) <= {FLANK}"
        kind = f"({reach} and lclip > 0) or (ref_start < gap_end and gap_end < ref_end and ref_start > gap_start) or (is_supplementary and {reach})"
    return first.filter(f"mapq >= {min_mapq} and read_len >= {MIN_LENGTH} and ({kind})")


def flank_left(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Reads whose first record near the gap's start reaches into it or stops at it."""
    return _flank(aln, gaps, "left", min_mapq)


def flank_right(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    return _flank(aln, gaps, "right", min_mapq)


def classify_once(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """`(gap_id, read_name, read_class)` from each read's first fitting record near the gap: spanning, left or right; flanks need a clip."""
    fit = aln.filter(~F.col("is_secondary") & (F.col("mapq") >= min_mapq) & (F.col("read_len") >= MIN_LENGTH))
    first = _one(near(fit, gaps, FLANK, FLANK), ["gap_id", "read_name"], "aln_no")
    kind = (
        F.when(F.expr("ref_start <= gap_start and ref_end >= gap_end"), "spanning")
        .when(F.expr(f"abs(ref_end - gap_start) <= {FLANK}"), F.when(F.col("rclip") > 0, "left"))
        .when(F.expr(f"abs(ref_start - gap_end) <= {FLANK} and lclip > 0"), "right")
    )
    return first.withColumn("read_class", kind).filter("read_class is not null").select("gap_id", "read_name", "read_type", "read_class")


def anchored(aln: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Adds `is_anchored`: mapped well and clipped by less than CLIP at both ends."""
    return aln.withColumn("is_anchored", F.expr(f"mapq >= {min_mapq} and lclip < {CLIP} and rclip < {CLIP}"))


def _beside_gaps(aln: DataFrame, gaps: DataFrame) -> DataFrame:
    """Alignments within REACH of a gap: of (chrom, read_name, aln_no)."""
    windows = gaps.select("chrom", (F.col("gap_start") - REACH - 1).alias("w_start"), (F.col("gap_end") + REACH + 1).alias("w_end"))
    return overlap_join(mapped(aln).select("chrom", "read_name", "aln_no", "ref_start", "ref_end"), windows).select("chrom", "read_name", "aln_no").distinct().withColumn("__near", F.lit(True))


def useful_reads(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Adds `is_useful` to each read's first record: without coordinates, or on a contig with gaps and unanchored or within REACH of one."""
    first = _one(anchored(aln, min_mapq), ["read_name"], "aln_no")
    contigs = gaps.select("chrom").distinct().withColumn("__has", F.lit(True))
    flagged = first.join(contigs, "chrom", "left").join(_beside_gaps(first, gaps), ["chrom", "read_name", "aln_no"], "left")
    useful = F.col("ref_start").isNull() | F.col("ref_end").isNull() | F.coalesce("__has", F.lit(False)) & (~F.col("is_anchored") | F.coalesce("__near", F.lit(False)))
    return flagged.withColumn("is_useful", useful).drop("__has", "__near")


def kept_names(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Names with any record, not secondary, that is unanchored or within REACH of a gap."""
    fit = anchored(aln.filter(~F.col("is_secondary")), min_mapq)
    loose = fit.filter(~F.col("is_anchored")).select("read_name")
    return loose.unionByName(_beside_gaps(fit, gaps).select("read_name")).distinct()


def filter_stats(aln: DataFrame, judged: DataFrame) -> DataFrame:
    """Records seen, names kept, names stored (long enough), and the share kept."""
    kept = judged.agg(F.count_if("is_useful").alias("kept_reads"), F.count_if(F.col("is_useful") & (F.col("read_len") >= MIN_LENGTH)).alias("stored_reads"))
    return aln.agg(F.count(F.lit(1)).alias("total_reads")).crossJoin(F.broadcast(kept)).withColumn("kept_ratio", F.col("kept_reads") / F.greatest("total_reads", F.lit(1)))  # one row each


def bundle_counts(aln: DataFrame, gaps: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    """Six counts per gap: spanning, left and right reads of either type.

    One join with the widest window; what `spanning_all`, `flank_left` and `flank_right` ask of a read's records are
    conditions on its rows, settled by one aggregation per gap and read.  An alignment is shuffled as its name, place and
    one number: its place in the file, and below that what is asked of its other columns.  The first or last record
    that fits is then the least or greatest such number.
    """
    kind = F.when(F.col("read_type") == "hifi", 0).when(F.col("read_type") == "ont", 1).when(F.col("read_type").isNull(), 3).otherwise(2)
    length = F.when(F.col("read_len") >= MIN_LENGTH, 2).when(F.col("read_len") > 0, 1).otherwise(0)
    flags = [F.col("mapq") >= min_mapq, ~F.col("is_secondary"), F.col("is_supplementary"), F.col("lclip") > 0, F.col("rclip") > 0]
    code = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(flags)), kind * 32 + length * 128)
    asked = F.expr(f"mapq >= {min_mapq} or not is_secondary")
    slim = mapped(aln).filter(asked).select("chrom", "read_name", "ref_start", "ref_end", (F.col("aln_no").cast("bigint") * 1024 + code).alias("no"))
    met = near(slim, gaps, REACH, REACH)
    well, primary, supplementary, lclip, rclip = (F.col("no").bitwiseAND(1 << k) != 0 for k in range(5))
    long = well & (F.col("no").bitwiseAND(256) != 0)
    at_start, at_end = F.expr(_around("gap_start", FLANK)) & primary, F.expr(_around("gap_end", FLANK)) & primary
    direct = long & primary & F.expr("ref_start <= gap_start and ref_end >= gap_end")
    left = well & F.expr(f"{_around('gap_start', REACH)} and abs(ref_end - gap_start) <= {REACH}")
    right = well & F.expr(f"{_around('gap_end', REACH)} and abs(ref_start - gap_end) <= {REACH}")
    reach_l, reach_r = F.expr(f"abs(ref_end - gap_start) <= {FLANK}"), F.expr(f"abs(ref_start - gap_end) <= {FLANK}")
    into_l = long & ((reach_l & (rclip | supplementary)) | F.expr("ref_start < gap_start and gap_start < ref_end and ref_end < gap_end"))
    into_r = long & ((reach_r & (lclip | supplementary)) | F.expr("ref_start < gap_end and gap_end < ref_end and ref_start > gap_start"))
    marked = lambda ok: F.col("no") * 2 + F.when(ok, 1).otherwise(0)
    per = met.filter(direct | left | right | at_start | at_end).groupBy("gap_id", "read_name").agg(
        F.min(F.when(direct, F.col("no"))).alias("direct"),
        F.max(F.when(left, F.col("no"))).alias("l"),
        F.max(F.when(right, F.col("no"))).alias("r"),
        F.min(F.when(at_start, marked(into_l))).alias("fl"),
        F.min(F.when(at_end, marked(into_r))).alias("fr"),
    )
    kind_of = lambda no: F.shiftright(no, 5).bitwiseAND(3)
    length_of = lambda no: F.shiftright(no, 7).bitwiseAND(3)
    size = F.when(length_of("l") > 0, length_of("l")).otherwise(length_of("r"))
    known = F.when(F.col("direct").isNotNull() & (kind_of("direct") != 3), kind_of("direct"))
    linked = F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & (size == 2), kind_of("l"))
    flank = lambda c: F.when(F.col(c).bitwiseAND(1) != 0, kind_of(F.shiftright(c, 1)))
    kinds = {"spanning": F.coalesce(known, linked), "left": flank("fl"), "right": flank("fr")}
    counts = per.groupBy("gap_id").agg(*[F.count_if(kinds[k] == n).alias(f"{t}_{k}") for n, t in enumerate(("hifi", "ont")) for k in kinds])
    return gaps.select("gap_id").join(counts, "gap_id", "left").na.fill(0)


def extracted_reads(aln: DataFrame, regions: DataFrame, least: int = 100) -> DataFrame:
    """`(region_id, read_name, read_type, aln_no, read_len)` of primary records of `least` bases in regions (region_id, chrom, r_start, r_end): each name once, HiFi before ONT, then in file order."""
    fit = mapped(aln).filter(~F.col("is_secondary") & ~F.col("is_supplementary") & (F.col("read_len") >= least))
    met = overlap_join(fit, regions, window=("r_start", "r_end"))
    return _one(met, ["region_id", "read_name"], F.when(F.col("read_type") == "hifi", 0).otherwise(1), "aln_no").select("region_id", "read_name", "read_type", "aln_no", "read_len")


def of_kept_names(aln: DataFrame, names: DataFrame) -> DataFrame:
    """Records whose read_name is among names."""
    return aln.join(names.select("read_name"), "read_name", "left_semi")
