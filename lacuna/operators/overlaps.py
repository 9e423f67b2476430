"""Decisions over PAF-like overlap rows: trimming, merging, clustering, choice among tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.components import connected_components

MIN_IDENTITY = 0.9


def _identity():
    return F.col("matches") / F.greatest("block_len", F.lit(1))


def trim_points(paf: DataFrame) -> DataFrame:
    """`(gap_id, left_trim, right_trim)`: where an assembled side repeats its flank; null where nothing is to be cut."""
    good = paf.filter((_identity() >= MIN_IDENTITY) & (F.col("strand") == "+"))
    left = F.max(F.when(F.expr("tend >= tlen - 100 and qstart < 200"), F.col("qend")))
    right = F.min(F.when(F.expr("tstart < 100 and qend > qlen - 200"), F.col("qstart")))
    points = good.groupBy("gap_id").agg(left.alias("l"), right.alias("r"), F.max("qlen").alias("qlen"))
    return points.select("gap_id", F.expr("case when l > 0 and l < qlen - 100 then l end").alias("left_trim"), F.expr("case when r > 100 and r < qlen then r end").alias("right_trim"))


def merge_points(paf: DataFrame, min_overlap: int = 100) -> DataFrame:
    """`(gap_id, line_no, qend)`: the first row, in file order, over which the two sides can be merged."""
    fits = paf.filter((_identity() >= MIN_IDENTITY) & (F.col("block_len") >= min_overlap) & F.expr("tend >= tlen - 100 and strand = '+'"))
    return fits.groupBy("gap_id").agg(F.min("line_no").alias("line_no"), F.min_by("qend", "line_no").alias("qend"))


def clusters(reads: DataFrame, overlaps: DataFrame, cut) -> DataFrame:
    """`(gap_id, read_no, cluster)`: reads of a gap linked by overlaps of identity 0.9; gaps of up to 3 reads are one cluster.

    A node is named by gap and read; the cluster is named by its least read_no.
    """
    node = lambda no: F.to_json(F.struct(F.col("gap_id").alias("g"), no.alias("r")))
    big = reads.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("gap_id")))
    edges = overlaps.filter(_identity() >= MIN_IDENTITY).select(node(F.col("query_no")).alias("a"), node(F.col("target_no")).alias("b"))
    roots = connected_components(edges, cut)
    named = big.withColumn("node", node(F.col("read_no"))).join(roots, "node", "left")
    group = F.when(F.col("__n") <= 3, F.lit("")).otherwise(F.coalesce("root", "node"))
    return named.withColumn("__g", group).withColumn("cluster", F.min("read_no").over(Window.partitionBy("gap_id", "__g"))).select("gap_id", "read_no", "cluster")


def clusters_by_size(clustered: DataFrame) -> DataFrame:
    """`(gap_id, cluster, n_reads, place)`: a gap's clusters in order of falling size, equal ones by name."""
    sized = clustered.groupBy("gap_id", "cluster").agg(F.count(F.lit(1)).alias("n_reads"))
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("gap_id").orderBy(F.desc("n_reads"), "cluster")))


def tier_choice(counts: DataFrame) -> DataFrame:
    """`(gap_id, first_tier, tiers)`: the tiers open to a gap by its read counts, in order of trial."""
    any_hifi, any_ont = F.expr("hifi_left + hifi_right > 0"), F.expr("ont_left + ont_right > 0")
    rules = [("0", F.col("hifi_spanning") >= 3), ("0b", F.col("ont_spanning") >= 5), ("1", F.col("hifi_spanning") >= 3), ("2", F.col("ont_spanning") >= 3), ("3", F.expr("hifi_spanning + ont_spanning >= 3")), ("4", any_hifi), ("5", any_ont), ("6", any_hifi | any_ont)]
    tiers = F.array_compact(F.array(*[F.when(ok, name) for name, ok in rules]))
    return counts.select("gap_id", F.get(tiers, F.lit(0)).alias("first_tier"), F.array_join(tiers, ",").alias("tiers"))


def accepted(candidates: DataFrame) -> DataFrame:
    """Per gap the candidate of the lowest tier that isn't refused: validation_state passed or not_evaluated."""
    ok = candidates.filter(F.col("validation_state").isin("passed", "not_evaluated"))
    return ok.groupBy("gap_id").agg(F.min_by(F.struct("tier", "source", "seq", "validation_state"), F.struct("tier", "source", "seq")).alias("x")).select("gap_id", "x.*")


def merged_sequences(sides: DataFrame, points: DataFrame, filler: int = 500) -> DataFrame:
    """`(gap_id, seq, is_complete)` of sides (gap_id, left_seq, right_seq): joined at the merge point, else `filler` N between."""
    joined = sides.join(points.select("gap_id", "qend"), "gap_id", "left")
    left, right = F.coalesce("left_seq", F.lit("")), F.coalesce("right_seq", F.lit(""))
    whole = F.concat(left, F.expr("substring(coalesce(right_seq, ''), cast(qend as int) + 1)"))
    return joined.select("gap_id", F.when(F.col("qend").isNotNull(), whole).otherwise(F.concat(left, F.lit("N" * filler), right)).alias("seq"), F.col("qend").isNotNull().alias("is_complete"))


def n_runs(assembled: DataFrame) -> DataFrame:
    """Adds n_runs, n_bases and is_usable (no N at all, either case) to assembled sequences."""
    runs = F.regexp_count("seq", F.lit("[Nn]+"))
    return assembled.withColumns({"n_runs": runs, "n_bases": F.regexp_count("seq", F.lit("[Nn]")), "is_usable": runs == 0})


def fill_totals(fills: DataFrame) -> DataFrame:
    """Counts and bases of accepted fills by source."""
    return fills.groupBy("source").agg(F.count(F.lit(1)).alias("n_fills"), F.sum(F.length("seq")).cast("bigint").alias("total_bp"))
