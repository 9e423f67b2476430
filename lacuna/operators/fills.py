"""From candidates to accepted fills: flanking composition, local validation, the cascade of tiers, polishing, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import overlaps, validation
from lacuna.operators.gaps import splice_fills
from lacuna.operators.intervals import overlap_join

LOCAL_FLANK = 5000
POLISH_FLANK = 1000
MIN_CLUSTER = 3
POLISH_READS, POLISH_LENGTH = 5, 500


def best_sides(assembled: DataFrame) -> DataFrame:
    """`(gap_id, left_seq, right_seq)`: of each side's clusters (gap_id, side, cluster, n_reads, seq) of 3 reads or more the longest assembly, ties to the first cluster."""
    fit = assembled.filter((F.col("n_reads") >= MIN_CLUSTER) & (F.length("seq") > 0))
    best = fit.groupBy("gap_id", "side").agg(F.max_by("seq", F.struct(F.length("seq"), -F.col("cluster"))).alias("seq"))
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("seq"))).alias(f"{side}_seq")
    return best.groupBy("gap_id").agg(pick("left"), pick("right"))


def flanking_fill(sides: DataFrame, trims: DataFrame, merges: DataFrame) -> DataFrame:
    """`(gap_id, seq, is_complete, has_placeholder, strategy)` of best sides, with what repeats the flanks cut off (trim_points), merged where they overlap (merge_points)."""
    cut = sides.join(trims, "gap_id", "left").select(
        "gap_id",
        F.expr("substring(left_seq, coalesce(cast(left_trim as int), 0) + 1)").alias("left_seq"),
        F.expr("case when right_trim is null then right_seq else substring(right_seq, 1, cast(right_trim as int)) end").alias("right_seq"),
    )
    rest = cut.filter("length(coalesce(left_seq, '')) > 0 or length(coalesce(right_seq, '')) > 0")
    both = F.expr("length(left_seq) > 0 and length(right_seq) > 0")
    points = merges.join(rest.filter(both).select("gap_id"), "gap_id", "left_semi")
    joined = overlaps.merged_sequences(rest, points)
    return joined.select("gap_id", "seq", "is_complete", (~F.col("is_complete")).alias("has_placeholder"), F.when(F.col("is_complete"), "flanking_merged").otherwise("flanking").alias("strategy"))


def longer_assembly(assembled: DataFrame) -> DataFrame:
    """`(gap_id, preset, seq)`: of the assemblies of a gap under several presets the longest, ties to the lesser preset name."""
    best = assembled.filter("seq <> ''").groupBy("gap_id").agg(F.max_by(F.struct("preset", "seq"), F.struct(F.length("seq"), -F.ascii("preset"))).alias("x"))
    return best.select("gap_id", "x.*")


def local_references(contigs: DataFrame, fills: DataFrame, flank: int = LOCAL_FLANK) -> DataFrame:
    """`(fill_id, left_length, seq)`: each fill (fill_id, chrom, gap_start, gap_end, fill) between the flanks of its gap."""
    joined = fills.join(contigs.select("chrom", "seq"), "chrom")
    at = F.greatest(F.col("gap_start") - flank, F.lit(0))
    left = F.substring(F.col("seq"), (at + 1).cast("int"), (F.col("gap_start") - at).cast("int"))
    right = F.substring(F.col("seq"), (F.col("gap_end") + 1).cast("int"), F.lit(flank))
    return joined.select("fill_id", (F.col("gap_start") - at).alias("left_length"), F.concat(left, "fill", right).alias("seq"))


def local_validation(aln: DataFrame, fills: DataFrame) -> DataFrame:
    """`(fill_id, mode, valid, status)` of fills (fill_id, left_length, fill, is_complete) by the alignments on their local references (chrom = fill_id).

    A partial fill with a run of 10 N is judged by its sides, any other as a complete one.  A fill without any
    alignment isn't judged: valid is null, and the status not_evaluated.
    """
    length, before = F.length("fill"), F.instr("fill", "N" * 10) - 1
    has = (~F.col("is_complete")) & F.col("fill").rlike("N{10,}")
    placed = fills.select(
        "fill_id", F.col("fill_id").alias("chrom"), F.col("left_length").alias("gap_start"), (F.col("left_length") + length).alias("gap_end"), has.alias("is_partial"),
        (F.col("left_length") + before).alias("new_start"), (F.col("left_length") + before + F.length(F.regexp_extract("fill", "N{10,}", 0))).alias("new_end"),
    )
    whole = placed.filter("not is_partial").select(F.col("fill_id").alias("region_id"), "chrom", F.col("gap_start").alias("r_start"), F.col("gap_end").alias("r_end"))
    complete = validation.validate_complete(aln, whole).select(F.col("region_id").alias("fill_id"), F.lit("complete").alias("mode"), "valid", "status")
    partial = validation.validate_partial(aln, placed.filter("is_partial").drop("is_partial")).select("fill_id", F.lit("partial").alias("mode"), "valid", "status")
    seen = aln.select(F.col("chrom").alias("fill_id")).distinct().withColumn("__seen", F.lit(True))
    judged = complete.unionByName(partial).join(seen, "fill_id", "left")
    return judged.select("fill_id", "mode", F.when(F.col("__seen"), F.col("valid")).alias("valid"), F.when(F.col("__seen"), F.col("status")).otherwise("not_evaluated").alias("status"))


def cascade(tiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """The accepted candidate (gap_id, tier, source, seq, validation_state) of each gap among the tiers open to it (gap_id, tiers as names joined by commas)."""
    order = {name: k for k, name in enumerate(("0", "0b", "1", "2", "3", "4", "5", "6"))}
    rank = F.create_map(*[x for name, k in order.items() for x in (F.lit(name), F.lit(k))])
    name = F.create_map(*[x for t, k in order.items() for x in (F.lit(k), F.lit(t))])
    open_ = tiers.select("gap_id", F.explode(F.split("tiers", ",")).alias("tier")).filter("tier <> ''")
    usable = candidates.join(open_, ["gap_id", "tier"], "left_semi").withColumn("tier", rank[F.col("tier")])
    return overlaps.accepted(usable).withColumn("tier", name[F.col("tier")])


def outcomes(counts: DataFrame, accepted: DataFrame, triage: DataFrame) -> DataFrame:
    """One row per gap of counts: the accepted fill with the reads behind it, or the reason of failing from the flanks' triage."""
    joined = counts.join(accepted, "gap_id", "left").join(triage.select("gap_id", F.col("status").alias("flanks")), "gap_id", "left")
    filled = F.col("seq").isNotNull()
    state = F.when(filled & (F.col("validation_state") == "passed"), "validated").when(filled, "not_evaluated").otherwise(F.coalesce("flanks", F.lit("failed")))
    return joined.select(
        "gap_id", filled.alias("success"), "tier", "source", F.length("seq").cast("bigint").alias("fill_length"), state.alias("status"),
        "hifi_spanning", "ont_spanning", (F.col("hifi_left") + F.col("hifi_right")).alias("hifi_flanking"), (F.col("ont_left") + F.col("ont_right")).alias("ont_flanking"),
    )


def polished_fill(fills: DataFrame, polished: DataFrame) -> DataFrame:
    """`(gap_id, seq, is_polished)`: the polished sequence (gap_id, n_alignments, polished) where at least 2 reads aligned and it keeps 80 % of the length."""
    joined = fills.join(polished, "gap_id", "left")
    use = F.coalesce((F.col("n_alignments") >= 2) & (F.length("polished") >= 0.8 * F.length("seq")), F.lit(False))
    return joined.select("gap_id", F.when(use, F.col("polished")).otherwise(F.col("seq")).alias("seq"), use.alias("is_polished"))


def polish_flanks(aln: DataFrame, flanks: DataFrame, votes: DataFrame) -> DataFrame:
    """`(flank_id, n_reads, seq, is_polished)` of flanks (flank_id, chrom, f_start, f_end, seq) with the bases voted for (flank_id, pos, base), pos on the contig.

    A flank is polished if 5 primary reads of 500 bases overlap it and any base changes.
    """
    fit = validation.coverage.primary(aln).filter(F.col("read_len") >= POLISH_LENGTH)
    reads = overlap_join(fit, flanks.drop("seq"), window=("f_start", "f_end")).groupBy("flank_id").agg(F.count(F.lit(1)).alias("n_reads"))
    changes = votes.groupBy("flank_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("__new"))  # a flank's length at most
    joined = flanks.join(reads, "flank_id", "left").join(changes, "flank_id", "left").na.fill(0, ["n_reads"])
    old = F.split("seq", "")
    new = F.array_join(F.transform(old, lambda c, k: F.coalesce(F.when(c != "", F.col("__new")[F.col("f_start") + k]), c)), "")
    polished = F.when((F.col("n_reads") >= POLISH_READS) & F.col("__new").isNotNull(), new).otherwise(F.col("seq"))
    return joined.select("flank_id", "n_reads", polished.alias("seq"), (polished != F.col("seq")).alias("is_polished"))


def apply_polish(contigs: DataFrame, polished: DataFrame) -> DataFrame:
    """Contigs (chrom, seq) with polished flanks (chrom, f_start, f_end, seq) put in; of flanks that overlap the one further right wins."""
    order = Window.partitionBy("chrom").orderBy("f_start", "f_end")
    cut = polished.withColumn("__next", F.lead("f_start").over(order))
    fit = cut.withColumn("__end", F.least("f_end", F.coalesce("__next", "f_end"))).filter("__end > f_start")
    return splice_fills(contigs, fit.select("chrom", F.col("f_start").alias("gap_start"), F.col("__end").alias("gap_end"), F.expr("substring(seq, 1, cast(__end - f_start as int))").alias("fill")))


def polish_counts(polished: DataFrame) -> DataFrame:
    """How many gaps (gap_id, is_polished for each flank) there are, and how many of them changed at either side."""
    per = polished.groupBy("gap_id").agg(F.bool_or("is_polished").alias("x"))
    return per.agg(F.count(F.lit(1)).alias("n_gaps"), F.count_if("x").alias("n_polished"))


def iteration_stats(results: DataFrame) -> DataFrame:
    """Per iteration, of results (iteration, success, fill_length, is_complete): gaps processed, filled, failed, bases filled."""
    return results.groupBy("iteration").agg(
        F.count(F.lit(1)).alias("gaps_processed"), F.count_if("success").alias("gaps_filled"), F.count_if(~F.col("success")).alias("gaps_failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("fill_length"))), F.lit(0)).cast("bigint").alias("total_bp_filled"),
    )


def final_stats(results: DataFrame) -> DataFrame:
    """One row over a run: iterations, gaps at first, and the gaps that their last result left filled, partly filled or failed."""
    last = results.groupBy("gap_id").agg(F.max_by(F.struct("success", "is_complete"), "iteration").alias("x"))
    ends = last.agg(F.count(F.lit(1)).alias("total_gaps_initial"), F.count_if(F.expr("x.success and x.is_complete")).alias("gaps_completely_filled"), F.count_if(F.expr("x.success and not x.is_complete")).alias("gaps_partially_filled"), F.count_if(F.expr("not x.success")).alias("gaps_failed"))
    return results.agg(F.countDistinct("iteration").alias("iterations")).crossJoin(F.broadcast(ends))  # one row each


def haplotype_summary(gaps: DataFrame) -> DataFrame:
    """Per haplotype, of gaps (hap, is_shared): all gaps and those of this haplotype alone."""
    return gaps.groupBy("hap").agg(F.count(F.lit(1)).alias("total_gaps"), F.count_if(~F.col("is_shared")).alias("haplotype_specific_gaps"))
