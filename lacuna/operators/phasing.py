"""SNPs between haplotypes and the assignment of reads to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.intervals import overlap_join

HAPS = ("hap1", "hap2", "hap3")
#: phase_spans: the narrowest bins have 2^LEAST_BITS bases.
LEAST_BITS = 13


def snp_by_position(first: DataFrame, other: DataFrame, piece: int = 10_000) -> DataFrame:
    """`(chrom, pos, ref_base, alt_base)` where two haplotypes' sequences (chrom, seq) differ in place, N apart.

    Sequences are joined once per contig and cut into pieces before their bases are laid out.
    """
    joined = first.select("chrom", "seq").join(other.select("chrom", F.col("seq").alias("alt")), "chrom")
    cut = joined.select("chrom", F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.length("seq"), F.length("alt")) - 1, F.lit(0)), F.lit(piece))).alias("at"), "seq", "alt")
    pieces = cut.select("chrom", "at", F.substring(F.col("seq"), F.col("at") + 1, F.lit(piece)).alias("a"), F.substring(F.col("alt"), F.col("at") + 1, F.lit(piece)).alias("b"))
    bases = pieces.filter("a <> b").select("chrom", "at", F.posexplode(F.arrays_zip(F.split("a", "").alias("x"), F.split("b", "").alias("y"))))
    pair = bases.select("chrom", (F.col("at") + F.col("pos")).cast("bigint").alias("pos"), F.col("col.x").alias("ref_base"), F.col("col.y").alias("alt_base"))
    return pair.filter("ref_base <> alt_base and ref_base in ('A', 'C', 'G', 'T') and alt_base in ('A', 'C', 'G', 'T')")


def long_snps(snps: DataFrame, haps: tuple[str, ...] = HAPS) -> DataFrame:
    """One row (chrom, pos, hap, base) per haplotype that has a base."""
    return snps.select("chrom", "pos", F.inline(F.array(*[F.struct(F.lit(h).alias("hap"), F.col(h).alias("base")) for h in haps]))).filter("base is not null")


def hap_coverage(snps: DataFrame) -> DataFrame:
    return long_snps(snps).groupBy("hap").agg(F.count(F.lit(1)).alias("n_snps"))


def _outcome(scored: DataFrame, keys: list[str], haps: tuple[str, ...], min_snps: int) -> DataFrame:
    """`(keys, checked, outcome)` from rows (keys, checked, one count n_<hap> per haplotype)."""
    counts = [F.col(f"n_{h}") for h in haps]
    top = F.greatest(*counts)
    leaders = sum(F.when(c == top, 1).otherwise(0) for c in counts)
    winner = F.coalesce(*[F.when(c == top, h) for c, h in zip(counts, haps, strict=True)])
    outcome = F.when(F.col("checked") == 0, "no_snp").when(F.col("checked") < min_snps, "below_threshold").when(top == 0, "no_match").when(leaders == 1, winner).otherwise("tie")
    return scored.withColumn("outcome", outcome).select(*keys, "checked", "outcome")


def phase_reads(hits: DataFrame, reads: DataFrame, haps: tuple[str, ...] = HAPS, min_snps: int = 1) -> DataFrame:
    """`(read columns, checked, outcome)` from the SNPs that reads hit (read key, base, one column per haplotype).

    A haplotype without a base at a site counts with the first one's.  Outcomes: no_snp, below_threshold, no_match,
    the haplotype with most matches, or tie.
    """
    keys = reads.columns
    matches = [F.count_if(F.col("base") == F.coalesce(h, haps[0])).alias(f"n_{h}") for h in haps]
    scored = reads.join(hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("checked"), *matches), keys, "left").na.fill(0)
    return _outcome(scored, keys, haps, min_snps)


def phase_spans(reads: DataFrame, sites: DataFrame, base, keys: list[str], haps: tuple[str, ...] = HAPS, min_snps: int = 1) -> DataFrame:
    """As phase_reads, from alignments (keys, chrom, ref_start, ref_end, what base() needs) and sites (chrom, pos, one column per haplotype).

    base(pos) is the read's base at a site.  Every row of reads is judged by itself, and one with a null key hits
    nothing.  Reads go through one shuffle, a row each: one of up to 2^LEAST_BITS * 16^k bases is dealt to the bin of that
    width in which it starts, where the sites of that bin and of the next one wait in one row.  Sites are laid out only
    for widths that reads have.
    """
    length = F.greatest(F.col("ref_end") - F.col("ref_start"), F.lit(1))
    level = F.greatest(F.ceil((F.log2(length) - LEAST_BITS) / 4), F.lit(0)).cast("int")
    width = lambda k: F.pow(F.lit(2.0), k * 4 + LEAST_BITS)
    bin_of = lambda at, k: F.floor(at / width(k)).cast("bigint")
    found = reads.withColumn("__level", level)
    used = found.filter("ref_start is not null and ref_end is not null").select("__level").distinct()  # fourteen at most
    laid = sites.filter("pos is not null").withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(13)))).join(F.broadcast(used), "__level")
    here = bin_of(F.col("pos"), F.col("__level"))
    near = laid.withColumn("__bin", F.explode(F.array(here, here - 1))).groupBy("chrom", "__level", "__bin").agg(F.collect_list(F.struct("pos", *haps)).alias("__sites"))
    met = found.withColumn("__bin", bin_of(F.col("ref_start"), F.col("__level"))).join(near, ["chrom", "__level", "__bin"], "left")
    named = F.lit(True)
    for k in keys:
        named &= F.col(k).isNotNull()
    hit = F.filter("__sites", lambda s: (s["pos"] >= F.col("ref_start")) & (s["pos"] < F.col("ref_end")))
    hits = met.withColumn("__hits", F.when(named & F.col("__sites").isNotNull(), F.transform(hit, lambda s: F.struct(base(s["pos"]).alias("base"), *[s[h].alias(h) for h in haps]))).otherwise(F.array()))
    fits = lambda h: lambda s: s["base"] == F.coalesce(s[h], s[haps[0]])
    scored = hits.select(*keys, F.size("__hits").cast("bigint").alias("checked"), *[F.size(F.filter("__hits", fits(h))).alias(f"n_{h}") for h in haps])
    return _outcome(scored, keys, haps, min_snps)


def phase_stats(phased: DataFrame) -> DataFrame:
    return phased.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_reads"))


def snps_from_pairs(pairs: DataFrame) -> DataFrame:
    """`(chrom, pos, ref_base, bases)` from aligned bases (chrom, pos, ref_base, hap, base, place), gaps and N left out before.

    A site is where any haplotype differs from the reference; there every haplotype's base counts, that of the
    first row by place, in `bases` (haplotype -> base).
    """
    usable = pairs.filter("base in ('A', 'C', 'G', 'T') and ref_base in ('A', 'C', 'G', 'T')")
    first = usable.groupBy("chrom", "pos", "hap").agg(F.min_by(F.struct("ref_base", "base"), "place").alias("x"), F.bool_or(F.col("base") != F.col("ref_base")).alias("differs")).select("chrom", "pos", "hap", "x.*", "differs")
    sites = first.groupBy("chrom", "pos").agg(F.max("ref_base").alias("ref_base"), F.bool_or("differs").alias("is_site"), F.array_sort(F.collect_list(F.struct("hap", "base"))).alias("found"))  # as many entries as haplotypes
    return sites.filter("is_site").select("chrom", "pos", "ref_base", F.map_from_entries("found").alias("bases"))


def outside_gaps(points: DataFrame, gaps: DataFrame) -> DataFrame:
    """points (chrom, pos, ...) that lie in no gap (chrom, gap_start, gap_end)."""
    keys = ["chrom", "pos"]
    at = points.select(*keys).distinct().withColumn("__p", F.col("pos")).withColumn("__q", F.col("pos") + 1)
    inside = overlap_join(at, gaps.select("chrom", "gap_start", "gap_end"), ("__p", "__q"), ("gap_start", "gap_end")).select(*keys).distinct()
    return points.join(inside, keys, "left_anti")


def phased_reads(phased: DataFrame, haps: tuple[str, ...] = HAPS, use_ambiguous: bool = True) -> DataFrame:
    """Rows of phase_reads with `hap`: a read goes to its haplotype, one of no haplotype to each of them (or to none)."""
    own = F.col("outcome").isin(*haps)
    to = F.when(own, F.array("outcome")).otherwise(F.array(*map(F.lit, haps)) if use_ambiguous else F.array().cast("array<string>"))
    return phased.withColumn("is_ambiguous", ~own).withColumn("hap", F.explode(to))


def merged_phased(phased: DataFrame) -> DataFrame:
    """One table of all haplotypes' reads, every row kept: an ambiguous read stands in it once for each haplotype."""
    return phased.select(F.concat_ws("__", "hap", "read_name").alias("read_name"), "hap", "aln_no", "is_ambiguous")


def exported_snps(snps: DataFrame, haps: tuple[str, ...] = HAPS) -> DataFrame:
    """`(chrom, value)`: a contig's SNPs as one JSON object, position -> haplotype -> base, in order of position.

    For exchange with other tools; a table of SNPs is kept as Parquet.
    """
    entry = F.concat(F.lit('"'), F.col("pos").cast("string"), F.lit('":'), F.to_json(F.struct(*haps)))
    per = snps.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("es"))
    return per.select("chrom", F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("}")).alias("value"))


def imported_snps(exported: DataFrame, haps: tuple[str, ...] = HAPS) -> DataFrame:
    """`(chrom, pos, one column per haplotype)` from exported_snps."""
    kinds = ", ".join(f"{h}: string" for h in haps)
    rows = exported.select("chrom", F.explode(F.from_json("value", f"map<string, struct<{kinds}>>")))
    return rows.select("chrom", F.col("key").cast("bigint").alias("pos"), "value.*")
