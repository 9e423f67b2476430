"""`python -m lacuna CONTIGS.fa... --hifi READS... --ont READS... --out OUT`: rounds of gap filling on the session that spark-submit provides.

Several assemblies are haplotypes: their contigs are filled together, named hap1__contig, hap2__contig and so on, and
written apart.  Reads are FASTQ where the name says so (.fq, .fastq, also .gz), else FASTA.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import fills, gaps
from lacuna.plans.rounds import results, run_rounds
from lacuna.shipping import ship
from lacuna.sources import files


def read_reads(spark: SparkSession, path: str, read_type: str) -> DataFrame:
    """`(read_name, read_type, seq)` of a FASTQ or FASTA file."""
    name = path.removesuffix(".gz")
    if name.endswith((".fq", ".fastq")):
        rows = files.read_fastq(spark, path, read_type)
    else:
        rows = files.read_fasta(spark, path).select(F.col("chrom").alias("read_name"), F.lit(read_type).alias("read_type"), "seq")
    return rows.select("read_name", "read_type", "seq")


def fill(spark: SparkSession, assemblies: list[str], reads: DataFrame, out: str, min_size: int = 100, max_rounds: int = 10) -> None:
    """Fills the gaps of the assemblies by reads (read_name, read_type, seq); contigs, gaps and statistics go below out."""
    each = [files.read_fasta(spark, path).withColumn("hap", F.lit(f"hap{k + 1}")) for k, path in enumerate(assemblies)]
    contigs = gaps.normalize_lengths(reduce(DataFrame.unionByName, each).select("hap", "chrom", "ord", "seq"), min_size)
    done = run_rounds(gaps.prefix_contigs(contigs), reads, f"{out}/rounds", min_size, max_rounds)
    split = gaps.split_prefix(done)
    for k in range(len(assemblies)):
        files.write_fasta(split.filter(F.col("hap") == f"hap{k + 1}"), f"{out}/contigs-hap{k + 1}")
    left = gaps.scan_gaps(done, min_size)
    files.write_bed(left, f"{out}/gaps")
    files.write_report(gaps.gap_stats(left), f"{out}/stats")
    tried = results(spark, f"{out}/rounds")
    files.write_report(fills.iteration_stats(tried), f"{out}/iterations")
    files.write_report(fills.final_stats(tried), f"{out}/final")
    shared = gaps.shared_or_specific(gaps.split_prefix(left))
    files.write_report(fills.haplotype_summary(shared), f"{out}/haplotypes")


def main() -> None:
    args = argparse.ArgumentParser(prog="lacuna", description=__doc__)
    args.add_argument("contigs", nargs="+")
    args.add_argument("--hifi", nargs="*", default=[])
    args.add_argument("--ont", nargs="*", default=[])
    args.add_argument("--out", required=True)
    args.add_argument("--min-gap-size", type=int, default=100)
    args.add_argument("--max-iterations", type=int, default=10)
    given = args.parse_args()
    if not given.hifi and not given.ont:
        args.error("give reads by --hifi or --ont")
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    reads = [read_reads(spark, path, kind) for kind in ("hifi", "ont") for path in getattr(given, kind)]
    fill(spark, given.contigs, reduce(DataFrame.unionByName, reads), given.out, given.min_gap_size, given.max_iterations)


if __name__ == "__main__":
    main()
