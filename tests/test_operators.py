import numpy as np
"""Boundaries of predicates, planted truth, formats and plans, on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lacuna.operators import align, assembly, components, coverage, fills, gaps, intervals, kernels, overlaps, phasing, reads, sequence, state
from lacuna.plans import registry
from lacuna.plans.rounds import shared_checkpoint
from lacuna.sources import files
from lacuna.streaming import status

ALN = "chrom string, read_name string, aln_no int, read_type string, ref_start bigint, ref_end bigint, read_len bigint, mapq int, is_secondary boolean, is_supplementary boolean, lclip int, rclip int, md string"


def aln(spark, *rows):
    base = {"chrom": "c", "aln_no": 1, "read_type": "hifi", "read_len": 1000, "mapq": 60, "is_secondary": False, "is_supplementary": False, "lclip": 0, "rclip": 0, "md": "10A5"}
    names = [x.split()[0] for x in ALN.split(", ")]
    return spark.createDataFrame([tuple((base | {"read_name": f"r{k}"} | r)[n] for n in names) for k, r in enumerate(rows)], ALN)


@pytest.fixture
def gap(spark):
    return spark.createDataFrame([("g", "c", 10_000, 10_500)], "gap_id string, chrom string, gap_start bigint, gap_end bigint")


@pytest.mark.parametrize("change, found", [({}, 1), ({"read_len": 499}, 0), ({"read_len": 500}, 1), ({"mapq": 19}, 0), ({"mapq": 20}, 1), ({"is_secondary": True}, 0), ({"is_supplementary": True}, 1), ({"ref_start": 10_001}, 0), ({"ref_end": 10_499}, 0), ({"ref_start": 0}, 1)])
def test_spanning_direct(spark, gap, change, found):
    assert reads.spanning_direct(aln(spark, {"ref_start": 10_000, "ref_end": 10_500} | change), gap).count() == found


@pytest.mark.parametrize("end, clip, found", [(9_500, 1, 0), (9_501, 1, 1), (10_500, 1, 1), (10_501, 1, 0), (10_100, 0, 1), (10_000, 0, 0)])
def test_flank_left(spark, gap, end, clip, found):
    assert reads.flank_left(aln(spark, {"ref_start": 8_000, "ref_end": end, "rclip": clip}), gap).count() == found


def test_linked_takes_the_last_record(spark, gap):
    rows = [{"read_name": "x", "aln_no": 1, "ref_start": 7_000, "ref_end": 9_900}, {"read_name": "x", "aln_no": 2, "ref_start": 8_000, "ref_end": 11_000}, {"read_name": "x", "aln_no": 3, "ref_start": 10_600, "ref_end": 12_000}]
    found = reads.spanning_linked(aln(spark, *rows), gap).collect()
    assert [(r["left_end"], r["right_start"]) for r in found] == [(11_000, 10_600)]


@pytest.mark.parametrize("lclip, end, near", [(99, 8_998, False), (99, 9_000, True), (100, 8_000, True)])
def test_useful(spark, gap, lclip, end, near):
    assert reads.useful_reads(aln(spark, {"ref_start": 5_000, "ref_end": end, "lclip": lclip}), gap).first()["is_useful"] == near


def test_empty_alignments(spark, gap):
    none = spark.createDataFrame([], ALN)
    row = reads.bundle_counts(none, gap).first().asDict()
    assert row.pop("gap_id") == "g" and set(row.values()) == {0}
    regions = gap.select(F.col("gap_id").alias("region_id"), "chrom", F.col("gap_start").alias("r_start"), F.col("gap_end").alias("r_end"))
    assert coverage.region_stats(none, regions).first()["zero_coverage_ratio"] == 1.0


def test_gap_scan_agrees_with_a_regex_across_blocks(spark):
    rng = random.Random(5)
    contigs = [(f"c{k}", k, "".join(rng.choice("ACGTNNnn") for _ in range(rng.randint(1, 300)))) for k in range(30)]
    df = spark.createDataFrame([*contigs, ("e", 99, "")], "chrom string, ord int, seq string")
    want = sorted((c, m.start(), m.end()) for c, _, s in contigs for m in re.finditer("N+", s.upper()) if m.end() - m.start() >= 2)
    got = sorted((r["chrom"], r["gap_start"], r["gap_end"]) for r in gaps.scan_gaps(df, 2, block=7).collect())
    assert got == want


def test_splicing_by_blocks_agrees_with_whole_contigs(spark):
    rng = random.Random(6)
    contigs = [(f"c{k}", k, "".join(rng.choice("ACGTNNN") for _ in range(rng.randint(1, 120))) + rng.choice(["", "N" * 40, "A"])) for k in range(20)]
    df = spark.createDataFrame([*contigs, ("e", 99, ""), ("none", 100, None)], "chrom string, ord int, seq string")
    fills = [(c, m.start(), m.end(), "G" * rng.choice([0, 1, 30])) for c, _, s in contigs for m in re.finditer("N+", s) if rng.random() < 0.7]
    made = spark.createDataFrame(fills, "chrom string, gap_start bigint, gap_end bigint, fill string")
    whole = {r["chrom"]: r["seq"] or "" for r in gaps.splice_fills(df, made).collect()}
    for size in (7, 1000):
        got = defaultdict(list)
        for r in gaps.splice_blocks(gaps.contig_blocks(df, size), made, size).collect():
            got[r["chrom"]].append((r["block_start"], r["seq"]))
        for chrom, rows in got.items():
            at = 0
            for start, seq in sorted(rows, key=lambda x: (x[0], len(x[1]))):
                assert start == at
                at += len(seq)
            assert "".join(seq for _, seq in sorted(rows, key=lambda x: (x[0], len(x[1])))) == whole[chrom]
        assert set(got) == set(whole)
    assert gaps.splice_blocks(gaps.contig_blocks(df.limit(0), 7), made, 7).count() == 0


def test_splice_and_normalize(spark):
    df = spark.createDataFrame([("a", 0, "acNNNNgtNNtt"), ("b", 1, "TT")], "chrom string, ord int, seq string")
    fills = spark.createDataFrame([("a", 2, 6, "GG"), ("a", 8, 10, "")], "chrom string, gap_start bigint, gap_end bigint, fill string")
    assert {r["chrom"]: r["seq"] for r in gaps.splice_fills(df, fills).collect()} == {"a": "acGGgttt", "b": "TT"}
    assert gaps.normalize_lengths(df, 3, 5).first()["seq"] == "acNNNNNgtNNtt"


def test_shared_is_inclusive(spark):
    df = spark.createDataFrame([("h1", "c", 0, 5), ("h2", "c", 1000, 1005), ("h1", "d", 0, 5), ("h2", "d", 1001, 1006)], "hap string, chrom string, gap_start bigint, gap_end bigint")
    assert {(r["chrom"], r["is_shared"]) for r in gaps.shared_or_specific(df).collect()} == {("c", True), ("d", False)}


def test_vote_keeps_the_first_of_ties(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))) for _ in range(6)]
    df = spark.createDataFrame([("g", k, s) for k, s in enumerate(seqs)], "gap_id string, read_no bigint, seq string")
    want = "".join(Counter(s[i] for s in seqs if i < len(s)).most_common(1)[0][0] for i in range(max(map(len, seqs))))
    assert sequence.majority_vote(df).first()["consensus"] == want


@pytest.mark.parametrize("kind, n, identity, route", [("hifi", 2, 1.0, "none"), ("hifi", 3, 0.95, "direct_consensus"), ("hifi", 3, 0.949, "poa_consensus"), ("hifi", 3, 0.849, "none"), ("ont", 4, 0.99, "none"), ("ont", 5, 0.85, "ont_poa_consensus")])
def test_routes(spark, kind, n, identity, route):
    assert sequence.consensus_route(spark.createDataFrame([(kind, n, identity)], "read_type string, n_reads int, identity double")).first()["route"] == route


def test_jaccard_of_short_reads_is_zero(spark):
    df = spark.createDataFrame([("g", 0, "ACGT"), ("g", 1, "ACGT")], "gap_id string, read_no bigint, seq string")
    assert sequence.pair_identity(df).first()["identity"] == 0.0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), shared_checkpoint).collect()}
    assert got == {n: root[n] for n in linked}


def test_components_of_hot_nodes(spark):
    edges = [(k, 1) for k in range(2, 400)] + [(k, 900) for k in range(500, 700)] + [(399, 500), (901, 902), (903, 904), (904, 905)] + [(901, 902)] * 300
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), shared_checkpoint).collect()}
    assert got == {n: 1 for n in [*range(1, 400), *range(500, 700), 900]} | {901: 901, 902: 901, 903: 903, 904: 903, 905: 903}
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint"), shared_checkpoint).isEmpty()


def test_stars_need_no_round(spark):
    cuts = []
    cut = lambda df: cuts.append(1) or shared_checkpoint(df)
    links = spark.createDataFrame([(k, k % 3) for k in range(3, 300)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.connected_components(links, cut).collect()}
    assert got == {k: k % 3 for k in range(300)} and len(cuts) == 1
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 40)], "a bigint, b bigint")
    assert {r["root"] for r in components.connected_components(chain, cut).collect()} == {0}



def test_hot_node_is_not_shuffled(spark):
    links = spark.createDataFrame([(1, k) for k in range(2, 5000)] + [(k, k + 1) for k in range(6000, 6200)], "a bigint, b bigint")
    cold = components._with_least(links, components._least(links), links.count())
    assert cold.filter("a = 1 and m = 2").count() == 4998 and cold.count() == links.count()
    plan = cold._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "LeftAnti" in plan


def test_clusters_of_three_are_one(spark):
    found = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 1), (2, 2), (2, 3), (2, 4)], "gap_id bigint, read_no bigint")
    links = spark.createDataFrame([(2, 1, 3, 900, 1000), (2, 2, 4, 899, 1000)], "gap_id bigint, query_no bigint, target_no bigint, matches bigint, block_len bigint")
    got = {(r["gap_id"], r["read_no"]): r["cluster"] for r in overlaps.clusters(found, links, shared_checkpoint).collect()}
    assert got == {(1, 5): 5, (1, 6): 5, (1, 7): 5, (2, 1): 1, (2, 3): 1, (2, 2): 2, (2, 4): 4}


def test_assembly_of_planted_reads(spark):
    rng = random.Random(1)
    truth = "".join(rng.choice("ACGT") for _ in range(3000))
    df = spark.createDataFrame([("g", k, truth[k * 50 : k * 50 + 300]) for k in range(60)], "gap_id string, read_no bigint, seq string")
    assert [tuple(r) for r in assembly.assemble(df, shared_checkpoint).collect()] == [("g", 60, truth)]


def test_consensus_repairs_errors(spark):
    rng = random.Random(4)
    truth = "".join(rng.choice("ACGT") for _ in range(200))
    forms = [truth[:40] + truth[41:], truth[:90] + "T" + truth[90:], truth[:150] + ("A" if truth[150] != "A" else "C") + truth[151:], truth, truth]
    df = spark.createDataFrame([("g", k, s) for k, s in enumerate(forms)], "gap_id string, read_no bigint, seq string")
    assert kernels.poa_consensus(df).first()["seq"] == truth


def test_phasing_outcomes(spark):
    found = spark.createDataFrame([(k,) for k in range(4)], "read bigint")
    hits = spark.createDataFrame([(0, "A", "A", "C", None), (1, "A", "A", "A", "C"), (2, "G", "A", "C", "T")], "read bigint, base string, hap1 string, hap2 string, hap3 string")
    got = {r["read"]: r["outcome"] for r in phasing.phase_reads(hits, found).collect()}
    assert got == {0: "tie", 1: "tie", 2: "no_match", 3: "no_snp"}


def test_spans_are_phased_in_one_pass(spark):
    rng = random.Random(8)
    sites = [(f"c{rng.randrange(2)}", p, *(rng.choice([*"ACGT", None]) if k else rng.choice("ACGT") for k in range(3))) for p in (rng.randrange(600_000) for _ in range(400))]
    reads = []
    for n in range(300):
        start, size = rng.choice([rng.randrange(600_000), 8192 * rng.randrange(70)]), rng.choice([-5, 0, 1, 3000, 8191, 8192, 8193, 60_000, 131_072, 131_073, 2_500_000])
        reads.append((None if n % 50 == 7 else f"r{n}", n % 3, f"c{rng.randrange(3)}", None if n % 60 == 9 else start, start + size, n))
    alns = spark.createDataFrame(reads, "read_name string, aln_no int, chrom string, ref_start bigint, ref_end bigint, step bigint")
    snps = spark.createDataFrame(sites, "chrom string, pos bigint, hap1 string, hap2 string, hap3 string")
    base = lambda pos: F.substr(F.lit("ACGT"), ((F.col("step") + pos) % 4).cast("int") + 1, F.lit(1))
    got = phasing.phase_spans(alns, snps, base, ["read_name", "aln_no"]).collect()
    hits = alns.join(snps, "chrom").filter("ref_start <= pos and pos < ref_end").withColumn("base", base(F.col("pos"))).select("read_name", "aln_no", "base", "hap1", "hap2", "hap3")
    want = phasing.phase_reads(hits, alns.select("read_name", "aln_no")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({r["outcome"] for r in got}) == 6
    plan = registry.QUERIES["phase_reads"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1, "alignments are numbered once"


def test_formats_round_trip(spark, tmp_path):
    contigs = spark.createDataFrame([("c1", "ACGT" * 50), ("c2", "N" * 80)], "chrom string, seq string")
    files.write_fasta(contigs, f"{tmp_path}/f", compression="gzip")
    assert {(r["chrom"], r["seq"]) for r in files.read_fasta(spark, f"{tmp_path}/f").collect()} == {("c1", "ACGT" * 50), ("c2", "N" * 80)}
    bed = spark.createDataFrame([("c", 1, 5, "n", 4)], "chrom string, gap_start bigint, gap_end bigint, name string, size bigint")
    files.write_bed(bed, f"{tmp_path}/b")
    assert files.read_bed(spark, f"{tmp_path}/b").collect() == bed.collect()
    (tmp_path / "a.sam").write_text("@HD\tx\nr1\t0\tc\t11\t60\t2S3M1D2M\t*\t0\t0\tTTACGTA\t*\tMD:Z:3^A2\n")
    row = files.read_sam(spark, f"{tmp_path}/a.sam", "hifi").first()
    assert (row["ref_start"], row["ref_end"], row["lclip"], row["rclip"], row["md"]) == (10, 16, 2, 0, "3^A2")
    pairs = files.aligned_pairs(files.read_sam(spark, f"{tmp_path}/a.sam", "hifi")).select("pos", "base").collect()
    assert [tuple(p) for p in sorted(pairs)] == [(10, "A"), (11, "C"), (12, "G"), (14, "T"), (15, "A")]
    (tmp_path / "r.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert [(r["read_name"], r["seq"]) for r in files.read_fastq(spark, f"{tmp_path}/r.fq", "ont").collect()] == [("r1", "ACGT"), ("r2", "GG")]


def test_streamed_status_is_the_batch_status(spark, tmp_path):
    schema = "gap_id bigint, seq_no bigint, ts timestamp, status string"
    log = spark.createDataFrame([(1, 1, "a", "pending"), (1, 2, "a", "failed"), (2, 3, "a", "pending")], "gap_id bigint, seq_no bigint, x string, status string").withColumn("ts", F.timestamp_seconds("seq_no")).select("gap_id", "seq_no", "ts", "status")
    log.write.parquet(f"{tmp_path}/in")
    query = status.append_to_table(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert sorted(status.summarise(f"{tmp_path}/out", spark, 0).collect()) == sorted(state.summary(log).collect())


def test_plans_have_equi_joins_and_no_python(spark):
    for name in ("spanning_direct", "useful_reads", "region_stats", "phase_reads", "reads_bundle_counts", "local_validation", "fill_result"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|Cartesian|Python|Arrow", plan), name


def test_no_sequence_is_shuffled_by_the_scan(spark):
    plan = registry.QUERIES["gap_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "MapInArrow" in plan.partition("Exchange")[2], "the scan stands below the only exchange of runs"


def test_overlap_join_gives_each_pair_once(spark):
    rng = random.Random(3)
    span = lambda: (lambda a: (a, a + rng.randint(1, 80)))(rng.randrange(300))
    a, b = [(k, *span()) for k in range(40)], [(k, *span()) for k in range(40)]
    x = spark.createDataFrame([("c", *r) for r in a], "chrom string, i int, ref_start bigint, ref_end bigint")
    y = spark.createDataFrame([("c", *r) for r in b], "chrom string, j int, w_start bigint, w_end bigint")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(x, y, width=16).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if s < v and e > u)


def test_rounds_restore_planted_gaps_and_go_on_where_they_stopped(spark, tmp_path):
    from lacuna.plans.rounds import run_rounds

    rng = random.Random(12)
    truth = {c: "".join(rng.choice("ACGT") for _ in range(2500)) for c in "ab"}
    broken = [("a", 0, truth["a"][:1000] + "N" * 500 + truth["a"][1120:]), ("b", 1, truth["b"][:600] + "N" * 120 + truth["b"][700:1500] + "N" * 100 + truth["b"][1600:])]
    flip = str.maketrans("ACGT", "TGCA")
    found = [(f"{c}{k}", s[k : k + 400] if k % 80 else s[k : k + 400][::-1].translate(flip)) for c, s in truth.items() for k in range(0, 2100, 40)]
    contigs, given = spark.createDataFrame(broken, "chrom string, ord int, seq string"), spark.createDataFrame(found, "read_name string, seq string")
    for _ in range(2):
        got = {r["chrom"]: r["seq"] for r in run_rounds(contigs, given, f"{tmp_path}/run").collect()}
        assert got == truth


def test_gaps_keep_their_names_over_rounds(spark):
    from lacuna.plans.rounds import next_gaps

    known = spark.createDataFrame([("c_100_200", "o1", "c", 100, 200), ("c_300_350", "o2", "c", 300, 350), ("c_500_600", "o3", "c", 500, 600)], "gap_id string, origin_id string, chrom string, gap_start bigint, gap_end bigint")
    filled = spark.createDataFrame([("c_100_200", "A" * 130, True), ("c_300_350", "C" * 7 + "N" * 20 + "G" * 3, False)], "gap_id string, fill string, is_complete boolean")
    assert sorted(map(tuple, next_gaps(known, filled).collect())) == [("c_337_357", "o2", "c", 337, 357), ("c_510_610", "o3", "c", 510, 610)]


def test_sequences_that_sam_leaves_out(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text("r\t256\tc\t5\t0\t4M\t*\t0\t0\t*\t*\nr\t0\tc\t9\t60\t4M\t*\t0\t0\tACGT\tIIII\n")
    assert [(r["seq"], r["read_len"]) for r in files.read_sam(spark, str(path), "hifi").orderBy("aln_no").collect()] == [(None, 0), ("ACGT", 4)]


def test_rounds_merge_flanking_reads_and_leave_partial_fills(spark, tmp_path):
    from lacuna.plans.rounds import results, run_rounds

    rng = random.Random(21)
    truth = {c: "".join(rng.choice("ACGT") for _ in range(3400)) for c in "ab"}
    broken = [(c, k, s[:1200] + "N" * 900 + s[2100:]) for k, (c, s) in enumerate(truth.items())]
    # no read of 400 spans 900 bases; those of b leave 1500 to 1850 uncovered
    found = [(f"{c}{k}", s[k : k + 400], "hifi") for c, s in truth.items() for k in range(700, 2500, 25) if c == "a" or not 1100 < k < 1850]
    contigs, given = spark.createDataFrame(broken, "chrom string, ord int, seq string"), spark.createDataFrame(found, "read_name string, seq string, read_type string")
    got = {r["chrom"]: r["seq"] for r in run_rounds(contigs, given, f"{tmp_path}/run").collect()}
    assert got["a"] == truth["a"]
    left, right = got["b"].split("N" * 500)
    assert truth["b"].startswith(left) and truth["b"].endswith(right) and len(left) > 1400 and len(right) > 1400
    log = spark.read.parquet(f"{tmp_path}/run/round-*/status").collect()
    assert {"filled_partial"} <= {r["status"] for r in log} <= {"filled_complete", "filled_partial", "needs_polish", "unfillable"}
    assert {r["validation_state"] for r in log if r["status"].startswith("filled")} == {"passed"}
    assert {r["gap_id"] for r in log} == {"a_1200_2100", "b_1200_2100"} and all(r["ts"] for r in log)
    assert any(r["round_gap_id"] != r["gap_id"] for r in log)  # where the gap lies moves, its name stays
    tried = results(spark, f"{tmp_path}/run")
    assert fills.final_stats(tried).first().asDict() == {"iterations": len({r["round"] for r in log}), "total_gaps_initial": 2, "gaps_completely_filled": 1, "gaps_partially_filled": int(max(log, key=lambda r: (r["gap_id"] > "b", r["round"]))["status"] == "filled_partial"), "gaps_failed": int(max(log, key=lambda r: (r["gap_id"] > "b", r["round"]))["status"] != "filled_partial")}


def test_command_line_fills_haplotypes_from_fastq(spark, tmp_path):
    from lacuna.__main__ import fill, read_reads

    rng = random.Random(8)
    truth = ["".join(rng.choice("ACGT") for _ in range(1600)) for _ in range(2)]
    for k, s in enumerate(truth):
        (tmp_path / f"{k}.fa").write_text(f">c\n{s[:800]}{'N' * 150}{s[900:]}\n")
    pieces = [(f"r{h}_{k}", s[k : k + 500]) for h, s in enumerate(truth) for k in range(400, 900, 40)]
    (tmp_path / "reads.fastq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in pieces))
    fill(spark, [f"{tmp_path}/{k}.fa" for k in range(2)], read_reads(spark, f"{tmp_path}/reads.fastq", "hifi"), f"{tmp_path}/out", max_rounds=1)
    for k, s in enumerate(truth):
        assert [(r["chrom"], r["seq"]) for r in files.read_fasta(spark, f"{tmp_path}/out/contigs-hap{k + 1}").collect()] == [("c", s)]
    assert spark.read.parquet(f"{tmp_path}/out/rounds/round-000/status").filter("tier = '0' and validation_state = 'passed'").count() == 2


def test_overlaps_within_gaps(spark):
    rng = random.Random(5)
    truth = "".join(rng.choice("ACGT") for _ in range(1500))
    back = truth[400:1000][::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("g", 0, truth[:600]), ("g", 1, truth[300:900]), ("g", 2, back), ("g", 3, truth[1100:]), ("h", 0, truth[300:900])]
    got = {(r["query_no"], r["target_no"]): r for r in align.overlaps_within(spark.createDataFrame(rows, "gap_id string, read_no bigint, seq string")).collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 1)}
    assert got[1, 0]["strand"] == "+" and got[2, 1]["strand"] == "-"
    r = got[1, 0]
    assert r["qstart"] < 12 and r["qend"] > 288 and r["tstart"] - r["qstart"] == 300 and r["matches"] >= 0.9 * r["block_len"]


def test_identity_pairs_are_spread_over_all_pairs(spark):
    sizes = {"a": 300, "b": 21, "c": 2, "d": 4, "e": 1, "f": 90_000_000}
    got = {}
    for r in sequence.drawn_pairs(spark.createDataFrame(list(sizes.items()), "gap_id string, n bigint")).collect():
        got.setdefault(r["gap_id"], set()).add((r["i"], r["j"]))
    assert {g: len(x) for g, x in got.items()} == {"a": 10, "b": 10, "c": 1, "d": 6, "f": 10}
    for g, pairs in got.items():
        n = sizes[g]
        p, start = n * (n - 1) // 2, int(hashlib.md5(g.encode()).hexdigest()[:8], 16)
        want = {(start + k * p // min(10, p)) % p for k in range(min(10, p))}
        assert {(j - 1) * (j - 2) // 2 + i - 1 for i, j in pairs} == want and all(1 <= i < j <= n for i, j in pairs)


@pytest.mark.parametrize("n", [65, 3000])
def test_consensus_counts_every_read_once(spark, n):
    rng = random.Random(6)
    truth = "".join(rng.choices("ACGT", k=60))
    stray = "".join("A" if c != "A" else "C" for c in truth)
    df = spark.createDataFrame([("g", k, truth) for k in range(n - 1)] + [("g", n, stray)], "gap_id string, read_no bigint, seq string")
    assert [(r["n_reads"], r["seq"]) for r in kernels.poa_consensus(df).collect()] == [(n, truth)]


def test_consensus_does_not_depend_on_partitions(spark):
    rng, rows = random.Random(7), []
    for g in range(12):
        truth = rng.choices("ACGT", k=50)
        for k in range(rng.randint(3, 9)):
            rows.append((g, k, "".join(rng.choice(["", "A", c + "G", c, c, c, c, c, c]) for c in truth)))
    df = spark.createDataFrame(rows, "gap_id int, read_no bigint, seq string")
    want = sorted(map(tuple, kernels.poa_consensus(df).collect()))
    assert len(want) == 12 and sorted(map(tuple, kernels.poa_consensus(df.repartition(9)).collect())) == want


def test_reads_of_many_copies_are_placed(spark):
    rng = random.Random(8)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    text, own = dna(600), dna(600)
    blocks = spark.createDataFrame([(f"c{k:03d}", 0, text) for k in range(70)] + [("own", 0, own)], "chrom string, block_start bigint, seq string")
    given = spark.createDataFrame([("r1", text[100:400]), ("r2", text[100:400]), ("r3", own[50:350])], "read_name string, seq string")
    got = {r["read_name"]: (r["chrom"], r["strand"], r["ref_start"], r["ref_end"], r["mapq"]) for r in align.place_reads(given, blocks).collect()}
    assert got == {"r1": ("c000", "+", 100, 400, 0), "r2": ("c000", "+", 100, 400, 0), "r3": ("own", "+", 50, 350, 60)}


def test_gaps_of_many_copies_are_filled(spark):
    from lacuna.plans.rounds import spanning_fills

    rng = random.Random(9)
    truth = "".join(rng.choices("ACGT", k=1000))
    contigs = spark.createDataFrame([(f"c{k:03d}", k, truth[:450] + "N" * 100 + truth[550:]) for k in range(70)], "chrom string, ord int, seq string")
    given = spark.createDataFrame([(f"r{k}", truth[k : k + 400]) for k in range(300, 340, 10)], "read_name string, seq string")
    fills = spanning_fills(contigs, given).collect()
    assert sorted((r["gap_id"], r["chrom"]) for r in fills) == sorted((g["name"], g["chrom"]) for g in gaps.scan_gaps(contigs, 100).collect())
    assert len(fills) == 70 and {r["fill"] for r in fills} == {truth[450:550]}


def test_pieces_cover_every_base(spark, tmp_path):
    texts = ["abc" * 7, "acgt" * 100, "tgca" * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["gap_id"]: (r["n_reads"], len(r["seq"])) for r in registry.QUERIES["poa_consensus"](spark, str(tmp_path)).collect()}
    assert {k: n for k, (n, _) in got.items()} == {f"ctg{i}:{at}": 3 for i, t in enumerate(texts) for at in range(0, len(t), 300)}


def test_fastq_keeps_qualities_that_begin_with_at(spark, tmp_path):
    rng = np.random.default_rng(5)
    records = [(f"r{k}", "".join(rng.choice(list("ACGT"), n)), "".join(rng.choice(list("@+I!@"), n))) for k, n in enumerate(rng.integers(1, 60, 2000))]
    path = tmp_path / "reads.fastq"
    path.write_text("".join(f"@{n} more\n{s}\n+\n{q}\n" for n, s, q in records))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("7000", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = sorted((r["read_name"], r["seq"], r["quality"]) for r in files.read_fastq(spark, str(path), "hifi").collect())
        assert got == sorted(records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    path.write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        files.read_fastq(spark, str(path), "hifi").collect()


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">a one>two > three\nACG\nTT\n>b\nNN\n>c\n")
    rows = files.read_fasta(spark, str(path)).orderBy("ord").collect()
    assert [(r["chrom"], r["description"], r["seq"]) for r in rows] == [("a", "one>two > three", "ACGTT"), ("b", "", "NN"), ("c", "", "")]


def test_sam_records_are_numbered_in_file_order(spark, tmp_path):
    path = tmp_path / "x.sam"
    lines = ["@HD\tVN:1.6", "r1\t2048\tchr2\t900\t60\t4M\t*\t0\t0\tACGT\tIIII", "r1\t0\tchr1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII", "u\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII"]
    path.write_text("\n".join(lines) + "\n")
    rows = {(r["read_name"], r["aln_no"]): r for r in files.read_sam(spark, str(path), "hifi").collect()}
    assert (rows["r1", 1]["chrom"], rows["r1", 2]["chrom"], rows["u", 1]["ref_start"], rows["u", 1]["is_unmapped"]) == ("chr2", "chr1", None, True)
    gaps_ = spark.createDataFrame([("g", "chr1", 100, 200)], "gap_id string, chrom string, gap_start bigint, gap_end bigint")
    useful = {r["read_name"]: r["is_useful"] for r in reads.useful_reads(files.read_sam(spark, str(path), "hifi"), gaps_).collect()}
    assert useful == {"r1": False, "u": True}


def test_vote_over_pieces_and_many_reads(spark):
    rng = np.random.default_rng(9)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(0, 90, 200)]
    df = spark.createDataFrame([("g", k, s) for k, s in enumerate(seqs)], "gap_id string, read_no bigint, seq string").repartition(3)
    want = []
    for at in range(max(map(len, seqs))):
        column = [s[at] for s in seqs if at < len(s)]
        want.append(max(dict.fromkeys(column), key=column.count))
    assert sequence.majority_vote(df, 16).first()["consensus"] == "".join(want)


def test_pairs_of_many_reads_are_drawn_from_all(spark):
    df = spark.createDataFrame([("g", k, "ACGTTGCAAGGCTTAACC" + "ACGT"[k % 4]) for k in range(60)], "gap_id string, read_no bigint, seq string")
    rows = sequence.pair_identity(df).collect()
    assert len(rows) == 10 and max(r["j"] for r in rows) > 20


def test_identities_of_all_pairs_of_any_number_of_reads(spark):
    rng = random.Random(5)
    given = {"g": ["".join(rng.choices("ACGTN", k=rng.choice([0, 10, 15, 40, 300]))) for _ in range(11)], "h": ["".join(map(chr, rng.choices(range(33, 1033), k=60)))] * 2 + ["x" * 20], "one": ["ACGT" * 9]}
    given["g"][3] = given["g"][2][:20] + given["g"][4]
    df = spark.createDataFrame([(g, 7 * k, s) for g, seqs in given.items() for k, s in enumerate(seqs)], "gap_id string, read_no bigint, seq string")
    want = {}
    for g, seqs in given.items():
        sets = [{s[i : i + 15] for i in range(len(s) - 14)} for s in seqs]
        want |= {(g, i + 1, j + 1): len(a & b) / len(a | b) if a and b else 0.0 for j, b in enumerate(sets) for i, a in enumerate(sets[:j])}
    for tile in (3, 64):
        rows = sequence.all_identities(df, tile).collect()
        assert len(rows) == len(want) and {(r["gap_id"], r["i"], r["j"]): r["identity"] for r in rows} == want
    means = {r["gap_id"]: (r["n_reads"], r["identity"]) for r in sequence.mean_identity(df).collect()}
    assert means["one"] == (1, 1.0) and means["g"][0] == 11 and means["g"][1] == pytest.approx(sum(v for k, v in want.items() if k[0] == "g") / 55)


def test_runs_within_blocks_and_numbers_over_stripes_are_not_dealt_together(spark):
    contigs = spark.createDataFrame([("a", 5, "NNACNNNNGTNNNNNN"), ("b", -3, "NNNNNNNN"), ("c", 900, "ACGTNN"), ("d", 901, None), ("e", 902, "NNNNnnnnNNNNACGT")], "chrom string, ord bigint, seq string")
    found = gaps.scan_gaps(contigs, 2, block=4)
    assert sorted((r["chrom"], r["gap_start"], r["gap_end"], r["size"]) for r in found.collect()) == [("a", 0, 2, 2), ("a", 4, 8, 4), ("a", 10, 16, 6), ("b", 0, 8, 8), ("c", 4, 6, 2), ("e", 0, 12, 12)]
    assert sorted((r["gap_start"], r["name"]) for r in gaps.number_gaps(found).filter("chrom in ('a', 'e')").collect()) == [(0, "a_gap2"), (0, "e_gap6"), (4, "a_gap3"), (10, "a_gap4")]
    moved = lambda plan: plan.split("Union", 1)[1].split("\n:- ", 1)[1].split("\n+- ", 1)[0]
    assert "Exchange" not in moved(found._jdf.queryExecution().optimizedPlan().toString()) and "Window" not in moved(found._jdf.queryExecution().optimizedPlan().toString())
    fills = spark.createDataFrame([("a", 0, 2, "ACGTACGT")], "chrom string, gap_start bigint, gap_end bigint, fill string")
    lifted = gaps.lifted(found.withColumnRenamed("name", "gap_id").withColumn("other", F.lit(1)), fills)
    assert lifted.columns[-2:] == ["other", "shift"] and {r["gap_id"]: r["shift"] for r in lifted.collect() if r["chrom"] == "a"} == {"a_0_2": 0, "a_4_8": 6, "a_10_16": 6}


def test_consensus_of_small_gaps_shuffles_reads_once_and_agrees_with_tiles(spark, monkeypatch):
    rows = [("a", "hifi", k, "ACGTTGCATTGACCATGAC" * 3 + "ACGT"[k % 4]) for k in range(5)] + [("b", "hifi", k, s) for k, s in enumerate(["ACGT" * 9, "ACGT" * 8, "ACGT" * 10])]
    rows += [("c", "ont", k, "ACGT" * 9) for k in range(6)] + [("d", "hifi", 0, "ACGT" * 9), ("e", "hifi", 0, None), ("e", "hifi", 1, ""), ("e", "hifi", 2, "AC"), (None, "hifi", 0, "ACGT")]
    table = spark.createDataFrame(rows, "gap_id string, read_type string, read_no bigint, seq string")
    poa = lambda df: df.groupBy("gap_id").agg(F.count(F.lit(1)).alias("n_reads"), F.min("seq").alias("seq"))
    small = sequence.consensus_fill(table, poa)
    whole = sorted(map(tuple, small.collect()))
    plain = sequence.consensus_fill(table)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(sequence, "TILE", 4)
    assert sorted(map(tuple, sequence.consensus_fill(table, poa).collect())) == whole
    assert {r[0] for r in whole} == {"a", "b", "c"}
    assert sequence.voted([b"AC", b"", b"TCG"], 2) == b"ACG"


def test_spanning_reads_meet_gaps_in_one_join(spark):
    kind = "chrom string, read_name string, aln_no int, read_type string, ref_start bigint, ref_end bigint, read_len bigint, mapq int, is_secondary boolean, is_supplementary boolean, lclip int, rclip int"
    rows = [("c", "a", 1, "hifi", 100, 5000, 4900, 60, False, False, 0, 0), ("c", "b", 1, None, 0, 950, 0, 60, False, False, 0, 9), ("c", "b", 2, "ont", 2100, 3000, 900, 60, False, True, 9, 0), ("c", "d", 1, "ont", 0, 900, 300, 60, False, False, 0, 9), ("c", "d", 2, "ont", 2100, 3000, 900, 60, True, False, 9, 0)]
    aln, found = spark.createDataFrame(rows, kind), spark.createDataFrame([("g", "c", 1000, 2000)], "gap_id string, chrom string, gap_start bigint, gap_end bigint")
    spans = reads.spanning_all(aln, found)
    for df in (spans, reads.spanning_linked(aln, found)):
        assert len(re.findall(r"(?:SortMergeJoin|HashJoin) \[", df._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted(tuple(r) for r in spans.collect()) == [("g", "a", "hifi", 4900, "direct"), ("g", "b", None, 900, "linked")]
    assert reads.bundle_counts(aln, found).first().asDict() == {"gap_id": "g", "hifi_spanning": 1, "hifi_left": 0, "hifi_right": 0, "ont_spanning": 0, "ont_left": 0, "ont_right": 1}


def test_few_sequences_are_voted_on_where_they_differ():
    """voted counts equal sequences together and is the vote of each place, of any lengths, ties to the first."""
    rng = random.Random(4)
    for k in range(200):
        truth = "".join(rng.choices("ACGT", k=rng.randrange(30)))
        seqs = [truth[: rng.randrange(len(truth) + 1)] if rng.random() < 0.3 else "".join(rng.choice("AC") if rng.random() < 0.2 else c for c in truth) for _ in range(rng.randrange(1, 9))]
        want = ""
        for i in range(max(map(len, seqs))):
            column = [s[i] for s in seqs if len(s) > i]
            want += max(dict.fromkeys(column), key=column.count)
        assert sequence.voted([s.encode() for s in seqs], (7, 1 << 16)[k % 2]) == want.encode()


def test_direct_consensus_shuffles_reads_once(spark):
    """Gaps of few reads take one exchange with sequences; larger ones give the same by joins."""
    rows = [(g, r, "ACGTACGT" if r % 3 else "ACGAACGT" + "T" * (r % 2)) for g in range(5) for r in range(g + 1)]
    few = spark.createDataFrame(rows, "gap_id long, read_no long, seq string")
    out = sequence.direct_consensus(few)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    many = spark.createDataFrame([(9, r, "ACGTACGT" if r % 3 else "ACGAACGT") for r in range(100)], few.schema)
    got = {r["gap_id"]: (r["n_reads"], r["seq"]) for r in sequence.direct_consensus(few.union(many)).collect()}
    assert got == {r["gap_id"]: (r["n_reads"], r["seq"]) for r in out.collect()} | {9: (100, "ACGTACGT")}
    assert got[3] == (4, "ACGAACGTT") and got[0] == (1, "ACGAACGT")
