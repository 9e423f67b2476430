"""All queries over the driver's tables, with their SQL twins.

A query loads derived fixtures, applies one operator and returns plain columns.  The SQL says the same another way:
per base instead of by sweep line, by direct range predicates instead of bins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import align, assembly, coverage, fills, gaps, intervals, kernels, overlaps, phasing, reads, sequence, state, validation
from lacuna.operators.tables import settled
from lacuna.plans.fixtures import duck, load
from lacuna.shipping import shipped

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None, fixtures: str = ""):
    """Registers a query; `fixtures` names the tables that its SQL starts from."""

    def add(f):
        QUERIES[name] = shipped(f)
        if sql is not None:
            ORACLE_SQL[name] = (duck(*fixtures.split()) + " " if fixtures else "") + sql
        return f

    return add


def _aln_gaps(spark, d):
    return load(spark, d, "aln"), load(spark, d, "gaps")


MIN_RUN = 3
_RUNS = """, n as (
  select chrom, ord, seq, unnest(range(1, length(seq) + 1)) as i from contigs
), p as (
  select chrom, ord, i, i - row_number() over (partition by chrom order by i) as g from n where substr(seq, i, 1) = 'N'
), runs as (
  select chrom, ord, cast(min(i) - 1 as bigint) as gap_start, cast(max(i) as bigint) as gap_end, cast(count(*) as bigint) as size from p group by chrom, ord, g
)
"""


# --- gaps and edits ------------------------------------------------------------------------------------------


@query("gap_scan", _RUNS + "select chrom, ord, gap_start, gap_end, size, concat(chrom, '_', gap_start, '_', gap_end) as name from runs where size >= 3", "contigs")
def _(spark, d):
    return gaps.scan_gaps(load(spark, d, "contigs"), MIN_RUN)


@query("gap_scan_named", _RUNS + "select chrom, ord, gap_start, gap_end, size, concat(chrom, '_gap', row_number() over (order by ord, gap_start)) as name from runs where size between 3 and 6", "contigs")
def _(spark, d):
    return gaps.number_gaps(gaps.scan_gaps(load(spark, d, "contigs"), MIN_RUN, 6))


@query("gap_stats", _RUNS + """, s as (select size, row_number() over (order by size) as k, count(*) over () as n from runs where size >= 3)
select cast(count(*) as bigint) as count, cast(sum(size) as bigint) as total_bp, min(size) as min_size, max(size) as max_size,
       cast(sum(size) // count(*) as bigint) as mean_size, max(case when k = n // 2 + 1 then size end) as median_size from s""", "contigs")
def _(spark, d):
    return gaps.gap_stats(gaps.scan_gaps(load(spark, d, "contigs"), MIN_RUN))


@query("gap_normalize_lengths", "select chrom, ord, regexp_replace(seq, 'N{5,}', repeat('N', 500), 'g') as seq from contigs", "contigs")
def _(spark, d):
    return gaps.normalize_lengths(load(spark, d, "contigs"), 5)


_HAP_GAPS = """
select 'hap1' as hap, chrom, gap_start, gap_end from gaps
union all select 'hap2', chrom, gap_start + gap_start % 3500, gap_end + gap_start % 3500 from gaps
union all select 'hap3', chrom, gap_start + gap_start % 1700, gap_end + gap_start % 1700 from gaps"""


def _hap_gaps(spark, d):
    return spark.sql(_HAP_GAPS.replace("from gaps", "from {g}"), g=load(spark, d, "gaps"))


@query("gap_shared_specific", f""", h as ({_HAP_GAPS})
select *, exists (select 1 from h o where o.chrom = h.chrom and o.hap <> h.hap and abs(o.gap_start - h.gap_start) <= 1000) as is_shared from h""", "gaps")
def _(spark, d):
    return gaps.shared_or_specific(_hap_gaps(spark, d))


_PRIORITY_ROWS = """
select o_orderkey as gap_id, cast(case when o_orderkey % 11 <> 0 then o_custkey * 37 % 15000 end as bigint) as size,
       o_custkey % 8 as hifi_spanning, o_orderkey % 5 as ont_spanning, o_orderkey % 7 as hifi_left, o_custkey % 6 as hifi_right from orders"""
_PRIORITY = f"""with g as ({_PRIORITY_ROWS}), p as (select gap_id, cast(
  case when coalesce(size, 500) < 1000 then 50 when coalesce(size, 500) < 5000 then 30 when coalesce(size, 500) < 10000 then 10 else 0 end
  + case when hifi_spanning >= 5 then 100 when hifi_spanning >= 3 then 50 else 0 end + case when ont_spanning >= 3 then 30 else 0 end
  + case when hifi_left >= 3 and hifi_right >= 3 then 20 else 0 end as int) as priority from g) """


def _priorities(spark, d):
    rows = spark.sql(_PRIORITY_ROWS.replace("from orders", "from {o}"), o=spark.read.parquet(f"{d}/orders.parquet"))
    return gaps.priority(rows).select("gap_id", "priority")


@query("gap_priority", _PRIORITY + "select * from p")
def _(spark, d):
    return _priorities(spark, d)


@query("gap_batches", _PRIORITY + "select gap_id, priority, cast((row_number() over (order by priority desc, gap_id) - 1) // 50 as bigint) as batch from p")
def _(spark, d):
    return gaps.batches(_priorities(spark, d)).select("gap_id", "priority", "batch")


@query("gap_attemptable", """, l as (select gap_id, arg_max(status, (ts, seq_no)) as status from status_log group by gap_id)
select c_custkey as gap_id from customer where c_custkey not in (select gap_id from l where status in ('unfillable', 'filled_complete', 'filled_partial'))""", "status_log")
def _(spark, d):
    known = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("gap_id"))
    return gaps.attemptable(known, state.latest(load(spark, d, "status_log")))


@query("truncate_partial", """, f as (select chrom, regexp_replace(seq, 'N{4,}', repeat('N', 500), 'g') as seq, ord % 2 = 0 as left_valid, ord % 3 = 0 as right_valid from contigs)
select chrom, left_valid, right_valid, case when regexp_matches(seq, 'N{10,}')
  then concat(case when left_valid then regexp_extract(seq, '(?s)^(.*?)(N{10,})(.*)$', 1) else '' end, regexp_extract(seq, '(?s)^(.*?)(N{10,})(.*)$', 2),
              case when right_valid then regexp_extract(seq, '(?s)^(.*?)(N{10,})(.*)$', 3) else '' end) else seq end as seq from f""", "contigs")
def _(spark, d):
    fills = gaps.normalize_lengths(load(spark, d, "contigs"), 4).select("chrom", "seq", F.expr("ord % 2 = 0").alias("left_valid"), F.expr("ord % 3 = 0").alias("right_valid"))
    return gaps.truncate_partial(fills).select("chrom", "left_valid", "right_valid", "seq")


def _fills(spark, d):
    found = gaps.scan_gaps(load(spark, d, "contigs"), 4).filter("gap_start % 3 <> 0")
    return found.select("chrom", "gap_start", "gap_end", F.expr("repeat('G', cast(gap_start % 9 as int))").alias("fill"))


_FILLS = _RUNS + ", fills as (select chrom, gap_start, gap_end, repeat('G', cast(gap_start % 9 as int)) as fill from runs where size >= 4 and gap_start % 3 <> 0)"


@query("splice_fills", _FILLS + """, inside as (select chrom, unnest(range(gap_start + 1, gap_end + 1)) as i from fills), parts as (
  select chrom, i, substr(seq, i, 1) as s from n where not exists (select 1 from inside x where x.chrom = n.chrom and x.i = n.i)
  union all select chrom, gap_start + 1, fill from fills
) select c.chrom, coalesce(string_agg(s, '' order by i), '') as seq from contigs c left join parts using (chrom) group by c.chrom""", "contigs")
def _(spark, d):
    return gaps.splice_fills(load(spark, d, "contigs").select("chrom", "seq"), _fills(spark, d))


@query("splice_blocks", _FILLS + """, inside as (select chrom, unnest(range(gap_start + 1, gap_end + 1)) as i from fills), parts as (
  select chrom, i, substr(seq, i, 1) as s from n where not exists (select 1 from inside x where x.chrom = n.chrom and x.i = n.i)
  union all select chrom, gap_start + 1, fill from fills
), texts as (select chrom, (i - 1) // 64 as block, string_agg(s, '' order by i) as seq from parts group by all),
b as (select chrom, unnest(range(0, greatest(length(seq), 1), 64)) // 64 as block from contigs),
whole as (select chrom, block, coalesce(seq, '') as seq from b left join texts using (chrom, block))
select chrom, cast(coalesce(sum(length(seq)) over (partition by chrom order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as block_start, seq from whole""", "contigs")
def _(spark, d):
    return gaps.splice_blocks(gaps.contig_blocks(load(spark, d, "contigs"), 64), _fills(spark, d), 64)


@query("lift_over", _FILLS + """, g as (select concat(chrom, '_', gap_start, '_', gap_end) as gap_id, chrom, gap_start, gap_end from runs where size >= 4)
select gap_id, g.chrom, g.gap_start, g.gap_end, cast(coalesce(sum(length(fill) - (f.gap_end - f.gap_start)), 0) as bigint) as shift
from g left join fills f on f.chrom = g.chrom and f.gap_start < g.gap_start group by all""", "contigs")
def _(spark, d):
    found = gaps.scan_gaps(load(spark, d, "contigs"), 4).select(F.col("name").alias("gap_id"), "chrom", "gap_start", "gap_end")
    return gaps.lifted(found, _fills(spark, d))


@query("merge_prefix", f", h as ({_HAP_GAPS}) select hap, concat(hap, '__', chrom) as chrom, gap_start, gap_end from h", "gaps")
def _(spark, d):
    return gaps.prefix_contigs(_hap_gaps(spark, d))


@query("split_prefix", f", h as ({_HAP_GAPS}) select hap, chrom, gap_start, gap_end from h", "gaps")
def _(spark, d):
    return gaps.split_prefix(gaps.prefix_contigs(_hap_gaps(spark, d)).drop("hap")).select("hap", "chrom", "gap_start", "gap_end")


# --- reads ---------------------------------------------------------------------------------------------------

_NEAR = "aln a join gaps g on a.chrom = g.chrom"
_DIRECT = f"""direct as (select gap_id, read_name, read_type, read_len, aln_no, ref_start, ref_end from {_NEAR}
  where not is_secondary and mapq >= 20 and read_len >= 500 and ref_start < gap_end + 100 and ref_end > gap_start - 100 and ref_start <= gap_start and ref_end >= gap_end)"""
_LINKED = f"""l as (select * from (select gap_id, read_name, read_type, gap_start, gap_end, ref_end as left_end, read_len as left_len, row_number() over (partition by gap_id, read_name order by aln_no desc) as k
    from {_NEAR} where mapq >= 20 and ref_start < gap_start + 1000 and ref_end > greatest(gap_start - 1000, 0) and abs(ref_end - gap_start) <= 1000) where k = 1),
  r as (select * from (select gap_id, read_name, ref_start as right_start, read_len as right_len, row_number() over (partition by gap_id, read_name order by aln_no desc) as k
    from {_NEAR} where mapq >= 20 and ref_start < gap_end + 1000 and ref_end > greatest(gap_end - 1000, 0) and abs(ref_start - gap_end) <= 1000) where k = 1),
  linked as (select gap_id, read_name, read_type, left_end, right_start, case when left_len > 0 then left_len else right_len end as read_len
    from l join r using (gap_id, read_name) where left_end <= gap_start + 1000 and right_start >= gap_end - 1000 and case when left_len > 0 then left_len else right_len end >= 500)"""
_ALL = """spanning as (select gap_id, read_name, read_type, read_len, method from (select *, row_number() over (partition by gap_id, read_name order by method, place) as k from (
    select gap_id, read_name, read_type, read_len, 'direct' as method, aln_no as place from direct union all select gap_id, read_name, read_type, read_len, 'linked', 0 from linked)) where k = 1)"""


def _flank_sql(side: str) -> str:
    at, clip, reach = ("gap_start", "rclip", "abs(ref_end - gap_start) <= 500") if side == "left" else ("gap_end", "lclip", "abs(ref_start - gap_end) <= 500")
    inside = "ref_end < gap_end" if side == "left" else "ref_start > gap_start"
    return f"""{side}s as (select gap_id, read_name, read_type, aln_no from (select *, row_number() over (partition by gap_id, read_name order by aln_no) as k from {_NEAR}
      where not is_secondary and ref_start < {at} + 500 and ref_end > greatest({at} - 500, 0))
      where k = 1 and mapq >= 20 and read_len >= 500 and (({reach} and {clip} > 0) or (ref_start < {at} and {at} < ref_end and {inside}) or (is_supplementary and {reach})))"""


@query("spanning_direct", f", {_DIRECT} select * from direct", "gaps aln")
def _(spark, d):
    return reads.spanning_direct(*_aln_gaps(spark, d)).select("gap_id", "read_name", "read_type", "read_len", "aln_no", "ref_start", "ref_end")


@query("spanning_supplementary", f", {_LINKED} select * from linked", "gaps aln")
def _(spark, d):
    return reads.spanning_linked(*_aln_gaps(spark, d)).select("gap_id", "read_name", "read_type", "left_end", "right_start", "read_len")


@query("spanning_all", f", {_DIRECT}, {_LINKED}, {_ALL} select * from spanning", "gaps aln")
def _(spark, d):
    return reads.spanning_all(*_aln_gaps(spark, d))


@query("flank_left", f", {_flank_sql('left')} select * from lefts", "gaps aln")
def _(spark, d):
    return reads.flank_left(*_aln_gaps(spark, d)).select("gap_id", "read_name", "read_type", "aln_no")


@query("flank_right", f", {_flank_sql('right')} select * from rights", "gaps aln")
def _(spark, d):
    return reads.flank_right(*_aln_gaps(spark, d)).select("gap_id", "read_name", "read_type", "aln_no")


@query("gap_read_classes", f""", c as (select *, row_number() over (partition by gap_id, read_name order by aln_no) as k from {_NEAR}
  where not is_secondary and mapq >= 20 and read_len >= 500 and ref_start < gap_end + 500 and ref_end > greatest(gap_start - 500, 0)), v as (
  select gap_id, read_name, read_type, case when ref_start <= gap_start and ref_end >= gap_end then 'spanning'
    when abs(ref_end - gap_start) <= 500 then case when rclip > 0 then 'left' end when abs(ref_start - gap_end) <= 500 and lclip > 0 then 'right' end as read_class from c where k = 1)
select * from v where read_class is not null""", "gaps aln")
def _(spark, d):
    return reads.classify_once(*_aln_gaps(spark, d))


@query("anchored_reads", "select read_name, aln_no, mapq >= 20 and lclip < 100 and rclip < 100 as is_anchored from aln", "aln")
def _(spark, d):
    return reads.anchored(load(spark, d, "aln")).select("read_name", "aln_no", "is_anchored")


_USEFUL = """f as (select * from (select *, row_number() over (partition by read_name order by aln_no) as k from aln) where k = 1), useful as (
  select read_name, aln_no, read_len, ref_start is null or exists (select 1 from gaps g where g.chrom = f.chrom) and (not (mapq >= 20 and lclip < 100 and rclip < 100)
    or exists (select 1 from gaps g where g.chrom = f.chrom and greatest(gap_start - ref_end, ref_start - gap_end, 0) <= 1000)) as is_useful from f)"""


@query("useful_reads", f", {_USEFUL} select * from useful", "gaps aln")
def _(spark, d):
    return reads.useful_reads(*_aln_gaps(spark, d)).select("read_name", "aln_no", "read_len", "is_useful")


@query("kept_read_names_poly", """select distinct read_name from aln a where not is_secondary and (not (mapq >= 20 and lclip < 100 and rclip < 100)
  or exists (select 1 from gaps g where g.chrom = a.chrom and greatest(gap_start - ref_end, ref_start - gap_end, 0) <= 1000))""", "gaps aln")
def _(spark, d):
    return reads.kept_names(*_aln_gaps(spark, d))


@query("filter_stats", f""", {_USEFUL} select cast((select count(*) from aln) as bigint) as total_reads, cast(count(*) filter (is_useful) as bigint) as kept_reads,
  cast(count(*) filter (is_useful and read_len >= 500) as bigint) as stored_reads, count(*) filter (is_useful) / greatest((select count(*) from aln), 1) as kept_ratio from useful""", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    return reads.filter_stats(aln, reads.useful_reads(aln, found))


_BUNDLE = f"""{_DIRECT}, {_LINKED}, {_ALL}, {_flank_sql('left')}, {_flank_sql('right')}, bundle as (
  select gap_id, read_type, 'spanning' as kind from spanning union all select gap_id, read_type, 'left' from lefts union all select gap_id, read_type, 'right' from rights
), counts as (select g.gap_id, """ + ", ".join(f"cast(count(*) filter (read_type = '{t}' and kind = '{k}') as bigint) as {t}_{k}" for t in ("hifi", "ont") for k in ("spanning", "left", "right")) + " from gaps g left join bundle using (gap_id) group by g.gap_id)"


@query("reads_bundle_counts", f", {_BUNDLE} select * from counts", "gaps aln")
def _(spark, d):
    return reads.bundle_counts(*_aln_gaps(spark, d))


@query("tier_choice", f""", {_BUNDLE}, t as (select gap_id, list_filter([case when hifi_spanning >= 3 then '0' end, case when ont_spanning >= 5 then '0b' end,
  case when hifi_spanning >= 3 then '1' end, case when ont_spanning >= 3 then '2' end, case when hifi_spanning + ont_spanning >= 3 then '3' end, case when hifi_left + hifi_right > 0 then '4' end,
  case when ont_left + ont_right > 0 then '5' end, case when hifi_left + hifi_right + ont_left + ont_right > 0 then '6' end], lambda x: x is not null) as l from counts)
select gap_id, l[1] as first_tier, coalesce(array_to_string(l, ','), '') as tiers from t""", "gaps aln")
def _(spark, d):
    return overlaps.tier_choice(reads.bundle_counts(*_aln_gaps(spark, d)))


@query("genome_size_estimate", f""", {_DIRECT}, s as (select gap_id, count(*) as n, sum(read_len) as t from direct group by gap_id)
select gap_id, cast(n as bigint) as n_reads, cast(t as bigint) as total_bp, cast(greatest(case when n >= 5 then floor(cast(0.8 as double) * t / n) else t // 10 end, 5000) as bigint) as genome_size from s""", "gaps aln")
def _(spark, d):
    return sequence.genome_size(reads.spanning_direct(*_aln_gaps(spark, d)))


# --- coverage and validation ---------------------------------------------------------------------------------

_PRIMARY = "prim as (select * from aln where not is_secondary and not is_supplementary and not is_unmapped)"


def _region_sql(regions: str) -> str:
    """region_stats of `regions`, base by base."""
    return f"""{_PRIMARY}, regs as ({regions}), m as (select * from prim a join regs r on a.chrom = r.chrom and ref_start < r_end + 500 and ref_end > greatest(r_start - 500, 0)),
  c as (select region_id, count(*) filter (ref_start <= r_start and ref_end >= r_end) as spanning_reads, count(*) filter (ref_start < r_start and r_start < ref_end) as left_boundary_reads,
    count(*) filter (ref_start < r_end and r_end < ref_end) as right_boundary_reads,
    count(*) filter (ref_end between r_start - 100 and r_start + 100 and rclip > 0) / nullif(count(*) filter (ref_end between r_start - 100 and r_start + 100), 0) as left_clip_ratio,
    count(*) filter (ref_start between r_end - 100 and r_end + 100 and lclip > 0) / nullif(count(*) filter (ref_start between r_end - 100 and r_end + 100), 0) as right_clip_ratio from m group by region_id),
  b as (select region_id, chrom, unnest(range(r_start, r_end)) as p from regs),
  dep as (select b.region_id, b.p, count(a.chrom) as n from b left join prim a on a.chrom = b.chrom and a.ref_start <= b.p and a.ref_end > b.p group by b.region_id, b.p),
  dd as (select region_id, avg(n) as avg_coverage, min(n) as min_coverage, count(*) filter (n = 0) / count(*) as zero_coverage_ratio from dep group by region_id),
  rs as (select regs.region_id, cast(coalesce(spanning_reads, 0) as bigint) as spanning_reads, cast(coalesce(left_boundary_reads, 0) as bigint) as left_boundary_reads,
    cast(coalesce(right_boundary_reads, 0) as bigint) as right_boundary_reads, coalesce(left_clip_ratio, 0.0) as left_clip_ratio, coalesce(right_clip_ratio, 0.0) as right_clip_ratio,
    coalesce(avg_coverage, 0.0) as avg_coverage, cast(coalesce(min_coverage, 0) as bigint) as min_coverage, coalesce(zero_coverage_ratio, 1.0) as zero_coverage_ratio, r_end - r_start as fill_length
    from regs left join c using (region_id) left join dd using (region_id))"""


_GAP_REGIONS = "select gap_id as region_id, chrom, gap_start as r_start, gap_end as r_end from gaps"


def _gap_regions(found):
    return found.select(F.col("gap_id").alias("region_id"), "chrom", F.col("gap_start").alias("r_start"), F.col("gap_end").alias("r_end"))


@query("region_stats", f", {_region_sql(_GAP_REGIONS)} select * exclude (fill_length) replace (round(avg_coverage, 6) as avg_coverage, round(zero_coverage_ratio, 6) as zero_coverage_ratio, round(left_clip_ratio, 6) as left_clip_ratio, round(right_clip_ratio, 6) as right_clip_ratio) from rs", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    out = coverage.region_stats(aln, _gap_regions(found))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_coverage", "zero_coverage_ratio", "left_clip_ratio", "right_clip_ratio")})


@query("junction_coverage", f""", {_PRIMARY}, w as (select gap_id as point_id, chrom, greatest(gap_start - 50, 0) as a, gap_start + 50 as b from gaps)
select point_id, round(coalesce(sum(case when ref_start is not null then least(ref_end, b) - greatest(ref_start, a) end), 0) / any_value(b - a), 6) as junction_coverage
from w left join prim p on p.chrom = w.chrom and ref_start < b and ref_end > a group by point_id""", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    points = found.select(F.col("gap_id").alias("point_id"), "chrom", F.col("gap_start").alias("pos"))
    return coverage.junction_coverage(aln, points).withColumn("junction_coverage", F.round("junction_coverage", 6))


_FLANKS = """fl as (select concat(gap_id, '/l') as flank_id, gap_id, chrom, greatest(gap_start - 1000, 0) as f_start, gap_start as f_end from gaps
  union all select concat(gap_id, '/r'), gap_id, chrom, gap_end, gap_end + 1000 from gaps)"""
_CLIPS = f"""{_PRIMARY}, {_FLANKS}, ch as (select flank_id, pos, cast(count(*) as bigint) as n_reads from (
  select flank_id, f_start, f_end, unnest([case when lclip > 0 then ref_start end, case when rclip > 0 then ref_end end]) as pos from prim p join fl on p.chrom = fl.chrom and ref_start < f_end and ref_end > f_start)
  where pos >= f_start and pos < f_end group by flank_id, pos), md as (select flank_id, cast(sum(length(md) - length(regexp_replace(md, '[ACGT]', '', 'g'))) as bigint) as mismatches, cast(sum(read_len) as bigint) as aligned
  from prim p join fl on p.chrom = fl.chrom and ref_start < f_end and ref_end > f_start where md is not null group by flank_id)"""


@query("clip_histogram", f", {_CLIPS} select * from ch", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    return coverage.clip_histogram(aln, validation.flanks_of(found).drop("gap_id"))


@query("mismatch_density", f", {_CLIPS} select flank_id, mismatches, aligned, round(mismatches / aligned, 9) as density from md", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    return coverage.mismatch_density(aln, validation.flanks_of(found).drop("gap_id")).withColumn("density", F.round("density", 9))


_TRIAGE = f"""{_CLIPS}, bad as (select fl.gap_id, bool_or(coalesce(m, 0) >= 5 or coalesce(mismatches / aligned, 0) > 0.05) as bad
  from fl left join (select flank_id, max(n_reads) as m from ch group by flank_id) using (flank_id) left join md using (flank_id) group by fl.gap_id)"""


@query("flank_triage", f", {_TRIAGE} select gap_id, case when bad then 'needs_polish' else 'unfillable' end as status from bad", "gaps aln")
def _(spark, d):
    return validation.triage(*_aln_gaps(spark, d))


@query("pre_assess", f", {_TRIAGE} select gap_id, case when bad then 'needs_polish' else 'pending' end as status from bad", "gaps aln")
def _(spark, d):
    return validation.pre_assess(*_aln_gaps(spark, d))


_CONFIDENCE = """round(cast(least(case when spanning_reads >= 5 then 0.4 when spanning_reads >= 2 then 0.3 when spanning_reads >= 1 then 0.2 else 0 end
  + case when avg_coverage >= 10 then 0.3 when avg_coverage >= 5 then 0.2 when avg_coverage >= 2 then 0.1 else 0 end + case when zero_coverage_ratio = 0 then 0.2 when zero_coverage_ratio < 0.02 then 0.1 else 0 end
  + case when (left_clip_ratio + right_clip_ratio) / 2 < 0.1 then 0.1 when (left_clip_ratio + right_clip_ratio) / 2 < 0.2 then 0.05 else 0 end, 1.0) as double), 6)"""


@query("confidence_score", f", {_region_sql(_GAP_REGIONS)} select region_id, {_CONFIDENCE} as confidence from rs", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    c = F.col
    score = coverage.confidence(c("spanning_reads"), c("avg_coverage"), c("zero_coverage_ratio"), (c("left_clip_ratio") + c("right_clip_ratio")) / 2)
    return coverage.region_stats(aln, _gap_regions(found)).select("region_id", F.round(score, 6).alias("confidence"))


_COMPLETE = "select gap_id as region_id, chrom, gap_start as r_start, gap_end + gap_start % 1700 as r_end from gaps"


@query("validate_complete", f""", {_region_sql(_COMPLETE)}, v as (select *, spanning_reads >= case when fill_length < 1000 then 1 else 2 end and avg_coverage >= 2 as valid from rs)
select region_id, spanning_reads, round(avg_coverage, 6) as avg_coverage, valid, {_CONFIDENCE} as confidence, case when valid then 'filled_complete' else 'failed' end as status from v""", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    fills = found.select(F.col("gap_id").alias("region_id"), "chrom", F.col("gap_start").alias("r_start"), (F.col("gap_end") + F.col("gap_start") % 1700).alias("r_end"))
    return validation.validate_complete(aln, fills).withColumn("avg_coverage", F.round("avg_coverage", 6))


_PARTIAL = "pf as (select gap_id as fill_id, chrom, gap_start, gap_end, gap_start + gap_start % 300 as new_start, gap_end - gap_start % 700 % 200 as new_end from gaps)"
_SIDES = """select concat(fill_id, '/l') as region_id, chrom, gap_start as r_start, new_start as r_end from pf where new_start > gap_start
  union all select concat(fill_id, '/r'), chrom, new_end, gap_end from pf where gap_end > new_end"""


@query("validate_partial", f""", {_PARTIAL}, {_region_sql(_SIDES)}, jw as (select region_id, chrom, case when ends_with(region_id, '/l') then r_start else r_end end as pos from regs),
  jc as (select region_id, coalesce(sum(case when ref_start is not null then least(ref_end, pos + 50) - greatest(ref_start, greatest(pos - 50, 0)) end), 0) / any_value(pos + 50 - greatest(pos - 50, 0)) as j
    from jw left join prim p on p.chrom = jw.chrom and ref_start < pos + 50 and ref_end > greatest(pos - 50, 0) group by region_id),
  k as (select split_part(region_id, '/', 1) as fill_id, split_part(region_id, '/', 2) as side, j >= 5 and avg_coverage >= 5 and zero_coverage_ratio <= 0.05 as ok from rs join jc using (region_id)),
  o as (select fill_id, bool_or(ok) filter (side = 'l') as left_valid, bool_or(ok) filter (side = 'r') as right_valid from k group by fill_id)
select pf.fill_id, left_valid, right_valid, coalesce(left_valid, false) or coalesce(right_valid, false) as valid,
  case when coalesce(left_valid, false) or coalesce(right_valid, false) then 'filled_partial' else 'failed' end as status from pf left join o using (fill_id)""", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    start = F.col("gap_start")
    fills = found.select(F.col("gap_id").alias("fill_id"), "chrom", "gap_start", "gap_end", (start + start % 300).alias("new_start"), (F.col("gap_end") - start % 700 % 200).alias("new_end"))
    return validation.validate_partial(aln, fills)


@query("overlap_pairs", f"select read_name, aln_no, gap_id from {_NEAR} where ref_start < gap_end and ref_end > gap_start", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    return intervals.overlap_join(aln, found, window=("gap_start", "gap_end")).select("read_name", "aln_no", "gap_id")


# --- sequences -----------------------------------------------------------------------------------------------

_READS = "rd as (select concat('g', ord - ord % 64) as gap_id, ord as read_no, seq from contigs)"


def _reads(spark, d):
    return load(spark, d, "contigs").select(F.concat(F.lit("g"), F.col("ord") - F.col("ord") % 64).alias("gap_id"), F.col("ord").alias("read_no"), "seq")


_ALL_PAIRS = f"""{_READS}, rk as (select *, row_number() over (partition by gap_id order by read_no) as i from rd),
  ks as (select gap_id, i, case when length(seq) >= 15 then list_distinct([substr(seq, x, 15) for x in range(1, length(seq) - 13)]) else [] end as k from rk),
  u as (select gap_id, i, unnest(k) as w from ks), sh as (select a.gap_id, a.i, b.i as j, count(*) as c from u a join u b on a.gap_id = b.gap_id and a.w = b.w and a.i < b.i group by all),
  ij as (select a.gap_id, a.i, b.i as j, len(a.k) as na, len(b.k) as nb from ks a join ks b on a.gap_id = b.gap_id and a.i < b.i),
  id as (select gap_id, i, j, case when na = 0 or nb = 0 then 0.0 else coalesce(c, 0) / (na + nb - coalesce(c, 0)) end as identity from ij left join sh using (gap_id, i, j))"""
_PAIRS = f"""{_READS}, rk as (select *, row_number() over (partition by gap_id order by read_no) as i from rd),
  ks as (select gap_id, i, case when length(seq) >= 15 then list_distinct([substr(seq, x, 15) for x in range(1, length(seq) - 13)]) else [] end as k from rk),
  np as (select gap_id, count(*) * (count(*) - 1) // 2 as p, cast('0x' || substr(md5(cast(gap_id as varchar)), 1, 8) as bigint) as start from rd group by gap_id having count(*) >= 2),
  nx as (select gap_id, (start + k * p // least(10, p)) % p as x from (select *, unnest(range(0, least(10, p))) as k from np)),
  ij as (select a.gap_id, a.i as i, b.i as j from nx join rk b on nx.gap_id = b.gap_id and nx.x >= (b.i - 1) * (b.i - 2) // 2 and nx.x < b.i * (b.i - 1) // 2 join rk a on a.gap_id = nx.gap_id and a.i = nx.x - (b.i - 1) * (b.i - 2) // 2 + 1),
  ch as (select ij.gap_id, ij.i, ij.j, a.k as ka, b.k as kb from ij join ks a on a.gap_id = ij.gap_id and a.i = ij.i join ks b on b.gap_id = ij.gap_id and b.i = ij.j),
  id as (select gap_id, i, j, case when len(ka) = 0 or len(kb) = 0 then 0.0 else len(list_intersect(ka, kb)) / len(list_distinct(list_concat(ka, kb))) end as identity from ch)"""


@query("kmer_jaccard", f", {_ALL_PAIRS} select gap_id, cast(i as int) as i, cast(j as int) as j, round(identity, 9) as identity from id", "contigs")
def _(spark, d):
    return sequence.all_identities(_reads(spark, d)).withColumn("identity", F.round("identity", 9))


@query("mean_identity", f", {_ALL_PAIRS} select gap_id, cast(n as bigint) as n_reads, round(coalesce(m, 1.0), 9) as identity from (select gap_id, count(*) as n from rd group by gap_id) left join (select gap_id, avg(identity) as m from id group by gap_id) using (gap_id)", "contigs")
def _(spark, d):
    return sequence.mean_identity(_reads(spark, d)).withColumn("identity", F.round("identity", 9))


@query("backbone_read", f", {_READS} select gap_id, read_no, seq from (select *, row_number() over (partition by gap_id order by length(seq), read_no) as k, count(*) over (partition by gap_id) as n from rd) where k = n // 2 + 1", "contigs")
def _(spark, d):
    return sequence.backbone(_reads(spark, d)).select("gap_id", "read_no", "seq")


@query("majority_vote", f""", {_READS}, b as (select gap_id, read_no, unnest(range(1, length(seq) + 1)) as pos, unnest(string_split(seq, '')) as base from rd),
  v as (select gap_id, pos, base, count(*) as n, min(read_no) as f from b group by all), w as (select gap_id, pos, base, row_number() over (partition by gap_id, pos order by n desc, f) as k from v)
select gap_id, string_agg(base, '' order by pos) as consensus from w where k = 1 group by gap_id""", "contigs")
def _(spark, d):
    return sequence.majority_vote(_reads(spark, d))


_ROUTES = "select o_orderkey as gap_id, case when o_orderkey % 3 = 0 then 'ont' else 'hifi' end as read_type, o_custkey % 9 as n_reads, cast(80 + o_orderkey % 20 as double) / 100 as identity from orders"


@query("consensus_route", f"""with s as ({_ROUTES}), r as (select *, case when n_reads < 3 then 'none' when read_type = 'ont' then case when identity >= 0.85 and n_reads >= 5 then 'ont_poa_consensus' else 'none' end
  when identity >= 0.95 then 'direct_consensus' when identity >= 0.85 then 'poa_consensus' else 'none' end as route from s)
select gap_id, read_type, n_reads, identity, route, round(cast(case route when 'direct_consensus' then least(identity + 0.1, 1.0) when 'none' then 0.0 else identity end as double), 6) as confidence from r""")
def _(spark, d):
    rows = spark.sql(_ROUTES.replace("from orders", "from {o}"), o=spark.read.parquet(f"{d}/orders.parquet"))
    return sequence.consensus_route(rows).withColumn("confidence", F.round("confidence", 6))


# --- SNPs and phasing ----------------------------------------------------------------------------------------

_BASE = "substr('ACGT', cast((read_len / 100 + (pos - 250) * 3 % 7) % 4 as int) + 1, 1)"
_HITS = f"hits as (select read_name, aln_no, s.chrom, pos, hap1, hap2, hap3, {_BASE.replace('read_len / 100', 'read_len // 100')} as base from aln a join snps s on a.chrom = s.chrom and ref_start <= pos and ref_end > pos where not is_secondary)"


def _hits(spark, d):
    sites = load(spark, d, "snps").withColumn("w_start", F.col("pos")).withColumn("w_end", F.col("pos") + 1)
    met = intervals.overlap_join(load(spark, d, "aln").filter("not is_secondary"), sites)
    return met.withColumn("base", F.expr(_BASE.replace("read_len / 100", "read_len div 100")))


@query("snp_by_position", """, o as (select concat('ctg', ord - 1) as chrom, seq as alt from contigs where ord % 2 = 1), j as (select chrom, seq, alt, unnest(range(1, least(length(seq), length(alt)) + 1)) as i from contigs join o using (chrom))
select chrom, cast(i - 1 as bigint) as pos, substr(seq, i, 1) as ref_base, substr(alt, i, 1) as alt_base from j where substr(seq, i, 1) <> substr(alt, i, 1) and substr(seq, i, 1) <> 'N' and substr(alt, i, 1) <> 'N'""", "contigs")
def _(spark, d):
    first = load(spark, d, "contigs")
    return phasing.snp_by_position(first, first.filter("ord % 2 = 1").select(F.concat(F.lit("ctg"), F.col("ord") - 1).alias("chrom"), "seq"))


@query("snp_hap_coverage", "select hap, cast(count(*) as bigint) as n_snps from (select unnest(['hap1', 'hap2', 'hap3']) as hap, unnest([hap1, hap2, hap3]) as base from snps) where base is not null group by hap", "snps")
def _(spark, d):
    return phasing.hap_coverage(load(spark, d, "snps"))


_PHASED = f"""{_HITS}, sc as (select read_name, aln_no, count(*) as checked, count(*) filter (base = hap1) as n1, count(*) filter (base = coalesce(hap2, hap1)) as n2, count(*) filter (base = coalesce(hap3, hap1)) as n3 from hits group by all),
  ph as (select read_name, aln_no, cast(coalesce(checked, 0) as bigint) as checked, case when checked is null then 'no_snp' when greatest(n1, n2, n3) = 0 then 'no_match'
    when (n1 = greatest(n1, n2, n3))::int + (n2 = greatest(n1, n2, n3))::int + (n3 = greatest(n1, n2, n3))::int > 1 then 'tie' when n1 = greatest(n1, n2, n3) then 'hap1' when n2 = greatest(n1, n2, n3) then 'hap2' else 'hap3' end as outcome
    from (select read_name, aln_no from aln where not is_secondary and not is_unmapped) left join sc using (read_name, aln_no))"""


def _phased(spark, d):
    alns = load(spark, d, "aln").filter("not is_secondary and not is_unmapped").select("read_name", "aln_no", "chrom", "ref_start", "ref_end", F.expr("read_len div 100").alias("step"))
    base = lambda pos: F.substr(F.lit("ACGT"), ((F.col("step") + (pos - 250) * 3 % 7) % 4).cast("int") + 1, F.lit(1))
    return phasing.phase_spans(alns, load(spark, d, "snps"), base, ["read_name", "aln_no"])


@query("phase_reads", f", {_PHASED} select * from ph", "aln snps")
def _(spark, d):
    return _phased(spark, d)


@query("phase_stats", f", {_PHASED} select outcome, cast(count(*) as bigint) as n_reads from ph group by outcome", "aln snps")
def _(spark, d):
    return phasing.phase_stats(_phased(spark, d))


@query("pileup_polish", f""", {_HITS}, c as (select chrom as region_id, pos, max(hap1) as ref_base, count(*) as total, count(*) filter (base = 'A') as a, count(*) filter (base = 'C') as c, count(*) filter (base = 'G') as g, count(*) filter (base = 'T') as t from hits group by chrom, pos)
select region_id, pos, case when total >= 3 and greatest(a, c, g, t) / total >= 0.6 then case greatest(a, c, g, t) when a then 'A' when c then 'C' when g then 'G' else 'T' end else ref_base end as base from c""", "aln snps")
def _(spark, d):
    return sequence.pileup_polish(_hits(spark, d).select(F.col("chrom").alias("region_id"), "pos", F.col("hap1").alias("ref_base"), "base"))


# --- state and overlaps --------------------------------------------------------------------------------------

_LATEST = "l as (select gap_id, arg_max(status, (ts, seq_no)) as status from status_log group by gap_id)"


@query("status_latest", f", {_LATEST} select * from l", "status_log")
def _(spark, d):
    return state.latest(load(spark, d, "status_log"))


@query("status_summary", f", {_LATEST} select status, cast(count(*) as bigint) as n_gaps from l group by status", "status_log")
def _(spark, d):
    return state.summary(load(spark, d, "status_log"))


@query("status_history", "select gap_id, string_agg(status, ',' order by ts, seq_no) as statuses from status_log group by gap_id", "status_log")
def _(spark, d):
    return state.history(load(spark, d, "status_log")).select("gap_id", F.array_join("statuses", ",").alias("statuses"))


_RESULTS = "select o_orderkey as gap_id, o_orderkey % 2 = 0 as success, o_orderkey % 3 = 0 as complete, o_orderkey % 5 > 0 as validated, case when o_custkey % 2 = 0 then 'unfillable' else 'needs_polish' end as triage from orders"


@query("round_transition", f""", {_LATEST}, r as ({_RESULTS}), w as (select gap_id, case when success and validated and complete then 'filled_complete' when success and validated then 'filled_partial'
  when not success and triage = 'unfillable' then 'unfillable' else 'failed' end as new from r) select gap_id, coalesce(new, status) as status from l full join w using (gap_id)""", "status_log")
def _(spark, d):
    results = spark.sql(_RESULTS.replace("from orders", "from {o}"), o=spark.read.parquet(f"{d}/orders.parquet"))
    return state.after_round(state.latest(load(spark, d, "status_log")), results)


@query("trim_flanks", """, g as (select gap_id, max(qend) filter (tend >= tlen - 100 and qstart < 200) as l, min(qstart) filter (tstart < 100 and qend > qlen - 200) as r, max(qlen) as q
  from paf where matches / greatest(block_len, 1) >= 0.9 and strand = '+' group by gap_id)
select gap_id, case when l > 0 and l < q - 100 then l end as left_trim, case when r > 100 and r < q then r end as right_trim from g""", "paf")
def _(spark, d):
    return overlaps.trim_points(load(spark, d, "paf"))


@query("overlap_merge", """select gap_id, min(line_no) as line_no, arg_min(qend, line_no) as qend from paf
where matches / greatest(block_len, 1) >= 0.9 and block_len >= 100 and tend >= tlen - 100 and strand = '+' group by gap_id""", "paf")
def _(spark, d):
    return overlaps.merge_points(load(spark, d, "paf"))


_CLUSTER_READS = "select o_orderkey % 97 as gap_id, o_orderkey as read_no from orders"
_CLUSTER_EDGES = "select o_orderkey % 97 as gap_id, o_orderkey as query_no, o_orderkey + 97 * (1 + o_orderkey % 3) as target_no, 850 + o_orderkey * 7 % 90 as matches, 1000 as block_len from orders"


@query("cluster_reads", f"""with recursive rd as ({_CLUSTER_READS}), e as (select * from ({_CLUSTER_EDGES}) where matches / block_len >= 0.9 and target_no in (select read_no from rd)),
  u as (select gap_id, query_no as a, target_no as b from e union select gap_id, target_no, query_no from e), reach as (select gap_id, read_no as a, read_no as b from rd union select r.gap_id, r.a, u.b from reach r join u on r.gap_id = u.gap_id and r.b = u.a),
  s as (select gap_id, count(*) as n, min(read_no) as m from rd group by gap_id)
select gap_id, a as read_no, case when any_value(n) <= 3 then any_value(m) else min(b) end as cluster from reach join s using (gap_id) group by gap_id, a""")
def _(spark, d):
    from lacuna.plans.rounds import shared_checkpoint

    orders = spark.read.parquet(f"{d}/orders.parquet")
    found = spark.sql(_CLUSTER_READS.replace("from orders", "from {o}"), o=orders)
    rows = spark.sql(_CLUSTER_EDGES.replace("from orders", "from {o}"), o=orders)
    real = rows.join(found.select("gap_id", F.col("read_no").alias("target_no")), ["gap_id", "target_no"], "left_semi")
    return overlaps.clusters(found, real, shared_checkpoint)


_CANDIDATES = """select o_custkey % 200 as gap_id, cast(o_orderkey % 7 as int) as tier, concat('s', o_orderkey) as source, case o_orderkey % 3 when 0 then 'failed' when 1 then 'passed' else 'not_evaluated' end as validation_state, concat('ACGT', o_orderkey) as seq from orders"""


@query("accepted_fill", f"with c as ({_CANDIDATES}), k as (select *, row_number() over (partition by gap_id order by tier, source, seq) as n from c where validation_state in ('passed', 'not_evaluated')) select gap_id, tier, source, seq, validation_state from k where n = 1")
def _(spark, d):
    return overlaps.accepted(spark.sql(_CANDIDATES.replace("from orders", "from {o}"), o=spark.read.parquet(f"{d}/orders.parquet")))


# --- kernels: no SQL twin ------------------------------------------------------------------------------------


def _pieces(spark, d, size: int = 300, step: int = 150, least: int = 300):
    """Every contig of `least` bases, without N, as pieces up to its end: (gap_id, read_no, seq)."""
    plain = load(spark, d, "contigs").select("chrom", F.translate("seq", "N", "A").alias("seq")).filter(F.length("seq") >= least)
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(step)))
    return plain.withColumn("at", at).select(F.col("chrom").alias("gap_id"), F.col("at").cast("bigint").alias("read_no"), F.substring(F.col("seq").cast("binary"), F.col("at") + 1, F.lit(size)).cast("string").alias("seq"))


@query("assemble_gap")
def _(spark, d):
    """Every contig from its pieces; those of fewer than 3 pieces have no sequence."""
    pieces = _pieces(spark, d, least=1)
    counts = pieces.groupBy("gap_id").agg(F.count(F.lit(1)).alias("n_reads"))
    return counts.join(assembly.assemble(pieces, settled).select("gap_id", "seq"), "gap_id", "left")


@query("poa_consensus")
def _(spark, d):
    """Reads of a place: a piece of a contig as it is, without its 11th base, and with its 21st changed."""
    seq = F.col("seq")
    forms = F.array(seq, F.concat(F.substring(seq, 1, 10), F.expr("substring(seq, 12)")), F.concat(F.substring(seq, 1, 20), F.lit("A"), F.expr("substring(seq, 22)")))
    reads_ = _pieces(spark, d, 300, 300, 1).select(F.concat_ws(":", "gap_id", "read_no").alias("gap_id"), F.posexplode(forms)).select("gap_id", F.col("pos").cast("bigint").alias("read_no"), F.col("col").alias("seq"))
    return kernels.poa_consensus(reads_)


@query("align_reads")
def _(spark, d):
    contigs = load(spark, d, "contigs").select("chrom", "ord", F.translate("seq", "N", "A").alias("seq"))
    reads_ = _pieces(spark, d, 300, 300, 1).select(F.concat_ws(":", "gap_id", "read_no").alias("read_name"), "seq")
    out = align.align_reads(reads_, gaps.contig_blocks(contigs))
    return out.withColumn("cigar", F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), F.element_at(F.split(F.lit("M,I,D,N,S"), ","), x["op"] + 1))), ""))


# --- alignment, consensus, assembly and haplotypes of random sequence, whose results are known -----------------

#: A contig for each document: the hexadecimal MD5 of its id and a number, for every 32 characters, as bases.
_GENOME = """genome as (select concat('g', doc_id) as chrom, translate({join}, '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from {documents})"""
_DUCK_GENOME = "with " + _GENOME.format(join="array_to_string(list_transform(range(0, coalesce(length(text), 0) // 32 + 1), lambda k: md5(concat(doc_id, ':', k))), '')", documents="documents")
_TURN = ("ACGT", "CATG")


def _genome(spark, d):
    join = "array_join(transform(sequence(0, coalesce(length(text), 0) div 32), k -> md5(concat(doc_id, ':', k))), '')"
    return spark.sql("with " + _GENOME.format(join=join, documents="{documents}") + " select chrom, cast(substring(chrom, 2) as bigint) as ord, seq from genome", documents=spark.read.parquet(f"{d}/documents.parquet"))


def _cut(contigs, size, step, least):
    """Pieces (chrom, at, s) of `size` bases at each `step`, those at the end being shorter down to `least`."""
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(step)))
    return contigs.withColumn("at", at).select("chrom", "at", F.expr(f"substring(seq, at + 1, {size})").alias("s")).filter(F.length("s") >= least)


@query("align_edit_cost", _DUCK_GENOME + """, places as (select chrom, unnest(range(0, length(seq) - 299, 300)) as b, seq from genome where length(seq) >= 300)
select concat(chrom, ':', b) as read_name, chrom, case when b % 600 = 0 then '+' else '-' end as strand, b as ref_start, b + 300 as ref_end, cast(1 as int) as nm, '300M' as cigar, concat('150', substr(seq, b + 151, 1), '149') as md,
  cast(0 as int) as lclip, cast(0 as int) as rclip from places""")
def _(spark, d):
    """Reads that differ from their contig in one base, every other one turned round: where they lie and what it costs."""
    contigs = _genome(spark, d)
    changed = F.concat(F.substring("s", 1, 150), F.translate(F.substring("s", 151, 1), *_TURN), F.expr("substring(s, 152)"))
    turned = F.when(F.col("at") % 600 == 0, changed).otherwise(F.reverse(F.translate(changed, "ACGT", "TGCA")))
    out = align.align_reads(_cut(contigs, 300, 300, 300).select(F.concat_ws(":", "chrom", "at").alias("read_name"), turned.alias("seq")), gaps.contig_blocks(contigs))
    text = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), F.element_at(F.split(F.lit("M,I,D,N,S"), ","), x["op"] + 1))), "")
    return out.select("read_name", "chrom", "strand", "ref_start", "ref_end", "nm", text.alias("cigar"), "md", "lclip", "rclip")


@query("poa_planted", _DUCK_GENOME + """, places as (select chrom, unnest(range(0, length(seq) - 299, 300)) as b, seq from genome where length(seq) >= 300)
select concat(chrom, ':', b) as gap_id, cast(4 as bigint) as n_reads, substr(seq, b + 1, 300) as seq from places""")
def _(spark, d):
    """Four reads of each place, one without a base, one with a base more, one with a base changed."""
    s = F.col("s")
    forms = F.array(s, F.concat(F.substring(s, 1, 100), F.expr("substring(s, 102)")), F.concat(F.substring(s, 1, 200), F.translate(F.substring(s, 201, 1), *_TURN), F.expr("substring(s, 201)")), F.concat(F.substring(s, 1, 150), F.translate(F.substring(s, 151, 1), *_TURN), F.expr("substring(s, 152)")))
    rows = _cut(_genome(spark, d), 300, 300, 300).select(F.concat_ws(":", "chrom", "at").alias("gap_id"), F.posexplode(forms))
    return kernels.poa_consensus(rows.select("gap_id", F.col("pos").cast("bigint").alias("read_no"), F.col("col").alias("seq")), 100)


@query("assemble_planted", _DUCK_GENOME + "select chrom as gap_id, cast(ceil(length(seq) / 150.0) as bigint) as n_reads, seq from genome where length(seq) > 300")
def _(spark, d):
    """Every contig from pieces that overlap by half."""
    rows = _cut(_genome(spark, d), 300, 150, 1)
    return assembly.assemble(rows.select(F.col("chrom").alias("gap_id"), F.col("at").cast("bigint").alias("read_no"), F.col("s").alias("seq")), settled)


@query("polish_planted", _DUCK_GENOME + "select chrom as draft_id, cast(3 as bigint) as n_alignments, seq as polished from genome where length(seq) >= 300")
def _(spark, d):
    """Drafts with a base changed and one left out in every 1000, by three whole reads."""
    contigs = _genome(spark, d).filter("length(seq) >= 300")
    spoilt = F.concat(F.substring("s", 1, 120), F.translate(F.substring("s", 121, 1), *_TURN), F.expr("substring(s, 122, 78)"), F.expr("substring(s, 201)"))
    drafts = _cut(contigs, 1000, 1000, 1).withColumn("s", F.when(F.length("s") >= 300, F.regexp_replace(spoilt, "^(.{220}).", "$1")).otherwise(F.col("s")))
    whole = drafts.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("x")).select(F.col("chrom").alias("draft_id"), F.array_join(F.transform("x", lambda x: x["s"]), "").alias("seq"))
    given = contigs.select("chrom", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), "seq").withColumn("read_name", F.concat_ws("/", "chrom", "k"))
    return kernels.polish(whole, given.select("read_name", "seq"), given.select(F.col("chrom").alias("draft_id"), "read_name"))


@query("snp_from_assemblies", _DUCK_GENOME + """, long as (select * from genome where length(seq) >= 640),
  two as (select chrom, unnest(range(250, length(seq) - 50, 500)) as pos, seq from long), three as (select chrom, unnest(range(200, length(seq) - 50, 300)) as pos, seq from long),
  sites as (select chrom, pos, substr(seq, pos + 1, 1) as ref_base, bool_or(h = 2) as two, bool_or(h = 3) as three from (select *, 2 as h from two union all select *, 3 as h from three) group by chrom, pos, seq)
select chrom, pos, ref_base, concat('hap1=', ref_base, ',hap2=', case when two then translate(ref_base, 'ACGT', 'CATG') else ref_base end, ',hap3=', case when three then translate(ref_base, 'ACGT', 'CATG') else ref_base end) as bases from sites""")
def _(spark, d):
    """Two haplotypes against a first one: one with 7 bases more in each contig, one whose contigs are turned round."""
    from lacuna.operators import haplotypes

    first = _genome(spark, d).filter("length(seq) >= 640")
    sized = first.withColumn("n", F.explode(F.array(F.length("seq"))))  # a length takes a look at the whole text: not again for each base

    def varied(start, step):
        turn = lambda c, k: F.when((k >= start) & (k < F.col("n") - 50) & ((k - start) % step == 0), F.translate(c, *_TURN)).otherwise(c)
        return F.array_join(F.transform(F.split("seq", "(?!$)"), turn), "")

    two, three = (sized.withColumn("seq", varied(*x)).drop("n") for x in ((250, 500), (200, 300)))
    longer = two.withColumn("seq", F.concat(F.substring("seq", 1, 100), F.lit("ACGTTCA"), F.expr("substring(seq, 101)")))
    turned = three.withColumn("seq", F.reverse(F.translate("seq", "ACGT", "TGCA")))
    out = haplotypes.snps_from_assemblies(first, {"hap2": longer, "hap3": turned})
    return out.withColumn("bases", F.array_join(F.transform(F.array_sort(F.map_entries("bases")), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


@query("fill_round")
def _(spark, d):
    """Every contig that has 20 bases on both sides of the 100 in its middle, which are taken out and filled again from pieces around them."""
    from lacuna.plans.rounds import spanning_fills

    plain = load(spark, d, "contigs").select("chrom", "ord", F.translate("seq", "N", "A").alias("seq")).filter("length(seq) >= 140").withColumn("mid", F.expr("length(seq) div 2"))
    broken = plain.select("chrom", "ord", F.concat(F.expr("substring(seq, 1, mid - 50)"), F.lit("N" * 100), F.expr("substring(seq, mid + 51)")).alias("seq"))
    at = F.explode(F.sequence(F.lit(-400), F.lit(100), F.lit(50)))
    pieces = plain.withColumn("at", at).select(F.concat_ws(":", "chrom", "at").alias("read_name"), F.expr("substring(seq, greatest(mid + at, 0) + 1, 300)").alias("seq"))
    return spanning_fills(broken, pieces)


# --- further summaries ---------------------------------------------------------------------------------------


@query("snp_two_pass", f""", {_HITS}, q as (select chrom, pos, hap1 as ref_base, concat('hap', cast(aln_no % 3 as int) + 1) as hap, base, concat(read_name, '/', aln_no) as place from hits),
  f as (select chrom, pos, hap, arg_min(ref_base, place) as ref_base, arg_min(base, place) as base, bool_or(base <> ref_base) as differs from q group by chrom, pos, hap)
select chrom, pos, max(ref_base) as ref_base, string_agg(concat(hap, '=', base), ',' order by hap) as bases from f group by chrom, pos having bool_or(differs)""", "aln snps")
def _(spark, d):
    pairs = _hits(spark, d).select("chrom", "pos", F.col("hap1").alias("ref_base"), F.concat(F.lit("hap"), F.col("aln_no") % 3 + 1).alias("hap"), "base", F.concat_ws("/", "read_name", "aln_no").alias("place"))
    out = phasing.snps_from_pairs(pairs)
    return out.withColumn("bases", F.array_join(F.transform(F.array_sort(F.map_entries("bases")), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


@query("assembled_n_runs", "select chrom, cast(len(regexp_extract_all(seq, 'N+')) as int) as n_runs, cast(len(regexp_extract_all(seq, 'N')) as int) as n_bases, not contains(seq, 'N') as is_usable from contigs", "contigs")
def _(spark, d):
    return overlaps.n_runs(load(spark, d, "contigs").select("chrom", "seq")).drop("seq")


@query("fill_totals", f"with c as ({_CANDIDATES.replace(chr(39) + 's' + chr(39) + ', o_orderkey', chr(39) + 's' + chr(39) + ', o_orderkey % 5')}) select source, cast(count(*) as bigint) as n_fills, cast(sum(length(seq)) as bigint) as total_bp from c group by source")
def _(spark, d):
    rows = spark.sql(_CANDIDATES.replace("'s', o_orderkey", "'s', o_orderkey % 5").replace("from orders", "from {o}"), o=spark.read.parquet(f"{d}/orders.parquet"))
    return overlaps.fill_totals(rows)


@query("merged_sequences", """, m as (select gap_id, arg_min(qend, line_no) as qend from paf where matches / greatest(block_len, 1) >= 0.9 and block_len >= 100 and tend >= tlen - 100 and strand = '+' and gap_id % 2 = 0 group by gap_id),
  s as (select distinct gap_id, repeat('AC', cast(gap_id as int) + 1) as l, repeat('GT', 1600) as r from paf)
select gap_id, case when qend is not null then concat(l, substr(r, qend + 1)) else concat(l, repeat('N', 500), r) end as seq, qend is not null as is_complete from s left join m using (gap_id)""", "paf")
def _(spark, d):
    paf = load(spark, d, "paf")
    sides = paf.select("gap_id").distinct().select("gap_id", F.expr("repeat('AC', cast(gap_id as int) + 1)").alias("left_seq"), F.expr("repeat('GT', 1600)").alias("right_seq"))
    return overlaps.merged_sequences(sides, overlaps.merge_points(paf.filter("gap_id % 2 = 0")))


# --- fills, outcomes and haplotypes --------------------------------------------------------------------------


def _from(spark, d, sql: str, table: str):
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=spark.read.parquet(f"{d}/{table}.parquet"))


@query("contig_lengths", "select chrom, ord, cast(length(seq) as bigint) as length from contigs", "contigs")
def _(spark, d):
    from lacuna.sources.files import contig_lengths

    return contig_lengths(load(spark, d, "contigs"))


@query("extract_reads", f""", x as (select gap_id as region_id, read_name, read_type, aln_no, read_len, row_number() over (partition by gap_id, read_name order by case read_type when 'hifi' then 0 else 1 end, aln_no) as k
  from {_NEAR} where not is_unmapped and not is_secondary and not is_supplementary and read_len >= 100 and ref_start < gap_end and ref_end > gap_start)
select region_id, read_name, read_type, aln_no, read_len from x where k = 1""", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    return reads.extracted_reads(aln, _gap_regions(found))


@query("reads_of_kept_names", """select read_name, aln_no from aln where read_name in (select read_name from aln a where not is_secondary and (not (mapq >= 20 and lclip < 100 and rclip < 100)
  or exists (select 1 from gaps g where g.chrom = a.chrom and greatest(gap_start - ref_end, ref_start - gap_end, 0) <= 1000)))""", "gaps aln")
def _(spark, d):
    aln, found = _aln_gaps(spark, d)
    return reads.of_kept_names(aln, reads.kept_names(aln, found)).select("read_name", "aln_no")


@query("snps_outside_gaps", "select chrom, pos, hap1 from snps s where not exists (select 1 from gaps g where g.chrom = s.chrom and gap_start <= pos and pos < gap_end)", "snps gaps")
def _(spark, d):
    return phasing.outside_gaps(load(spark, d, "snps"), load(spark, d, "gaps")).select("chrom", "pos", "hap1")


_SPLIT = f"""{_PHASED}, sp as (select *, outcome not in ('hap1', 'hap2', 'hap3') as is_ambiguous, unnest(case when outcome in ('hap1', 'hap2', 'hap3') then [outcome] else ['hap1', 'hap2', 'hap3'] end) as hap from ph)"""


@query("phased_reads", f", {_SPLIT} select read_name, aln_no, hap, is_ambiguous from sp", "aln snps")
def _(spark, d):
    return phasing.phased_reads(_phased(spark, d)).select("read_name", "aln_no", "hap", "is_ambiguous")


@query("merge_phased_reads", f", {_SPLIT} select concat(hap, '__', read_name) as read_name, hap, aln_no, is_ambiguous from sp", "aln snps")
def _(spark, d):
    return phasing.merged_phased(phasing.phased_reads(_phased(spark, d)))


@query("snp_export", """select chrom, concat('{', string_agg(concat('"', pos, '":{"hap1":"', hap1, '","hap2":"', hap2, '"', case when hap3 is null then '' else concat(',"hap3":"', hap3, '"') end, '}'), ',' order by pos), '}') as value from snps group by chrom""", "snps")
def _(spark, d):
    return phasing.exported_snps(load(spark, d, "snps"))


@query("snp_import", "select chrom, pos, hap1, hap2, hap3 from snps", "snps")
def _(spark, d):
    return phasing.imported_snps(phasing.exported_snps(load(spark, d, "snps")))


@query("status_by_haplotype", ", l as (select concat('hap', seq_no % 3 + 1) as hap, * from status_log) select hap, gap_id, arg_max(status, (ts, seq_no)) as status from l group by hap, gap_id", "status_log")
def _(spark, d):
    return state.latest_by_haplotype(load(spark, d, "status_log").withColumn("hap", F.concat(F.lit("hap"), F.col("seq_no") % 3 + 1)))


@query("haplotype_summary", f""", h as ({_HAP_GAPS}), m as (select *, exists (select 1 from h o where o.chrom = h.chrom and o.hap <> h.hap and abs(o.gap_start - h.gap_start) <= 1000) as is_shared from h)
select hap, cast(count(*) as bigint) as total_gaps, cast(count(*) filter (not is_shared) as bigint) as haplotype_specific_gaps from m group by hap""", "gaps")
def _(spark, d):
    return fills.haplotype_summary(gaps.shared_or_specific(_hap_gaps(spark, d)))


@query("cluster_sizes", "with c as (select o_custkey % 50 as gap_id, o_orderkey % 7 as cluster, count(*) as n from orders group by 1, 2) select gap_id, cluster, cast(n as bigint) as n_reads, cast(row_number() over (partition by gap_id order by n desc, cluster) as int) as place from c")
def _(spark, d):
    return overlaps.clusters_by_size(_from(spark, d, "select o_custkey % 50 as gap_id, o_orderkey % 7 as cluster from orders", "orders"))


_RUN_RESULTS = "select o_custkey as gap_id, o_orderkey % 4 as iteration, o_orderkey % 3 > 0 as success, o_orderkey % 2 = 0 as is_complete, o_orderkey % 900 as fill_length from (select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey, o_orderkey % 4) x"


@query("iteration_stats", f"with r as ({_RUN_RESULTS}) select iteration, cast(count(*) as bigint) as gaps_processed, cast(count(*) filter (success) as bigint) as gaps_filled, cast(count(*) filter (not success) as bigint) as gaps_failed, cast(coalesce(sum(fill_length) filter (success), 0) as bigint) as total_bp_filled from r group by iteration")
def _(spark, d):
    return fills.iteration_stats(_from(spark, d, _RUN_RESULTS, "orders"))


@query("final_stats", f"""with r as ({_RUN_RESULTS}), l as (select *, row_number() over (partition by gap_id order by iteration desc) as k from r)
select cast((select count(distinct iteration) from r) as bigint) as iterations, cast(count(*) as bigint) as total_gaps_initial, cast(count(*) filter (success and is_complete) as bigint) as gaps_completely_filled,
  cast(count(*) filter (success and not is_complete) as bigint) as gaps_partially_filled, cast(count(*) filter (not success) as bigint) as gaps_failed from l where k = 1""")
def _(spark, d):
    return fills.final_stats(_from(spark, d, _RUN_RESULTS, "orders"))


_SIDES_OF = "select o_custkey % 200 as gap_id, case when o_orderkey % 2 = 0 then 'left' else 'right' end as side, o_orderkey % 5 as cluster, o_orderkey % 9 as n_reads, repeat('ACGT', cast(o_orderkey % 700 as int)) as seq from orders"


@query("flanking_fill", f""", a as ({_SIDES_OF}), b as (select gap_id, side, arg_max(seq, length(seq) * 10 - cluster) as seq from a where n_reads >= 3 and seq <> '' group by gap_id, side),
  s as (select gap_id, max(seq) filter (side = 'left') as l, max(seq) filter (side = 'right') as r from b group by gap_id),
  g as (select gap_id, max(qend) filter (tend >= tlen - 100 and qstart < 200) as l, min(qstart) filter (tstart < 100 and qend > qlen - 200) as r, max(qlen) as q from paf where matches / greatest(block_len, 1) >= 0.9 and strand = '+' group by gap_id),
  t as (select gap_id, case when l > 0 and l < q - 100 then l end as lt, case when r > 100 and r < q then r end as rt from g),
  c as (select s.gap_id, coalesce(substr(l, coalesce(lt, 0) + 1), '') as l, coalesce(case when rt is null then r else substr(r, 1, rt) end, '') as r from s left join t using (gap_id)),
  m as (select gap_id, arg_min(qend, line_no) as qend from paf where matches / greatest(block_len, 1) >= 0.9 and block_len >= 100 and tend >= tlen - 100 and strand = '+' and gap_id % 3 = 0 group by gap_id),
  f as (select c.gap_id, l, r, case when l <> '' and r <> '' then qend end as qend from c left join m using (gap_id) where l <> '' or r <> '')
select gap_id, case when qend is not null then concat(l, substr(r, qend + 1)) else concat(l, repeat('N', 500), r) end as seq, qend is not null as is_complete, qend is null as has_placeholder, case when qend is not null then 'flanking_merged' else 'flanking' end as strategy from f""", "paf")
def _(spark, d):
    paf = load(spark, d, "paf")
    return fills.flanking_fill(fills.best_sides(_from(spark, d, _SIDES_OF, "orders")), overlaps.trim_points(paf), overlaps.merge_points(paf.filter("gap_id % 3 = 0")))


_PRESETS = "select o_custkey % 300 as gap_id, case when o_orderkey % 2 = 0 then 'hifi' else 'ont' end as preset, repeat('ACGT', cast(o_orderkey % 50 as int)) as seq from orders"


@query("longer_assembly", f"with a as ({_PRESETS}), k as (select *, row_number() over (partition by gap_id order by length(seq) desc, preset) as n from a where seq <> '') select gap_id, preset, seq from k where n = 1")
def _(spark, d):
    return fills.longer_assembly(_from(spark, d, _PRESETS, "orders"))


_TIERED = """select concat(chrom, '_', gap_start, '_', gap_end) as gap_id, case k when 0 then '0' when 1 then '0b' when 2 then '1' when 3 then '4' else '6' end as tier, concat('s', k) as source,
  case gap_start / 500 % (k + 2) when 0 then 'failed' when 1 then 'passed' else 'not_evaluated' end as validation_state, repeat('ACGT', cast(k + 1 as int)) as seq
from (select distinct concat('chr', l_suppkey % 5) as chrom, cast(l_partkey * 500 as bigint) as gap_start, cast(l_partkey * 500 + 500 as bigint) as gap_end, l_linenumber % 5 as k from lineitem where l_partkey % 20 = 0) g"""
_TIERED_SPARK = _TIERED.replace("gap_start / 500", "gap_start div 500")
_TIERS = """t as (select gap_id, unnest(list_filter([case when hifi_spanning >= 3 then '0' end, case when ont_spanning >= 5 then '0b' end, case when hifi_spanning >= 3 then '1' end, case when ont_spanning >= 3 then '2' end,
  case when hifi_spanning + ont_spanning >= 3 then '3' end, case when hifi_left + hifi_right > 0 then '4' end, case when ont_left + ont_right > 0 then '5' end, case when hifi_left + hifi_right + ont_left + ont_right > 0 then '6' end], lambda x: x is not null)) as tier from counts)"""
_CASCADE = f"""{_BUNDLE}, {_TIERS}, cand as ({_TIERED.replace('gap_start / 500', 'gap_start // 500')}),
  acc as (select * exclude (n) from (select *, row_number() over (partition by gap_id order by tier, source, seq) as n from cand semi join t using (gap_id, tier) where validation_state in ('passed', 'not_evaluated')) where n = 1)"""


def _accepted(spark, d):
    counts = reads.bundle_counts(*_aln_gaps(spark, d))
    return counts, fills.cascade(overlaps.tier_choice(counts), _from(spark, d, _TIERED_SPARK, "lineitem"))


@query("tier_cascade", f", {_CASCADE} select gap_id, tier, source, seq, validation_state from acc", "gaps aln")
def _(spark, d):
    return _accepted(spark, d)[1].select("gap_id", "tier", "source", "seq", "validation_state")


@query("fill_result", f""", {_CASCADE}, {_TRIAGE} select counts.gap_id, seq is not null as success, tier, source, cast(length(seq) as bigint) as fill_length,
  case when validation_state = 'passed' then 'validated' when seq is not null then 'not_evaluated' when bad then 'needs_polish' else 'unfillable' end as status,
  hifi_spanning, ont_spanning, hifi_left + hifi_right as hifi_flanking, ont_left + ont_right as ont_flanking from counts left join acc using (gap_id) left join bad using (gap_id)""", "gaps aln")
def _(spark, d):
    counts, accepted = _accepted(spark, d)
    return fills.outcomes(counts, accepted, validation.triage(*_aln_gaps(spark, d)))


_LOCAL = "select concat('chr', k) as fill_id, cast(5000 * (k + 1) as bigint) as left_length, concat(repeat('ACGT', cast(100 * (k + 1) as int)), repeat('N', cast(6 * k as int)), repeat('ACGT', 200)) as fill, k % 2 = 0 as is_complete from (select distinct n_nationkey % 7 as k from nation) x"
_LOCAL_REGIONS = "select fill_id as region_id, fill_id as chrom, left_length as r_start, left_length + length(fill) as r_end from lf where is_complete or not regexp_matches(fill, 'N{10,}')"
_LOCAL_SIDES = """select concat(fill_id, '/l') as region_id, fill_id as chrom, left_length as r_start, left_length + strpos(fill, 'NNNNNNNNNN') - 1 as r_end from lp
  union all select concat(fill_id, '/r'), fill_id, left_length + strpos(fill, 'NNNNNNNNNN') - 1 + length(regexp_extract(fill, 'N{10,}')), left_length + length(fill) from lp"""


@query("local_validation", f""", lf as ({_LOCAL}), lp as (select * from lf where not is_complete and regexp_matches(fill, 'N{{10,}}')), {_region_sql(_LOCAL_REGIONS + " union all " + _LOCAL_SIDES)},
  jw as (select region_id, chrom, case when ends_with(region_id, '/l') then r_start else r_end end as pos from regs where contains(region_id, '/')),
  jc as (select region_id, coalesce(sum(case when ref_start is not null then least(ref_end, pos + 50) - greatest(ref_start, greatest(pos - 50, 0)) end), 0) / any_value(pos + 50 - greatest(pos - 50, 0)) as j
    from jw left join prim p on p.chrom = jw.chrom and ref_start < pos + 50 and ref_end > greatest(pos - 50, 0) group by region_id),
  v as (select region_id as fill_id, 'complete' as mode, spanning_reads >= case when fill_length < 1000 then 1 else 2 end and avg_coverage >= 2 as valid from rs where not contains(region_id, '/')
    union all select split_part(region_id, '/', 1), 'partial', bool_or(j >= 5 and avg_coverage >= 5 and zero_coverage_ratio <= 0.05) from rs join jc using (region_id) group by 1)
select fill_id, mode, case when fill_id in (select chrom from aln) then valid end as valid,
  case when fill_id not in (select chrom from aln) then 'not_evaluated' when not valid then 'failed' when mode = 'complete' then 'filled_complete' else 'filled_partial' end as status from v""", "gaps aln")
def _(spark, d):
    return fills.local_validation(load(spark, d, "aln"), _from(spark, d, _LOCAL, "nation"))


_FORMS = "rd as (select chrom as gap_id, 'hifi' as read_type, r as read_no, case when r = 4 then concat('A', substr(seq, 2)) when r = 5 then concat('T', substr(seq, 2)) else seq end as seq from contigs, (select unnest([1, 2, 3, 4, 5]) as r) x where r <= 3 + ord % 3)"
_FORM_PAIRS = _PAIRS.replace(_READS, _FORMS)
_VOTE = """vb as (select gap_id, read_no, unnest(range(1, length(seq) + 1)) as pos, unnest(string_split(seq, '')) as base from rd), vv as (select gap_id, pos, base, count(*) as n, min(read_no) as f from vb group by all),
  vw as (select gap_id, pos, base, row_number() over (partition by gap_id, pos order by n desc, f) as k from vv), vote as (select gap_id, string_agg(base, '' order by pos) as consensus from vw where k = 1 group by gap_id),
  bk as (select gap_id, seq as spine, n from (select *, row_number() over (partition by gap_id order by length(seq), read_no) as k, count(*) over (partition by gap_id) as n from rd) where k = n // 2 + 1)"""


def _forms(spark, d):
    form = F.when(F.col("read_no") == 4, F.concat(F.lit("A"), F.expr("substring(seq, 2)"))).when(F.col("read_no") == 5, F.concat(F.lit("T"), F.expr("substring(seq, 2)"))).otherwise(F.col("seq"))
    many = load(spark, d, "contigs").withColumn("read_no", F.explode(F.expr("sequence(1, cast(3 + ord % 3 as int))")))
    return many.select(F.col("chrom").alias("gap_id"), F.lit("hifi").alias("read_type"), F.col("read_no").cast("bigint").alias("read_no"), form.alias("seq"))


@query("direct_consensus", f", {_FORMS}, {_VOTE} select gap_id, cast(n as bigint) as n_reads, case when n <= 3 then spine else coalesce(consensus, spine) end as seq from bk left join vote using (gap_id)", "contigs")
def _(spark, d):
    return sequence.direct_consensus(_forms(spark, d).select("gap_id", "read_no", "seq"))


@query("consensus_fill", f""", {_FORM_PAIRS}, {_VOTE}, mi as (select gap_id, avg(identity) as identity from id group by gap_id)
select gap_id, 'direct_consensus' as source, case when n <= 3 then spine else coalesce(consensus, spine) end as seq, cast(n as bigint) as n_reads, round(cast(least(identity + 0.1, 1.0) as double), 6) as confidence, true as is_complete
from bk left join vote using (gap_id) join mi using (gap_id) where n >= 3 and identity >= 0.95""", "contigs")
def _(spark, d):
    return sequence.consensus_fill(_forms(spark, d)).withColumn("confidence", F.round("confidence", 6))


_POLISHED = "select o_custkey as gap_id, o_orderkey % 4 as n_alignments, repeat('T', cast(o_orderkey % 30 as int)) as polished from (select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey) x"


@query("polished_fill", f"""with f as (select c_custkey as gap_id, repeat('A', cast(c_custkey % 25 as int)) as seq from customer), p as ({_POLISHED}), j as (select *, coalesce(n_alignments >= 2 and length(polished) >= 0.8 * length(seq), false) as use from f left join p using (gap_id))
select gap_id, case when use then polished else seq end as seq, use as is_polished from j""")
def _(spark, d):
    found = _from(spark, d, "select c_custkey as gap_id, repeat('A', cast(c_custkey % 25 as int)) as seq from customer", "customer")
    return fills.polished_fill(found, _from(spark, d, _POLISHED, "orders"))


_POLISH_FLANKS = """pf as (select flank_id, gap_id, chrom, f_start, f_end, repeat('A', cast(f_end - f_start as int)) as seq from fl where f_end > f_start),
  hv as (select chrom, pos, case pos % 3 when 0 then 'A' when 1 then 'C' else 'T' end as base from snps), vt as (select flank_id, pos, base from hv join pf using (chrom) where pos >= f_start and pos < f_end),
  nr as (select flank_id, count(*) as n from prim p join pf on p.chrom = pf.chrom and ref_start < f_end and ref_end > f_start where read_len >= 500 group by flank_id),
  ps as (select pf.flank_id, string_agg(coalesce(base, 'A'), '' order by i) as s from (select flank_id, unnest(range(f_start, f_end)) as i from pf) pf left join vt on vt.flank_id = pf.flank_id and vt.pos = i group by pf.flank_id),
  pd as (select pf.flank_id, gap_id, cast(coalesce(n, 0) as bigint) as n_reads, case when coalesce(n, 0) >= 5 then s else seq end as seq, coalesce(n, 0) >= 5 and s <> seq as is_polished from pf left join nr using (flank_id) join ps using (flank_id))"""


def _polished_flanks(spark, d):
    aln, found = _aln_gaps(spark, d)
    flanks = validation.flanks_of(found).filter("f_end > f_start").withColumn("seq", F.expr("repeat('A', cast(f_end - f_start as int))"))
    sites = load(spark, d, "snps").select("chrom", "pos", F.expr("case pos % 3 when 0 then 'A' when 1 then 'C' else 'T' end").alias("base")).withColumn("p_end", F.col("pos") + 1)
    votes = intervals.overlap_join(sites, flanks.select("flank_id", "chrom", "f_start", "f_end"), ("pos", "p_end"), ("f_start", "f_end")).select("flank_id", "pos", "base")
    return fills.polish_flanks(aln, flanks.drop("gap_id"), votes).join(flanks.select("flank_id", "gap_id"), "flank_id")


@query("polish_flanks", f", {_PRIMARY}, {_FLANKS}, {_POLISH_FLANKS} select flank_id, n_reads, seq, is_polished from pd", "gaps aln snps")
def _(spark, d):
    return _polished_flanks(spark, d).select("flank_id", "n_reads", "seq", "is_polished")


@query("polish_counts", f", {_PRIMARY}, {_FLANKS}, {_POLISH_FLANKS}, pc as (select gap_id, bool_or(is_polished) as x from pd group by gap_id) select cast(count(*) as bigint) as n_gaps, cast(count(*) filter (x) as bigint) as n_polished from pc", "gaps aln snps")
def _(spark, d):
    return fills.polish_counts(_polished_flanks(spark, d))


@query("apply_polish", "select chrom, case when length(seq) >= 300 then concat(substr(seq, 1, 100), repeat('T', 50), repeat('G', 60), substr(seq, 211)) else seq end as seq from contigs", "contigs")
def _(spark, d):
    contigs = load(spark, d, "contigs").select("chrom", "seq")
    side = lambda start, end, base: F.struct(F.lit(start).cast("bigint").alias("f_start"), F.lit(end).cast("bigint").alias("f_end"), F.lit(base * (end - start)).alias("seq"))
    sides = F.array(side(100, 160, "T"), side(150, 210, "G"))
    return fills.apply_polish(contigs, contigs.filter("length(seq) >= 300").select("chrom", F.inline(sides)))
