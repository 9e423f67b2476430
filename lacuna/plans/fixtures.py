"""Alignment-like tables derived from the driver's parquet tables.

Each text runs in Spark SQL and, but for the flag of regexp_replace in `contigs`, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "contigs": """
select concat('ctg', doc_id) as chrom, doc_id as ord,
       regexp_replace(translate(text,
         'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'ACGTNACGTNACGTNACGTNACGTNAACGTNACGTNACGTNACGTNACGTNA'), '[^ACGTN]', 'N') as seq
from documents""",
    "gaps": """
select concat(chrom, '_', gap_start, '_', gap_end) as gap_id, chrom, gap_start, gap_end
from (select distinct concat('chr', l_suppkey % 5) as chrom, cast(l_partkey * 500 as bigint) as gap_start, cast(l_partkey * 500 + 500 as bigint) as gap_end
      from lineitem where l_partkey % 20 = 0) g""",
    "aln": """
select concat('chr', l_suppkey % 5) as chrom,
       concat('r', l_orderkey) as read_name,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as int) as aln_no,
       case when l_returnflag = 'A' then 'ont' else 'hifi' end as read_type,
       cast(l_partkey * 500 + l_linenumber * 37 as bigint) as ref_start,
       cast(l_partkey * 500 + l_linenumber * 37 + l_quantity * 100 as bigint) as ref_end,
       cast(l_quantity * 100 as bigint) as read_len,
       cast(round(l_discount * 600) as int) as mapq,
       l_linenumber >= 7 as is_secondary,
       l_linenumber in (5, 6) as is_supplementary,
       cast(case when l_returnflag = 'R' then round(l_tax * 2500) else 0 end as int) as lclip,
       cast(case when l_linestatus = 'F' then round(l_tax * 2500) else 0 end as int) as rclip,
       concat(l_linenumber * 10, repeat('A5C5', cast(l_quantity as int) % 4), 'T9') as md, false as is_unmapped
from lineitem
union all
select distinct '*', concat('u', l_orderkey), cast(1 as int), 'hifi', cast(null as bigint), cast(null as bigint), cast(300 + l_orderkey % 500 as bigint), cast(0 as int),
       false, false, cast(0 as int), cast(0 as int), cast(null as varchar(9)), true
from lineitem where l_linenumber = 1 and l_orderkey % 40 = 0""",
    "snps": """
select concat('chr', p_partkey % 5) as chrom,
       cast(p_partkey * 500 + 250 as bigint) as pos,
       substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) as hap1,
       substr('ACGT', cast((p_partkey + 1 + p_size % 3) % 4 as int) + 1, 1) as hap2,
       case when p_size % 2 = 0 then substr('ACGT', cast((p_partkey + 2) % 4 as int) + 1, 1) end as hap3
from part""",
    "paf": """
select cast(o_custkey % 50 as bigint) as gap_id,
       cast(o_orderkey as bigint) as line_no,
       cast(3000 as bigint) as qlen,
       cast(o_orderkey % 400 as bigint) as qstart,
       cast(2500 + o_orderkey % 500 as bigint) as qend,
       case when o_orderstatus = 'F' then '-' else '+' end as strand,
       cast(2000 as bigint) as tlen,
       cast(o_custkey % 200 as bigint) as tstart,
       cast(1800 + o_custkey % 201 as bigint) as tend,
       cast(850 + o_orderkey % 150 as bigint) as matches,
       cast(1000 as bigint) as block_len
from orders""",
    "status_log": """
select user_id as gap_id, event_id as seq_no, ts,
       case event_type when 'view' then 'pending' when 'click' then 'failed' when 'error' then 'unfillable'
                       when 'signup' then 'filled_partial' else 'filled_complete' end as status
from events""",
}
SOURCES = {"contigs": "documents", "gaps": "lineitem", "aln": "lineitem", "snps": "part", "paf": "orders", "status_log": "events"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCES[name]
    return spark.sql(SQL[name].replace(f"from {source}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def duck(*names: str) -> str:
    """The fixtures as the beginning of a DuckDB query."""
    texts = {n: SQL[n].replace("'[^ACGTN]', 'N')", "'[^ACGTN]', 'N', 'g')") for n in names}
    return "with " + ", ".join(f"{n} as ({t})" for n, t in texts.items())
