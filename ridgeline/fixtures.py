"""Genome-like relations derived from the test tables by arithmetic, in SQL that Spark and DuckDB both run.

The same text defines a relation for the engine and for the oracle; table names are filled in by `format`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "lineitem", "part", "documents")

VIEWS = {
    "contigs": """select n_nationkey as contig_id,
  concat('chr', cast(n_nationkey as varchar(10)), case when n_nationkey%5=4 then '' when n_nationkey%2=0 then '_MATERNAL' else '_PATERNAL' end) as contig,
  cast(20000+4100*n_nationkey as bigint) as len, cast(n_nationkey as bigint) as ord from {nation}""",
    "reads_base": """select concat(cast(l_orderkey as varchar(20)),'-',cast(l_linenumber as varchar(20)),'-',cast(l_partkey as varchar(20)),'-',cast(l_suppkey as varchar(20)),'-',cast(cast(round(l_extendedprice*100) as bigint) as varchar(20)),'-',cast(cast(round(l_quantity) as bigint) as varchar(20))) as read_id,
  c.contig_id, c.contig, c.len,
  cast(l_orderkey*7919+l_linenumber*104729+l_suppkey*31+l_partkey*17 as bigint) as x,
  case when l_linenumber%3=0 then 'short' when l_linenumber%3=1 then 'hifi' else 'ont' end as platform,
  cast(round(l_quantity) as bigint) as q, cast(round(l_discount*100) as int) as d, cast(round(l_tax*100) as int) as t,
  l_returnflag as rf, l_linestatus as ls, l_suppkey as sk
  from {lineitem} join {contigs} c on l_partkey%25=c.contig_id""",
    "reads_pos": """select b.*, case when x%11=0 then 0 when contig_id%5=1 and x%4=0 then cast(floor(len/3) as bigint) else x%len end as start0 from {reads_base} b""",
    "reads_end": """select p.*, least(start0 + case when platform='short' then 150 when platform='hifi' then 200*q else 900*q end, len) as end0 from {reads_pos} p""",
    "reads_kept": """select e.*, end0-start0 as span, case when platform='short' or end0-start0<400 then 0 when d=10 then 80 when d=9 and end0-start0>6000 then 2500 when d=9 then 20 else 0 end as dl,
  case when platform='short' or end0-start0<400 then 0 when t>=6 then 60 when t=5 then 10 else 0 end as il
  from {reads_end} e where not (contig_id%5=0 and start0 < floor(len/2)+4000 and end0 > floor(len/2))""",
    "reads": """select read_id, platform, contig_id, contig, len as contig_len, start0, end0,
  case when x%29=0 then 4 when sk%17=0 then 2048 when sk%13=0 then 256 else 0 end as flag, d*6 as mapq,
  concat(case when rf='R' then '25S' else '' end, case when dl+il=0 then concat(cast(span as varchar(20)),'M') else concat(
  cast(cast(floor(span/3) as bigint) as varchar(20)),'M', case when il>0 then concat(cast(il as varchar(20)),'I',cast(50 as varchar(20)),'M') else '' end,
  case when dl>0 then concat(cast(dl as varchar(20)),'D') else '' end,
  cast(span-cast(floor(span/3) as bigint)-dl-(case when il>0 then 50 else 0 end) as varchar(20)),'M') end,
  case when ls='O' and d>=5 then '30S' else '' end) as cigar,
  case when d<5 then 0 else d-4 end as nm,
  case when q%9>2 then repeat('ctgX,1,+,10M,60,0;', cast(q%9-2 as int)) else null end as sa,
  span - dl + il + (case when rf='R' then 25 else 0 end) + (case when ls='O' and d>=5 then 30 else 0 end) as seq_len,
  case when d<5 then null else start0 + (x*13)%span end as mm0
  from {reads_kept} h""",
    "mask": """select c.contig, cast((p_partkey*9973)%c.len as bigint) as start0, cast(least((p_partkey*9973)%c.len + p_size*20, c.len) as bigint) as end0 from {part} join {contigs} c on p_partkey%25=c.contig_id where p_partkey%20 in (0,7)""",
    "seqs": """select doc_id, concat('doc', cast(doc_id as varchar(20))) as contig, upper(regexp_replace(translate(lower(text),'bdefhijklmopqrsuvwxyz ','cgacgacgtacgtacgtacgtg'),'[^acgt]','n'{all})) as seq from {documents}""",
}
#: What a view is made of.
NEEDS = {
    "contigs": ["contigs"],
    "reads": ["contigs", "reads_base", "reads_pos", "reads_end", "reads_kept", "reads"],
    "mask": ["contigs", "mask"],
    "seqs": ["seqs"],
}


def with_clause(*views: str) -> str:
    """'WITH ...' that defines the views for DuckDB."""
    order = [v for v in VIEWS if any(v in NEEDS[w] for w in views)]
    names = {n: n for n in [*TABLES, *VIEWS]}
    return "WITH " + ",\n".join(f"{v} AS (\n{VIEWS[v].format(**names, all=", 'g'")}\n)" for v in order)


def oracle(sql: str, *views: str) -> str:
    """A whole DuckDB query over the views. `sql` may go on with further named relations: ', x AS (...) SELECT ...'."""
    return with_clause(*views) + sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables in sf_dir, lazily.

    The reads' places are kept in memory on the way: as one expression the nested cases of a read are too long to compile.
    """
    made: dict[str, DataFrame] = {}
    for v in [v for v in VIEWS if v in NEEDS[name]]:
        used = [n for n in [*TABLES, *made] if "{" + n + "}" in VIEWS[v]]
        inputs = {n: made[n] if n in made else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used}
        made[v] = spark.sql(VIEWS[v].replace("{all}", ""), **inputs)
        if v == "reads_end":
            made[v] = made[v].persist()
    return made[name]
