"""Results as files. Row sinks are Spark writers; reports have a bounded number of rows and are rendered on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import PipelineConfig
from ridgeline.operators.structural import COUNTERS


def decimals(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def write_bed(rows: DataFrame, path: str) -> None:
    """contig, start and end, tab-separated, in the order given."""
    rows.select("contig", "start0", "end0").write.mode("overwrite").csv(path, sep="\t", header=False)


def write_bedgraph(runs: DataFrame, path: str) -> None:
    runs.select("contig", "start0", "end0", "depth").write.mode("overwrite").option("compression", "gzip").csv(path, sep="\t", header=False)


def write_reads(reads: DataFrame, path: str) -> None:
    """Filtered reads as Parquet by platform, sorted so that a range of a contig is found by the files' statistics."""
    reads.repartitionByRange("platform", "contig", "start0").sortWithinPartitions("platform", "contig", "start0").write.mode("overwrite").partitionBy("platform").parquet(path)


def write_by_contig(rows: DataFrame, path: str, header: bool = True) -> None:
    """One folder a contig."""
    rows.withColumn("_contig", F.col("contig")).write.mode("overwrite").partitionBy("_contig").csv(path, sep="\t", header=header)


def window_stats_rows(stats: DataFrame) -> DataFrame:
    """The rows of window_stats.tsv: starts from 1, depths with four decimals, - for clean reads inside contigs; by contig and start."""
    clean = F.when(F.col("is_terminal"), F.col("clean_reads").cast("string")).otherwise("-")
    names = dict(zip(COUNTERS, ["ClipCount", "Insertion", "Deletion", "ReadsWithInsertion", "ReadsWithDeletion", "ReadsWithClip", "TotalReads"], strict=False))
    return stats.orderBy("contig", "start0").select(
        F.col("contig").alias("Chromosome"), (F.col("start0") + 1).alias("Start"), F.col("end0").alias("End"), decimals(F.col("depth"), 4).alias("Depth"),
        *[F.col(k).alias(v) for k, v in names.items()], clean.alias("ReadsWithoutINDELorClip"), F.initcap(F.col("has_spanning").cast("string")).alias("HasSpanningReads"),
    )


def anomaly_rows(found: DataFrame) -> DataFrame:
    """The rows of anomalous_regions.tsv."""
    yes = lambda c: F.initcap(F.col(c).cast("string"))
    return found.orderBy("contig", "start0").select(
        F.col("contig").alias("Chromosome"), (F.col("start0") + 1).alias("Start"), F.col("end0").alias("End"), yes("is_terminal").alias("IsTerminal"), decimals(F.col("depth"), 4).alias("Depth"),
        F.col("clip_count").alias("ClipCount"), F.col("insertion").alias("InsertionCount"), F.col("deletion").alias("DeletionCount"), F.col("clean_reads").alias("ReadsWithoutINDELClip"),
        F.col("total_reads").alias("TotalReads"), yes("has_spanning").alias("HasSpanningReads"), F.concat_ws(",", "tags").alias("AnomalyTags"),
    )


def merged_support_rows(table: DataFrame) -> DataFrame:
    """The rows of the merged support table: grouped by contig, by start; ratios with four decimals."""
    number = lambda c: F.when(F.col(c) == -1, F.lit("-1")).otherwise(decimals(F.col(c), 2))
    return table.orderBy("contig", "start0").select(
        F.col("contig").alias("Chr"), F.col("start0").alias("Start"), F.col("end0").alias("End"), F.col("hifi").alias("File1_Col1"), number("hifi_depth").alias("File1_Col2"), F.col("ont").alias("File2_Col1"),
        number("ont_depth").alias("File2_Col2"), decimals(F.col("ag"), 4).alias("AG_ratio"), decimals(F.col("ct"), 4).alias("CT_ratio"), decimals(F.col("gc"), 4).alias("GC_ratio"),
    )


def summary_rows(summary: DataFrame) -> DataFrame:
    """The rows of anomaly_summary.tsv: contigs by name, then Total."""
    rows = summary.orderBy((F.col("contig") == "Total").cast("int"), "contig")
    return rows.select(F.col("contig").alias("Chromosome"), "low_depth", "high_depth", "indel", "clip", F.col("non_spanning").alias("non-spanning"), F.col("nr_se").alias("nr-SE"))


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in whatever file system the path names."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def contig_report(qv: DataFrame, contigs: DataFrame) -> str:
    """The contig summary as text, contigs in the reference's order."""
    rows = qv.join(contigs.select("contig", "ord"), "contig").orderBy("ord").collect()  # a row a contig
    lines = ["Quality values by contig", "", "Chromosome\tTotal_Length\tBE_Errors\tSE_Errors\tTotal_Errors\tQV"]
    return "\n".join(lines + [f"{r.contig}\t{r.len:,}\t{r.be_errors}\t{r.se_errors}\t{r.total_errors}\t{r.qv}" for r in rows]) + "\n"


def genome_report(qv: DataFrame, stages: DataFrame | None = None) -> str:
    """The genome summary as text."""
    r = qv.first()
    value = "∞ (no errors detected)" if r.total_errors == 0 else "N/A" if r.qv is None else f"{r.qv:.2f}"
    rate = f"{r.total_errors / r.length:.2e}" if r.length > 0 else "N/A"
    lines = ["Genome summary", "", f"Reference length: {r.reference_length:,} bp", f"Masked length: {r.masked_length:,} bp", f"Base errors: {r.be_errors:,}", f"Structural errors: {r.se_errors:,}", f"Total errors: {r.total_errors:,}", f"Error rate: {rate}", f"QV: {value}"]
    for s in stages.collect() if stages is not None else []:
        lines.append(f"{s.stage}: {s.rows:,}")
    return "\n".join(lines) + "\n"


def candidate_report(summary: DataFrame, mean: DataFrame, contigs: DataFrame) -> str:
    """The candidates' summary as text."""
    s, m = summary.first(), mean.first()
    n = contigs.count()
    return f"Contigs: {n:,}\nMean depth: {m.mean_depth:.2f}\nDepth threshold: {round(m.mean_depth * 0.1, 4)}\nWindows: {s.total:,}\nWindows with low depth: {s.small:,} ({s.percent:.2f}%)\n"


def config_json(cfg: PipelineConfig) -> str:
    return json.dumps(cfg.as_dict(), indent=2)
