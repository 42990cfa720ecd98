"""The whole analysis: filter reads, find base and structural errors, report quality values."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.config import PipelineConfig
from ridgeline.operators.composition import CHUNK
from ridgeline.operators.intervals import in_contig_order, merge_intervals
from ridgeline.operators.quality_value import contig_qv, genome_qv, stage_counts
from ridgeline.operators.reads import long_reads, perfect_reads
from ridgeline.operators.repeats import haplotypes, identical_regions
from ridgeline.operators.support import with_mismatches
from ridgeline.plans import base_errors, structural_errors
from ridgeline.sources import sinks
from ridgeline.sources.bam import read_bam
from ridgeline.sources.fasta import fasta_index, fasta_order, read_fasta
from ridgeline.sources.tables import read_bed, read_fai


class ConfigError(ValueError):
    """A configuration that can't run."""


def validate(cfg: PipelineConfig) -> None:
    if not (cfg.base_errors or cfg.structural_errors):
        raise ConfigError("at least one of base errors and structural errors must be analysed")
    for path in [cfg.short_reads, cfg.hifi_reads, cfg.ont_reads, cfg.reference, *cfg.masks, *filter(None, [cfg.additional_bed, cfg.reference_index])]:
        if "://" not in path and not os.path.exists(path):
            raise ConfigError(f"no such file: {path}")


def load_reads(spark: SparkSession, path: str, platform: str) -> DataFrame:
    return read_bam(spark, path, platform) if path.endswith(".bam") else spark.read.parquet(path)


def run(spark: SparkSession, cfg: PipelineConfig) -> dict[str, DataFrame]:
    """Runs what cfg asks for, writes the results below its output_dir and returns them.

    Each result is written once and read back for what depends on it, so that nothing is computed twice.
    """
    validate(cfg)
    out = cfg.output_dir.rstrip("/")

    def kept(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{out}/work/{name}")
        return spark.read.parquet(f"{out}/work/{name}")

    k = cfg.repeats.k
    chunks = kept("reference", read_fasta(spark, cfg.reference, CHUNK, k - 1))
    index = read_fai(spark, cfg.reference_index) if cfg.reference_index else fasta_index(chunks).join(fasta_order(spark, cfg.reference), "contig")
    contigs = kept("contigs", index.select("contig", "len", "ord").coalesce(1))
    mask = kept("mask", merge_intervals(read_bed(spark, list(cfg.masks)))) if cfg.masks else None
    reads = {}
    for name, path in (("short", cfg.short_reads), ("hifi", cfg.hifi_reads), ("ont", cfg.ont_reads)):
        rows = load_reads(spark, path, name).withColumn("platform", F.lit(name))
        if not cfg.skip_filter:
            rows = perfect_reads(rows) if name == "short" else long_reads(rows, cfg.reads)
        sinks.write_reads(rows, f"{out}/reads/{name}")
        reads[name] = spark.read.parquet(f"{out}/reads/{name}")
    results: dict[str, DataFrame] = {}
    none = spark.createDataFrame([], "contig string, start0 bigint, end0 bigint")
    be = se = none
    if cfg.base_errors:
        extra = read_bed(spark, cfg.additional_bed) if cfg.additional_bed else None
        if cfg.identical_regions:
            regions = kept("identical_regions", identical_regions(chunks, haplotypes(contigs), k))
            sinks.write_bed(in_contig_order(regions, contigs), f"{out}/be/identical_regions.bed")
            extra = regions if extra is None else extra.unionByName(regions)
        windows = kept("candidates", base_errors.candidates(reads["short"], contigs, mask, extra, cfg.be))
        sinks.write_bed(in_contig_order(windows, contigs), f"{out}/be/candidates.bed")
        long = {p: kept(f"{p}_mismatches", with_mismatches(reads[p], chunks, CHUNK).drop("seq")) for p in ("hifi", "ont")}
        table = kept("support", base_errors.support_table(windows, long["hifi"], long["ont"], chunks, cfg.be))
        sinks.write_tsv(sinks.merged_support_rows(table), f"{out}/be/merged_support.tsv")
        found = base_errors.final_filter(table, contigs, cfg.be)
        be = kept("base_errors", base_errors.overlap_anti(found, mask) if mask is not None else found)
        sinks.write_tsv(sinks.merged_support_rows(be), f"{out}/be/result.tsv", header=False)
        sinks.write_by_contig(be, f"{out}/be/by_contig")
        results |= {"candidates": windows, "support": table, "base_errors": be}
    if cfg.structural_errors:
        found = structural_errors.structural_errors(reads["ont"], contigs, mask, cfg.se)
        stats, anomalies = kept("window_stats", found.stats), kept("anomalies_unmasked", found.anomalies)
        sinks.write_tsv(sinks.window_stats_rows(stats), f"{out}/se/window_stats.tsv")
        sinks.write_tsv(sinks.anomaly_rows(anomalies), f"{out}/se/anomalous_regions.unmasked.tsv")
        sinks.write_tsv(sinks.summary_rows(structural_errors.anomaly_summary(anomalies, contigs)), f"{out}/se/anomaly_summary.unmasked.tsv")
        sinks.write_bed(structural_errors.merged_anomalies(anomalies).orderBy("contig", "start0"), f"{out}/se/result.unmasked.bed")
        sinks.write_bed(found.nonspanning.orderBy("contig", "start0"), f"{out}/se/non_spanning.bed")
        se = kept("anomalies", structural_errors.overlap_anti(anomalies, mask) if mask is not None else anomalies)
        sinks.write_tsv(sinks.anomaly_rows(se), f"{out}/se/anomalous_regions.tsv")
        sinks.write_bed(in_contig_order(se, contigs), f"{out}/se/anomalous_regions.bed")
        sinks.write_by_contig(sinks.anomaly_rows(se).withColumn("contig", F.col("Chromosome")), f"{out}/se/by_contig")
        results |= {"window_stats": stats, "structural_errors": se}
    results["contig_qv"] = kept("contig_qv", contig_qv(contigs, be, se))
    results["genome_qv"] = kept("genome_qv", genome_qv(contigs, be, se, mask))
    texts = {
        "contig_qv.txt": sinks.contig_report(results["contig_qv"], contigs),
        "summary.txt": sinks.genome_report(results["genome_qv"], stage_counts(**{n: r for n, r in results.items() if not n.endswith("qv")})),
        "config.json": sinks.config_json(cfg),
    }
    for name, text in texts.items():
        sinks.write_text(spark, f"{out}/{name}", text)
    return results
