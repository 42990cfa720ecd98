"""Command line: python -m ridgeline {run,se,spanning,filter-reads,candidates,support,merge-support,be-filter} ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridgeline import __version__
from ridgeline.config import BaseErrorConfig, PipelineConfig, ReadFilterConfig, StructuralErrorConfig
from ridgeline.operators import depth, intervals, structural, support
from ridgeline.operators.composition import CHUNK, composition
from ridgeline.operators.reads import long_filter_stats, long_reads, perfect_reads, short_filter_stats
from ridgeline.plans import base_errors, structural_errors
from ridgeline.plans.run import load_reads, run
from ridgeline.session import get_session
from ridgeline.sources import sinks
from ridgeline.sources.bam import bam_contigs
from ridgeline.sources.fasta import fasta_index, fasta_order, read_fasta
from ridgeline.sources.tables import read_bed, read_fai, read_merged_support, read_support


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ridgeline", description="Read support of genome assemblies on Spark")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--master", default="local[8]", help="Spark master where no session runs yet")
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("run", help="the whole analysis")
    for name in ("short-read-bam", "hifi-bam", "ont-bam", "reference-fa", "output-dir"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--reference-fai")
    p.add_argument("--skip-filter", action="store_true")
    p.add_argument("--no-be-analysis", action="store_true")
    p.add_argument("--no-se-analysis", action="store_true")
    p.add_argument("--se-window-size", type=int, default=2000)
    p.add_argument("--se-min-indel-length", type=int, default=50)
    p.add_argument("--bed-files", nargs="+", default=[])
    p.add_argument("--additional-bed-file")
    p.add_argument("--generate-ir", action="store_true")

    p = sub.add_parser("se", help="structural errors of one set of long reads")
    p.add_argument("reads")
    p.add_argument("reference")
    p.add_argument("--output-dir", default=".")
    p.add_argument("--window-size", type=int, default=2000)
    p.add_argument("--min-indel-length", type=int, default=50)
    p.add_argument("--terminal-region-size", type=int, default=10_000)
    p.add_argument("--spanning-window-size", type=int, default=30_000)
    p.add_argument("--spanning-step-size", type=int, default=2000)

    p = sub.add_parser("spanning", help="regions that no read spans")
    p.add_argument("reads")
    p.add_argument("fai")
    p.add_argument("-w", "--window-size", type=int, default=30_000)
    p.add_argument("-s", "--step-size", type=int, default=2000)
    p.add_argument("-o", "--output", required=True)

    p = sub.add_parser("filter-reads", help="the read filters")
    p.add_argument("mode", choices=["short-read", "long-read"])
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--max-splits-base", type=float, default=3.0)
    p.add_argument("--max-splits-kb", type=float, default=0.05)
    p.add_argument("--include-all-reads", action="store_true")

    p = sub.add_parser("candidates", help="windows of low short-read depth")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--fai")

    p = sub.add_parser("support", help="perfect reads of each window")
    for name in ("bed", "reads", "fasta", "output"):
        p.add_argument(name)

    p = sub.add_parser("merge-support", help="both platforms' support with base composition")
    for name in ("bed", "file1", "file2", "fasta", "output"):
        p.add_argument(name)

    p = sub.add_parser("be-filter", help="the final rules for base errors")
    p.add_argument("data")
    p.add_argument("fai")
    p.add_argument("-o", "--output")
    p.add_argument("-e", "--exclude", action="store_true", help="keep the windows that the reads support")
    p.add_argument("-s", "--separator", default="\t")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or get_session(a.master)
    if a.command == "run":
        se = StructuralErrorConfig(window=a.se_window_size, min_indel=a.se_min_indel_length)
        run(spark, PipelineConfig(
            a.short_read_bam, a.hifi_bam, a.ont_bam, a.reference_fa, a.output_dir, a.reference_fai, tuple(a.bed_files), a.additional_bed_file, a.skip_filter,
            not a.no_be_analysis, not a.no_se_analysis, a.generate_ir, se=se,
        ))
    elif a.command == "se":
        cfg = StructuralErrorConfig(a.window_size, a.min_indel_length, a.terminal_region_size, spanning_window=a.spanning_window_size, spanning_step=a.spanning_step_size)
        contigs = fasta_index(read_fasta(spark, a.reference)).join(fasta_order(spark, a.reference), "contig")
        found = structural_errors.structural_errors(load_reads(spark, a.reads, "ont"), contigs, cfg=cfg)
        sinks.write_tsv(sinks.window_stats_rows(found.stats), f"{a.output_dir}/se.window_stats.tsv")
        sinks.write_tsv(sinks.anomaly_rows(found.anomalies), f"{a.output_dir}/se.anomalous_regions.tsv")
        sinks.write_bed(intervals.in_contig_order(found.anomalies, contigs), f"{a.output_dir}/se.anomalous_regions.bed")
        sinks.write_tsv(sinks.summary_rows(found.summary), f"{a.output_dir}/se.anomaly_summary.tsv")
        sinks.write_bed(found.merged.orderBy("contig", "start0"), f"{a.output_dir}/se.result.bed")
    elif a.command == "spanning":
        contigs, reads = read_fai(spark, a.fai), load_reads(spark, a.reads, "ont")
        cfg = StructuralErrorConfig(spanning_window=a.window_size, spanning_step=a.step_size)
        mapped = reads.where(F.col("flag").bitwiseAND(structural.UNMAPPED) == 0)
        regions = structural.nonspanning_regions(intervals.spanning_windows(contigs, a.window_size, a.step_size), mapped, contigs, a.window_size - a.step_size)
        sinks.write_bed(regions.orderBy("contig", "start0"), f"{a.output}.non_spanning_regions.merged.bed")
        sinks.write_bed(structural_errors.nonspanning_windows(reads, contigs, cfg).orderBy("contig", "start0"), f"{a.output}.non_spanning.bed")
    elif a.command == "filter-reads":
        short, cfg = a.mode == "short-read", ReadFilterConfig(a.max_splits_base, a.max_splits_kb, a.include_all_reads)
        reads = load_reads(spark, a.input, "short" if short else "long")
        sinks.write_reads(perfect_reads(reads) if short else long_reads(reads, cfg), a.output)
        if not a.quiet:
            (short_filter_stats(reads) if short else long_filter_stats(reads, cfg)).show(truncate=False)
    elif a.command == "candidates":
        contigs = read_fai(spark, a.fai) if a.fai else bam_contigs(spark, a.input)
        reads = load_reads(spark, a.input, "short")
        found = base_errors.candidates(reads, contigs)
        sinks.write_bed(intervals.in_contig_order(found, contigs), a.output)
        runs = depth.depth_runs(depth.counted_reads(reads), contigs)
        print(sinks.candidate_report(depth.window_summary(found, intervals.tumbling_windows(contigs, BaseErrorConfig().window)), depth.mean_depth(runs, contigs), contigs))
    elif a.command == "support":
        chunks = read_fasta(spark, a.fasta)
        reads = support.with_mismatches(load_reads(spark, a.reads, ""), chunks, CHUNK)
        sinks.write_tsv(support.window_support(read_bed(spark, a.bed), reads).orderBy("contig", "start0"), a.output, header=False)
    elif a.command == "merge-support":
        windows = read_bed(spark, a.bed)
        table = support.merged_support(windows, read_support(spark, a.file1), read_support(spark, a.file2))
        table = table.join(composition(windows, read_fasta(spark, a.fasta)), intervals.KEY, "left").fillna(0.0, ["ag", "ct", "gc"])
        sinks.write_tsv(sinks.merged_support_rows(table), a.output)
    elif a.command == "be-filter":
        found = base_errors.final_filter(read_merged_support(spark, a.data, a.separator), read_fai(spark, a.fai), exclude=a.exclude)
        rows = sinks.merged_support_rows(found)
        if a.output:
            sinks.write_tsv(rows, a.output, header=False)
        else:
            for row in rows.toLocalIterator():  # a partition at a time
                print(*row, sep=a.separator)


if __name__ == "__main__":
    main()
