"""Base errors: candidate windows, their support by long reads, and the final rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.config import BaseErrorConfig
from ridgeline.functions.rules import supported, terminal_region
from ridgeline.operators.composition import CHUNK, composition
from ridgeline.operators.depth import counted_reads, low_depth_windows
from ridgeline.operators.intervals import KEY, merge_intervals, overlap_anti, split_to_windows
from ridgeline.operators.support import merged_support, window_support

BE = BaseErrorConfig()


def candidates(short_reads: DataFrame, contigs: DataFrame, mask: DataFrame | None = None, additional: DataFrame | None = None, cfg: BaseErrorConfig = BE) -> DataFrame:
    """Windows of low short-read depth off the mask, with the windows of additional regions, each once."""
    found = low_depth_windows(counted_reads(short_reads), contigs, cfg.window, cfg.low_depth_fraction)
    if mask is not None:
        found = overlap_anti(found, mask)
    if additional is not None:
        parts = split_to_windows(found, contigs, cfg.window).unionByName(split_to_windows(additional, contigs, cfg.window))
        found = merge_intervals(parts, strict=True)
    return found


def support_table(windows: DataFrame, hifi: DataFrame, ont: DataFrame, chunks: DataFrame, cfg: BaseErrorConfig = BE, chunk: int = CHUNK) -> DataFrame:
    """Windows with both platforms' support and depth and their base composition."""
    merged = merged_support(windows, window_support(windows, hifi, cap=cfg.depth_cap), window_support(windows, ont, cap=cfg.depth_cap))
    return merged.join(composition(windows, chunks, chunk), KEY, "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ("ag", "ct", "gc")})


def final_filter(table: DataFrame, contigs: DataFrame, cfg: BaseErrorConfig = BE, exclude: bool = False) -> DataFrame:
    """The windows of a support table that the reads don't support; with exclude, those that they do.

    Windows above the depth cap on either platform appear in neither.
    """
    rows = table.where((F.col("hifi_depth") <= cfg.depth_cap) & (F.col("ont_depth") <= cfg.depth_cap)).join(contigs.select("contig", "len"), "contig", "left")
    terminal = terminal_region(F.col("start0"), F.col("end0"), F.col("len"), cfg.terminal)
    good = supported({k: F.col(k) for k in ("hifi", "hifi_depth", "ont", "ont_depth", "ag", "ct", "gc")}, terminal, cfg)
    return rows.where(good if exclude else ~good).drop("len")


def base_errors(short_reads: DataFrame, hifi: DataFrame, ont: DataFrame, contigs: DataFrame, chunks: DataFrame, mask: DataFrame | None = None, additional: DataFrame | None = None, cfg: BaseErrorConfig = BE) -> DataFrame:
    """From filtered reads to the final windows, masked."""
    table = support_table(candidates(short_reads, contigs, mask, additional, cfg), hifi, ont, chunks, cfg)
    found = final_filter(table, contigs, cfg)
    return overlap_anti(found, mask) if mask is not None else found
