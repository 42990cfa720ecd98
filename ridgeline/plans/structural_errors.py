"""Structural errors: window counters, depth and spanning reads, tagged by rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.config import StructuralErrorConfig
from ridgeline.operators.intervals import overlap_anti, region_windows, spanning_windows
from ridgeline.operators.structural import UNMAPPED, anomalies, anomaly_summary, merged_anomalies, nonspanning_regions, window_stats

SE = StructuralErrorConfig()


class StructuralErrors(NamedTuple):
    stats: DataFrame
    anomalies: DataFrame
    summary: DataFrame
    merged: DataFrame
    masked: DataFrame
    nonspanning: DataFrame


def nonspanning_windows(reads: DataFrame, contigs: DataFrame, cfg: StructuralErrorConfig = SE) -> DataFrame:
    """Windows of cfg.window in the regions that no read spans; none if reads span everything."""
    mapped = reads.where(F.col("flag").bitwiseAND(UNMAPPED) == 0)
    windows = spanning_windows(contigs, cfg.spanning_window, cfg.spanning_step)
    return region_windows(nonspanning_regions(windows, mapped, contigs, cfg.spanning_window - cfg.spanning_step), cfg.window)


def structural_errors(reads: DataFrame, contigs: DataFrame, mask: DataFrame | None = None, cfg: StructuralErrorConfig = SE) -> StructuralErrors:
    """Statistics, anomalies, their summary and merged regions as found, and the anomalies off the mask."""
    gaps = nonspanning_windows(reads, contigs, cfg)
    stats = window_stats(reads, contigs, gaps, cfg)
    found = anomalies(stats, cfg)
    return StructuralErrors(stats, found, anomaly_summary(found, contigs), merged_anomalies(found), overlap_anti(found, mask) if mask is not None else found, gaps)
