"""Read filters and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.config import ReadFilterConfig
from ridgeline.functions.cigar import is_clipped, split_count


def perfect_reads(reads: DataFrame) -> DataFrame:
    """Short reads without a mismatch and without a clip, whatever their flags; reads without an NM tag go."""
    return reads.where((F.col("nm") == 0) & ~is_clipped(F.col("cigar")))


def primary(flag: Column, excluded: int = 0x904) -> Column:
    """Neither unmapped nor secondary nor supplementary."""
    return flag.bitwiseAND(excluded) == 0


def few_splits(sa: Column, seq_len: Column, cfg: ReadFilterConfig = ReadFilterConfig()) -> Column:
    return split_count(sa) <= F.lit(cfg.max_splits_base) + F.lit(cfg.max_splits_kb) * seq_len / F.lit(1000.0)


def long_reads(reads: DataFrame, cfg: ReadFilterConfig = ReadFilterConfig()) -> DataFrame:
    """Long reads with few supplementary alignments for their length; primary alignments only, unless cfg includes all."""
    kept = reads if cfg.include_all_reads else reads.where(primary(F.col("flag"), cfg.excluded_flags))
    return kept.where(few_splits(F.col("sa"), F.col("seq_len"), cfg))


def short_filter_stats(reads: DataFrame) -> DataFrame:
    """One row: reads, those kept, and those lost to clips only, mismatches only and both; one pass."""
    good, clip = F.coalesce(F.col("nm") == 0, F.lit(False)), is_clipped(F.col("cigar"))
    return reads.agg(
        F.count("*").alias("total"), F.count_if(good & ~clip).alias("kept"), F.count_if(good & clip).alias("clip_only"), F.count_if(~good & ~clip).alias("mismatch_only"), F.count_if(~good & clip).alias("both")
    ).withColumn("kept_percent", F.when(F.col("total") > 0, F.round(F.col("kept") * 100.0 / F.col("total"), 2)).otherwise(F.lit(0.0)))


def long_filter_stats(reads: DataFrame, cfg: ReadFilterConfig = ReadFilterConfig()) -> DataFrame:
    """One row: reads, those looked at, and those dropped for their splits."""
    seen = F.lit(True) if cfg.include_all_reads else primary(F.col("flag"), cfg.excluded_flags)
    few = few_splits(F.col("sa"), F.col("seq_len"), cfg)
    return reads.agg(F.count("*").alias("total"), F.count_if(seen).alias("primary_reads"), F.count_if(seen & ~few).alias("dropped_splits"), F.count_if(seen & few).alias("kept"))
