"""Error counts and quality values by contig and for a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.rules import phred, phred_text
from ridgeline.operators.intervals import total_length


def error_counts(errors: DataFrame, contigs: DataFrame, name: str) -> DataFrame:
    """(contig, name): rows of errors on each contig, 0 where there are none."""
    counts = errors.groupBy("contig").agg(F.count("*").alias(name))
    return contigs.select("contig").join(counts, "contig", "left").select("contig", F.coalesce(name, F.lit(0).cast("long")).alias(name))


def contig_qv(contigs: DataFrame, base_errors: DataFrame, structural_errors: DataFrame) -> DataFrame:
    """(contig, len, be_errors, se_errors, total_errors, qv) of every contig; lengths are not masked."""
    rows = contigs.select("contig", "len").join(error_counts(base_errors, contigs, "be_errors"), "contig").join(error_counts(structural_errors, contigs, "se_errors"), "contig")
    rows = rows.withColumn("total_errors", F.col("be_errors") + F.col("se_errors"))
    return rows.withColumn("qv", phred_text(F.col("total_errors"), F.col("len")))


def genome_qv(contigs: DataFrame, base_errors: DataFrame, structural_errors: DataFrame, mask: DataFrame | None = None, merged_mask: bool = True) -> DataFrame:
    """One row: length without the mask, errors and qv; qv is infinite without errors, null if all is masked."""
    total = contigs.agg(F.sum("len").alias("reference_length"))
    hidden = total_length(mask, merged_mask).agg(F.coalesce(F.sum("masked"), F.lit(0).cast("long")).alias("masked_length")) if mask is not None else total.select(F.lit(0).cast("long").alias("masked_length"))
    be = base_errors.agg(F.count("*").alias("be_errors"))
    se = structural_errors.agg(F.count("*").alias("se_errors"))
    row = total.join(F.broadcast(hidden)).join(F.broadcast(be)).join(F.broadcast(se))  # one row each
    row = row.withColumns({"length": F.col("reference_length") - F.col("masked_length"), "total_errors": F.col("be_errors") + F.col("se_errors")})
    return row.withColumn("qv", phred(F.col("total_errors"), F.col("length")))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """(stage, rows) of named DataFrames."""
    out = None
    for name, rows in stages.items():
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
