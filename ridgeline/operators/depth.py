"""Coverage: depth runs by a sweep, window means, low-depth bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.functions.cigar import cigar_ops
from ridgeline.operators.intervals import CHUNK, KEY, binned, overlap_semi, tumbling_windows


#: Unmapped, secondary, failed and duplicate alignments, which depth leaves out.
NOT_IN_DEPTH = 0x704


def counted_reads(reads: DataFrame, excluded: int = NOT_IN_DEPTH) -> DataFrame:
    return reads.where(F.col("flag").bitwiseAND(excluded) == 0)


def gaps(cigar: Column, start0: Column) -> Column:
    """The deletions and skips of an alignment."""
    return cigar_ops(cigar, start0, lambda op, n, i: op.isin("D", "N"))


def depth_changes(reads: DataFrame, through_gaps: bool = False) -> DataFrame:
    """(contig, pos, delta): where reads begin and end, and, unless they count as covered, where their gaps do."""
    edge = lambda pos, delta: F.struct(pos.alias("pos"), F.lit(delta).cast("long").alias("delta"))
    edges = F.array(edge(F.col("start0"), 1), edge(F.col("end0"), -1))
    if not through_gaps:
        inner = F.flatten(F.transform(gaps(F.col("cigar"), F.col("start0")), lambda g: F.array(edge(g["ref0"], -1), edge(g["ref1"], 1))))
        edges = F.concat(edges, inner)
    return reads.where("start0 < end0").select("contig", F.explode(edges).alias("e")).groupBy("contig", F.col("e.pos").alias("pos")).agg(F.sum("e.delta").alias("delta"))


def depth_pieces(reads: DataFrame, contigs: DataFrame, through_gaps: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(contig, start0, end0, depth) over each contig from 0 to its end, stretches without a read included; neighbours may have equal depth.

    Changes are summed by position first. Running sums are taken inside chunks of a contig, and a chunk's start is the sum of the chunks before
    it, so one task orders the positions of a chunk.
    """
    ends = contigs.where("len > 0").select("contig", F.explode(F.array(F.lit(0).cast("long"), F.col("len"))).alias("pos"), F.lit(0).cast("long").alias("delta"))
    changes = depth_changes(reads, through_gaps).unionByName(ends).groupBy("contig", "pos").agg(F.sum("delta").alias("delta")).withColumn("chunk", F.floor(F.col("pos") / chunk))
    by_contig = Window.partitionBy("contig").orderBy("chunk")
    chunks = changes.groupBy("contig", "chunk").agg(F.sum("delta").alias("sum"), F.min("pos").alias("first"))
    chunks = chunks.select("contig", "chunk", F.coalesce(F.sum("sum").over(by_contig.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"), F.lead("first").over(by_contig).alias("next"))
    inside = Window.partitionBy("contig", "chunk").orderBy("pos")
    rows = changes.join(chunks, ["contig", "chunk"]).select(
        "contig",
        F.col("pos").alias("start0"),
        F.coalesce(F.lead("pos").over(inside), F.col("next")).alias("end0"),
        (F.col("before") + F.sum("delta").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("depth"),
    )
    runs = rows.join(contigs.select("contig", "len"), "contig").where("end0 is not null and start0 < end0 and end0 <= len")
    return runs.select(*KEY, "depth")


def depth_runs(reads: DataFrame, contigs: DataFrame, through_gaps: bool = False, chunk: int = CHUNK) -> DataFrame:
    """`depth_pieces` with neighbours of equal depth as one run."""
    return joined_runs(depth_pieces(reads, contigs, through_gaps, chunk), chunk)


def joined_runs(runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Neighbouring runs of equal depth as one, inside chunks of a contig and then between them."""
    for parts in (["contig", "chunk"], ["contig"]):
        rows = runs.withColumn("chunk", F.floor(F.col("start0") / chunk))
        order = Window.partitionBy(*parts).orderBy("start0")
        same = (F.lag("depth").over(order) == F.col("depth")) & (F.lag("end0").over(order) == F.col("start0"))
        rows = rows.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        runs = rows.groupBy(*parts, "run").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"), F.first("depth").alias("depth")).select(*KEY, "depth")
    return runs


def mean_depth(runs: DataFrame, contigs: DataFrame, digits: int = 2) -> DataFrame:
    """One row, mean_depth: covered bases over the length of all contigs, rounded as a depth summary prints it."""
    covered = runs.agg(F.sum(F.col("depth") * (F.col("end0") - F.col("start0"))).alias("bases"))
    length = contigs.agg(F.sum("len").alias("total"))
    share = F.when(F.col("total") > 0, F.coalesce("bases", F.lit(0)).cast("double") / F.col("total")).otherwise(F.lit(0.0))
    return covered.join(F.broadcast(length)).select(F.round(share, digits).alias("mean_depth"))  # one row each


def low_depth_runs(runs: DataFrame, contigs: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Runs below the given fraction of the mean depth (the bound rounded to four decimals)."""
    bound = mean_depth(runs, contigs).select(F.round(F.col("mean_depth") * fraction, 4).alias("bound"))
    return runs.join(F.broadcast(bound), F.col("depth") < F.col("bound")).select(*KEY, "depth")  # bound is one row


def low_depth_windows(reads: DataFrame, contigs: DataFrame, window: int = 50, fraction: float = 0.1) -> DataFrame:
    """Tumbling windows with a base of low depth: the candidates for base errors."""
    low = low_depth_runs(depth_pieces(reads, contigs), contigs, fraction)
    keys = binned(low.select(*KEY), window).select("contig", F.col("bin").alias("start0")).distinct()
    return tumbling_windows(contigs, window).join(keys, ["contig", "start0"], "left_semi")


def low_depth_windows_by_overlap(windows: DataFrame, low: DataFrame) -> DataFrame:
    """Windows of any kind that overlap a low-depth run."""
    return overlap_semi(windows, low)


def window_summary(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: candidate windows, all windows, and the percentage."""
    n = candidates.agg(F.count("*").alias("small"))
    total = windows.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("small", "total", F.when(F.col("total") > 0, F.round(F.col("small") * 100.0 / F.col("total"), 2)).otherwise(F.lit(0.0)).alias("percent"))


def window_mean_depth(reads: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """(contig, start0, end0, depth) of every tumbling window: bases of whole read spans over the window's length."""
    inside = reads.join(contigs.select("contig", "len"), "contig").withColumn("end0", F.least("end0", "len")).select(*KEY)
    cover = binned(inside, size).select("contig", "bin", (F.least(F.col("end0"), F.col("bin") + size) - F.greatest("start0", "bin")).alias("bases"))
    sums = cover.groupBy("contig", F.col("bin").alias("start0")).agg(F.sum("bases").alias("bases"))
    windows = tumbling_windows(contigs, size).join(sums, ["contig", "start0"], "left")
    return windows.select(*KEY, (F.coalesce("bases", F.lit(0)).cast("double") / (F.col("end0") - F.col("start0"))).alias("depth"))


def mean_positive_depth(depths: DataFrame) -> DataFrame:
    """One row, mean: over the windows that have any depth; null if none has."""
    return depths.agg(F.avg(F.when(F.col("depth") > 0, F.col("depth"))).alias("mean"))
