"""Counters of structural signals in tumbling windows, and the tags that they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.config import StructuralErrorConfig
from ridgeline.functions.cigar import cigar_ops
from ridgeline.functions.rules import anomaly_tags, terminal_window
from ridgeline.operators.depth import counted_reads, mean_positive_depth, window_mean_depth
from ridgeline.operators.intervals import floor_to, merge_intervals, touched_bins, tumbling_windows

COUNTERS = ["clip_count", "insertion", "deletion", "reads_with_insertion", "reads_with_deletion", "reads_with_clip", "total_reads", "clean_reads"]
TAGS = ["low_depth", "high_depth", "indel", "clip", "non_spanning"]
UNMAPPED = 0x4


def read_events(cfg: StructuralErrorConfig = StructuralErrorConfig()) -> Column:
    """The clips and long indels of a read (cigar, start0) as cigar_ops has them."""
    return cigar_ops(F.col("cigar"), F.col("start0"), lambda op, n, i: op.isin("S", "H") | (op.isin("I", "D") & (n >= cfg.min_indel)))


def window_counters(reads: DataFrame, contigs: DataFrame, cfg: StructuralErrorConfig = StructuralErrorConfig()) -> DataFrame:
    """(contig, start0, end0, counters) for every window of every contig.

    A read counts in every window from that of its start to that of its end, both included; so a read that ends where a window begins counts
    there too. A clip counts where the reference position stands, an insertion likewise, a deletion in all windows from that of its
    first base to that after its last. The first operation of a read at 0 and the last of one at the contig's end aren't clips. All events of a read fall
    into its own windows, so each (read, window) counts its events where it is made and a single aggregation, partly done
    before the shuffle, sums them.
    """
    w = cfg.window
    mapped = reads.where(F.col("flag").bitwiseAND(UNMAPPED) == 0).where("cigar is not null and cigar <> '*'").join(contigs.select("contig", "len"), "contig")
    events = F.filter(
        F.transform(
            read_events(cfg),
            lambda e: F.named_struct(
                F.lit("op"),
                e["op"],
                F.lit("b0"),
                floor_to(e["ref0"], w),
                F.lit("b1"),
                F.when(e["op"] == "D", floor_to(e["ref0"] + e["len"], w)).otherwise(floor_to(e["ref0"], w)),
                F.lit("exempt"),
                (e["idx"] == 0) & (F.col("start0") == 0) | (e["idx"] == F.col("n_ops") - 1) & (F.col("end0") == F.col("len")),
            ),
        ),
        lambda e: ~(e["op"].isin("S", "H") & e["exempt"]),
    )
    each = mapped.withColumn("n_ops", F.regexp_count("cigar", F.lit("[MIDNSHP=X]"))).select("contig", "len", events.alias("events"), F.explode(touched_bins(F.col("start0"), F.col("end0"), w)).alias("bin")).where("bin < len")

    def here(*ops: str) -> Column:
        return F.size(F.filter("events", lambda e: e["op"].isin(*ops) & (e["b0"] <= F.col("bin")) & (F.col("bin") <= e["b1"]))).cast("long")

    each = each.select("contig", "bin", "len", here("S", "H").alias("c"), here("I").alias("i"), here("D").alias("d"))
    clean = (F.col("c") + F.col("i") + F.col("d") == 0) & terminal_window(F.col("bin"), F.col("len"), cfg.terminal)
    sums = each.groupBy("contig", F.col("bin").alias("start0")).agg(
        F.sum("c").alias("clip_count"),
        F.sum("i").alias("insertion"),
        F.sum("d").alias("deletion"),
        F.count_if(F.col("i") > 0).alias("reads_with_insertion"),
        F.count_if(F.col("d") > 0).alias("reads_with_deletion"),
        F.count_if(F.col("c") > 0).alias("reads_with_clip"),
        F.count("*").alias("total_reads"),
        F.count_if(clean).alias("clean_reads"),
    )
    windows = tumbling_windows(contigs, w).join(sums, ["contig", "start0"], "left")
    return windows.select("contig", "start0", "end0", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTERS])


def window_stats(reads: DataFrame, contigs: DataFrame, nonspanning: DataFrame | None = None, cfg: StructuralErrorConfig = StructuralErrorConfig()) -> DataFrame:
    """Counters with depth, is_terminal and has_spanning (false for the windows, contig and start0, of nonspanning)."""
    depth = window_mean_depth(counted_reads(reads), contigs, cfg.window).select("contig", "start0", "depth")
    rows = window_counters(reads, contigs, cfg).join(depth, ["contig", "start0"], "left").withColumn("depth", F.coalesce("depth", F.lit(0.0)))
    rows = rows.join(contigs.select("contig", "len"), "contig", "left").withColumn("is_terminal", terminal_window(F.col("start0"), F.col("len"), cfg.terminal)).drop("len")
    if nonspanning is None:
        return rows.withColumn("has_spanning", F.lit(True))
    marks = nonspanning.select("contig", "start0").distinct().withColumn("__mark", F.lit(True))
    return rows.join(marks, ["contig", "start0"], "left").withColumn("has_spanning", F.col("__mark").isNull()).drop("__mark")


def anomalies(stats: DataFrame, cfg: StructuralErrorConfig = StructuralErrorConfig()) -> DataFrame:
    """The windows with a tag, in column tags; none at all if no window has depth."""
    mean = mean_positive_depth(stats)
    names = {
        "depth": "depth", "clips": "clip_count", "reads": "total_reads", "reads_with_insertion": "reads_with_insertion", "reads_with_deletion": "reads_with_deletion",
        "clean": "clean_reads", "insertions": "insertion", "deletions": "deletion", "terminal": "is_terminal", "spanning": "has_spanning",
    }
    tagged = stats.join(F.broadcast(mean), F.col("mean").isNotNull())  # mean is one row
    tagged = tagged.withColumn("tags", anomaly_tags({k: F.col(v) for k, v in names.items()}, F.col("mean"), cfg))
    return tagged.where(F.size("tags") > 0).drop("mean")


def anomaly_summary(found: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, counts of windows by tag, nr_se), every contig and a row Total; a tag counts once a window."""
    counts = found.groupBy("contig").agg(*[F.count_if(F.array_contains("tags", t)).alias(t) for t in TAGS], F.count("*").alias("nr_se"))
    names = [*TAGS, "nr_se"]
    rows = contigs.select("contig").distinct().join(counts, "contig", "left").select("contig", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])
    total = counts.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("long")).alias(n) for n in names]).select(F.lit("Total").alias("contig"), *names)
    return rows.unionByName(total)


def terminal_counts(stats: DataFrame, least: float = 0.1) -> DataFrame:
    """(contig, indel, clip): terminal windows with a clean share strictly below `least`."""
    bad = stats.where("is_terminal and total_reads > 0").where(F.col("clean_reads").cast("double") / F.col("total_reads") < least)
    indel = F.col("insertion") + F.col("deletion") > 0
    return bad.groupBy("contig").agg(F.count_if(indel).alias("indel"), F.count_if(~indel).alias("clip"))


def merged_anomalies(found: DataFrame) -> DataFrame:
    """Anomalous windows as merged regions."""
    return merge_intervals(found.select("contig", "start0", "end0"))


def without_read(windows: DataFrame, reads: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Windows that no read spans from end to end.

    A window is spanned just if some read that begins at or before it reaches its end. Reads become the farthest end for each start; per chunk of
    a contig these are run through in order, with what the chunks before reach, so no read meets more than one window.
    """
    from pyspark.sql.window import Window

    best = reads.groupBy("contig", "start0").agg(F.max("end0").alias("reach"))
    both = best.select("contig", "start0", "reach", F.lit(None).cast("long").alias("end0")).unionByName(windows.select("contig", "start0", F.lit(None).cast("long").alias("reach"), "end0")).withColumn("chunk", F.floor(F.col("start0") / chunk))
    by_contig = Window.partitionBy("contig").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = both.groupBy("contig", "chunk").agg(F.max("reach").alias("r")).select("contig", "chunk", F.max("r").over(by_contig).alias("before"))
    inside = Window.partitionBy("contig", "chunk").orderBy("start0").rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("reach", F.max("reach").over(inside)).where("end0 is not null").join(chunks, ["contig", "chunk"])
    reach = F.greatest("reach", "before")  # nulls are skipped
    return seen.where(reach.isNull() | (reach < F.col("end0"))).select("contig", "start0", "end0")


def nonspanning_regions(windows: DataFrame, reads: DataFrame, contigs: DataFrame, trim: int = 28_000) -> DataFrame:
    """Merged windows without a spanning read; at a contig's start or else its end, `trim` bases less, as no read there can span."""
    gaps = without_read(windows, reads).withColumn("start0", F.greatest("start0", F.lit(0).cast("long")))
    rows = merge_intervals(gaps).join(contigs.where("len > 0").select("contig", "len"), "contig")
    at_start, at_end = F.col("start0") == 0, F.col("end0") == F.col("len")
    cut = rows.withColumns({"s": F.when(~at_start & at_end, F.col("start0") + trim).otherwise(F.col("start0")), "e": F.when(at_start, F.col("end0") - trim).otherwise(F.col("end0"))})
    return cut.where("s < e").select("contig", F.col("s").alias("start0"), F.col("e").alias("end0"))
