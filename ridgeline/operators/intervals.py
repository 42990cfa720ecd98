"""Windows and interval joins on 0-based half-open intervals (contig, start0, end0).

Overlap joins cut both sides into bins of a fixed width and join on (contig, bin), so a contig is as many join keys as it has
bins and Spark's skew handling applies to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["contig", "start0", "end0"]
#: Bases of a bin in overlap joins.
BIN = 16_384
#: Bases of a chunk within which rows of a contig are ordered by one task.
CHUNK = 1_000_000


def floor_to(x: Column, size: int) -> Column:
    return (F.floor(x / F.lit(size)) * size).cast("long")


def tumbling_windows(contigs: DataFrame, size: int) -> DataFrame:
    """Windows of `size` from 0 to each contig's end, the last one shorter; contigs without a length have none."""
    rows = contigs.where("len > 0").select("contig", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(size).cast("long"))).alias("start0"))
    return rows.select("contig", "start0", F.least(F.col("start0") + size, F.col("len")).alias("end0"))


def spanning_windows(contigs: DataFrame, window: int = 30_000, step: int = 2000) -> DataFrame:
    """Sliding windows, and for every contig one that ends with it, from the last multiple of step that leaves window - step or more.

    A contig shorter than that gets a window that begins before 0, which no read can span.
    """
    known = contigs.where("len > 0")
    last = known.select("contig", floor_to(F.col("len") - (window - step), step).alias("start0"), F.col("len").alias("end0"))
    slid = known.where(F.col("len") >= window).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - window, F.lit(step).cast("long"))).alias("start0"))
    return slid.select("contig", "start0", (F.col("start0") + window).alias("end0")).unionByName(last)


def split_to_windows(regions: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Regions as the whole windows that they touch, cut at the contig's end; regions of unknown contigs end at their own."""
    sized = regions.join(contigs.select("contig", "len"), "contig", "left").withColumn("stop", F.least("end0", F.coalesce("len", "end0")))
    rows = sized.where("start0 < stop").select("contig", "len", "stop", F.explode(F.sequence(floor_to(F.col("start0"), size), F.col("stop") - 1, F.lit(size).cast("long"))).alias("w"))
    end = F.least(F.col("w") + size, F.coalesce("len", floor_to(F.col("stop") + (size - 1), size)))
    return rows.select("contig", F.col("w").alias("start0"), end.alias("end0"))


def region_windows(regions: DataFrame, size: int) -> DataFrame:
    """Regions as windows that begin at multiples of size, the last one cut at the region's end."""
    rows = regions.where("start0 < end0").select("contig", "end0", F.explode(F.sequence(floor_to(F.col("start0"), size), F.col("end0") - 1, F.lit(size).cast("long"))).alias("w"))
    return rows.select("contig", F.col("w").alias("start0"), F.least(F.col("w") + size, F.col("end0")).alias("end0"))


def region_window_keys(regions: DataFrame, size: int) -> DataFrame:
    """(contig, start0) of the windows that regions touch, each once."""
    return region_windows(regions, size).select("contig", "start0").distinct()


def extended(regions: DataFrame, contigs: DataFrame, by: int) -> DataFrame:
    """Regions made longer at their end, up to the contig's; what is empty or on no known contig goes."""
    rows = regions.join(contigs.select("contig", "len"), "contig").withColumn("end0", F.least(F.col("end0") + by, F.col("len")))
    return rows.where("start0 < end0").select(*KEY)


def touched_bins(first: Column, last: Column, size: int) -> Column:
    """Bins from that of `first` to that of `last`, both included."""
    return F.sequence(floor_to(first, size), floor_to(last, size), F.lit(size).cast("long"))


def binned(rows: DataFrame, size: int = BIN) -> DataFrame:
    """A row for each bin that a non-empty interval overlaps, in column bin."""
    return rows.where("start0 < end0").withColumn("bin", F.explode(touched_bins(F.col("start0"), F.col("end0") - 1, size)))


def overlapping(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """(contig, start0, end0) of a, each distinct interval once, that some interval of b overlaps."""
    left = binned(a.select(*KEY).distinct(), size)
    right = binned(b.select("contig", F.col("start0").alias("start0"), F.col("end0").alias("end0")), size).select("contig", "bin", F.col("start0").alias("b0"), F.col("end0").alias("b1"))
    met = (left["contig"] == right["contig"]) & (left["bin"] == right["bin"]) & (left["start0"] < right["b1"]) & (right["b0"] < left["end0"])
    return left.join(right, met, "left_semi").select(*KEY).distinct()


def overlap_semi(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of a that overlap b, as often as they stand in a."""
    return a.join(overlapping(a, b, size), KEY, "left_semi")


def overlap_anti(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of a that nothing in b overlaps: a mask's difference."""
    return a.join(overlapping(a, b, size), KEY, "left_anti")


def overlap_pairs(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of a with those of b (its columns prefixed b_) that overlap them; a pair comes from the first bin that both share."""
    left = binned(a, size)
    right = binned(b, size).select(*[F.col(c).alias(f"b_{c}") for c in [*b.columns, "bin"]])
    first = floor_to(F.greatest("start0", "b_start0"), size)
    met = (F.col("contig") == F.col("b_contig")) & (F.col("bin") == F.col("b_bin")) & (F.col("start0") < F.col("b_end0")) & (F.col("b_start0") < F.col("end0"))
    return left.join(right, met).where(F.col("bin") == first).drop("bin", "b_bin")


def overlap_sums(a: DataFrame, b: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(contig, start0, end0, pairs, bases) for each distinct interval of a that b overlaps: how many pairs `overlap_pairs` has of it, and the bases that they share.

    No pair is made. The rows of b over an interval are those that begin before its end, less those that end by its start; the bases shared are
    those of b before its end, less those before its start. Edges are summed by position first. Running sums are taken inside chunks of a contig, and
    a chunk goes on from the sums of the chunks before it, so one task orders the positions of a chunk.
    """
    places = a.where("start0 < end0").groupBy(*KEY).agg(F.count("*").alias("times"))
    edge = lambda pos, *kind: F.struct(F.col(pos).alias("pos"), *[F.lit(k).cast("long").alias(c) for c, k in zip(("begun", "over"), kind)])
    cut = lambda rows, *edges: rows.select("contig", F.explode(F.array(*edges)).alias("e")).select("contig", "e.*")
    edges = cut(b.where("start0 < end0"), edge("start0", 1, 0), edge("end0", 0, 1)).unionByName(cut(places, edge("start0", 0, 0), edge("end0", 0, 0)))
    edges = edges.groupBy("contig", "pos").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over")).withColumn("chunk", F.floor(F.col("pos") / chunk))
    edges = edges.withColumn("moment", (F.col("begun") - F.col("over")) * F.col("pos"))
    sums = ("begun", "over", "moment")
    earlier = Window.partitionBy("contig").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = edges.groupBy("contig", "chunk").agg(*[F.sum(c).alias(c) for c in sums])
    chunks = chunks.select("contig", "chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long")).alias(f"{c}_before") for c in sums])
    inside = Window.partitionBy("contig", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = edges.join(chunks, ["contig", "chunk"]).select("contig", "pos", F.col("begun").alias("here"), *[(F.col(f"{c}_before") + F.sum(c).over(inside)).alias(c) for c in sums])
    rows = rows.withColumn("bases", F.col("pos") * (F.col("begun") - F.col("over")) - F.col("moment"))
    starts = rows.select("contig", F.col("pos").alias("start0"), "over", F.col("bases").alias("bases0"))
    ends = rows.select("contig", F.col("pos").alias("end0"), (F.col("begun") - F.col("here")).alias("begun"), F.col("bases").alias("bases1"))
    met = places.join(starts, ["contig", "start0"]).join(ends, ["contig", "end0"]).where("begun > over")
    return met.select(*KEY, (F.col("times") * (F.col("begun") - F.col("over"))).alias("pairs"), (F.col("times") * (F.col("bases1") - F.col("bases0"))).alias("bases"))


def _islands(rows: DataFrame, parts: list[str], strict: bool) -> DataFrame:
    order = Window.partitionBy(*parts).orderBy("start0", "end0")
    reach = F.max("end0").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start0") >= reach if strict else F.col("start0") > reach
    marked = rows.withColumn("__new", F.when(reach.isNull() | apart, 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*parts, "__island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"))


def merge_intervals(rows: DataFrame, strict: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The union of intervals; those that only touch become one too, unless `strict` asks for an overlap.

    Intervals are merged by the chunk in which they begin, then each contig's results once more; so one task orders a
    chunk, and afterwards only what is left of a contig.
    """
    rows = rows.where("start0 < end0").select(*KEY).withColumn("__chunk", F.floor(F.col("start0") / chunk))
    near = _islands(rows, ["contig", "__chunk"], strict)
    return _islands(near, ["contig"], strict).select(*KEY)


def total_length(rows: DataFrame, merged: bool = True) -> DataFrame:
    """(contig, masked): bases in the intervals of each contig; overlaps count once unless merged is off."""
    rows = merge_intervals(rows) if merged else rows
    return rows.groupBy("contig").agg(F.sum(F.col("end0") - F.col("start0")).alias("masked"))


def in_contig_order(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows in the order of the contig table (ord), then by start; unknown contigs last."""
    return rows.join(contigs.select("contig", "ord"), "contig", "left").orderBy(F.col("ord").asc_nulls_last(), "contig", "start0", "end0").drop("ord")
