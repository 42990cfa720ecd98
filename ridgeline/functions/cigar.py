"""CIGAR strings as arrays, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that move along the reference.
ON_REFERENCE = ("M", "D", "N", "=", "X")


def cigar_pairs(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string; empty for null, '' and '*'."""
    pattern = F.lit("([0-9]+)([MIDNSHP=X])")
    text = F.coalesce(cigar, F.lit(""))
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(2)).alias("op"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("n"))
    return F.transform(zipped, lambda x: F.struct(x["op"].alias("op"), x["n"].cast("long").alias("len")))


def cigar_ops(cigar: Column, start0: Column, keep=None) -> Column:
    """array<struct<idx, op, len, ref0, ref1>>: the operations with their place on the reference.

    keep(op, len, idx) chooses operations. The walk carries its position along; only kept operations are copied, so a long read with
    thousands of short operations costs little if few of them matter.
    """
    pairs = cigar_pairs(cigar)
    kind = "array<struct<idx:int,op:string,len:bigint,ref0:bigint,ref1:bigint>>"
    begin = F.struct(start0.cast("long").alias("pos"), F.lit(0).alias("idx"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["pos"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(F.lit(0).cast("long"))
        one = F.struct(acc["idx"].alias("idx"), x["op"].alias("op"), x["len"].alias("len"), acc["pos"].alias("ref0"), after.alias("ref1"))
        out = F.concat(acc["out"], F.array(one))
        if keep is not None:
            out = F.when(keep(x["op"], x["len"], acc["idx"]), out).otherwise(acc["out"])
        return F.struct(after.alias("pos"), (acc["idx"] + 1).alias("idx"), out.alias("out"))

    return F.aggregate(pairs, begin, step, lambda acc: acc["out"])


def cigar_span(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    return F.aggregate(cigar_pairs(cigar), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(F.lit(0).cast("long")))


def is_clipped(cigar: Column) -> Column:
    return cigar.rlike("[SH]")


def split_count(sa: Column) -> Column:
    """Supplementary alignments that an SA tag lists; 0 without a tag."""
    return F.coalesce(F.size(F.filter(F.split(sa, ";"), lambda x: x != "")), F.lit(0)).cast("long")
