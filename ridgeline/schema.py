"""Schemas of the relations that cross module boundaries. Coordinates are 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("read_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("contig", T.StringType()),
        T.StructField("start0", T.LongType()),
        T.StructField("end0", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("seq_len", T.LongType()),
        T.StructField("nm", T.IntegerType()),
        T.StructField("sa", T.StringType()),
    ]
)
CONTIGS = T.StructType([T.StructField("contig", T.StringType()), T.StructField("len", T.LongType()), T.StructField("ord", T.LongType())])
INTERVALS = T.StructType([T.StructField("contig", T.StringType()), T.StructField("start0", T.LongType()), T.StructField("end0", T.LongType())])
DEPTH_RUNS = T.StructType([*INTERVALS.fields, T.StructField("depth", T.LongType())])
SUPPORT = T.StructType([*INTERVALS.fields, T.StructField("min_support", T.LongType()), T.StructField("avg_depth", T.DoubleType())])
REF_CHUNKS = T.StructType([T.StructField("contig", T.StringType()), T.StructField("chunk_start0", T.LongType()), T.StructField("seq", T.StringType())])
