"""Identical regions: stretches of a haplotype whose k-mers stand in it more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.composition import CHUNK
from ridgeline.operators.intervals import extended, merge_intervals

U = np.uint64


def kmer_hashes(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """(contig, pos, h) of the k-mers that begin in each chunk and hold no N; h is a polynomial hash of 64 bits."""
    factor = U(0x9E3779B97F4A7C15)
    weights = np.multiply.accumulate(np.full(k, factor, U))[::-1]
    for batch in batches:
        for contig, start, seq in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            data = np.frombuffer(seq.encode(), np.uint8)
            n = min(size, len(data) - k + 1)
            if n <= 0:
                continue
            h = np.zeros(n, U)
            for j in range(k):
                h += data[j : j + n].astype(U) * weights[j]
            bad = np.concatenate([[0], np.cumsum(data == ord("N"))])
            pos = np.flatnonzero(bad[k : k + n] == bad[:n])
            yield pa.RecordBatch.from_arrays([pa.array([contig] * len(pos), pa.string()), pa.array(pos + start, pa.int64()), pa.array(h[pos].view(np.int64))], names=["contig", "pos", "h"])


def repeated_kmers(chunks: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """(contig, pos) of the k-mers that occur more than once in their haplotype. chunks (haplotype, contig, chunk_start0, seq) overlap by k - 1 bases.

    Only hashes are shuffled, summed before they are; the letters of those that repeat are fetched and compared.
    """
    owner = chunks.select("contig", "haplotype").distinct()
    hashed = chunks.select("contig", "chunk_start0", "seq").mapInArrow(lambda it: kmer_hashes(it, k, size), "contig string, pos bigint, h bigint").join(owner, "contig")
    many = hashed.groupBy("haplotype", "h").agg(F.count("*").alias("n")).where("n > 1").select("haplotype", "h")
    places = hashed.join(many, ["haplotype", "h"]).withColumn("chunk_start0", F.floor(F.col("pos") / size) * size)
    kmer = F.substring("seq", (F.col("pos") - F.col("chunk_start0") + 1).cast("int"), F.lit(k)).alias("kmer")
    letters = places.join(chunks.drop("haplotype"), ["contig", "chunk_start0"]).select("haplotype", "contig", "pos", kmer)
    twice = letters.groupBy("haplotype", "kmer").agg(F.count("*").alias("n")).where("n > 1").select("haplotype", "kmer")
    return letters.join(twice, ["haplotype", "kmer"], "left_semi").select("contig", "pos")


def identical_regions(chunks: DataFrame, contigs: DataFrame, k: int = 150, size: int = CHUNK) -> DataFrame:
    """Merged regions that repeated k-mers cover, for each haplotype by itself.

    contigs has contig, len and haplotype; contigs without a haplotype are left out. Runs of repeated positions are made k longer at their end and cut at the contig's.
    """
    own = chunks.join(contigs.where("haplotype is not null").select("contig", "haplotype"), "contig")
    found = repeated_kmers(own, k, size)
    runs = merge_intervals(found.select("contig", F.col("pos").alias("start0"), (F.col("pos") + 1).alias("end0")))
    return merge_intervals(extended(runs, contigs, k))


def suffix_counts(contigs: DataFrame) -> DataFrame:
    """(suffix, n, first): contigs by what follows their last _, with the first one's order; names without _ don't count."""
    named = contigs.where(F.col("contig").contains("_"))
    return named.groupBy(F.substring_index("contig", "_", -1).alias("suffix")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def haplotype_suffixes(contigs: DataFrame) -> DataFrame:
    """The two most frequent suffixes; of equally frequent ones those that come first."""
    return suffix_counts(contigs).orderBy(F.desc("n"), "first").limit(2)


def haplotypes(contigs: DataFrame) -> DataFrame:
    """Contigs with their haplotype, the suffix of their name if it is one of the two most frequent ones."""
    top = haplotype_suffixes(contigs).select(F.col("suffix").alias("haplotype"))  # two rows
    own = F.when(F.col("contig").contains("_"), F.substring_index("contig", "_", -1))
    return contigs.join(F.broadcast(top), own == F.col("haplotype"), "left")
