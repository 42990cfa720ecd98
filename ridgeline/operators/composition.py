"""Reference sequences as chunks, and the base composition of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.intervals import KEY

CHUNK = 65_536


def sequence_chunks(sequences: DataFrame, size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """(contig, chunk_start0, seq) of sequences (contig, seq): pieces of `size` bases, upper case, with `overlap` more at their end."""
    rows = sequences.where("length(seq) > 0").select("contig", F.upper("seq").alias("seq"), F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 1, F.lit(size).cast("long"))).alias("chunk_start0"))
    return rows.select("contig", "chunk_start0", F.substring("seq", (F.col("chunk_start0") + 1).cast("int"), F.lit(size + overlap)).alias("seq"))


def contigs_of_chunks(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(contig, len) of a reference, as a FASTA index has them."""
    return chunks.groupBy("contig").agg(F.max(F.col("chunk_start0") + F.least(F.length("seq"), F.lit(size))).cast("long").alias("len"))


#: Bases of the pieces that windows are joined to, so that a row carries little more than its window.
PIECE = 512


def pieces(chunks: DataFrame, size: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """(contig, piece_start0, seq): chunks cut small, without their overlap."""
    at = F.explode(F.sequence(F.lit(0), F.least(F.length("seq"), F.lit(size)) - 1, F.lit(piece)))
    rows = chunks.where("length(seq) > 0").select("contig", "chunk_start0", F.substring("seq", 1, size).alias("seq"), at.alias("at"))
    return rows.select("contig", (F.col("chunk_start0") + F.col("at")).alias("piece_start0"), F.substring("seq", F.col("at") + 1, F.lit(piece)).alias("seq"))


def window_pieces(windows: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(contig, start0, end0, piece_start0, seq): the parts of each distinct window, a null seq for what the reference doesn't have.

    The chunk size must be a multiple of a piece's.
    """
    low = (F.floor(F.greatest("start0", F.lit(0)) / PIECE) * PIECE).cast("long")
    parts = windows.select(*KEY).distinct().withColumn("piece_start0", F.explode(F.sequence(low, F.greatest(F.col("end0") - 1, low), F.lit(PIECE).cast("long"))))
    begin = F.greatest(F.col("start0") - F.col("piece_start0"), F.lit(0).cast("long"))
    n = F.greatest(F.least(F.col("end0"), F.col("piece_start0") + PIECE) - F.col("piece_start0") - begin, F.lit(0).cast("long"))
    return parts.join(pieces(chunks, size), ["contig", "piece_start0"], "left").select(*KEY, "piece_start0", F.substring("seq", (begin + 1).cast("int"), n.cast("int")).alias("seq"))


def window_sequences(windows: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Distinct windows with their bases; '' on an unknown contig."""
    rows = window_pieces(windows, chunks, size).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("piece_start0", "seq"))).alias("ps"))
    return rows.select(*KEY, F.array_join(F.transform("ps", lambda p: F.coalesce(p["seq"], F.lit(""))), "").alias("seq"))


def letters(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def ratios(a: Column, c: Column, g: Column, t: Column, n: Column) -> dict[str, Column]:
    """Shares of A and G, C and T, G and C in all letters, with four decimals; 0 for no letters."""
    share = lambda x, y: F.when(n > 0, F.bround((x + y) / n.cast("double"), 4)).otherwise(F.lit(0.0))
    return {"ag": share(a, g), "ct": share(c, t), "gc": share(g, c)}


def composition(windows: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(contig, start0, end0, ag, ct, gc) of distinct windows. A window's letters are counted in each piece that it touches and added up."""
    cut = window_pieces(windows, chunks, size)
    seq = F.upper("seq")
    sums = cut.groupBy(*KEY).agg(*[F.coalesce(F.sum(letters(seq, x)), F.lit(0).cast("long")).alias(x) for x in "acgt".upper()], F.coalesce(F.sum(F.length(seq)), F.lit(0).cast("long")).alias("n"))
    return sums.select(*KEY, *[c.alias(n) for n, c in ratios(*[F.col(x) for x in "ACGT"], F.col("n")).items()])
