"""FASTA files as chunks of bases.

Lines are read with their byte offsets by Hadoop's text format, so one file is read by many tasks from any file system; a line's
contig and place follow from its offset and the headers'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.operators.composition import CHUNK

TEXT = ("org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    pairs = spark.sparkContext.newAPIHadoopFile(path, *TEXT, conf={"textinputformat.record.delimiter": "\n"})
    return spark.createDataFrame(pairs, "offset bigint, line string")


#: Bytes of a file in which a line looks for its header.
BUCKET = 1 << 24


def _headers(lines: DataFrame) -> DataFrame:
    """(offset, contig, first): each header with the offset at which its bases begin."""
    name = F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("contig")
    return lines.where(F.col("line").startswith(">")).select("offset", name, (F.col("offset") + F.octet_length("line") + F.col("cr") + 1).alias("first"))


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(offset, line, cr): the lines without their ends; cr counts carriage returns."""
    return _lines(spark, path).select("offset", F.regexp_replace("line", "\r$", "").alias("line"), F.col("line").endswith("\r").cast("int").alias("cr"))


def fasta_order(spark: SparkSession, path: str) -> DataFrame:
    """(contig, ord): the contigs with numbers that rise in the order of the file."""
    return _headers(fasta_lines(spark, path)).groupBy("contig").agg(F.min("offset").alias("ord"))


def read_fasta(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = 0) -> DataFrame:
    """(contig, chunk_start0, seq): the file's sequences in upper case, `chunk` bases a row and `overlap` more.

    A contig's name is the first word of its header. As in an indexed FASTA, all lines of a contig but the last have the same length.
    """
    lines = fasta_lines(spark, path)
    end = (lines.agg(F.max("offset")).first()[0] or 0) + 1
    heads = _headers(lines)
    heads = heads.select("contig", "first", F.coalesce(F.lead("offset").over(Window.orderBy("offset")), F.lit(end)).alias("stop"))  # a row a contig
    reach = F.sequence(F.floor(F.col("first") / BUCKET), F.floor((F.col("stop") - 1) / BUCKET))
    heads = heads.where("first < stop").withColumn("bucket", F.explode(reach))
    own = lines.where(~F.col("line").startswith(">") & (F.length("line") > 0)).withColumn("bucket", F.floor(F.col("offset") / BUCKET))
    bases = own.join(heads, "bucket").where("offset >= first and offset < stop").drop("bucket")
    width = bases.where(F.col("offset") == F.col("first")).select(F.col("contig").alias("c"), F.length("line").alias("n"), (F.length("line") + F.col("cr") + 1).alias("w"))
    placed = bases.join(width, F.col("contig") == F.col("c")).select("contig", (F.floor((F.col("offset") - F.col("first")) / F.col("w")) * F.col("n")).alias("pos"), F.upper("line").alias("line"))
    # a line goes to every chunk that needs some of it
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - overlap) / chunk)) * chunk
    high = F.floor((F.col("pos") + F.length("line") - 1) / chunk) * chunk
    parts = placed.withColumn("chunk_start0", F.explode(F.sequence(low.cast("long"), high.cast("long"), F.lit(chunk).cast("long"))))
    whole = parts.groupBy("contig", "chunk_start0").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "")
    skip = F.greatest(F.col("chunk_start0") - F.col("ls")[0]["pos"], F.lit(0))
    return whole.select("contig", "chunk_start0", F.substring(text, (skip + 1).cast("int"), F.lit(chunk + overlap)).alias("seq"))


def fasta_index(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(contig, len) from chunks."""
    return chunks.groupBy("contig").agg(F.max(F.col("chunk_start0") + F.least(F.length("seq"), F.lit(chunk))).cast("long").alias("len"))


def select_contigs(chunks: DataFrame, contigs: DataFrame) -> DataFrame:
    """The chunks of some contigs."""
    return chunks.join(contigs.select("contig").distinct(), "contig", "left_semi")
