"""Text formats: FASTA indexes, BED, bedGraph and tab-separated results, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.schema import CONTIGS, DEPTH_RUNS, INTERVALS


def _text_rows(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """The leading tab-separated fields of each line as strings; empty lines and comments go."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return lines.select(*[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(contig, len, ord, offset, line_bases, line_width) of a FASTA index; ord follows the offsets, as the file does.

    Lines with fewer than two fields or without a length are left out; an index of two columns has null offsets and takes ord by name.
    """
    rows = _text_rows(spark, path, ["contig", "len", "offset", "line_bases", "line_width"])
    rows = rows.select("contig", *[F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("len", "offset", "line_bases", "line_width")]).where("len is not null")
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.orderBy(F.col("offset").asc_nulls_last(), "contig")) - 1  # a row a contig
    return rows.withColumn("ord", order.cast("long")).select(*CONTIGS.fieldNames(), "offset", "line_bases", "line_width")


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, start0, end0) of one or more BED files, plain or gzip; lines with fewer than three fields or bad numbers are left out."""
    rows = _text_rows(spark, path, INTERVALS.fieldNames())
    return rows.select("contig", F.expr("try_cast(start0 as bigint)").alias("start0"), F.expr("try_cast(end0 as bigint)").alias("end0")).where("start0 is not null and end0 is not null")


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, start0, end0, depth) of a bedGraph with whole depths."""
    rows = _text_rows(spark, path, DEPTH_RUNS.fieldNames())
    return rows.select("contig", *[F.expr(f"try_cast({c} as bigint)").alias(c) for c in DEPTH_RUNS.fieldNames()[1:]]).dropna()


def read_window_depth(spark: SparkSession, path: str | list[str], size: int) -> DataFrame:
    """(contig, start0, depth) of a regions BED with mean depths; starts are moved down to whole windows."""
    rows = _text_rows(spark, path, ["contig", "start0", "end0", "depth"])
    rows = rows.select("contig", F.expr("try_cast(start0 as bigint)").alias("start0"), F.expr("try_cast(depth as double)").alias("depth")).dropna()
    return rows.withColumn("start0", (F.floor(F.col("start0") / size) * size).cast("long"))


def read_mappability(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, start0, end0) of the bedGraph rows whose mappability isn't 1."""
    rows = _text_rows(spark, path, ["contig", "start0", "end0", "value"])
    rows = rows.select("contig", F.expr("try_cast(start0 as bigint)").alias("start0"), F.expr("try_cast(end0 as bigint)").alias("end0"), F.expr("try_cast(value as double)").alias("value"))
    return rows.where("value <> 1").dropna().drop("value")


def read_support(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, start0, end0, min_support, avg_depth), found as the last five fields of each line, after any number of others.

    A window that stands in several lines takes the last of them; lines with fewer than five fields are left out.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parts = F.split("value", "\t")
    at = lambda k: F.try_element_at(parts, F.lit(k - 5))
    rows = lines.where(F.size(parts) >= 5).select("line", at(0).alias("contig"), *[F.expr(f"try_cast(try_element_at(split(value, '\\t'), {k - 5}) as {t})").alias(n) for k, n, t in ((1, "start0", "bigint"), (2, "end0", "bigint"), (3, "min_support", "bigint"), (4, "avg_depth", "double"))])
    last = rows.dropna().groupBy("contig", "start0", "end0").agg(F.max_by(F.struct("min_support", "avg_depth"), "line").alias("r"))
    return last.select("contig", "start0", "end0", "r.*")


#: The merged table of both platforms, as its sink writes it.
MERGED = T.StructType([*INTERVALS.fields, *[T.StructField(n, t) for n, t in (("hifi", T.LongType()), ("hifi_depth", T.DoubleType()), ("ont", T.LongType()), ("ont_depth", T.DoubleType()), ("ag", T.DoubleType()), ("ct", T.DoubleType()), ("gc", T.DoubleType()))]])


def read_merged_support(spark: SparkSession, path: str | list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """The merged support table; malformed rows are left out."""
    return spark.read.csv(path, schema=MERGED, sep=sep, header=header, mode="DROPMALFORMED")
