"""The stateless read filters over a stream of Parquet reads; each record is judged by itself, so no watermark or state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ridgeline.config import ReadFilterConfig
from ridgeline.operators.reads import long_reads, perfect_reads
from ridgeline.schema import READS


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """Reads from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def filtered_stream(reads: DataFrame, short: bool, cfg: ReadFilterConfig = ReadFilterConfig()) -> DataFrame:
    return perfect_reads(reads) if short else long_reads(reads, cfg)


def write_stream(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, each input file once; runs until what is there is done."""
    return reads.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
