"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded digest within their source and ranked there; sorting all rows by fractional rank mixes the
sources in proportion everywhere, so that equal cuts of that order all match the mixture.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import hex_bucket, ranked, table

SEED = "ridgeline-shards-1"
#: Pieces into which the common order is cut for sorting.
PIECES = 4096


def seeded(seed: str, *parts: Column) -> Column:
    """A digest of the seed and the parts; null and empty differ."""
    shown = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(seed), *shown))


def shard_rows(
    rows: DataFrame, n_shards: int, id_col: str = "doc_id", source_col: str = "source", ties: Sequence[str] = (), seed: str = SEED
) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (gapless from 0 in each shard); shard sizes differ by one row at most.

    Law `rows`: the row at place p of the common order goes to shard floor(p * n_shards / rows). Rows of one source and equal id
    are ordered by `ties`, so only rows equal in all of these could change places. A null source is a source of its own, null ids
    are one id. Columns named shard or slot are replaced; an empty table stays empty. Two shuffles of the given columns; each task
    sorts a 4096th of a source, then a 4096th of all rows, so no source is too large.
    """
    rows = rows.drop("shard", "slot")
    names = rows.columns
    work = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).alias("s"), seeded(seed, F.col(id_col)).alias("h"))
    tie = [F.col(f"row.`{c}`") for c in (id_col, *ties)]
    work = ranked(work.withColumn("b", hex_bucket(F.col("h"))), ["s"], "b", [F.col("h"), *tie], "k")
    start = (F.conv(F.substring(seeded(seed + "/start", F.col("s")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    work = work.withColumn("f", (F.col("k").cast("double") + start) / F.col("k_total").cast("double"))
    work = work.withColumn("g", F.floor(F.col("f") * PIECES).cast("long"))
    order = [F.col("f"), F.col("s").asc_nulls_last(), F.col("h"), *tie]
    work = ranked(work.drop("k", "k_total"), [], "g", order, "p")
    shard = F.expr(f"cast((p * {n_shards}) div p_total as int)")
    first = F.expr(f"(shard * p_total + {n_shards - 1}) div {n_shards}")
    work = work.withColumn("shard", shard).withColumn("slot", F.col("p") - first)
    return work.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "shard", "slot")


def op3_shards(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    out = shard_rows(docs, 16, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is worked out byte by byte from its polynomial's table.
OP3_SQL = r"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)
), tab AS (SELECT list(v ORDER BY i) AS t FROM bits), d AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, hex(coalesce(text, '')) AS x, md5(concat('ridgeline-shards-1|', coalesce(concat('=', doc_id), '-'))) AS h FROM documents
), c AS (
  SELECT doc_id, source, size, h, xor(4294967295, list_reduce(
    list_prepend(cast(4294967295 AS bigint), list_transform(range(0, length(x), 2), lambda i: cast(concat('0x', substr(x, cast(i + 1 AS bigint), 2)) AS bigint))),
    lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM d, tab
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS k, count(*) OVER (PARTITION BY source) AS n,
    (cast(concat('0x', substr(md5(concat('ridgeline-shards-1/start|', coalesce(concat('=', source), '-'))), 1, 8)) AS bigint) + 0.5e0) / 4294967296.0e0 AS start FROM c
), p AS (
  SELECT *, row_number() OVER (ORDER BY (k + start) / cast(n AS double), source NULLS LAST, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS p, count(*) OVER () AS total FROM k
)
SELECT doc_id, cast(size AS bigint) AS size, cast(text_crc32 AS bigint) AS text_crc32, 'rows' AS law, cast(p * 16 // total AS int) AS shard,
  cast(p - ((p * 16 // total) * total + 15) // 16 AS bigint) AS slot, cast(NULL AS int) AS grown_shard FROM p
"""
