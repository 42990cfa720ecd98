"""A training corpus from `documents`: quality rules, near-duplicates, decontamination, mixing and sharding.

Every stage keeps all columns as they are, whatever their names; `doc_id`, `text`, `lang` and `source` are the ones that it looks at.
Empty tables stay empty. Stages that rank or choose rows do so for short rows, and every text is moved once to meet the result. Scratch tables that led to it go before that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.decontaminate import contaminated
from ridgeline.llm.mixing import mix, word_count
from ridgeline.llm.ngram_join import jaccard_components
from ridgeline.llm.quality import kept_rows
from ridgeline.llm.shared import materialize, placed, settled, table
from ridgeline.llm.sharding import shard_rows

SHARDS = 16


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject; null, empty and short texts go. Repeated rows share their fate."""
    return kept_rows(docs)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Documents without a word are in no group and stay. Rows are told apart by where they stand if an id is null or repeated: different texts under one
    id both stay, of repeated rows one does. Null ids come last.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not odd.limit(1).count():
        found = lambda: jaccard_components(docs.select("doc_id", "text"), size=5, percent=80)
        gone = settled(spark, lambda: found().where("component_id <> doc_id").select("doc_id"), "pipeline")
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = placed(docs).select("row", F.xxhash64("file", "at").alias("key"))
    near = lambda: jaccard_components(rows.select(F.col("key").alias("doc_id"), "row.text"), size=5, percent=80)
    found = settled(spark, lambda: near().select(F.col("doc_id").alias("key"), "component_id"), "pipeline")
    order = F.struct(F.col("row.doc_id").isNull().alias("null"), F.col("row.doc_id").alias("doc_id"), "key")
    ranks = found.join(rows.select("key", order.alias("order")), "key")
    first = ranks.groupBy("component_id").agg(F.min("order")["key"].alias("key"))
    gone = materialize(found.join(first, "key", "left_anti").select("key"), "pipeline")
    return rows.join(gone, "key", "left_anti").select("row.*")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item or edited copy of one. Null and empty texts stay; repeated rows share their fate."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    found = lambda: contaminated(rows.select(F.col("key").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hits = settled(spark, lambda: found().select(F.col("doc_id").alias("key")).distinct(), "pipeline")
    return rows.join(hits, "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for; those without a word are left out.

    Blocks of words are chosen over a few short columns; a document comes as often as the block of its middle word. A null source is a
    source. Repeated rows are mixed one by one; which of them comes more often is open, and makes no difference.
    """
    rows = placed(docs)
    name = F.struct("row.doc_id", F.xxhash64("row.text")).cast("string").alias("name")
    slim = rows.select("row.source", word_count(F.col("row.text")).alias("size"), name, "file", "at")
    taken = settled(spark, lambda: mix(slim, id_col="name").where("copies > 0").select("file", "at", "copies"), "pipeline")
    out = rows.join(taken, ["file", "at"])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; given columns of these names are replaced. Rows of equal id and text take any order among them."""
    rows = placed(docs.drop("shard", "slot"))
    slim = rows.select("row.doc_id", "row.source", F.xxhash64("row.text").alias("tie"), "file", "at")
    shards = settled(spark, lambda: shard_rows(slim, SHARDS, ties=("tie",)).select("file", "at", "shard", "slot"), "pipeline")
    return rows.join(shards, ["file", "at"]).select("row.*", "shard", "slot")


STAGES = [("quality", keep_good), ("near_duplicates", keep_first), ("decontamination", keep_clean), ("mixing", mix_sources), ("sharding", cut_shards)]

#: The quality rules' iterated estimates have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
