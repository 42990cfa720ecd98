"""What the operators of this subpackage share: scratch tables, ranks without a single task, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters lowered by `ascii_lower`.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir.

    Only where that setting is missing in a local session, as in tests, a folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridgeline-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runs what is inside with these session settings."""
    conf = spark.conf
    before = {k: conf.get(k, None) for k in values}
    for k, v in values.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


#: For steps that get whole texts as Python objects.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


#: Paths of the scratch tables written inside `settled`; each thread has its own.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, name: str, values: dict[str, str] | None = None) -> DataFrame:
    """The rows, written to the shared folder under these settings and read back.

    This cuts the lineage, survives the loss of any executor and gives later plans a measured size.
    """
    path = scratch(df.sparkSession, name)
    if (paths := _written.get()) is not None:
        paths.append(path)
    with settings(df.sparkSession, values or {}):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables as `materialize` returns them. Nothing may read these any more."""
    for df in tables:
        delete(df.sparkSession, df.scratch)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, as `materialize` has it; the scratch tables written on the way are deleted. Nothing else may still read these."""
    token = _written.set(paths := [])
    try:
        made = make()
    finally:
        _written.reset(token)
    out = materialize(made, name)
    for path in paths:
        delete(spark, path)
    return out


#: A join of texts with the few that are wanted drops most others by a Bloom filter before they are shuffled, which Spark limits
#: to 8 MB whatever the size of the tables. The wanted side must hold a comparison, by which Spark sees that a filter is worth it.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


#: Shuffle files go as soon as the rows are written, not when the driver happens to collect its garbage.
PASSING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def filed(docs: DataFrame) -> DataFrame:
    """docs if its rows come straight from files, else docs written and read back."""
    try:
        docs.metadataColumn("_metadata")
        return docs
    except AnalysisException:
        return materialize(docs, "placed")


def placed(docs: DataFrame) -> DataFrame:
    """(row, file, at): each row of docs as a struct, and where it stands. Rows that come from no file are written first."""
    docs = filed(docs)
    place = docs.metadataColumn("_metadata")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))


def hex_bucket(digest: Column, digits: int = 3) -> Column:
    """The leading hex digits of a digest as a number: 16**digits buckets that follow the digest's order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def ranked(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], out: str = "rank", weight: str | None = None
) -> DataFrame:
    """Adds `out`, the 0-based rank of each row in its group (or the sum of `weight` over the rows before it), and `out`_total.

    `bucket` must rise with `order` within a group and deal a group's rows evenly: only a (group, bucket) is sorted in one task,
    however large the group. Bucket totals are summed over the few buckets of a group. Group keys may be null.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(w).alias("__sum"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = sums.select(
        *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__sum").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("__before"),
        F.sum("__sum").over(over).alias(f"{out}_total"),
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.join(sums, same)
        .withColumn(out, F.col("__before") + F.sum(w).over(inner) - w)
        .drop("__before", *[f"__{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that can be reached.

    Each round every node hooks to its smallest neighbour, pointers are followed twice, and edges are rewritten to the
    pointers and made distinct; at least half of the nodes with an edge vanish in a round. All rounds are aggregations and
    joins; the loop only asks whether an edge is left. Null ends are ignored.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    parents: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("p"))
        hook = materialize(hook, name)
        for _ in range(2):
            up = hook.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p").select("id", F.col("pp").alias("p"))
        hook = materialize(hook, name)
        parents.append(hook)
        left, right = (hook.select(F.col("id").alias(k), F.col("p").alias(f"p{k}")) for k in "ab")
        edges = edges.join(left, "a").join(right, "b").where("pa <> pb")
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
    if not parents:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = parents[0].withColumnRenamed("p", "component")
    for up in parents[1:]:
        up = up.select(F.col("id").alias("component"), F.col("p").alias("__up"))
        out = out.join(up, "component", "left").select("id", F.coalesce("__up", "component").alias("component"))
    return out


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key, for batches in which equal keys stand together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[key] != batch[key].shift()).to_numpy().nonzero()[0].tolist()
        for start, end in zip(change, [*change[1:], len(batch)], strict=True):
            part = batch.iloc[start:end]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def map_runs(df: DataFrame, key: str, each: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Applies `each` to the rows of every key; one Python call serves many keys, so small groups cost little."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, key):
            out = each(rows)
            if out is not None and len(out):
                yield out

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInPandas(run, schema)
