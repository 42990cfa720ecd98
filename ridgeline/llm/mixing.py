"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.shared import WORD, hex_bucket, materialize, ranked, table
from ridgeline.llm.sharding import seeded

SEED = "ridgeline-mix-1"
BLOCK = 64
SHARDS = 16
#: A prime above any number of blocks of a source, so that multiplying by it runs through all of them.
PRIME = 2305843009213693951


def cycled_weights(totals: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds weight to (source, source_size): sources by code point, null last, take the weights in turn."""
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights)) + 1))


def targets(weighted: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target to (source, source_size, weight): `share` of all sizes dealt out by weight, none above `most` times its size.

    What lies above a limit is dealt again by weight until none is above; that is the level at which the sum of
    min(limit, weight * level) is right, found over the sources in the order in which they reach their limits.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("__full", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = weighted.withColumn("__limit", F.col("source_size").cast("double") * most).withColumn("__full", F.col("__limit") / F.col("weight"))
    df = df.withColumn("__goal", F.sum(F.col("source_size").cast("double")).over(everything) * share)
    left = F.col("__goal") - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    df = df.withColumn("__level", left / F.sum("weight").over(after))
    # the first source that its level doesn't fill sets the level of all that come after
    level = F.coalesce(F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", F.col("__level").alias("v")))).over(everything)["v"], F.max("__full").over(everything))
    return df.withColumn("target", F.least(F.col("__limit"), F.col("weight") * level)).drop("__limit", "__full", "__goal", "__level")


def apportion(votes: DataFrame, seats: Column, by: str = "source", votes_col: str = "target") -> DataFrame:
    """(house, source, seats) by Sainte-Lague for each house size in the array `seats`; ties go to the first by code point.

    Rounding votes over the mean divisor misses the house by less than half a seat a source. The seats near that
    are ranked by their quotients votes / (2k + 1); at most about five a source and house, so nothing grows with the seats.
    """
    all_rows = Window.partitionBy(F.lit(0))
    df = votes.withColumn("__all", F.sum(votes_col).over(all_rows)).withColumn("__n", F.count("*").over(all_rows)).where(f"{votes_col} > 0")
    df = df.withColumn("__house", F.explode(seats)).withColumn("house", F.col("__house.house")).withColumn("__seats", F.col("__house.seats"))
    fair = F.col(votes_col) / F.col("__all") * F.col("__seats")
    margin = F.ceil(F.col(votes_col) / F.col("__all") * (1.5 * F.col("__n") + 1)).cast("long") + 1
    df = df.withColumn("__low", F.greatest(F.lit(0).cast("long"), F.floor(fair + 0.5).cast("long") - margin)).withColumn("__high", F.floor(fair + 0.5).cast("long") + margin)
    house = Window.partitionBy("house")
    df = df.withColumn("__missing", F.col("__seats") - F.sum("__low").over(house))
    rows = df.select("house", by, "__low", "__missing", votes_col, F.explode(F.sequence("__low", "__high")).alias("__k"))
    rank = F.row_number().over(house.orderBy((F.col(votes_col) / (2 * F.col("__k") + 1)).desc(), F.col(by).asc_nulls_last(), "__k"))
    won = rows.withColumn("__won", (rank <= F.col("__missing")).cast("long"))
    return won.groupBy("house", by).agg((F.max("__low") + F.sum("__won")).alias("seats"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5, most: float = 2.0, block: int = BLOCK, n_shards: int = SHARDS, seed: str = SEED,
) -> DataFrame:
    """Adds source_size, target, taken, copies, shards and shard_blocks to each row; sizes are tokens.

    Each source's rows, in seeded order, form one run of tokens cut into blocks of `block`. The blocks of the whole mix are
    dealt to sources by highest quotients, shard after shard: shard_blocks has the source's quota in each of `n_shards` equal
    shards. Shard after shard draws its quota of the source's blocks, each going on in their seeded order where the one before ended and beginning anew when all
    are taken. `taken` is the number of the row's tokens in taken
    blocks, repeats counted, at most ceil(most) times its size; `copies` is how often the block of its middle token is taken, and `shards` has the
    shard of each copy. A source misses its
    target by a block or two.
    Sizes that are null count 0, such rows take nothing. A null source is a source; null ids are one id, and rows of equal id
    keep an order by size. Given columns with the names of the added ones are replaced. An empty table stays empty.
    Per-source tables have a row a source; a task sorts a 4096th of a source.
    """
    added = ["source_size", "target", "taken", "copies", "shards", "shard_blocks"]
    docs = docs.drop(*added)
    names = docs.columns
    work = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n"), seeded(seed, F.col(id_col)).alias("h")
    )
    work = materialize(work, "mix")  # texts are read and counted once
    totals = work.groupBy("source").agg(F.sum("n").alias("source_size"))
    goals = targets(cycled_weights(totals, weights), share, most)
    seats = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5).cast("long")
    goals = goals.withColumn("__seats", seats)
    houses = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda j: F.struct(j.alias("house"), F.floor(F.col("__seats") * j / n_shards).cast("long").alias("seats")))
    won = apportion(goals, houses)
    in_order = Window.partitionBy("source").orderBy("house")
    won = won.withColumn("quota", F.col("seats") - F.coalesce(F.lag("seats").over(in_order), F.lit(0).cast("long")))
    won = won.groupBy("source").agg(F.max_by("seats", "house").alias("quota"), F.transform(F.sort_array(F.collect_list(F.struct("house", "quota"))), lambda x: x["quota"]).alias("shard_blocks"))
    plan = goals.join(won.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select(
        F.col("source").alias("__source"), "source_size", "target", F.coalesce("quota", F.lit(0).cast("long")).alias("quota"), F.coalesce("shard_blocks", F.array().cast("array<bigint>")).alias("shard_blocks")
    )
    plan = materialize(plan, "mix")
    work = ranked(work.withColumn("b", hex_bucket(F.col("h"))), ["source"], "b", [F.col("h"), F.col("n")], "start", "n").drop("start_total", "h", "b")
    work = work.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    work = work.withColumn("nb", F.greatest(blocks, F.lit(1).cast("long")))
    work = work.withColumn("quota", F.least(F.col("quota"), F.col("nb") * int(most)))
    turn = F.conv(F.substring(seeded(seed + "/turn", F.col("source")), 1, 7), 16, 10).cast("long")
    work = work.withColumns({"full": F.expr("quota div nb"), "rest": F.expr("quota % nb"), "step": F.expr(f"{PRIME} % nb"), "turn": turn % F.col("nb")})

    def place(b: Column) -> Column:
        """A block's place in the source's seeded order: draw k of the shards' quotas, one after the other, is of place k % nb."""
        return ((b.cast("decimal(38,0)") * F.col("step") + F.col("turn")) % F.col("nb")).cast("long")

    def times(b: Column) -> Column:
        """How often a block is drawn."""
        return F.col("full") + F.when(place(b) < F.col("rest"), 1).otherwise(0)

    end = F.col("start") + F.col("n")
    inside = lambda b: F.least(end, (b + 1) * block) - F.greatest(F.col("start"), b * block)
    span = F.sequence(F.expr(f"start div {block}"), F.expr(f"greatest(start, start + n - 1) div {block}"))
    taken = F.when(F.col("n") > 0, F.aggregate(span, F.lit(0).cast("long"), lambda acc, b: (acc + inside(b) * times(b)).cast("long"))).otherwise(F.lit(0).cast("long"))
    middle = F.expr(f"(start + n div 2) div {block}")
    copies = F.when(F.col("n") > 0, times(middle)).otherwise(0).cast("int")
    work = work.withColumns({"taken": taken, "copies": copies, "middle": place(middle)})
    draws = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda r: F.col("middle") + r * F.col("nb"))).otherwise(F.array().cast("array<bigint>"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda j: F.aggregate(F.slice("shard_blocks", F.lit(1), j), F.lit(0).cast("long"), lambda acc, x: acc + x))
    work = work.withColumn("ends", ends)
    work = work.withColumn("shards", F.transform(draws, lambda t: F.size(F.filter("ends", lambda e: e <= t))))
    return work.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *added)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (text, source) as often as `mix` takes them: a row goes with the block of its middle word. Texts without a word are left out."""
    names = docs.columns
    sized = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.struct("doc_id", F.xxhash64("text")).cast("string").alias("__row"))
    out = mix(sized, id_col="__row", **options).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n, md5(concat('ridgeline-mix-1|', coalesce(concat('=', doc_id), '-'))) AS h FROM documents
), s AS (SELECT source, cast(sum(n) AS bigint) AS size FROM d GROUP BY source), w AS (
  SELECT *, [3.0e0, 1.0e0, 2.0e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0e0 * size AS lim FROM s
), f AS (
  SELECT *, lim / weight AS fill, (1.5e0 * sum(size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), g AS (
  SELECT source, size, least(lim, weight * coalesce((SELECT arg_min(level, fill) FROM f WHERE level <= fill), (SELECT max(fill) FROM f))) AS target FROM f
), q AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS seat
  FROM (SELECT source, target, unnest(range(cast(target AS bigint) // 64 + 100)) AS k FROM g WHERE target > 0)
), won AS (SELECT source, count(*) AS quota FROM q WHERE seat <= (SELECT floor(sum(target) / 64 + 0.5e0) FROM g) GROUP BY source), plan AS (
  SELECT g.*, greatest((g.size + 63) // 64, 1) AS nb, least(coalesce(won.quota, 0), 2 * greatest((g.size + 63) // 64, 1)) AS quota,
    cast(concat('0x', substr(md5(concat('ridgeline-mix-1/turn|', coalesce(concat('=', g.source), '-'))), 1, 7)) AS bigint) AS turn
  FROM g LEFT JOIN won ON won.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT d.*, cast(coalesce(sum(n) OVER (PARTITION BY source ORDER BY h, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start FROM d
), b AS (
  SELECT p.doc_id, p.h, p.n, p.start, plan.*, unnest(CASE WHEN p.n > 0 THEN range(p.start // 64, (p.start + p.n - 1) // 64 + 1) ELSE [NULL] END) AS b FROM p JOIN plan ON plan.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, cast(n AS bigint) AS size, cast(size AS bigint) AS source_size, target, cast(coalesce(sum((least(start + n, (b + 1) * 64) - greatest(start, b * 64))
  * (quota // nb + CASE WHEN (cast(b AS hugeint) * (2305843009213693951 % nb) + turn % nb) % nb < quota % nb THEN 1 ELSE 0 END)), 0) AS bigint) AS taken
FROM b GROUP BY doc_id, h, start, n, size, target
"""
