"""Token counts: rollups by source, language and tokenizer version, kept up to date by signed deltas.

A change of a document carries the counts before and after it; its delta is the difference, so totals are sums of deltas and no
document is ever looked up. A batch of changes is aggregated to one row a key and committed under its name, once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.shared import materialize, scratch, table

#: Folder of the vocabulary files on every executor.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]


class ByteBpe:
    """A byte-level BPE from a rank file; loaded by each worker when first used."""

    def __init__(self, name: str, path: str):
        self.name, self.path, self.encoding = name, path, None

    def count(self, texts: Sequence[str]) -> list[int]:
        if self.encoding is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding(self.name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return [len(self.encoding.encode_ordinary(x)) if x else 0 for x in texts]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"encoding": None}


class Words:
    """Counts runs between spaces, tabs and line ends."""

    name = "words/1"

    def count(self, texts: Sequence[str]) -> list[int]:
        return [len(x.encode().split()) for x in texts]


def tokenizers(folder: str = TOKENIZERS) -> list:
    return [Words(), ByteBpe("byte_bpe_50k/1", os.path.join(folder, "byte_bpe_50k.tiktoken"))]


def without_repeated_lines(text: str) -> str:
    """The text without the lines that equal an earlier one; lines without a word stay."""
    lines = text.split("\n")
    seen: set[str] = set()
    out = [x for x in lines if not x.strip() or not (x in seen or seen.add(x))]
    return text if len(out) == len(lines) else "\n".join(out)


def measure(batches: Iterator[pa.RecordBatch], counters: list, steps: dict) -> Iterator[pa.RecordBatch]:
    """Adds a list of token counts (by counter) and bytes for the text itself and for what each step makes of it."""
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        keep = [n for n in batch.schema.names if n != "text"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in keep]
        base = [c.count(texts) for c in counters]
        made = [(base, [len(x.encode()) for x in texts])]
        for step in steps.values():
            new = [step(x) for x in texts]
            changed = [i for i, (x, y) in enumerate(zip(texts, new, strict=True)) if x is not y and x != y]
            counts = [list(c) for c in base]
            for c, counter in zip(counts, counters, strict=True):
                for i, n in zip(changed, counter.count([new[i] for i in changed]), strict=True):
                    c[i] = n
            made.append((counts, [len(x.encode()) for x in new]))
        for counts, sizes in made:
            columns += [pa.array([list(x) for x in zip(*counts, strict=True)], pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=keep + [f"{k}_{n}" for n in ["text", *steps] for k in ("tokens", "bytes")])


def measured(docs: DataFrame, counters: list, steps: dict | None = None) -> DataFrame:
    """docs with tokens_x (array by counter) and bytes_x in place of text, x being `text` and each step's name.

    Null and empty texts have no tokens. Repeated rows and ids each get their row. Given columns with the names of the added ones are replaced. An
    empty table gives no rows. A text is handed to the tokenizers whole, whatever its length.
    """
    steps = steps or {}
    docs = docs.drop(*[f"{k}_{n}" for n in ["text", *steps] for k in ("tokens", "bytes")])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    fields += [f"tokens_{n} array<bigint>, bytes_{n} bigint" for n in ["text", *steps]]
    return docs.mapInArrow(lambda it: measure(it, counters, steps), ", ".join(fields))


def counted(tokens: Column, size: Column) -> Column:
    """A document's counts, as `signed_deltas` takes them."""
    return F.struct(tokens.alias("tokens"), size.alias("bytes"))


def signed_deltas(changes: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a key for changes (source, lang, before, after); before and after are `counted`, or null.

    An insert has no before, a delete no after, a revision both. Null sources and languages are keys of their own. Changes are summed
    where they lie before they are shuffled, so one source may have any number of them. Keys whose sums are all 0 are left out.
    """

    def signs(which: str, sign: int) -> Column:
        return F.when(F.col(which).isNotNull(), F.array(*[
            F.struct(F.lit(n).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"), (F.col(f"{which}.tokens")[i] * sign).alias("n_tokens"), (F.col(f"{which}.bytes") * sign).alias("n_bytes"))
            for i, n in enumerate(names)
        ])).otherwise(F.array())

    rows = changes.select("source", "lang", F.explode(F.concat(signs("before", -1), signs("after", 1))).alias("d")).select("source", "lang", "d.*")
    out = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    return out.where(" or ".join(f"{c} <> 0" for c in SUMS))


class Rollup:
    """Totals by key in a folder that all executors share, kept up to date by every committed batch.

    A state is one folder with the totals and the names of the batches that they hold; a commit adds its deltas to the newest state and writes the
    next. A state counts from the moment at which Spark's committer marks its folder as complete. A job that dies before leaves a folder that the
    next attempt replaces, so any batch may be sent again at any time. One writer at a time; readers may read the state before the newest.
    """

    SCHEMA = ", ".join(["batch string", *[f"{k} string" for k in KEYS], *[f"{c} bigint" for c in SUMS]])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str = ""):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def states(self) -> list[int]:
        """Numbers of the complete states, in order."""
        top, files = self._folder()
        names = [x.getPath().getName() for x in files.listStatus(top)] if files.exists(top) else []
        found = sorted(int(n.removeprefix("state=")) for n in names if n.startswith("state="))
        return [k for k in found if files.exists(self._folder(f"state={k}/_SUCCESS")[0])]

    def _state(self) -> DataFrame:
        """The newest state: a row for each batch that it holds, whose key is null, and a row for each key, whose batch is null."""
        there = self.states()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/state={there[-1]}") if there else self.spark.createDataFrame([], self.SCHEMA)

    def committed(self, batch: str) -> bool:
        return bool(self._state().where(F.col("batch") == batch).limit(1).count())

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds the deltas (see `signed_deltas`) unless a batch of that name is in the totals; False if one is."""
        if self.committed(batch):
            return False
        there, now = self.states(), self._state()
        rows = now.where("batch is null").select(*KEYS, *SUMS).unionByName(deltas.select(*KEYS, *SUMS))
        totals = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where(" or ".join(f"{c} <> 0" for c in SUMS))
        names = now.where("batch is not null").select("batch").unionByName(self.spark.range(1).select(F.lit(batch).alias("batch")))
        out = totals.withColumn("batch", F.lit(None).cast("string")).unionByName(names, allowMissingColumns=True)
        columns = [F.col(x.split()[0]) for x in self.SCHEMA.split(", ")]
        out.select(*columns).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state={there[-1] + 1 if there else 0}")
        for old in there[:-1]:
            where, files = self._folder(f"state={old}")
            files.delete(where, True)
        return True

    def totals(self) -> DataFrame:
        """The totals of all committed batches; keys without a document left are not shown."""
        return self._state().where("batch is null").select(*KEYS, *SUMS)


def op5_token_counts(spark, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Totals after three batches over all documents, the first sent twice.

    load inserts every text; revise replaces every text that has a line twice by the text without the repeats; dedup deletes
    every text, as revised, that equals one with a smaller doc_id as it was loaded. Rows that share the smallest id all stay; null ids do too.
    """
    counters = tokenizers(folder)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.xxhash64("text").alias("h1"), F.md5(F.coalesce("text", F.lit(""))).alias("h2"))
    rows = materialize(measured(docs, counters, {"unique": without_repeated_lines}), "tokens")
    loaded, revised = counted(F.col("tokens_text"), F.col("bytes_text")), counted(F.col("tokens_unique"), F.col("bytes_unique"))
    none = F.lit(None).cast("struct<tokens:array<bigint>,bytes:bigint>")
    names = [c.name for c in counters]
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = rows.join(first, ["h1", "h2"]).where("doc_id > first")
    rollup = Rollup(spark, scratch(spark, "rollup"))
    load = signed_deltas(rows.select("source", "lang", none.alias("before"), loaded.alias("after")), names)
    rollup.commit("load", load)
    rollup.commit("revise", signed_deltas(rows.where("bytes_text <> bytes_unique").select("source", "lang", loaded.alias("before"), revised.alias("after")), names))
    rollup.commit("load", load)
    rollup.commit("dedup", signed_deltas(copies.select("source", "lang", revised.alias("before"), none.alias("after")), names))
    return rollup.totals()
