"""URL filters: a sort-merge range join of urls with nested host and path rules.

Hosts are reversed label by label ("org.example.www."), so a rule's host is a prefix, that is an interval, of the sorted
keys. Urls and rules are dealt to key ranges, each rule to all ranges that its interval touches, and one sweep over each
sorted range keeps a stack of the rules whose interval holds the present key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import ascii_lower, table

#: Sampled keys for each range; the ranges' bounds are the only thing that reaches the driver.
SAMPLES = 16
#: Above every character of a key.
LAST = chr(0x10FFFF)

#: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lowered; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


class Node:
    """The rules of one host on the stack; paths come sorted, and `up` leads to the next shorter path that is a prefix."""

    def __init__(self, key: str):
        self.key, self.paths, self.up, self.verdicts, self.rules, self.open = key, [], [], [], [], []

    def add(self, path: str, verdict: str, rule: str) -> None:
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.verdicts[-1] = verdict
            return
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        self.up.append(self.open[-1] if self.open else -1)
        self.open.append(len(self.paths))
        self.paths.append(path)
        self.verdicts.append(verdict)
        self.rules.append(rule)

    def find(self, path: str) -> int:
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.up[k]
        return k


def sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    stack: list[Node] = []
    at = None
    for batch in batches:
        out = []
        for part, key, kind, path, verdict, rule, url_id, host in batch[["part", "key", "kind", "path", "verdict", "rule", "id", "host"]].itertuples(index=False, name=None):
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Node(key))
                stack[-1].add(path, verdict, rule)
                continue
            best = None
            for depth, node in enumerate(stack):
                if (k := node.find(path)) >= 0:
                    length = len(node.key) + len(node.paths[k])
                    if best is None or (length, depth) > best[:2]:
                        best = (length, depth, node.rules[k], node.verdicts[k])
            out.append((url_id, host, path, best and best[2], best[3] if best else default))
        if out:
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"]).astype({"id": "Int64"})


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of `urls`, by `rules` (verdict, host, path).

    A rule fits its host and all subdomains where the url's path starts with the rule's. The rule with the most characters
    of host and path wins, the longer host on a tie; block wins over allow for the same host and path. Without a rule
    the verdict is `default`. Rules with a null are ignored. Null urls and urls without :// have an empty host and path. Repeated
    rows are judged one by one; null ids are kept; other columns are ignored; no rules, or no urls, is fine.
    A task holds the rules of the hosts above one key, and a batch of urls. A host with many urls spans several ranges, since they are cut by
    (key, path, id).
    """
    spark = urls.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = urls.select(F.col(id_col).cast("long").alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    # at most SAMPLES * n keys, chosen by hash; they set where ranges begin, not what is found
    some = rows.orderBy(F.xxhash64("id", "key", "path")).limit(SAMPLES * n).select("key", "path", "id")
    keys = sorted((r[0], r[1], -1 if r[2] is None else r[2]) for r in some.collect())
    bounds = keys[SAMPLES::SAMPLES]

    @F.pandas_udf("int")
    def part_of(key: pd.Series, path: pd.Series, row_id: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in zip(key, path, row_id, strict=True)], dtype="int32")

    good = rules.select(F.col("verdict"), ascii_lower(F.col("host")).alias("host"), F.col("path")).dropna()
    low = F.lit(-(2**63)).cast("long")
    good = good.withColumn("key", host_key(F.col("host"))).select(
        "key",
        F.lit(0).alias("kind"),
        "path",
        "verdict",
        F.concat("host", "path").alias("rule"),
        part_of("key", F.lit(""), low).alias("first"),
        part_of(F.concat("key", F.lit(LAST)), F.lit(""), low).alias("last"),
    )
    good = good.withColumn("part", F.explode(F.sequence("first", "last"))).drop("first", "last")
    rows = rows.withColumns({"kind": F.lit(1), "part": part_of("key", "path", F.coalesce("id", F.lit(-1).cast("long")))})
    both = rows.unionByName(good, allowMissingColumns=True)
    swept = both.repartition(F.col("part")).sortWithinPartitions("part", "key", "kind", "path")
    out = swept.mapInPandas(lambda it: sweep(it, default), "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT u.page_id, u.host, u.path, r.verdict, concat(r.host, r.path) AS rule,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, concat('.', r.host))) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, CASE WHEN verdict IS NULL THEN NULL ELSE rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
