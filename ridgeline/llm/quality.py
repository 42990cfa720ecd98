"""Quality rules: fixed bounds, then robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of transformed statistics. For every language and source concentration steps over all texts go from several starts to
the mean and covariance of a central share of them; of what they come to, the estimate with the smallest determinant counts. Texts beyond a
Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import materialize, table
from ridgeline.llm.words import IS_SPACE, SPACES, STARTS_CHAR, mixed, per_text, pieces, shingles_of, words_of

SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Bounds of the fixed rules and of the outlier test.

    floors: for each statistic a spread that counts as none; it is added to every covariance, so that a statistic that is the same in most texts
    of a source doesn't make the others outliers. central: share of the texts that the estimate rests on. tail: the share of normal vectors that the
    outlier test would reject; its quantile of the chi-squared distribution is the cutoff of the squared distance. It is small since statistics of
    real texts have heavier tails, and what is clean should stay. settled: steps end when no determinant falls by more than this share, or after max_steps.
    min_group: a source with fewer texts takes the estimate of its language, and a language with fewer that of all texts.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    central: float = 0.75
    settled: float = 0.001
    max_steps: int = 12
    tail: float = 1e-8
    min_group: int = 30
    floors: tuple[float, ...] = (0.05, 0.04, 0.15, 0.15)


RULES = Rules()
DIMS = 4


def count_texts(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for piece in pieces(batch.column(batch.schema.get_field_index("text"))):
            words = words_of(piece, lower=False)
            inside = ~IS_SPACE[piece.data]
            grams, of = shingles_of(words, 3)
            whole = np.diff(words.begins) >= 3
            grams = grams + mixed(of.astype(np.uint64))  # the same window in two texts isn't a repeat
            _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
            twice = (times[inverse] > 1) & whole[of]
            # the k-th window of a text begins at its k-th word
            first_gram = np.searchsorted(of, np.arange(len(whole)))
            at = words.begins[of] + np.arange(len(of)) - first_gram[of]
            covered = np.zeros(len(words.hashes) + 2, bool)
            for j in range(3):
                covered[at[twice] + j] = True
            lines, again = lines_of(piece)
            parts.append(
                [
                    np.diff(words.begins),
                    per_text(inside & STARTS_CHAR[piece.data], piece.begins),
                    per_text(IS_SYMBOL[piece.data], piece.begins),
                    lines,
                    again,
                    per_text(covered[: len(words.hashes)], words.begins),
                ]
            )
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] if parts else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *columns], names=[*keep, *COUNTS])


def lines_of(piece) -> tuple[list[int], list[int]]:
    """For each text the lines with a word, and how many of them equal an earlier one."""
    raw = piece.data.tobytes()
    lines, again = [], []
    for a, b in zip(piece.begins[:-1].tolist(), piece.begins[1:].tolist(), strict=True):
        full = [x for x in raw[a:b].split(b"\n") if x.strip(SPACES)]
        lines.append(len(full))
        again.append(len(full) - len(set(full)))
    return lines, again


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and the counts of COUNTS for each row; a null text has none of anything."""
    slim = docs.select(*keep, "text")
    schema = ", ".join([f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} bigint" for c in COUNTS])
    return slim.mapInArrow(lambda it: count_texts(it, keep), schema)


def statistics() -> Column:
    """The vector: logarithm of the mean word length, and square roots of the shares of symbols, repeated lines and repeated words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_repeat_words") / words),
    )


def distance() -> Column:
    """Squared Mahalanobis distance of x, by mean and the inverse covariance (row by row)."""
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(DIMS)]
    return sum((d[i] * d[j] * F.col("inverse")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))


def chi2_share(x: float, pairs: int) -> float:
    """Share of a chi-squared distribution with 2 * pairs degrees of freedom below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(pairs))


def consistency(central: float) -> float:
    """By how much the covariance of the most central share of a normal distribution falls short."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, DIMS // 2) < central else (low, mid)
    return central / chi2_share(low, DIMS // 2 + 1)


#: Squared distances are binned by their logarithm; the bin in which the central share ends counts in part.
BINS, PER_E = 512, 24.0


def quantile(tail: float) -> float:
    """The squared distance that a share `tail` of a normal distribution exceeds."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        beyond = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(DIMS // 2))
        low, high = (mid, high) if beyond > tail else (low, mid)
    return low


def estimate(sums: pd.DataFrame, central: float, factor: float, floors: tuple[float, ...]) -> pd.DataFrame:
    """Mean, inverse covariance and logarithm of the determinant of a group and start from sums by bin of distance."""
    sums = sums.sort_values("bin")
    n = sums["n"].to_numpy(float)
    goal = central * n.sum()
    before = np.concatenate([[0.0], np.cumsum(n)[:-1]])
    part = np.clip((goal - before) / n, 0.0, 1.0)
    total = part @ n
    s1 = np.array([part @ sums[f"s{i}"].to_numpy(float) for i in range(DIMS)])
    mean = s1 / total
    cov = np.zeros((DIMS, DIMS))
    for i in range(DIMS):
        for j in range(i, DIMS):
            cov[i, j] = cov[j, i] = part @ sums[f"s{i}{j}"].to_numpy(float) / total - mean[i] * mean[j]
    cov = cov * factor + np.diag(np.square(floors))
    found = {"g": sums["g"].iloc[0], "start": sums["start"].iloc[0], "mean": mean.tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(), "det": float(np.linalg.slogdet(cov)[1])}
    return pd.DataFrame([found])


#: Deterministic starts: spreads by median deviations, by the covariance of all rows, and by that of the signs of the deviations.
STARTS = 3
FIT = "g string, start int, mean array<double>, inverse array<double>, det double"


def starts(sums: pd.DataFrame, floors: tuple[float, ...]) -> pd.DataFrame:
    """The starts of a group from its medians, median deviations, sums, and sums of signs of deviations."""
    r = sums.iloc[0]
    mid, off, n = np.array(r["mids"], float), np.array(r["off"], float), float(r["n"])
    spread = np.square(off * 1.4826) + np.square(floors)
    mean = np.array([r[f"s{i}"] for i in range(DIMS)], float) / n
    every, signs = np.zeros((DIMS, DIMS)), np.zeros((DIMS, DIMS))
    for i in range(DIMS):
        for j in range(i, DIMS):
            every[i, j] = every[j, i] = r[f"s{i}{j}"] / n - mean[i] * mean[j]
            signs[i, j] = signs[j, i] = r[f"t{i}{j}"] / n
    scale = np.sqrt(spread)
    by_signs = (0.5 * signs + 0.5 * np.eye(DIMS)) * np.outer(scale, scale)
    found = [(mid, np.diag(spread)), (mean, every + np.diag(np.square(floors))), (mid, by_signs)]
    rows = [(r["g"], k, m.tolist(), np.linalg.inv(c).ravel().tolist(), float(np.linalg.slogdet(c)[1])) for k, (m, c) in enumerate(found)]
    return pd.DataFrame(rows, columns=["g", "start", "mean", "inverse", "det"])


def fit(vectors: DataFrame, rules: Rules) -> DataFrame:
    """(g, mean, inverse) for each group of (g, x): of all starts the estimate with the smallest determinant.

    Each concentration step is one aggregation over all rows for all groups and starts; steps go on until no start's determinant falls any more. What is
    joined back is a row a group and start; Spark broadcasts it if its measured size allows and splits hot groups of a sort-merge join
    otherwise. Sums by group and bin are partly added before the shuffle, so a group may have any number of rows.
    """
    x = [F.col("x")[i] for i in range(DIMS)]
    products = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    sums = [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(DIMS)], *[F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i, j in products]]
    mids = materialize(vectors.groupBy("g").agg(F.array(*[F.percentile_approx(v, 0.5) for v in x]).alias("mids")), "mcd")
    sign = [F.signum(x[i] - F.col("mids")[i]) for i in range(DIMS)]
    off = F.array(*[F.percentile_approx(F.abs(x[i] - F.col("mids")[i]), 0.5) for i in range(DIMS)]).alias("off")
    about = vectors.join(mids, "g").groupBy("g", "mids").agg(off, *sums, *[F.sum(sign[i] * sign[j]).alias(f"t{i}{j}") for i, j in products])
    factor, floors = consistency(rules.central), rules.floors
    now = materialize(about.groupBy("g").applyInPandas(lambda pdf: starts(pdf, floors), FIT), "mcd")
    for step in range(rules.max_steps):
        bin_of = F.least(F.lit(BINS), F.greatest(F.lit(0), (F.log(distance() + 1e-6) * PER_E + 0.5 * BINS).cast("int")))
        binned = vectors.join(now, "g").select("g", "start", "x", bin_of.alias("bin")).groupBy("g", "start", "bin").agg(*sums)
        after = materialize(binned.groupBy("g", "start").applyInPandas(lambda pdf: estimate(pdf, rules.central, factor, floors), FIT), "mcd")
        falls = after.join(now.select("g", "start", F.col("det").alias("before")), ["g", "start"]).where(F.col("before") - F.col("det") > rules.settled)
        now = after
        if step and not falls.limit(1).count():
            break
    best = now.groupBy("g").agg(F.min(F.struct("det", "start", "mean", "inverse")).alias("x"))
    return materialize(best.select("g", "x.mean", "x.inverse"), "mcd")


def levels(lang: Column, source: Column) -> list[Column]:
    """Group names of a text, the narrowest first; nulls have names of their own."""
    shown = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit("="), c), F.lit("-"))
    return [F.concat(F.lit("s|"), F.concat_ws("|", shown(lang), shown(source))), F.concat(F.lit("l|"), shown(lang)), F.lit("all")]


def rated(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, lang, source, the counts, base_failed and x for docs with text, lang and source."""
    slim = docs.withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "text": F.col("text").cast("string")})
    counted = text_counts(slim, list(dict.fromkeys([*keep, "lang", "source"])))
    return counted.withColumn("x", statistics())


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def estimates(rows: DataFrame, rules: Rules) -> DataFrame:
    """(g, mean, inverse) of every language and source, language, and of all, over the `rated` rows that pass the base rules."""
    names = levels(F.col("lang"), F.col("source"))
    vectors = rows.where(~base_failed(rules)).select(F.explode(F.array(*names)).alias("g"), "x")
    sizes = vectors.groupBy("g").count().where((F.col("count") >= rules.min_group) | (F.col("g") == "all")).select("g")
    return fit(vectors.join(materialize(sizes, "mcd"), "g", "left_semi"), rules)


def verdicts(rows: DataFrame, fits: DataFrame, rules: Rules) -> DataFrame:
    """Adds base_failed, distance (null if that holds) and kept to `rated` rows, by the narrowest estimate there is."""
    found = None
    for i, name in enumerate(levels(F.col("lang"), F.col("source"))):
        own = fits.select(F.col("g").alias(f"__g{i}"), F.struct("mean", "inverse").alias(f"__fit{i}"))
        rows = rows.join(own, name == F.col(f"__g{i}"), "left")
        found = F.coalesce(found, F.col(f"__fit{i}")) if found is not None else F.col(f"__fit{i}")
    rows = rows.withColumn("__fit", found).withColumns({"mean": F.col("__fit.mean"), "inverse": F.col("__fit.inverse"), "base_failed": base_failed(rules)})
    rows = rows.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= quantile(rules.tail)))
    return rows.drop("__fit", "mean", "inverse", "x", *[f"__{k}{i}" for k in ("g", "fit") for i in range(3)])


def judge(docs: DataFrame, id_col: str = "doc_id", rules: Rules = RULES) -> DataFrame:
    """(id, counts, base_failed, distance, kept) for each row of docs (id, text, lang, source).

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in repeated windows of three.
    Such texts, the empty and null ones among them, are rejected and take no part in the estimates. All others are kept unless their squared
    distance exceeds the cutoff. Null languages and sources are groups of their own. Repeated rows each get a row. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = materialize(rated(docs.select(F.col(id_col).alias("__id"), "text", "lang", "source"), ["__id"]), "quality")
    return verdicts(rows, estimates(rows, rules), rules).select(F.col("__id").alias(id_col), *COUNTS, "base_failed", "distance", "kept")


def kept_rows(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns.

    Texts are counted twice and not shuffled: once for the estimates, once where the verdict falls.
    """
    names = docs.columns
    slim = materialize(rated(docs.select("text", "lang", "source"), []), "quality")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], "text", "lang", "source")
    out = verdicts(rated(plain, [f"__c{i}" for i in range(len(names))]), estimates(slim, rules), rules)
    return out.where("kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])


def op9_quality(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
