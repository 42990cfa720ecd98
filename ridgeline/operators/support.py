"""Reads that support a window without a flaw, and the literal pileup form of the same question."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.cigar import cigar_ops
from ridgeline.operators.intervals import KEY, overlap_pairs

DEPTH_CAP = 1000.0


def window_support(windows: DataFrame, reads: DataFrame, mismatches: str = "mismatches", cap: float = DEPTH_CAP) -> DataFrame:
    """(contig, start0, end0, min_support, avg_depth) for each distinct window.

    A read supports a window if it covers all of it, has no mismatch (array of positions) and no deletion in it, and no insertion or deletion
    whose anchor, the base before it, lies in it. avg_depth is bases of overlapping alignments, deletions included, over the window's
    length, with two decimals. Above the cap the support is 0. A window without reads has 0 and 0.0.
    """
    places = windows.where("start0 < end0").select(*KEY).distinct()
    indels = cigar_ops(F.col("cigar"), F.col("start0"), lambda op, n, i: op.isin("I", "D"))
    slim = reads.select("contig", "start0", "end0", F.coalesce(F.col(mismatches), F.array().cast("array<bigint>")).alias("mm"), indels.alias("indels"))
    met = overlap_pairs(places, slim)
    s, e = F.col("start0"), F.col("end0")
    flaw = F.exists("b_mm", lambda p: (p >= s) & (p < e)) | F.exists(
        "b_indels", lambda x: ((x["ref0"] > s) & (x["ref0"] <= e)) | ((x["op"] == "D") & (x["ref0"] < e) & (x["ref1"] > s))
    )
    perfect = (F.col("b_start0") <= s) & (F.col("b_end0") >= e) & ~flaw
    sums = met.groupBy(*KEY).agg(F.count_if(perfect).alias("perfect"), F.sum(F.least("end0", "b_end0") - F.greatest("start0", "b_start0")).alias("bases"))
    out = places.join(sums, KEY, "left").withColumn("depth", F.coalesce("bases", F.lit(0)).cast("double") / (e - s))
    support = F.when(F.col("depth") > cap, F.lit(0)).otherwise(F.coalesce("perfect", F.lit(0))).cast("long")
    return out.select(*KEY, support.alias("min_support"), F.round("depth", 2).alias("avg_depth"))


def merged_support(windows: DataFrame, hifi: DataFrame, ont: DataFrame) -> DataFrame:
    """Windows with (hifi, hifi_depth, ont, ont_depth); -1 where a platform has no row for a window."""
    out = windows.select(*KEY).distinct()
    for name, rows in (("hifi", hifi), ("ont", ont)):
        out = out.join(rows.select(*KEY, F.col("min_support").alias(name), F.col("avg_depth").alias(f"{name}_depth")), KEY, "left")
    missing = {"hifi": F.lit(-1).cast("long"), "hifi_depth": F.lit(-1.0), "ont": F.lit(-1).cast("long"), "ont_depth": F.lit(-1.0)}
    return out.withColumns({n: F.coalesce(n, x) for n, x in missing.items()})


TOKEN = re.compile(r"\^.|\$|[+-](\d+)|.", re.DOTALL)
MATCHES = frozenset(".,")
KEPT = frozenset(".,<>")


def pileup_cells(bases: str) -> list[dict]:
    """The reads of a pileup row in order: base, whether the read starts or ends here, whether an indel follows."""
    cells: list[dict] = []
    starts, at = False, 0
    while at < len(bases):
        token = TOKEN.match(bases, at)
        text, at = token[0], token.end()
        if text[0] == "^" and len(text) == 2:
            starts = True
        elif text == "$":
            cells[-1]["ends"] = True
        elif token[1]:
            at += int(token[1])
            cells[-1]["indel"] = True
        else:
            cells.append({"base": text, "starts": starts, "ends": False, "indel": False})
            starts = False
    return cells


def pileup_support(rows: Sequence[str]) -> int:
    """Flawless reads of a window given its pileup rows' base strings, one a position.

    Reads are followed from row to row by their order: those that end leave it, those that start join it at the end. A read that starts after the
    first row or ends before the last one, that has an indel after a base, a mismatch or a deletion anywhere, doesn't count.
    """
    alive: list[int] = []
    flawed: set[int] = set()
    count = 0
    for k, row in enumerate(rows):
        ended = []
        for i, cell in enumerate(pileup_cells(row)):
            if cell["starts"] or i >= len(alive):
                alive.insert(i, count)
                if k:
                    flawed.add(count)
                count += 1
            if cell["base"] not in KEPT or cell["indel"]:
                flawed.add(alive[i])
            if cell["ends"]:
                ended.append(alive[i])
                if k < len(rows) - 1:
                    flawed.add(alive[i])
        alive = [r for r in alive if r not in ended]
    return count - len(flawed)


def pileup_window_support(pileup: DataFrame, cap: float = DEPTH_CAP) -> DataFrame:
    """window_support for windows (contig, start0, end0) given as pileup rows (pos0, depth, bases); one window at a time."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos0")
        depth = float(rows["depth"].mean())
        support = 0 if depth > cap else pileup_support(rows["bases"].fillna("").tolist())
        return pd.DataFrame([[*rows[KEY].iloc[0], support, round(depth, 2)]], columns=[*KEY, "min_support", "avg_depth"])

    return pileup.groupBy(*KEY).applyInPandas(each, "contig string, start0 bigint, end0 bigint, min_support bigint, avg_depth double")


def mismatch_positions(seq: str, ops: Iterable[tuple[str, int]], start0: int, ref: str, ref0: int) -> list[int]:
    """Reference positions in `ref`, which begins at ref0, at which an alignment's bases differ from it; bases that a read lacks differ."""
    bases, known = (np.frombuffer(x.upper().encode(), np.uint8) for x in (seq, ref))
    at, pos, out = 0, start0, []
    for op, n in ops:
        if op in "M=X":
            low, high = max(pos, ref0), min(pos + n, ref0 + len(known))
            if low < high:
                mine = bases[at + low - pos : at + high - pos]
                differ = np.ones(high - low, bool)
                differ[: len(mine)] = mine != known[low - ref0 : low - ref0 + len(mine)]
                out += (np.flatnonzero(differ) + low).tolist()
        at += n if op in "MIS=X" else 0
        pos += n if op in "MDN=X" else 0
    return out


def with_mismatches(reads: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """reads with their mismatch positions, from their bases and the reference chunks (contig, chunk_start0, seq) that they touch.

    A record is cut by chunk, compared with its own slice of each in Arrow batches and put together again; records with NM = 0 skip the
    comparison. Records are told apart by all that the comparison takes, so those that are equal in it share a result.
    """
    record = F.xxhash64("read_id", "flag", "contig", "start0", "end0", "cigar", "seq")
    first, last = F.col("start0"), F.greatest(F.col("start0"), F.col("end0") - 1)
    pieces = F.sequence(F.floor(first / chunk) * chunk, last, F.lit(chunk).cast("long"))
    spans = reads.where("nm is null or nm > 0").select(record.alias("record"), "contig", "start0", "end0", "cigar", "seq", F.explode(pieces).alias("chunk_start0"))
    form = F.lit("([0-9]+)([MIDNSHP=X])")
    ops = F.transform(F.arrays_zip(F.regexp_extract_all("cigar", form, F.lit(2)), F.regexp_extract_all("cigar", form, F.lit(1))), lambda x: F.concat(x["1"], x["0"]))
    known = chunks.select("contig", "chunk_start0", F.substring("seq", 1, chunk).alias("whole"))
    from0 = F.greatest(F.col("start0"), F.col("chunk_start0"))
    to0 = F.least(F.col("end0"), F.col("chunk_start0") + chunk)
    own = F.substring(F.col("whole"), (from0 - F.col("chunk_start0") + 1).cast("int"), F.greatest(to0 - from0, F.lit(0)).cast("int"))
    work = spans.join(known, ["contig", "chunk_start0"]).select("record", "chunk_start0", "start0", "seq", ops.alias("ops"), from0.alias("from0"), own.alias("ref"))

    def compare(batches):
        for pdf in batches:
            rows = pdf[["seq", "ops", "start0", "from0", "ref"]].itertuples(index=False, name=None)
            found = [mismatch_positions(seq or "", [(x[-1], int(x[:-1])) for x in cigar], start, ref, at) for seq, cigar, start, at, ref in rows]
            yield pdf[["record", "chunk_start0"]].assign(mm=found)

    found = work.mapInPandas(compare, "record bigint, chunk_start0 bigint, mm array<bigint>")
    found = found.groupBy("record").agg(F.array_sort(F.flatten(F.transform(F.collect_set(F.struct("chunk_start0", "mm")), lambda x: x["mm"]))).alias("mismatches"))
    out = reads.withColumn("record", record).join(found, "record", "left").drop("record")
    return out.withColumn("mismatches", F.coalesce("mismatches", F.array().cast("array<bigint>")))
