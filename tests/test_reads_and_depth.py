"""CIGAR arrays, read filters, depth, structural counters and rules."""

import random

import pytest
from pyspark.sql import functions as F

from ridgeline.config import ReadFilterConfig, StructuralErrorConfig
from ridgeline.functions import cigar, rules
from ridgeline.operators import depth, reads, structural

READS = "read_id string, flag int, contig string, start0 bigint, end0 bigint, cigar string, nm int, sa string, seq_len bigint"
CONTIGS = "contig string, len bigint, ord bigint"


def read(name, start, cig, flag=0, nm=0, sa=None, seq_len=100, contig="a"):
    span = sum(int(n) for n, op in __import__("re").findall(r"(\d+)([MDN=X])", cig or ""))
    return (name, flag, contig, start, start + span, cig, nm, sa, seq_len)


def table(spark, *data):
    return spark.createDataFrame(list(data), READS)


def contigs(spark, **lengths):
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(lengths.items())], CONTIGS)


def test_cigar_walk(spark):
    rows = table(spark, read("r", 10, "5H10S3M2I4D1N6=7X8P2S")).select(F.inline(cigar.cigar_ops(F.col("cigar"), F.col("start0")))).collect()
    assert [(r.op, r.len, r.ref0, r.ref1) for r in rows] == [
        ("H", 5, 10, 10), ("S", 10, 10, 10), ("M", 3, 10, 13), ("I", 2, 13, 13), ("D", 4, 13, 17), ("N", 1, 17, 18), ("=", 6, 18, 24), ("X", 7, 24, 31), ("P", 8, 31, 31), ("S", 2, 31, 31),
    ]
    kept = table(spark, read("r", 0, "3M60I2M")).select(cigar.cigar_ops(F.col("cigar"), F.col("start0"), lambda op, n, i: n > 50).alias("o")).first().o
    assert [(x.idx, x.op, x.ref0) for x in kept] == [(1, "I", 3)]
    odd = spark.createDataFrame([(None,), ("",), ("*",)], "cigar string").select(F.size(cigar.cigar_pairs(F.col("cigar"))).alias("n"), cigar.cigar_span(F.col("cigar")).alias("s")).collect()
    assert [(r.n, r.s) for r in odd] == [(0, 0)] * 3


def test_short_read_filter(spark):
    data = table(spark, read("ok", 0, "10M", flag=4), read("clip", 0, "2S8M"), read("hard", 0, "8M2H"), read("nm", 0, "10M", nm=1), read("none", 0, "10M", nm=None))
    assert [r.read_id for r in reads.perfect_reads(data).collect()] == ["ok"]
    stats = reads.short_filter_stats(data).first()
    assert (stats.total, stats.kept, stats.clip_only, stats.mismatch_only, stats.both, stats.kept_percent) == (5, 1, 2, 2, 0, 20.0)
    assert reads.short_filter_stats(data.limit(0)).first().kept_percent == 0.0


def test_split_filter_borders(spark):
    sa = lambda n: "c,1,+,5M,60,0;" * n
    data = table(
        spark,
        read("three", 0, "1M", sa=sa(3), seq_len=0), read("four", 0, "1M", sa=sa(4), seq_len=20_000), read("five", 0, "1M", sa=sa(5), seq_len=20_000), read("none", 0, "1M"),
        read("second", 0, "1M", flag=256), read("supp", 0, "1M", flag=2048), read("unmapped", 0, "1M", flag=4), read("blank", 0, "1M", sa=";;"),
    )
    assert sorted(r.read_id for r in reads.long_reads(data).collect()) == ["blank", "four", "none", "three"]
    assert len(reads.long_reads(data, ReadFilterConfig(include_all_reads=True)).collect()) == 7
    assert tuple(reads.long_filter_stats(data).first()) == (8, 5, 1, 4)


def test_depth_runs_by_hand(spark):
    data = table(spark, read("x", 0, "5M"), read("y", 3, "2M3D2M"), read("z", 10, "2M"))
    got = sorted(tuple(r) for r in depth.depth_runs(data, contigs(spark, a=15, b=4)).collect())
    assert got == [("a", 0, 3, 1), ("a", 3, 5, 2), ("a", 5, 8, 0), ("a", 8, 10, 1), ("a", 10, 12, 1), ("a", 12, 15, 0), ("b", 0, 4, 0)] or got == [
        ("a", 0, 3, 1), ("a", 3, 5, 2), ("a", 5, 8, 0), ("a", 8, 12, 1), ("a", 12, 15, 0), ("b", 0, 4, 0),
    ]
    through = sorted(tuple(r) for r in depth.depth_runs(data, contigs(spark, a=15), through_gaps=True).collect())
    assert through == [("a", 0, 3, 1), ("a", 3, 5, 2), ("a", 5, 12, 1), ("a", 12, 15, 0)]


def test_depth_over_chunks_equals_a_plain_count(spark):
    rng = random.Random(4)
    data = [read(f"r{i}", s := rng.randrange(0, 180), f"{min(20, 200 - s)}M", contig=rng.choice("ab")) for i in range(60)]
    plain = {(c, p): sum(1 for r in data if r[2] == c and r[3] <= p < r[4]) for c in "ab" for p in range(200)}
    runs = depth.depth_runs(table(spark, *data), contigs(spark, a=200, b=200), chunk=37).collect()
    assert {(r.contig, p): r.depth for r in runs for p in range(r.start0, r.end0)} == plain
    mean = depth.mean_depth(spark.createDataFrame(runs), contigs(spark, a=200, b=200)).first()[0]
    assert mean == pytest.approx(sum(plain.values()) / 400, abs=0.005)
    windows = depth.window_mean_depth(table(spark, *data), contigs(spark, a=200, b=200), 60).collect()
    assert all(w.depth == pytest.approx(sum(plain[w.contig, p] for p in range(w.start0, w.end0)) / (w.end0 - w.start0)) for w in windows) and len(windows) == 8


def test_low_depth_windows(spark):
    data = table(spark, *[read(f"r{i}", 0, "100M") for i in range(30)], read("far", 180, "20M"))
    got = sorted(tuple(r) for r in depth.low_depth_windows(data, contigs(spark, a=200), 50).collect())
    assert got == [("a", 100, 150), ("a", 150, 200)]
    assert depth.mean_positive_depth(spark.createDataFrame([(0.0,)], "depth double")).first()[0] is None


def counters(spark, data, length=20_000, **cfg):
    got = structural.window_counters(table(spark, *data), contigs(spark, a=length), StructuralErrorConfig(**cfg)).collect()
    return {r.start0: r for r in got}


def test_a_read_that_ends_at_a_border_counts_in_both_windows(spark):
    got = counters(spark, [read("r", 0, "2000M")])
    assert [got[b].total_reads for b in (0, 2000, 4000)] == [1, 1, 0] and len(got) == 10


def test_deletions_fill_their_windows(spark):
    got = counters(spark, [read("r", 100, "1850M50D500M"), read("s", 100, "1851M49D500M")])
    assert [(got[b].deletion, got[b].reads_with_deletion) for b in (0, 2000, 4000)] == [(1, 1), (1, 1), (0, 0)]
    got = counters(spark, [read("r", 100, "100M2500D100M100M50D10M")])
    assert [(got[b].deletion, got[b].reads_with_deletion) for b in (0, 2000)] == [(1, 1), (2, 1)]


def test_clips_at_contig_ends_are_exempt(spark):
    clips = lambda *a, **k: sum(r.clip_count for r in counters(spark, [read("r", *a)], **k).values())
    assert clips(0, "10S100M") == 0 and clips(1, "10S100M") == 1 and clips(0, "5H10S100M") == 1
    assert clips(19_900, "100M10S") == 0 and clips(19_800, "100M10S") == 1 and clips(19_900, "100M5S5H") == 0
    assert clips(50, "5S10M60N5M", length=4000) == 1


def test_clean_reads_only_near_ends(spark):
    got = counters(spark, [read("r", 0, "40000M"), read("s", 100, "60I39000M")], length=40_000)
    assert (got[0].clean_reads, got[0].insertion, got[2000].clean_reads, got[8000].clean_reads, got[10_000].clean_reads, got[30_000].clean_reads) == (1, 1, 2, 2, 0, 2)
    assert got[38_000].total_reads == 2
    assert counters(spark, [read("u", 0, "100M", flag=4), read("n", 0, None)])[0].total_reads == 0


def stat(**k):
    base = dict(contig="a", start0=20_000, end0=22_000, clip_count=0, insertion=0, deletion=0, reads_with_insertion=0, reads_with_deletion=0, reads_with_clip=0, total_reads=10, clean_reads=0, depth=10.0, is_terminal=False, has_spanning=True)
    return base | k


@pytest.mark.parametrize(
    ("change", "tags"),
    [
        ({}, []),
        ({"depth": 0.0}, []),
        ({"depth": 1.0}, ["low_depth"]),
        ({"depth": 99.0}, ["high_depth"]),
        ({"clip_count": 5}, []),
        ({"clip_count": 6}, ["clip"]),
        ({"clip_count": 30, "reads_with_insertion": 6, "reads_with_deletion": 6}, ["clip", "indel", "indel"]),
        ({"total_reads": 0, "clip_count": 3}, []),
        ({"has_spanning": False}, ["non_spanning"]),
        ({"is_terminal": True, "depth": 1.0, "clean_reads": 2}, []),
        ({"is_terminal": True, "clean_reads": 1}, ["clip"]),
        ({"is_terminal": True, "clean_reads": 0, "deletion": 1, "has_spanning": False}, ["non_spanning", "indel"]),
        ({"is_terminal": True, "clean_reads": 0, "total_reads": 0}, []),
    ],
)
def test_tags(spark, change, tags):
    others = [stat(start0=50_000 + i * 2000) for i in range(40)]
    frame = spark.createDataFrame([stat(**change), *others])
    found = [r.tags for r in structural.anomalies(frame).collect() if r.start0 == 20_000]
    assert found == ([tags] if tags else [])


def test_no_depth_no_anomalies(spark):
    frame = spark.createDataFrame([stat(depth=0.0, has_spanning=False)])
    assert structural.anomalies(frame).count() == 0


def test_summary_and_terminal_counts(spark):
    found = structural.anomalies(spark.createDataFrame([stat(reads_with_insertion=9, reads_with_deletion=9), stat(start0=30_000, has_spanning=False), stat(start0=40_000)]))
    got = {r.contig: tuple(r)[1:] for r in structural.anomaly_summary(found, contigs(spark, a=10, b=10)).collect()}
    assert got == {"a": (0, 0, 1, 0, 1, 2), "b": (0,) * 6, "Total": (0, 0, 1, 0, 1, 2)}
    ends = spark.createDataFrame([stat(is_terminal=True, clean_reads=1, total_reads=11, insertion=1), stat(is_terminal=True, clean_reads=1), stat(is_terminal=True, total_reads=20)])
    assert [tuple(r) for r in structural.terminal_counts(ends).collect()] == [("a", 1, 1)]


def test_nonspanning_by_running_maximum_equals_the_plain_test(spark):
    rng = random.Random(8)
    data = [read(f"r{i}", rng.randrange(0, 90), f"{rng.randrange(1, 40)}M", contig=rng.choice("ab")) for i in range(80)]
    windows = [(c, s, s + w) for c in "abc" for s in range(-5, 100, 3) for w in (5, 20)]
    got = sorted(tuple(r) for r in structural.without_read(spark.createDataFrame(windows, "contig string, start0 bigint, end0 bigint"), table(spark, *data), chunk=17).collect())
    assert got == sorted(w for w in windows if not any(r[2] == w[0] and r[3] <= w[1] and r[4] >= w[2] for r in data))


def test_terminal_trim(spark):
    known = contigs(spark, a=100_000, b=60_000, c=20_000)
    windows = spark.createDataFrame([("a", 0, 30_000), ("a", 50_000, 52_000), ("a", 70_000, 100_000), ("b", 0, 60_000), ("c", -8000, 20_000), ("x", 0, 9)], "contig string, start0 bigint, end0 bigint")
    none = table(spark, read("r", 0, "1M", contig="q"))
    got = sorted(tuple(r) for r in structural.nonspanning_regions(windows, none, known).collect())
    assert got == [("a", 0, 2000), ("a", 50_000, 52_000), ("a", 98_000, 100_000), ("b", 0, 32_000)]


@pytest.mark.parametrize(
    ("hifi", "hd", "ont", "od", "ag", "ct", "gc", "terminal", "want"),
    [
        (4, 90.0, 3, 90.0, 0.5, 0.5, 0.5, False, False),
        (5, 90.0, 0, 90.0, 0.5, 0.5, 0.5, False, True),
        (0, 90.0, 4, 90.0, 0.5, 0.5, 0.5, False, True),
        (1, 10.0, 0, 0.0, 0.5, 0.5, 0.5, True, True),
        (1, 10.01, 0, 0.0, 0.5, 0.5, 0.5, True, False),
        (5, 90.0, 0, 0.0, 0.9, 0.1, 0.6, False, False),
        (5, 90.0, 0, 0.0, 0.9, 0.1, 0.59, False, True),
        (5, 90.0, 9, 90.0, 0.1, 0.5, 0.9, False, True),
        (-1, -1.0, -1, -1.0, 0.0, 0.0, 0.0, True, False),
        (0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, True, False),
    ],
)
def test_support_rules(spark, hifi, hd, ont, od, ag, ct, gc, terminal, want):
    cols = {k: F.lit(v) for k, v in dict(hifi=hifi, hifi_depth=hd, ont=ont, ont_depth=od, ag=ag, ct=ct, gc=gc).items()}
    assert spark.range(1).select(rules.supported(cols, F.lit(terminal)).alias("x")).first().x is want


def test_terminal_predicates_differ(spark):
    row = spark.range(1).select(
        rules.terminal_region(F.lit(10_000), F.lit(10_050), F.lit(50_000)).alias("a"), rules.terminal_window(F.lit(10_000), F.lit(50_000)).alias("b"), rules.terminal_region(F.lit(39_950), F.lit(40_000), F.lit(50_000)).alias("c"),
        rules.terminal_window(F.lit(39_999), F.lit(50_000)).alias("d"), rules.terminal_window(F.lit(40_000), F.lit(50_000)).alias("e"), rules.terminal_region(F.lit(0), F.lit(1), F.lit(None).cast("long")).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, False, True, False)


@pytest.mark.parametrize(("errors", "length", "want"), [(0, 1000, "∞"), (1, 1000, "30.00"), (5, 0, "N/A"), (0, 0, "∞"), (10, 10, "-0.00")])
def test_quality_value(spark, errors, length, want):
    assert spark.range(1).select(rules.phred_text(F.lit(errors), F.lit(length)).alias("q")).first().q in (want, want.lstrip("-"))


def test_error_types(spark):
    reasons = ["Low depth (1)", "High depth", "High insertion reads ratio", "deletion reads ratio", "High clip ratio", "Terminal region anomaly", "x"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in reasons], "r string").select(rules.error_type(F.col("r")).alias("t")).collect()]
    assert got == ["low_depth", "high_depth", "indel", "indel", "clip", "terminal", "other"]
