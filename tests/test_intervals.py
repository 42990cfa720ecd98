"""Windows, interval joins and merges: hand-written borders, and properties over random intervals."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ridgeline.operators import intervals as iv

SPEC = "contig string, start0 bigint, end0 bigint"
CONTIGS = "contig string, len bigint, ord bigint"
QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
some = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(1, 25)).map(lambda x: (x[0], x[1], x[1] + x[2])), max_size=25)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def bed(spark, data):
    return spark.createDataFrame(data, SPEC)


def contigs(spark, **lengths):
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(lengths.items())], CONTIGS)


def test_tumbling_windows_cover_each_contig(spark):
    got = rows(iv.tumbling_windows(contigs(spark, a=120, b=50, none=0), 50))
    assert got == [("a", 0, 50), ("a", 50, 100), ("a", 100, 120), ("b", 0, 50)]


@pytest.mark.parametrize(
    ("length", "want"),
    [
        (20_000, [(-8000, 20_000)]),
        (28_000, [(0, 28_000)]),
        (29_999, [(0, 29_999)]),
        (30_000, [(0, 30_000), (2000, 30_000)]),
        (33_000, [(0, 30_000), (2000, 32_000), (4000, 33_000)]),
    ],
)
def test_spanning_windows_end_with_the_contig(spark, length, want):
    assert [r[1:] for r in rows(iv.spanning_windows(contigs(spark, a=length)))] == want


def test_last_windows_of_neighbouring_contigs_do_not_hide_each_other(spark):
    got = rows(iv.spanning_windows(contigs(spark, a=29_000, b=28_500)))
    assert got == [("a", 0, 29_000), ("b", 0, 28_500)]


def test_split_to_whole_windows(spark):
    known = contigs(spark, a=120)
    assert rows(iv.split_to_windows(bed(spark, [("a", 78, 128)]), known, 50)) == [("a", 50, 100), ("a", 100, 120)]
    assert rows(iv.split_to_windows(bed(spark, [("a", 130, 140)]), known, 50)) == []
    assert rows(iv.split_to_windows(bed(spark, [("x", 78, 128)]), known, 50)) == [("x", 50, 100), ("x", 100, 150)]


def test_region_windows_and_keys(spark):
    regions = bed(spark, [("a", 1500, 4100), ("a", 0, 100), ("a", 7, 7)])
    assert rows(iv.region_windows(regions, 2000)) == [("a", 0, 100), ("a", 0, 2000), ("a", 2000, 4000), ("a", 4000, 4100)]
    assert rows(iv.region_window_keys(regions, 2000)) == [("a", 0), ("a", 2000), ("a", 4000)]


def test_extension_stops_at_the_end(spark):
    got = rows(iv.extended(bed(spark, [("a", 0, 10), ("a", 95, 99), ("x", 0, 5), ("a", 100, 100)]), contigs(spark, a=100), 20))
    assert got == [("a", 0, 30), ("a", 95, 100)]


def test_touching_regions_merge_unless_strict(spark):
    data = bed(spark, [("a", 0, 50), ("a", 50, 100), ("a", 90, 95), ("b", 50, 60), ("b", 5, 5)])
    assert rows(iv.merge_intervals(data)) == [("a", 0, 100), ("b", 50, 60)]
    assert rows(iv.merge_intervals(data, strict=True)) == [("a", 0, 50), ("a", 50, 100), ("b", 50, 60)]


def test_merge_across_chunks(spark):
    data = [("a", k * 10, k * 10 + (12 if k % 7 else 10)) for k in range(100)]
    assert rows(iv.merge_intervals(bed(spark, data), chunk=35)) == rows(iv.merge_intervals(bed(spark, data)))


@QUICK
@given(some)
def test_merged_is_the_union_and_stays(spark, data):
    got = rows(iv.merge_intervals(bed(spark, data), chunk=20))
    bases = lambda xs: {(c, p) for c, s, e in xs for p in range(s, e)}
    assert bases(got) == bases(data)
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert rows(iv.merge_intervals(bed(spark, got))) == got


@QUICK
@given(some, some)
def test_semi_and_anti_share_the_rows(spark, a, b):
    hit = [x for x in a if any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b)]
    left, right = bed(spark, a), bed(spark, b)
    assert rows(iv.overlap_semi(left, right, 8)) == sorted(hit)
    assert rows(iv.overlap_anti(left, right, 8)) == sorted(x for x in a if x not in hit)


@QUICK
@given(some, some)
def test_pairs_come_once(spark, a, b):
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert rows(iv.overlap_pairs(bed(spark, a), bed(spark, b), 8)) == want


@QUICK
@given(some, some, st.sampled_from([3, 16, 1000]))
def test_sums_are_those_of_the_pairs(spark, a, b, chunk):
    want = {}
    for x in a:
        for y in b:
            if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]:
                n, bases = want.get(x, (0, 0))
                want[x] = (n + 1, bases + min(x[2], y[2]) - max(x[1], y[1]))
    assert rows(iv.overlap_sums(bed(spark, a), bed(spark, b), chunk)) == sorted((*x, *y) for x, y in want.items())


def test_sums_make_no_pairs(spark):
    """300 intervals under 300,000 reads that cover them all: 90 million pairs in one bin."""
    reads = spark.range(300_000).selectExpr("'a' contig", "id % 7 start0", "10000 + id % 11 end0")
    mask = spark.range(300).selectExpr("'a' contig", "100 + id start0", "200 + id end0")
    sums = iv.overlap_sums(mask, reads)
    assert {(r.pairs, r.bases) for r in sums.collect()} == {(300_000, 30_000_000)} and sums.count() == 300
    assert "BroadcastNestedLoopJoin" not in sums._jdf.queryExecution().toString() and "bin" not in sums._jdf.queryExecution().toString()
    assert iv.overlap_sums(mask, reads.limit(0)).count() == iv.overlap_sums(mask.limit(0), reads).count() == 0


def test_masked_length(spark):
    data = bed(spark, [("a", 0, 10), ("a", 5, 20), ("b", 1, 2)])
    assert rows(iv.total_length(data)) == [("a", 20), ("b", 1)]
    assert rows(iv.total_length(data, merged=False)) == [("a", 25), ("b", 1)]


def test_contig_order(spark):
    got = [tuple(r) for r in iv.in_contig_order(bed(spark, [("a", 5, 6), ("z", 1, 2), ("b", 9, 10), ("a", 1, 2)]), contigs(spark, b=10, a=10)).collect()]
    assert got == [("b", 9, 10), ("a", 1, 2), ("a", 5, 6), ("z", 1, 2)]
