"""Window support, composition, repeats, quality values, files, and a whole run on a small genome."""

import gzip
import random
import re

import pytest

from ridgeline.__main__ import main
from ridgeline.config import PipelineConfig
from ridgeline.operators import composition, quality_value, repeats, support
from ridgeline.plans import base_errors
from ridgeline.plans.run import ConfigError, run, validate
from ridgeline.sources import bam, fasta, sinks, tables
from ridgeline.streaming import filters

SPEC = "contig string, start0 bigint, end0 bigint"


def aligned(name, start, cig, mm=(), contig="a"):
    span = sum(int(n) for n, op in re.findall(r"(\d+)([MDN=X])", cig))
    return (name, contig, start, start + span, cig, list(mm))


def supports(spark, windows, *reads, cap=1000.0):
    frame = spark.createDataFrame(list(reads), "read_id string, contig string, start0 bigint, end0 bigint, cigar string, mismatches array<bigint>")
    got = support.window_support(spark.createDataFrame([("a", s, e) for s, e in windows], SPEC), frame, cap=cap).collect()
    return {r.start0: (r.min_support, r.avg_depth) for r in got}


@pytest.mark.parametrize(
    ("read", "counts"),
    [
        (aligned("r", 50, "50M"), True),
        (aligned("r", 51, "60M"), False),
        (aligned("r", 0, "99M"), False),
        (aligned("r", 0, "200M", [49, 100]), True),
        (aligned("r", 0, "200M", [50]), False),
        (aligned("r", 0, "200M", [99]), False),
        (aligned("r", 0, "50M5I100M"), True),  # the base before it is outside
        (aligned("r", 0, "51M5I100M"), False),
        (aligned("r", 0, "100M5I100M"), False),  # right after the last base
        (aligned("r", 0, "101M5I100M"), True),
        (aligned("r", 0, "40M10D100M"), True),
        (aligned("r", 0, "40M11D100M"), False),
        (aligned("r", 0, "100M5D100M"), False),
        (aligned("r", 0, "101M5D100M"), True),
        (aligned("r", 0, "60M30N100M"), True),
    ],
)
def test_a_read_supports_a_window_without_a_flaw(spark, read, counts):
    assert supports(spark, [(50, 100)], read)[50][0] == counts


def test_support_depth_and_cap(spark):
    many = [aligned(f"r{i}", 0, "100M") for i in range(4)] + [aligned("half", 75, "100M")]
    got = supports(spark, [(50, 100), (0, 50), (900, 950)], *many)
    assert got == {50: (4, 4.5), 0: (4, 4.0), 900: (0, 0.0)}
    assert supports(spark, [(50, 100)], *many, cap=4.4)[50] == (0, 4.5)


def test_pileup_and_alignments_agree(spark):
    # two clean reads, one with a mismatch, one that starts late, one that ends early, one with an insertion, one with a deletion
    rows = ["^I.^I,^I.^I.^I,+2ac^I.", ".,T.$,*^I.", ".$,$.$,$.$.$"]
    reads = [("a", 0, "3M", []), ("b", 0, "3M", []), ("c", 0, "3M", [1]), ("d", 0, "2M", []), ("e", 0, "1M2I2M", []), ("f", 0, "1M1D1M", []), ("g", 1, "2M", [])]
    got = supports(spark, [(0, 3)], *[aligned(n, s, c, m) for n, s, c, m in reads])
    assert support.pileup_support(rows) == got[0][0] == 2
    frame = spark.createDataFrame([("a", 0, 3, k, 6 if k != 1 else 7, r) for k, r in enumerate(rows)], "contig string, start0 bigint, end0 bigint, pos0 bigint, depth bigint, bases string")
    r = support.pileup_window_support(frame).first()
    assert (r.min_support, r.avg_depth) == (2, got[0][1])
    assert support.pileup_support(["<.", ">."]) == 2 and support.pileup_support([]) == 0


def test_merge_of_support_fills_gaps(spark):
    w = spark.createDataFrame([("a", 0, 50), ("a", 50, 100)], SPEC)
    one = spark.createDataFrame([("a", 0, 50, 3, 4.5)], SPEC + ", min_support bigint, avg_depth double")
    got = {r.start0: tuple(r)[3:] for r in support.merged_support(w, one, one.where("false")).collect()}
    assert got == {0: (3, 4.5, -1, -1.0), 50: (-1, -1.0, -1, -1.0)}


def test_final_filter_borders(spark):
    def row(start, hifi, depth, ont=0, ont_depth=0.0):
        return ("a", start, start + 50, hifi, depth, ont, ont_depth, 0.5, 0.5, 0.5)

    data = spark.createDataFrame([row(20_000, 4, 50.0, 3), row(20_050, 5, 50.0), row(20_100, 0, 1000.0), row(20_150, 0, 1000.01), row(20_200, 0, 1.0, 0, 1000.01), row(10_000, 1, 10.0), row(10_050, 1, 10.0)], tables.MERGED)
    known = spark.createDataFrame([("a", 100_000, 0)], "contig string, len bigint, ord bigint")
    assert sorted(r.start0 for r in base_errors.final_filter(data, known).collect()) == [10_050, 20_000, 20_100]
    assert sorted(r.start0 for r in base_errors.final_filter(data, known, exclude=True).collect()) == [10_000, 20_050]
    assert base_errors.final_filter(data, known.limit(0)).count() == 4


def test_composition_over_chunk_borders(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGTNacgt") for _ in range(3000))
    chunks = composition.sequence_chunks(spark.createDataFrame([("a", seq), ("e", "")], "contig string, seq string"), size=1024, overlap=7)
    windows = [("a", s, s + 50) for s in range(0, 2951, 37)] + [("a", 2990, 3040), ("a", 400, 2100), ("x", 0, 50), ("a", 5000, 5050)]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in composition.composition(spark.createDataFrame(windows, SPEC), chunks, 1024).collect()}
    for c, s, e in windows:
        part = seq[s:e].upper() if c == "a" else ""
        want = tuple(round(sum(part.count(x) for x in two) / len(part), 4) if part else 0.0 for two in ("AG", "CT", "GC"))
        assert got[c, s, e] == pytest.approx(want, abs=1.01e-4 if part else 0)
    texts = {tuple(r)[:3]: r.seq for r in composition.window_sequences(spark.createDataFrame(windows, SPEC), chunks, 1024).collect()}
    assert all(texts[w] == (seq[w[1] : w[2]].upper() if w[0] == "a" else "") for w in windows)
    assert composition.contigs_of_chunks(chunks, 1024).collect() == [("a", 3000)]


def test_identical_regions_against_all_kmers(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared, k = letters(40), 12
    seqs = {"c1_MAT": letters(100) + shared + letters(60), "c2_MAT": letters(30) + shared + "N" * 20, "c1_PAT": letters(50) + shared + letters(9), "c3_x": shared}
    contigs = repeats.haplotypes(spark.createDataFrame([(c, len(s), i) for i, (c, s) in enumerate(seqs.items())], "contig string, len bigint, ord bigint"))
    chunks = composition.sequence_chunks(spark.createDataFrame(list(seqs.items()), "contig string, seq string"), 64, k - 1)
    got = sorted(tuple(r) for r in repeats.identical_regions(chunks, contigs, k, 64).collect())
    places = {}
    for c, s in seqs.items():
        for p in range(len(s) - k + 1):
            if "N" not in s[p : p + k]:
                places.setdefault((c[3:], s[p : p + k]), []).append((c, p))
    covered = {(c, q) for (h, _), xs in places.items() if len(xs) > 1 and h in ("MAT", "PAT") for c, p in xs for q in range(p, min(p + k + 1, len(seqs[c])))}
    assert {(c, q) for c, s, e in got for q in range(s, e)} == covered and {c for c, _, _ in got} == {"c1_MAT", "c2_MAT"}


def test_haplotype_suffixes_break_ties_by_order(spark):
    names = ["z_p", "a_m", "b_m", "c_p", "d_u", "plain", "e_u"]
    contigs = spark.createDataFrame([(n, 5, i) for i, n in enumerate(names)], "contig string, len bigint, ord bigint")
    assert [r.suffix for r in repeats.haplotype_suffixes(contigs).collect()] == ["p", "m"]
    assert {r.contig: r.haplotype for r in repeats.haplotypes(contigs).collect()} == {"z_p": "p", "a_m": "m", "b_m": "m", "c_p": "p", "d_u": None, "plain": None, "e_u": None}


def test_quality_values(spark):
    contigs = spark.createDataFrame([("a", 1000, 0), ("b", 500, 1)], "contig string, len bigint, ord bigint")
    be, se = spark.createDataFrame([("a", 0, 50)], SPEC), spark.createDataFrame([("a", 0, 50)] * 0, SPEC)
    assert {r.contig: (r.total_errors, r.qv) for r in quality_value.contig_qv(contigs, be, se).collect()} == {"a": (1, "30.00"), "b": (0, "∞")}
    mask = spark.createDataFrame([("a", 0, 300), ("a", 200, 500)], SPEC)
    r = quality_value.genome_qv(contigs, be, se, mask).first()
    assert (r.reference_length, r.masked_length, r.length, r.total_errors) == (1500, 500, 1000, 1) and r.qv == pytest.approx(30)
    assert quality_value.genome_qv(contigs, be, se, mask, merged_mask=False).first().masked_length == 600
    hidden = spark.createDataFrame([("a", 0, 1000), ("b", 0, 500)], SPEC)
    assert quality_value.genome_qv(contigs, be, se, hidden).first().qv is None
    assert "N/A" in sinks.genome_report(quality_value.genome_qv(contigs, be, se, hidden)) and "∞" in sinks.genome_report(quality_value.genome_qv(contigs, se, se))
    assert "a\t1,000\t1\t0\t1\t30.00" in sinks.contig_report(quality_value.contig_qv(contigs, be, se), contigs)


def test_text_tables(spark, tmp_path):
    (tmp_path / "x.fai").write_text("b\t200\t3\t60\t61\na\t100\t300\t60\t61\nbroken\nc\tx\t1\n")
    assert [tuple(r)[:3] for r in tables.read_fai(spark, str(tmp_path / "x.fai")).orderBy("ord").collect()] == [("b", 200, 0), ("a", 100, 1)]
    (tmp_path / "x.bed").write_text("#c\na\t1\t5\textra\n\na\t2\na\tx\t9\nb\t0\t7\r\n")
    assert sorted(tuple(r) for r in tables.read_bed(spark, str(tmp_path / "x.bed")).collect()) == [("a", 1, 5), ("b", 0, 7)]
    with gzip.open(tmp_path / "d.bedgraph.gz", "wt") as f:
        f.write("a\t0\t10\t3\na\t10\t12\t0\n")
    assert [tuple(r) for r in tables.read_bedgraph(spark, str(tmp_path / "d.bedgraph.gz")).collect()] == [("a", 0, 10, 3), ("a", 10, 12, 0)]
    (tmp_path / "w.bed").write_text("a\t2001\t4000\t3.5\n")
    assert [tuple(r) for r in tables.read_window_depth(spark, str(tmp_path / "w.bed"), 2000).collect()] == [("a", 2000, 3.5)]
    (tmp_path / "m.bg").write_text("a\t0\t10\t1\na\t10\t20\t0.5\n")
    assert [tuple(r) for r in tables.read_mappability(spark, str(tmp_path / "m.bg")).collect()] == [("a", 10, 20)]
    (tmp_path / "s.tsv").write_text("chr\t1\tA\t3\t...\t..\ta\t0\t50\t3\t4.50\na\t0\t50\t9\t1.00\nshort\t1\n")
    assert [tuple(r) for r in tables.read_support(spark, str(tmp_path / "s.tsv")).collect()] == [("a", 0, 50, 9, 1.0)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_in_chunks(spark, tmp_path, end):
    rng = random.Random(2)
    seqs = {"a": "".join(rng.choice("acgtN") for _ in range(523)), "b.1": "ACGT", "c": "".join(rng.choice("ACGT") for _ in range(180))}
    text = "".join(f">{n} note{end}" + "".join(s[i : i + 60] + end for i in range(0, len(s), 60)) for n, s in seqs.items())
    (tmp_path / "g.fa").write_text(text, newline="")
    got = {(r.contig, r.chunk_start0): r.seq for r in fasta.read_fasta(spark, str(tmp_path / "g.fa"), 100, 9).collect()}
    assert got == {(n, p): s[p : p + 109].upper() for n, s in seqs.items() for p in range(0, len(s), 100)}
    chunks = fasta.read_fasta(spark, str(tmp_path / "g.fa"), 100, 9)
    assert {r.contig: r.len for r in fasta.fasta_index(chunks, 100).collect()} == {n: len(s) for n, s in seqs.items()}
    assert {r.contig for r in fasta.select_contigs(chunks, spark.createDataFrame([("c",)], "contig string")).collect()} == {"c"}


def genome(rng, **lengths):
    return {n: "".join(rng.choice("ACGT") for _ in range(k)) for n, k in lengths.items()}


def sampled(rng, seqs, n, low, high, platform):
    out = []
    for i in range(n):
        contig = rng.choice(list(seqs))
        size = min(rng.randrange(low, high), len(seqs[contig]))
        start = rng.randrange(0, len(seqs[contig]) - size + 1)
        out.append((f"{platform}{i}", platform, 0, contig, start, start + size, 60, f"{size}M", seqs[contig][start : start + size], size, 0, None))
    return out


def test_bam_round_trip(spark, tmp_path):
    rng = random.Random(7)
    seqs = genome(rng, a=5000, b=3000)
    rows = sampled(rng, seqs, 300, 50, 900, "ont")
    rows += [("odd", "ont", 4, None, -1, -1, 0, None, None, 1, None, None), ("tags", "ont", 2048, "a", 10, 25, 3, "2S5M1I6D4M3H", "ACGTNACGTACG", 12, 7, "b,5,+,9M,60,0;")]
    frame = spark.createDataFrame(rows, bam.READS).coalesce(1)
    header = [("a", 5000), ("b", 3000), ("empty", 0)]
    assert [tuple(r) for r in bam.write_bam_parts(frame, header, str(tmp_path)).collect()] == [(f"{tmp_path}/part-00000.bam", 302)]
    path = f"{tmp_path}/part-00000.bam"
    got = bam.read_bam(spark, path, "ont")
    assert sorted(map(str, got.collect())) == sorted(map(str, frame.collect()))
    assert bam.bam_contigs(spark, path).collect() == [("a", 5000, 0), ("b", 3000, 1)]
    near = bam.read_bam(spark, path, "ont", "a", 100, 200).collect()
    assert {r.read_id for r in near} == {r[0] for r in rows if r[3] == "a" and r[4] < 200 and r[5] > 100}


def test_mismatches_from_bases(spark):
    rng = random.Random(9)
    ref = genome(rng, a=700)["a"]
    chunks = composition.sequence_chunks(spark.createDataFrame([("a", ref)], "contig string, seq string"), 128)
    seq = list(ref[90:120] + "GG" + ref[120:200] + ref[210:400])
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}
    for at in (0, 45, 250):
        seq[at] = other[seq[at]]
    rows = [("r", "x", 0, "a", 90, 400, 60, "3S30M2I80M10D190M", "TTT" + "".join(seq), 305, 5, None), ("clean", "x", 0, "a", 0, 50, 60, "50M", ref[:50], 50, 0, None)]
    got = {r.read_id: r.mismatches for r in support.with_mismatches(spark.createDataFrame(rows, bam.READS), chunks, 128).collect()}
    assert got == {"r": [90, 133, 348], "clean": []}


def test_streamed_filter_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i}", "s", rng.choice([0, 4, 256]), "a", 0, 9, 0, rng.choice(["9M", "2S9M"]), None, 9, rng.choice([0, 1, None]), None) for i in range(60)]
    frame = spark.createDataFrame(rows, bam.READS)
    frame.repartition(3).write.parquet(f"{tmp_path}/in")
    for short in (True, False):
        out = filters.filtered_stream(filters.read_stream(spark, f"{tmp_path}/in", 1), short)
        filters.write_stream(out, f"{tmp_path}/out{short}", f"{tmp_path}/c{short}").awaitTermination(60)
        want = filters.filtered_stream(frame, short)
        assert sorted(r.read_id for r in spark.read.parquet(f"{tmp_path}/out{short}").collect()) == sorted(r.read_id for r in want.collect())


@pytest.fixture(scope="module")
def small_run(spark, tmp_path_factory):
    """A genome of two contigs; the reads of all platforms lack [20000, 24000) of the first, and hifi and ont disagree with its base 30010."""
    top = tmp_path_factory.mktemp("run")
    rng = random.Random(21)
    seqs = genome(rng, chr1_MATERNAL=64_000, chr1_PATERNAL=40_000)
    (top / "g.fa").write_text("".join(f">{n}\n" + "".join(s[i : i + 80] + "\n" for i in range(0, len(s), 80)) for n, s in seqs.items()))
    hole = lambda r, a, b: not (r[3] == "chr1_MATERNAL" and r[4] < b and r[5] > a)
    sets = {"short": [r for r in sampled(rng, seqs, 16000, 100, 151, "short") if hole(r, 20_000, 24_000) and hole(r, 30_000, 30_050)]}
    for name, n, low, high in (("hifi", 400, 3000, 9000), ("ont", 400, 32_000, 38_000)):
        rows = []
        for r in sampled(rng, seqs, n, low, high, name):
            if not hole(r, 20_000, 24_000):
                continue
            if r[3] == "chr1_MATERNAL" and r[4] <= 30_010 < r[5]:
                at = 30_010 - r[4]
                seq = r[8][:at] + {"A": "C", "C": "A", "G": "T", "T": "G"}[r[8][at]] + r[8][at + 1 :]
                r = (*r[:8], seq, r[9], 1, None)
            rows.append(r)
        sets[name] = rows
    for name, rows in sets.items():
        folder = top / name
        folder.mkdir()
        bam.write_bam_parts(spark.createDataFrame(rows, bam.READS).coalesce(1), [(n, len(s)) for n, s in seqs.items()], str(folder)).collect()
    (top / "mask.bed").write_text("chr1_MATERNAL\t20000\t20100\n")
    cfg = PipelineConfig(*[f"{top}/{n}/part-00000.bam" for n in ("short", "hifi", "ont")], f"{top}/g.fa", f"{top}/out", masks=(f"{top}/mask.bed",), identical_regions=True)
    return cfg, run(spark, cfg), top


def test_a_run_finds_what_was_planted(spark, small_run):
    cfg, found, top = small_run
    be = {(r.contig, r.start0) for r in found["base_errors"].collect()}
    assert ("chr1_MATERNAL", 30_000) in be
    inner = {s for c, s in be if c == "chr1_MATERNAL" and 20_000 <= s < 24_000}
    assert inner == set(range(20_100, 24_000, 50))
    assert not [x for x in be if 100 < x[1] < 19_950 or 24_050 < x[1] < 29_950]
    se = {(r.contig, r.start0): r.tags for r in found["structural_errors"].collect()}
    assert any("non_spanning" in t for (c, s), t in se.items() if c == "chr1_MATERNAL")
    row = found["genome_qv"].first()
    assert row.masked_length == 100 and row.total_errors == len(be) + len(se)
    out = top / "out"
    assert (out / "summary.txt").read_text().count("QV") == 1 and (out / "config.json").exists() and "chr1_PATERNAL" in (out / "contig_qv.txt").read_text()
    stats = spark.read.csv(f"{out}/se/window_stats.tsv", sep="\t", header=True)
    assert stats.count() == 52 and stats.columns[:4] == ["Chromosome", "Start", "End", "Depth"] and stats.where("Start = '1'").count() == 2
    assert {p.name for p in (out / "be" / "by_contig").iterdir() if p.is_dir()} <= {"_contig=chr1_MATERNAL", "_contig=chr1_PATERNAL"}


def test_command_line_steps(spark, small_run, capsys):
    cfg, found, top = small_run
    (top / "g.fai").write_text("chr1_MATERNAL\t64000\t0\t80\t81\nchr1_PATERNAL\t40000\t90000\t80\t81\n")
    out = f"{top}/cli"
    main(["filter-reads", "long-read", "-i", cfg.hifi_reads, "-o", f"{out}/hifi", "-q"], spark)
    main(["filter-reads", "short-read", "-i", cfg.short_reads, "-o", f"{out}/short"], spark)
    main(["candidates", "-i", f"{out}/short", "--fai", f"{top}/g.fai", "-o", f"{out}/cand.bed"], spark)
    main(["support", f"{out}/cand.bed", f"{out}/hifi", f"{top}/g.fa", f"{out}/hifi.tsv"], spark)
    main(["merge-support", f"{out}/cand.bed", f"{out}/hifi.tsv", f"{out}/hifi.tsv", f"{top}/g.fa", f"{out}/merged.tsv"], spark)
    main(["be-filter", f"{out}/merged.tsv", f"{top}/g.fai", "-o", f"{out}/be.tsv"], spark)
    main(["be-filter", f"{out}/merged.tsv", f"{top}/g.fai", "-e"], spark)
    main(["spanning", cfg.ont_reads, f"{top}/g.fai", "-o", f"{out}/span"], spark)
    main(["se", cfg.ont_reads, f"{top}/g.fa", "--output-dir", f"{out}/se"], spark)
    rows = spark.read.csv(f"{out}/be.tsv", sep="\t")
    assert len(rows.columns) == 10 and rows.where("_c0 = 'chr1_MATERNAL' and _c1 = '30000'").count() == 1
    assert spark.read.csv(f"{out}/span.non_spanning.bed", sep="\t").count() > 0 and spark.read.text(f"{out}/se/se.result.bed").count() > 0
    assert "Mean depth" in capsys.readouterr().out


def test_bad_configurations(small_run):
    cfg, _, _ = small_run
    with pytest.raises(ConfigError):
        validate(PipelineConfig("x", "x", "x", "x", "x", base_errors=False, structural_errors=False))
    with pytest.raises(ConfigError):
        validate(PipelineConfig("/no/such.bam", cfg.hifi_reads, cfg.ont_reads, cfg.reference, "/tmp/x"))


def test_row_formats(spark):
    table = spark.createDataFrame([("a", 0, 50, 3, 4.5, -1, -1.0, 0.03125, 0.5, 1.0)], tables.MERGED)
    assert tuple(sinks.merged_support_rows(table).first()) == ("a", 0, 50, 3, "4.50", -1, "-1", "0.0312", "0.5000", "1.0000")


def test_mismatches_of_records_that_share_read_flag_and_start(spark):
    """Two supplementary records of a read at one start, on two contigs, and the same record twice."""
    rows = [("r", "ont", 2048, c, 0, 10, 60, "10M", "A" * 10, 10, 1, None) for c in ("a", "b", "a")]
    ref = {"a": "AAACAAAAAA", "b": "AAAAAAAACA"}
    chunks = spark.createDataFrame([(c, k, s[k : k + 4]) for c, s in ref.items() for k in (0, 4, 8)], "contig string, chunk_start0 bigint, seq string")
    got = sorted((r.contig, r.mismatches) for r in support.with_mismatches(spark.createDataFrame(rows, bam.READS), chunks, 4).collect())
    assert got == [("a", [3]), ("a", [3]), ("b", [8])]


def test_mismatches_within_a_slice():
    ops, ref = [("S", 2), ("M", 3), ("I", 1), ("M", 3), ("D", 2), ("M", 4)], "ACGTACGTACGTACGT"
    whole = support.mismatch_positions("ttACcxTACAACG", ops, 0, ref, 0)
    parts = [support.mismatch_positions("ttACcxTACAACG", ops, 0, ref[k : k + 5], k) for k in range(0, 15, 5)]
    assert sum(parts, []) == whole and whole


def test_contigs_in_the_order_of_the_file(spark, tmp_path, monkeypatch):
    names = ["z", "m", "a", "q", "b", "k"]
    (tmp_path / "g.fa").write_text("".join(f">{n} x\n" + "ACGT\n" * (i + 1) for i, n in enumerate(names)))
    monkeypatch.setattr(fasta, "BUCKET", 8)
    order = fasta.fasta_order(spark, str(tmp_path / "g.fa"))
    assert [r.contig for r in order.orderBy("ord").collect()] == names
    read = fasta.read_fasta(spark, str(tmp_path / "g.fa"), 8)
    assert {r.contig: r.len for r in fasta.fasta_index(read, 8).collect()} == {n: 4 * (i + 1) for i, n in enumerate(names)}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_reports_go_to_any_file_system(spark, tmp_path):
    sinks.write_text(spark, f"file://{tmp_path}/new/report.txt", "Länge\n")
    assert (tmp_path / "new" / "report.txt").read_text() == "Länge\n"
