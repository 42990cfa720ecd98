"""Independent SQL for the catalogue's queries, over the same fixture views, for DuckDB."""

from __future__ import annotations

from ridgeline.fixtures import oracle

WINDOWS = ", w{n} AS (SELECT contig, len, start0, least(start0 + {n}, len) AS end0 FROM (SELECT contig, len, unnest(range(0, len, {n})) AS start0 FROM contigs))"
W50, W2K = WINDOWS.format(n=50), WINDOWS.format(n=2000)

SPANNING = """, sw AS (
  SELECT contig, start0, start0 + 30000 AS end0 FROM (SELECT contig, unnest(range(0, len - 29999, 2000)) AS start0 FROM contigs WHERE len >= 30000)
  UNION ALL SELECT contig, cast(floor((len - 28000) / 2000.0) * 2000 AS bigint), len FROM contigs
)"""

#: A merge of relation {src}; {cmp} is > for regions that may touch, >= where they must overlap.
MERGE = """, {out}_1 AS (SELECT contig, start0, end0, max(end0) OVER (PARTITION BY contig ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT contig, start0, end0 FROM {src} WHERE start0 < end0)),
{out}_2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start0 {cmp} reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS island FROM {out}_1),
{out} AS (SELECT contig, min(start0) AS start0, max(end0) AS end0 FROM {out}_2 GROUP BY contig, island)"""


def merged(src: str, out: str, strict: bool = False) -> str:
    return MERGE.format(src=src, out=out, cmp=">=" if strict else ">")


ONT = ", ont AS (SELECT * FROM reads WHERE platform = 'ont' AND flag & 4 = 0)"

#: Depth of 2 kb windows by whole spans of ONT reads.
D2K = W2K + """, r AS (SELECT contig, start0, least(end0, contig_len) AS end0 FROM reads WHERE platform = 'ont' AND flag & 1796 = 0),
d2k AS (
  SELECT w2000.contig, w2000.len, w2000.start0, w2000.end0,
    coalesce(sum(CASE WHEN r.start0 IS NOT NULL THEN least(r.end0, w2000.end0) - greatest(r.start0, w2000.start0) END), 0) / cast(w2000.end0 - w2000.start0 AS double) AS depth
  FROM w2000 LEFT JOIN r ON r.contig = w2000.contig AND r.start0 < w2000.end0 AND w2000.start0 < r.end0
  GROUP BY w2000.contig, w2000.len, w2000.start0, w2000.end0
), m AS (SELECT avg(CASE WHEN depth > 0 THEN depth END) AS mean FROM d2k)"""

#: CIGAR operations with their place on the reference.
OPS = """, raw AS (SELECT read_id, contig, contig_len, start0, end0, flag, platform, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) AS os, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1) AS ns FROM reads),
flat AS (SELECT read_id, contig, contig_len, start0, end0, flag, platform, len(os) AS n_ops, unnest(os) AS op, cast(unnest(ns) AS bigint) AS len, unnest(range(len(os))) AS idx FROM raw),
ops AS (SELECT *, start0 + coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END) OVER (PARTITION BY read_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref0 FROM flat)"""

COUNTERS = W2K + OPS + """, spans AS (
  SELECT read_id, contig, contig_len, unnest(range(start0 // 2000 * 2000, end0 // 2000 * 2000 + 1, 2000)) AS bin FROM reads WHERE platform = 'ont' AND flag & 4 = 0
), ev AS (
  SELECT read_id, op, ref0 // 2000 * 2000 AS b0, CASE WHEN op = 'D' THEN (ref0 + len) // 2000 * 2000 ELSE ref0 // 2000 * 2000 END AS b1 FROM ops
  WHERE platform = 'ont' AND flag & 4 = 0 AND ((op IN ('I', 'D') AND len >= 50) OR (op IN ('S', 'H') AND NOT (idx = 0 AND start0 = 0) AND NOT (idx = n_ops - 1 AND end0 = contig_len)))
), per AS (
  SELECT s.contig, s.contig_len, s.bin, s.read_id, count(CASE WHEN op IN ('S', 'H') THEN 1 END) AS c, count(CASE WHEN op = 'I' THEN 1 END) AS i, count(CASE WHEN op = 'D' THEN 1 END) AS d
  FROM spans s LEFT JOIN ev ON ev.read_id = s.read_id AND b0 <= bin AND bin <= b1 WHERE s.bin < s.contig_len GROUP BY s.contig, s.contig_len, s.bin, s.read_id
), sums AS (
  SELECT contig, bin, sum(c) AS clip_count, sum(i) AS insertion, sum(d) AS deletion, count(CASE WHEN i > 0 THEN 1 END) AS reads_with_insertion, count(CASE WHEN d > 0 THEN 1 END) AS reads_with_deletion,
    count(CASE WHEN c > 0 THEN 1 END) AS reads_with_clip, count(*) AS total_reads, count(CASE WHEN c + i + d = 0 AND (bin < 10000 OR bin >= contig_len - 10000) THEN 1 END) AS clean_reads
  FROM per GROUP BY contig, bin
), counters AS (
  SELECT w.contig, w.len, w.start0, w.end0, cast(coalesce(clip_count, 0) AS bigint) AS clip_count, cast(coalesce(insertion, 0) AS bigint) AS insertion, cast(coalesce(deletion, 0) AS bigint) AS deletion,
    coalesce(reads_with_insertion, 0) AS reads_with_insertion, coalesce(reads_with_deletion, 0) AS reads_with_deletion, coalesce(reads_with_clip, 0) AS reads_with_clip, coalesce(total_reads, 0) AS total_reads, coalesce(clean_reads, 0) AS clean_reads
  FROM w2000 w LEFT JOIN sums s ON s.contig = w.contig AND s.bin = w.start0
)"""

NAMES = "clip_count, insertion, deletion, reads_with_insertion, reads_with_deletion, reads_with_clip, total_reads, clean_reads"

GAPS = SPANNING + """, u AS (SELECT contig, greatest(start0, 0) AS start0, end0 FROM sw WHERE NOT EXISTS (SELECT 1 FROM reads r WHERE r.platform = 'ont' AND r.flag & 4 = 0 AND r.contig = sw.contig AND r.start0 <= sw.start0 AND r.end0 >= sw.end0))""" + merged("u", "um") + """, gaps AS (
  SELECT contig, start0, end0 FROM (
    SELECT um.contig, CASE WHEN um.start0 <> 0 AND um.end0 = c.len THEN um.start0 + 28000 ELSE um.start0 END AS start0, CASE WHEN um.start0 = 0 THEN um.end0 - 28000 ELSE um.end0 END AS end0 FROM um JOIN contigs c ON c.contig = um.contig
  ) WHERE start0 < end0
), gaps2k AS (SELECT contig, start0, least(start0 + 2000, stop) AS end0 FROM (SELECT contig, end0 AS stop, unnest(range(start0 // 2000 * 2000, end0, 2000)) AS start0 FROM gaps))"""

STATS = COUNTERS + D2K.replace(W2K, "", 1) + GAPS + """, stats AS (
  SELECT c.*, d.depth, c.start0 < 10000 OR c.start0 >= c.len - 10000 AS is_terminal, g.contig IS NULL AS has_spanning
  FROM counters c JOIN d2k d ON d.contig = c.contig AND d.start0 = c.start0 LEFT JOIN (SELECT DISTINCT contig, start0 FROM gaps2k) g ON g.contig = c.contig AND g.start0 = c.start0
), tagged AS (
  SELECT s.*, list_filter([
    CASE WHEN NOT has_spanning THEN 'non_spanning' END,
    CASE WHEN NOT is_terminal AND depth > 0 AND depth < mean * 0.2e0 THEN 'low_depth' WHEN NOT is_terminal AND depth > mean * 2.0e0 THEN 'high_depth' END,
    CASE WHEN NOT is_terminal AND total_reads > 0 AND clip_count / cast(total_reads AS double) > 0.5e0 THEN 'clip' END,
    CASE WHEN NOT is_terminal AND total_reads > 0 AND reads_with_insertion / cast(total_reads AS double) > 0.5e0 THEN 'indel' END,
    CASE WHEN NOT is_terminal AND total_reads > 0 AND reads_with_deletion / cast(total_reads AS double) > 0.5e0 THEN 'indel' END,
    CASE WHEN is_terminal AND total_reads > 0 AND (clean_reads < 1 OR clean_reads / cast(total_reads AS double) <= 0.1e0) THEN CASE WHEN insertion > 0 OR deletion > 0 THEN 'indel' ELSE 'clip' END END
  ], lambda x: x IS NOT NULL) AS tags FROM stats s, m WHERE mean IS NOT NULL
), found AS (SELECT * FROM tagged WHERE len(tags) > 0)"""

#: Depth runs of clean short reads over whole contigs.
RUNS = OPS + """, ok AS (SELECT * FROM reads WHERE platform = 'short' AND nm = 0 AND NOT regexp_matches(cigar, '[SH]') AND flag & 1796 = 0),
steps AS (
  SELECT contig, pos, sum(delta) AS delta FROM (
    SELECT contig, start0 AS pos, 1 AS delta FROM ok UNION ALL SELECT contig, end0, -1 FROM ok
    UNION ALL SELECT o.contig, o.ref0, -1 FROM ops o JOIN ok USING (read_id) WHERE o.op IN ('D', 'N') UNION ALL SELECT o.contig, o.ref0 + o.len, 1 FROM ops o JOIN ok USING (read_id) WHERE o.op IN ('D', 'N')
    UNION ALL SELECT contig, 0, 0 FROM contigs UNION ALL SELECT contig, len, 0 FROM contigs) GROUP BY contig, pos
), pieces AS (
  SELECT contig, pos AS start0, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS end0, sum(delta) OVER (PARTITION BY contig ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM steps
), marked AS (
  SELECT *, CASE WHEN lag(depth) OVER (PARTITION BY contig ORDER BY start0) = depth THEN 0 ELSE 1 END AS new FROM pieces WHERE end0 IS NOT NULL
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY start0 ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT contig, cast(min(start0) AS bigint) AS start0, cast(max(end0) AS bigint) AS end0, cast(any_value(depth) AS bigint) AS depth FROM numbered GROUP BY contig, run),
mean AS (SELECT round(sum(depth * (end0 - start0)) / cast((SELECT sum(len) FROM contigs) AS double), 2) AS mean_depth FROM runs),
low AS (SELECT contig, start0, end0, depth FROM runs, mean WHERE depth < round(mean_depth * 0.1e0, 4))"""

CAND = RUNS + W50 + ", cand AS (SELECT contig, start0, end0 FROM w50 WHERE EXISTS (SELECT 1 FROM low WHERE low.contig = w50.contig AND low.start0 < w50.end0 AND w50.start0 < low.end0))"

SUPPORT = """, {p}_met AS (
  SELECT c.contig, c.start0 AS s, c.end0 AS e, r.read_id, r.start0 AS r0, r.end0 AS r1, r.mm0 FROM cand c JOIN (SELECT * FROM reads WHERE platform = '{p}') r ON r.contig = c.contig AND r.start0 < c.end0 AND c.start0 < r.end0
), {p}_bad AS (
  SELECT DISTINCT m.read_id, m.s FROM {p}_met m JOIN (SELECT * FROM ops WHERE platform = '{p}' AND op IN ('I', 'D')) o ON o.read_id = m.read_id
  WHERE (o.ref0 > m.s AND o.ref0 <= m.e) OR (o.op = 'D' AND o.ref0 < m.e AND o.ref0 + o.len > m.s)
), {p} AS (
  SELECT c.contig, c.start0, c.end0, CASE WHEN bases > 1000 * (c.end0 - c.start0) THEN 0 ELSE coalesce(perfect, 0) END AS min_support, round(coalesce(bases, 0) / cast(c.end0 - c.start0 AS double), 2) AS avg_depth
  FROM cand c LEFT JOIN (
    SELECT m.contig, m.s, count(CASE WHEN r0 <= m.s AND r1 >= m.e AND (mm0 IS NULL OR mm0 < m.s OR mm0 >= m.e) AND b.read_id IS NULL THEN 1 END) AS perfect, sum(least(r1, m.e) - greatest(r0, m.s)) AS bases
    FROM {p}_met m LEFT JOIN {p}_bad b ON b.read_id = m.read_id AND b.s = m.s GROUP BY m.contig, m.s) x ON x.contig = c.contig AND x.s = c.start0
)"""

COMPOSED = """, cseq AS (SELECT c.contig, substring(repeat(s.seq, cast(c.len // length(s.seq) AS int) + 1), 1, c.len) AS seq FROM contigs c JOIN seqs s ON s.doc_id = c.contig_id),
wseq AS (SELECT w.contig, w.start0, w.end0, coalesce(substring(q.seq, w.start0 + 1, w.end0 - w.start0), '') AS seq FROM {src} w LEFT JOIN cseq q ON q.contig = w.contig),
comp AS (
  SELECT contig, start0, end0,
    CASE WHEN length(seq) > 0 THEN round_even(length(regexp_replace(seq, '[^AG]', '', 'g')) / cast(length(seq) AS double), 4) ELSE 0.0e0 END AS ag,
    CASE WHEN length(seq) > 0 THEN round_even(length(regexp_replace(seq, '[^CT]', '', 'g')) / cast(length(seq) AS double), 4) ELSE 0.0e0 END AS ct,
    CASE WHEN length(seq) > 0 THEN round_even(length(regexp_replace(seq, '[^GC]', '', 'g')) / cast(length(seq) AS double), 4) ELSE 0.0e0 END AS gc FROM wseq
)"""

TABLE = CAND + SUPPORT.format(p="hifi") + SUPPORT.format(p="ont") + COMPOSED.format(src="cand") + """, tab AS (
  SELECT k.contig, k.start0, k.end0, h.min_support AS hifi, h.avg_depth AS hifi_depth, o.min_support AS ont, o.avg_depth AS ont_depth, ag, ct, gc, c.len
  FROM comp k JOIN hifi h USING (contig, start0, end0) JOIN ont o USING (contig, start0, end0) JOIN contigs c USING (contig)
), good AS (
  SELECT *, CASE WHEN start0 <= 10000 OR end0 >= len - 10000 OR ((ag >= 0.9e0 OR ct >= 0.9e0) AND gc >= 0.6e0) OR gc >= 0.9e0
    THEN (hifi > 0 AND hifi_depth <> 0 AND hifi / hifi_depth >= 0.1e0) OR (ont > 0 AND ont_depth <> 0 AND ont / ont_depth >= 0.1e0) ELSE hifi > 4 OR ont > 3 END AS ok
  FROM tab WHERE hifi_depth <= 1000 AND ont_depth <= 1000
)"""
TABLE_COLUMNS = "contig, start0, end0, hifi, hifi_depth, ont, ont_depth, ag, ct, gc"

PHRED = "CASE WHEN {e} = 0 THEN '∞' WHEN {n} <= 0 THEN 'N/A' ELSE printf('%.2f', -10.0e0 * log10({e} / cast({n} AS double))) END"

R, M, C = "reads", "mask", "contigs"

ORACLES = {
    "se_depth_anomaly": oracle(D2K + " SELECT contig, cast(count(*) AS bigint) AS windows, count(CASE WHEN inner_ AND depth > 0 AND depth < mean * 0.2e0 THEN 1 END) AS low_depth, count(CASE WHEN inner_ AND depth > mean * 2.0e0 THEN 1 END) AS high_depth FROM (SELECT *, NOT (start0 < 10000 OR start0 >= len - 10000) AS inner_ FROM d2k, m) GROUP BY contig", R),
    "tumbling_windows_50": oracle(W50 + " SELECT contig, start0, end0 FROM w50", C),
    "tumbling_windows_2k": oracle(W2K + " SELECT contig, start0, end0 FROM w2000", C),
    "spanning_windows": oracle(SPANNING + " SELECT contig, start0, end0 FROM sw", C),
    "split_bed_50": oracle(" SELECT contig, start0, least(start0 + 50, len) AS end0 FROM (SELECT m.contig, c.len, unnest(range(m.start0 // 50 * 50, least(m.end0, c.len), 50)) AS start0 FROM mask m JOIN contigs c ON c.contig = m.contig)", M),
    "region_windows_2k": oracle(" SELECT contig, start0, least(start0 + 2000, stop) AS end0 FROM (SELECT contig, end0 AS stop, unnest(range(start0 // 2000 * 2000, end0, 2000)) AS start0 FROM mask)", M),
    "region_window_keys_2k": oracle(" SELECT DISTINCT contig, unnest(range(start0 // 2000 * 2000, end0, 2000)) AS start0 FROM mask", M),
    "kmer_extension": oracle(" SELECT m.contig, m.start0, least(m.end0 + 150, c.len) AS end0 FROM mask m JOIN contigs c ON c.contig = m.contig WHERE m.start0 < least(m.end0 + 150, c.len)", M),
    "short_read_filter": oracle(" SELECT read_id FROM reads WHERE platform = 'short' AND nm = 0 AND cigar NOT LIKE '%S%' AND cigar NOT LIKE '%H%'", R),
    "primary_filter": oracle(" SELECT read_id, flag FROM reads WHERE platform <> 'short' AND flag & 2308 = 0", R),
    "split_read_filter": oracle(" SELECT read_id FROM reads WHERE platform <> 'short' AND flag & 2308 = 0 AND (sa IS NULL OR len(list_filter(string_split(sa, ';'), lambda x: x <> '')) <= 3.0e0 + 0.05e0 * seq_len / 1000.0e0)", R),
    "filter_breakdown": oracle(" SELECT count(*) AS total, count(CASE WHEN g AND NOT s THEN 1 END) AS kept, count(CASE WHEN g AND s THEN 1 END) AS clip_only, count(CASE WHEN NOT g AND NOT s THEN 1 END) AS mismatch_only, count(CASE WHEN NOT g AND s THEN 1 END) AS both, round(count(CASE WHEN g AND NOT s THEN 1 END) * 100.0e0 / count(*), 2) AS kept_percent FROM (SELECT coalesce(nm = 0, false) AS g, regexp_matches(cigar, '[SH]') AS s FROM reads WHERE platform = 'short')", R),
    "long_filter_breakdown": oracle(" SELECT count(*) AS total, count(CASE WHEN p THEN 1 END) AS primary_reads, count(CASE WHEN p AND NOT f THEN 1 END) AS dropped_splits, count(CASE WHEN p AND f THEN 1 END) AS kept FROM (SELECT flag & 2308 = 0 AS p, sa IS NULL OR (length(sa) - length(replace(sa, ';', ''))) <= 3.0e0 + 0.05e0 * seq_len / 1000.0e0 AS f FROM reads WHERE platform <> 'short')", R),
    "overlap_semi": oracle(W50 + " SELECT contig, start0, end0 FROM w50 WHERE EXISTS (SELECT 1 FROM mask m WHERE m.contig = w50.contig AND m.start0 < w50.end0 AND w50.start0 < m.end0)", M),
    "overlap_anti_mask": oracle(W2K + " SELECT contig, start0, end0 FROM w2000 WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.contig = w2000.contig AND m.start0 < w2000.end0 AND w2000.start0 < m.end0)", M),
    "overlap_pairs": oracle(" SELECT m.contig, m.start0, m.end0, count(*) AS reads, cast(sum(least(m.end0, r.end0) - greatest(m.start0, r.start0)) AS bigint) AS bases FROM mask m JOIN reads r ON r.contig = m.contig AND r.start0 < m.end0 AND m.start0 < r.end0 GROUP BY m.contig, m.start0, m.end0", R, M),
    "interval_merge": oracle(", src AS (SELECT contig, start0, end0 FROM reads WHERE platform = 'short')" + merged("src", "out") + " SELECT contig, start0, end0 FROM out", R),
    "interval_merge_strict": oracle(", src AS (SELECT contig, unnest(range(start0 // 50 * 50, end0, 50)) AS start0 FROM mask), src2 AS (SELECT contig, start0, start0 + 50 AS end0 FROM src)" + merged("src2", "out", True) + " SELECT contig, start0, end0 FROM out", M),
    "depth_runs": oracle(RUNS + " SELECT contig, start0, end0, depth FROM runs", R),
    "mean_depth": oracle(RUNS + " SELECT mean_depth FROM mean", R),
    "low_depth_bases": oracle(RUNS + " SELECT contig, start0, end0, depth FROM low", R),
    "be_candidates": oracle(CAND + " SELECT contig, start0, end0 FROM cand", R),
    "candidate_summary": oracle(CAND + " SELECT count(*) AS small, (SELECT count(*) FROM w50) AS total, round(count(*) * 100.0e0 / (SELECT count(*) FROM w50), 2) AS percent FROM cand", R),
    "window_depth_2k": oracle(D2K + " SELECT contig, start0, end0, depth FROM d2k", R),
    "cigar_ops": oracle(OPS + " SELECT read_id, cast(idx AS int) AS idx, op, len, cast(ref0 AS bigint) AS ref0, cast(ref0 + CASE WHEN op IN ('M','D','N','=','X') THEN len ELSE 0 END AS bigint) AS ref1 FROM ops", R),
    "se_window_counters": oracle(COUNTERS + f" SELECT contig, start0, end0, {NAMES} FROM counters", R),
    "se_window_stats": oracle(STATS + f" SELECT contig, start0, end0, {NAMES}, depth, is_terminal, has_spanning FROM stats", R),
    "se_anomalies": oracle(STATS + " SELECT contig, start0, end0, is_terminal, depth, has_spanning, array_to_string(tags, ',') AS tags FROM found", R),
    "se_anomaly_summary": oracle(STATS + ", s AS (SELECT contig, " + ", ".join(f"count(CASE WHEN list_contains(tags, '{t}') THEN 1 END) AS {t}" for t in ("low_depth", "high_depth", "indel", "clip", "non_spanning")) + ", count(*) AS nr_se FROM found GROUP BY contig), t AS (SELECT c.contig, " + ", ".join(f"coalesce({t}, 0) AS {t}" for t in ("low_depth", "high_depth", "indel", "clip", "non_spanning", "nr_se")) + " FROM contigs c LEFT JOIN s ON s.contig = c.contig) SELECT * FROM t UNION ALL SELECT 'Total', " + ", ".join(f"cast(sum({t}) AS bigint)" for t in ("low_depth", "high_depth", "indel", "clip", "non_spanning", "nr_se")) + " FROM t", R),
    "se_terminal_counts": oracle(STATS + " SELECT contig, count(CASE WHEN insertion + deletion > 0 THEN 1 END) AS indel, count(CASE WHEN insertion + deletion = 0 THEN 1 END) AS clip FROM stats WHERE is_terminal AND total_reads > 0 AND clean_reads / cast(total_reads AS double) < 0.1e0 GROUP BY contig", R),
    "se_result_merged": oracle(STATS + merged("found", "out") + " SELECT contig, start0, end0 FROM out", R),
    "nonspanning_windows": oracle(GAPS + " SELECT contig, start0, end0 FROM u", R),
    "nonspanning_regions": oracle(GAPS + " SELECT contig, start0, end0 FROM gaps", R),
    "nonspanning_windows_2k": oracle(GAPS + " SELECT contig, start0, end0 FROM gaps2k", R),
    "window_support": oracle(CAND + SUPPORT.format(p="hifi") + " SELECT contig, start0, end0, min_support, avg_depth FROM hifi", R),
    "support_merge": oracle(CAND + SUPPORT.format(p="hifi") + SUPPORT.format(p="ont") + " SELECT c.contig, c.start0, c.end0, coalesce(h.min_support, -1) AS hifi, coalesce(h.avg_depth, -1.0e0) AS hifi_depth, coalesce(o.min_support, -1) AS ont, coalesce(o.avg_depth, -1.0e0) AS ont_depth FROM cand c LEFT JOIN (SELECT * FROM hifi WHERE avg_depth > 0) h USING (contig, start0, end0) LEFT JOIN ont o USING (contig, start0, end0)", R),
    "base_composition": oracle(W50 + COMPOSED.format(src="w50") + " SELECT contig, start0, end0, ag, ct, gc FROM comp", "contigs", "seqs"),
    "be_support_table": oracle(TABLE + f" SELECT {TABLE_COLUMNS} FROM tab", R, "seqs"),
    "be_final": oracle(TABLE + f" SELECT {TABLE_COLUMNS} FROM good WHERE NOT ok", R, "seqs"),
    "be_final_excluded": oracle(TABLE + f" SELECT {TABLE_COLUMNS} FROM good WHERE ok", R, "seqs"),
    "contig_qv": oracle(TABLE + STATS.replace(OPS, "", 1).replace(RUNS, "", 1) + ", be AS (SELECT contig, count(*) AS n FROM good WHERE NOT ok GROUP BY contig), se AS (SELECT contig, count(*) AS n FROM found GROUP BY contig) SELECT contig, len, be_errors, se_errors, be_errors + se_errors AS total_errors, " + PHRED.format(e="(be_errors + se_errors)", n="len") + " AS qv FROM (SELECT c.contig, c.len, coalesce(be.n, 0) AS be_errors, coalesce(se.n, 0) AS se_errors FROM contigs c LEFT JOIN be ON be.contig = c.contig LEFT JOIN se ON se.contig = c.contig)", R, "seqs"),
    "genome_qv": oracle(TABLE + STATS.replace(OPS, "", 1).replace(RUNS, "", 1) + merged("mask", "mm") + ", n AS (SELECT cast((SELECT sum(len) FROM contigs) AS bigint) AS reference_length, cast((SELECT sum(end0 - start0) FROM mm) AS bigint) AS masked_length, (SELECT count(*) FROM good WHERE NOT ok) AS be_errors, (SELECT count(*) FROM found) AS se_errors) SELECT *, reference_length - masked_length AS length, be_errors + se_errors AS total_errors, round(-10.0e0 * log10((be_errors + se_errors) / cast(reference_length - masked_length AS double)), 6) AS qv FROM n", R, M, "seqs"),
    "haplotype_suffixes": oracle(" SELECT suffix, n, first FROM (SELECT list_extract(string_split(contig, '_'), -1) AS suffix, count(*) AS n, min(ord) AS first FROM contigs WHERE contains(contig, '_') GROUP BY 1) ORDER BY n DESC, first LIMIT 2", C),
    "identical_kmers": oracle(", k AS (SELECT contig, doc_id % 2 AS hap, unnest(range(0, length(seq) - 149)) AS pos, seq FROM seqs WHERE length(seq) >= 150), kk AS (SELECT contig, hap, pos, substring(seq, pos + 1, 150) AS kmer FROM k), g AS (SELECT contig, pos FROM (SELECT contig, pos, count(*) OVER (PARTITION BY hap, hash(kmer), md5(kmer)) AS n FROM kk WHERE NOT contains(kmer, 'N')) WHERE n > 1), p AS (SELECT g.contig, g.pos AS start0, g.pos + 1 AS end0 FROM g)" + merged("p", "pr") + ", e AS (SELECT pr.contig, pr.start0, least(pr.end0 + 150, length(s.seq)) AS end0 FROM pr JOIN seqs s ON s.contig = pr.contig)" + merged("e", "out") + " SELECT contig, start0, end0 FROM out", "seqs"),
    "masked_length": oracle(merged("mask", "mm") + " SELECT contig, cast(sum(end0 - start0) AS bigint) AS masked FROM mm GROUP BY contig", M),
    "masked_length_raw": oracle(" SELECT contig, cast(sum(end0 - start0) AS bigint) AS masked FROM mask GROUP BY contig", M),
    "legacy_error_type": oracle(", t AS (SELECT CASE WHEN contains(r, 'Low depth') THEN 'low_depth' WHEN contains(r, 'High depth') THEN 'high_depth' WHEN contains(r, 'insertion reads ratio') OR contains(r, 'deletion reads ratio') THEN 'indel' WHEN contains(r, 'clip ratio') THEN 'clip' WHEN contains(r, 'Terminal region anomaly') THEN 'terminal' ELSE 'other' END AS error_type FROM (SELECT concat(CASE WHEN flag = 4 THEN 'Low depth; ' ELSE '' END, CASE WHEN nm > 4 THEN 'High clip ratio' WHEN nm > 2 THEN 'High deletion reads ratio' WHEN nm > 1 THEN 'Terminal region anomaly' ELSE 'none' END) AS r FROM reads)) SELECT error_type, count(*) AS n FROM t GROUP BY error_type", R),
    "stage_counts": oracle(RUNS + W50 + " SELECT 'reads' AS stage, count(*) AS rows FROM reads UNION ALL SELECT 'windows', count(*) FROM w50 UNION ALL SELECT 'mask', count(*) FROM mask", R, M),
}
