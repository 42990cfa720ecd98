"""Jaccard join, line dedup and substring dedup against brute force on small tables."""

import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import line_dedup, ngram_join, substring_dedup
from ridgeline.llm.shared import components, materialize, placed
from tests.llm.helpers import edited, plain_components, prose, roots

def corpus(seed, n=150):
    rng = random.Random(seed)
    common = prose(rng, 25)
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            base = rng.choice(out)
            out.append(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])) if base.split() else base)
        elif kind < 0.7:
            out.append(prose(rng, rng.randrange(1, 14)))
        elif kind < 0.85:
            out.append(common + " " + prose(rng, rng.randrange(1, 60)))
        else:
            out.append(prose(rng, rng.randrange(0, 150)))
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3), (2, 80, 4)])
def test_components_are_exact(spark, size, percent, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, size=size, percent=percent).collect()}
    assert got == plain_components(docs, size, percent)


def test_components_when_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "ROW", 3)
    rng = random.Random(9)
    base = prose(rng, 60)
    docs = [(i, edited(rng, base, rng.randrange(0, 5))) for i in range(60)] + [(100 + i, base.upper()) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, size=3, percent=80).collect()}
    assert got == plain_components(docs, 3, 80)


def test_components_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c d"), (7, "a b c d"), (None, "a"), (8, "x y z"), (8, "p q r"), (9, "P Q R")]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id bigint, text string, key int, component string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (7, 2, 7), (None, 1, None), (8, 1, 8), (8, 1, 8), (9, 1, 8)], key=str)
    assert ngram_join.jaccard_components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_as_many_tokens_as_they_need(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        b = a.copy()
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([b[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < percent * (len(a) + len(b) - common):
            continue
        hot = np.sort(rng.choice(a, int(rng.integers(0, n + 1)), replace=False)) if rng.random() < 0.7 else a[:0]
        (x, needs_x), (y, needs_y) = (ngram_join.tokens_of_set(s, percent, hot) for s in (a, b))
        both, at_x, at_y = np.intersect1d(x, y, return_indices=True)
        counts = [np.count_nonzero(both & np.uint64(1) == k) for k in (0, 1)]
        need = [max(needs_x[at_x][both & np.uint64(1) == k].max(initial=0), needs_y[at_y][both & np.uint64(1) == k].max(initial=0)) for k in (0, 1)]
        assert any(n and n >= least for n, least in zip(counts, need, strict=True))


def test_component_rounds(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(25)] + [(100, 100 + i) for i in range(1, 50)]
    frame = spark.createDataFrame([*links, (None, 3), (7, None), (200, 200)], "a bigint, b bigint")
    nodes = {x for p in links for x in p if p[0] != p[1]}
    want = roots(nodes, links)
    assert {r.id: r.component for r in components(frame).collect()} == want
    assert components(frame.limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def plain_lines(docs):
    """(row, line_no) -> words of every line with a word, without the engine."""
    out = {}
    for row, (_, text) in enumerate(docs):
        for k, line in enumerate((text or "").split("\n")):
            words = tuple(w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", line.lower()) if w)
            if words:
                out[row, k] = words
    return out


def plain_pairs(lines, percent):
    """All pairs of different lines whose edit distance leaves `percent` of the longer one."""
    distinct = sorted(set(lines.values()))
    for a, b in combinations(distinct, 2):
        longest = max(len(a), len(b))
        if 100 * min(len(a), len(b)) >= percent * longest and 100 * sum((Counter(a) & Counter(b)).values()) >= percent * longest:
            if 100 * (longest - levenshtein(a, b)) >= percent * longest:
                yield a, b


def line_corpus(seed, n=40):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randrange(8, 60)) for _ in range(25)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            line = rng.choice(pool) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 30))
            lines.append(edited(rng, line, rng.choice([0, 1, 1, 2])).capitalize() + rng.choice(["", ".", " !"]))
            if rng.random() < 0.2:
                lines.append("")
        docs.append((i, "\n".join(lines)))
    return docs


def linked_lines(spark, texts, **rules):
    """The groups of lines that the join links, and those of all similar pairs, as sets of word tuples."""
    frame = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), "lines")
    rows = placed(frame).select(F.col("row.doc_id").alias("id"), "file", "at", "row.text")
    lines = plain_lines(list(enumerate(texts)))
    hashed = line_dedup.lines_of(rows)
    text = {r.h1: lines[r.id, r.line_no] for r in hashed.select("h1", "id", "line_no").collect()}
    known = hashed.groupBy("h1").agg(F.min(F.struct("id", "file", "at", "line_no")).alias("first"), F.first("n").alias("n"), F.first("d").alias("d"))
    found = components(line_dedup.line_links(rows, known, line_dedup.LineRules(**rules))).collect()
    got, want = {}, {}
    for r in found:
        got.setdefault(r.component, set()).add(text[r.id])
    for w, root in roots(set(lines.values()), list(plain_pairs(lines, rules.get("percent", 80)))).items():
        want.setdefault(root, set()).add(w)
    return sorted(map(sorted, got.values())), sorted(sorted(x) for x in want.values() if len(x) > 1)


@pytest.mark.parametrize(("seed", "percent"), [(3, 80), (12, 80), (5, 70), (6, 90)])
def test_no_similar_line_is_lost(spark, seed, percent):
    got, want = linked_lines(spark, [t for _, t in line_corpus(seed, 120)], percent=percent)
    assert got == want and want


def test_no_similar_line_is_lost_in_a_large_group(spark):
    """Lines around many centres that all share their word pairs, repeated words, and lines of all lengths with as many edits as may be."""
    rng = random.Random(17)
    common = prose(rng, 30).split()
    texts = []
    for _ in range(25):
        centre = common[:12] + prose(rng, 10).split() + common[12:]
        for _ in range(8):
            line = list(centre)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(0, 2)] = rng.choice([[], ["new"], [prose(rng, 1)]])
            texts.append(" ".join(line))
    for n in (*range(4, 40), 64, 90, 150):
        line = prose(rng, n).split() if n % 3 else ["one", "two", *prose(rng, n // 3).split()] * 3
        most = len(line) // 5
        for at in (range(0, 5 * most, 5), rng.sample(range(len(line)), most)):
            texts += [" ".join(line), " ".join(f"x{i}" if i in at else w for i, w in enumerate(line)), " ".join(w for i, w in enumerate(line) if i not in at)]
    got, want = linked_lines(spark, texts)
    assert got == want and max(map(len, want)) > 5


def test_simhash_of_a_line(spark):
    frame = spark.createDataFrame([(1, "one two two three"), (2, "One; two TWO three"), (3, " ".join(["many", "words"] * 9000)), (4, "one one two " * 100)], "doc_id bigint, text string")
    rows = placed(frame).select("row.doc_id", "row.text", "file", "at").withColumnRenamed("doc_id", "id")
    rows = {r.id: r for r in line_dedup.lines_of(rows).collect()}
    words = {r.w: r.h for r in spark.sql("select w, xxhash64(w) h from values ('one'), ('two'), ('three') t(w)").collect()}
    bits = [sum(((words[w] >> i) & 1) * 2 - 1 for w in ("one", "two", "two", "three")) for i in range(64)]
    assert rows[1].s % 2**64 == sum(1 << i for i in range(64) if bits[i] > 0) and rows[1].n == 4 and rows[3].n == 18000
    # the sketch: which of 64 numbers an odd count of words has
    odd = Counter((words[w] % 2**64) >> 58 for w in ("one", "two", "two", "three"))
    assert rows[1].d % 2**64 == sum(1 << at for at, n in odd.items() if n % 2)
    # a line of more words than a small counter holds; two thirds of its words are one
    assert rows[4].n == 300 and rows[4].s == words["one"]
    assert (rows[1].h1, rows[1].s, rows[1].d) == (rows[2].h1, rows[2].s, rows[2].d)


@pytest.mark.parametrize("seed", [3, 12])
def test_lines_against_edit_similarity(spark, seed):
    """Groups hold links only, all copies but the first go, and nine of ten similar pairs are connected."""
    docs = line_corpus(seed, 120)
    docs += docs[:5]
    lines = plain_lines(docs)
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id bigint, text string, row int").repartition(3)
    frame = materialize(frame, "lines")
    rows = {(r.file, r.at): r["row"] for r in placed(frame).select("file", "at", "row.row").collect()}
    got = {(rows[r.file, r.at], r.line_no): r.kept for r in line_dedup.line_decisions(frame).collect()}
    assert set(got) == set(lines)
    pairs = list(plain_pairs(lines, 80))
    whole = roots(set(lines.values()), pairs)
    kept = [p for p, k in got.items() if k]
    # a dropped line has a similar one that stays before it; of equal lines one stays at most
    first = {}
    for p in sorted(lines, key=lambda p: (docs[p[0]][0], p)):
        first.setdefault(whole[lines[p]], p)
    assert all(got[p] for p in first.values() if docs[p[0]] not in docs[-5:])
    assert len({lines[p] for p in kept}) == len(kept)
    # what is connected: every text that went is similar, over links, to one that stays
    gone = {w for p, w in lines.items() if not got[p]} - {lines[p] for p in kept}
    assert gone and {whole[w] for w in gone} <= {whole[lines[p]] for p in kept}
    spark_rows = placed(frame).select(F.col("row.doc_id").alias("id"), "file", "at", "row.text")
    known = line_dedup.lines_of(spark_rows)
    text = {r.h1: lines[rows[r.file, r.at], r.line_no] for r in known.collect()}
    known = known.groupBy("h1").agg(F.min(F.struct("id", "file", "at", "line_no")).alias("first"), *[F.first(c).alias(c) for c in "nsd"])
    found = components(line_dedup.line_links(spark_rows, known, line_dedup.LineRules())).collect()
    group = {text[r.id]: r.component for r in found}
    assert all(whole[text[r.id]] == whole[text[r.component]] for r in found)
    met = sum(a in group and group[a] == group.get(b) for a, b in pairs)
    assert met >= 0.9 * len(pairs)


def test_tables_of_word_pairs_go_once_they_are_read(spark, monkeypatch):
    """When the last lines are compared, no scratch table of word pairs stands any more."""
    inner, left = line_dedup.similar_lines, []

    def watched(*args):
        tables = {p.parent for p in Path(root).glob("lines-*/*.parquet")} - before
        left.append([t.name for t in tables if {"key", "keys"} & set(spark.read.parquet(str(t)).columns)])
        return inner(*args)

    frame = materialize(spark.createDataFrame(line_corpus(3), "doc_id bigint, text string"), "lines")
    root = Path(frame.inputFiles()[0].removeprefix("file:")).parents[1]
    before = {p.parent for p in root.glob("lines-*/*.parquet")}
    monkeypatch.setattr(line_dedup, "similar_lines", watched)
    assert line_dedup.line_decisions(frame).count()
    assert len(left) == 2 and left[0] and not left[1]


def test_lines_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "...\n\n"), (4, "a b\nA, B!\nc"), (4, "c"), (None, "a b"), (5, "a b\nnew\n---"), (7, "x y\nz w"), (7, "q r\nx y"), (8, "m n"), (8, "m n")]
    frame = spark.createDataFrame([(*d, 3, "k") for d in docs], "doc_id bigint, text string, line_no int, `file.at` string")
    got = Counter((r.doc_id, r.line_no, r.kept) for r in line_dedup.line_decisions(frame).collect())
    mine = {k: n for k, n in got.items() if k[0] in (5, 8, None)}
    assert mine == {(5, 0, False): 1, (5, 1, True): 1, (None, 0, False): 1, (8, 0, True): 1, (8, 0, False): 1}
    assert sum(n for k, n in got.items() if k[0] == 4 and k[2]) == 2 and sum(n for k, n in got.items() if k[0] == 7 and k[2]) == 3
    assert line_dedup.line_decisions(frame.limit(0)).count() == 0
    out = line_dedup.without_repeated_lines(frame)
    assert out.columns == frame.columns and out.count() == len(docs)
    left = Counter(line for r in out.collect() for line in (r.text or "").split("\n") if line.strip(".-"))
    assert set(left.values()) == {1} and {x.lower().replace(",", "").replace("!", "") for x in left} == {"a b", "c", "new", "x y", "z w", "q r", "m n"}


def test_a_very_long_line(spark):
    rng = random.Random(8)
    long = prose(rng, 40_000)
    docs = [(1, long), (2, long + " more"), (3, "some words\n" + prose(rng, 20_000))]
    got = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_decisions(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(1, 0): True, (2, 0): False, (3, 0): True, (3, 1): True}


def test_compact_windows_are_those_of_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 30, 4)
        of = np.repeat(np.arange(4), sizes)
        h = rng.permutation(len(of)).astype(np.uint64) + np.uint64(1)
        width = int(rng.integers(1, 9))
        got = set(zip(*[x.tolist() for x in substring_dedup.compact_windows(h, of, width)], strict=True))
        want = set()
        for c in range(len(of)):
            left = right = c
            while left > 0 and of[left - 1] == of[c] and h[left - 1] > h[c]:
                left -= 1
            while right + 1 < len(of) and of[right + 1] == of[c] and h[right + 1] > h[c]:
                right += 1
            if right - left + 1 >= width:
                want.add((c, left, right))
        assert got == want


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(6)
    shared, other, own = prose(rng, 60), prose(rng, 120), prose(rng, 55)
    near = other.split()
    near[30] = "changed"
    near.insert(80, "more")
    docs = [
        (1, prose(rng, 100) + " " + shared + " " + prose(rng, 40)),
        (2, prose(rng, 7) + " " + shared.upper() + " " + prose(rng, 300)),
        (3, shared),
        (4, other),
        (5, prose(rng, 90) + " " + " ".join(near) + " " + prose(rng, 90)),
        (6, own + " " + prose(rng, 30) + " " + own),
        (7, prose(rng, 400)),
        (8, None),
        (9, ""),
        (10, " ".join(shared.split()[:40])),
        (None, shared),
        (12, prose(rng, 2000)),
    ]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, of_id int").repartition(3)
    got = {(r.doc_id, r.of_id): r for r in substring_dedup.repeated_passages(frame).collect()}
    assert set(got) == {(2, 1), (3, 1), (5, 4), (6, 6)}
    assert (got[2, 1].first_word, got[2, 1].end_word, got[2, 1].of_first_word, got[2, 1].of_end_word, got[2, 1].similarity) == (7, 67, 100, 160, 1.0)
    assert (got[5, 4].first_word, got[5, 4].end_word) == (90, 211) and 0.8 <= got[5, 4].similarity < 1
    assert (got[6, 6].first_word, got[6, 6].end_word) == (85, 140)
    assert substring_dedup.repeated_passages(frame.limit(0)).count() == 0


def test_every_exact_passage_is_covered(spark):
    rng = random.Random(12)
    pool = [prose(rng, 70) for _ in range(4)]
    docs = [(i, " ".join([prose(rng, rng.randrange(0, 80)), f"before{i}", rng.choice(pool), f"after{i}", prose(rng, rng.randrange(0, 80))])) for i in range(40)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    covered = {i: set() for i, _ in docs}
    for r in got:
        covered[r.doc_id] |= set(range(r.first_word, r.end_word))
    seen = set()
    for i, text in docs:
        words = text.split()
        for k in range(len(words) - 49):
            window = tuple(words[k : k + 50])
            assert window not in seen or set(range(k, k + 50)) <= covered[i]
        seen |= {tuple(words[k : k + 50]) for k in range(len(words) - 49)}


def test_passages_of_frequent_lines_are_found(spark):
    rng = random.Random(21)
    lines = [prose(rng, 13) for _ in range(30)]
    singles = [(i, "\n".join([prose(rng, 60), line, prose(rng, 60)])) for i, line in enumerate(lines)]
    passages = ["\n".join(rng.sample(lines, 5)) for _ in range(25)]
    copies = [(1000 * c + i, "\n".join([prose(rng, 60), p, prose(rng, 60)])) for c in (1, 2) for i, p in enumerate(passages)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(singles + copies, "doc_id bigint, text string").repartition(3)).collect()
    assert {(2000 + i, 1000 + i) for i in range(25)} <= {(r.doc_id, r.of_id) for r in got if (r.first_word, r.end_word) == (60, 125)}


def test_prints_of_windows():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 3, 400).astype(np.uint64) + np.uint64(2**40)
    start = np.arange(393)
    got = substring_dedup.window_prints(hashes, start, 7)
    want = [tuple(hashes[i : i + 7].tolist()) for i in start]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(393), 2))


def test_passages_on_any_diagonal_are_found(spark, monkeypatch):
    rng = random.Random(31)
    lines = [prose(rng, 12) for _ in range(5)]
    docs, want = [], set()
    for i in range(12):
        rng.shuffle(lines)
        passage = "\n".join(lines)
        earlier = [prose(rng, 20) + "\n" + line for line in lines]
        docs.append((10 * i, "\n".join([*earlier, prose(rng, 9), passage, prose(rng, 30)])))
        docs.append((10 * i + 1, "\n".join([prose(rng, 30), passage, prose(rng, 30)])))
        docs.append((10 * i + 2, "\n".join([passage, prose(rng, 9), *earlier, passage])))
        want |= {(10 * i + 1, 30, 90), (10 * i + 2, 229, 289)}
    words = {i: text.split() for i, text in docs}
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = []
    for listed in (substring_dedup.LISTED, 0):
        own = []
        for i, text in docs:
            rows = substring_dedup.pd.DataFrame({"id": [i], "text": [text], "role": [2]})
            monkeypatch.setattr(substring_dedup, "LISTED", listed)
            got = substring_dedup.verify_unit(rows, substring_dedup.Passages())
            own += [] if got is None else [tuple(x) for x in got.to_numpy()]
        found.append(own)
    assert found[0] == found[1] and {(10 * i + 2, 229, 289) for i in range(12)} <= {x[:3] for x in found[0]}
    got = substring_dedup.repeated_passages(frame).collect()
    assert all(any(r.doc_id == d and r.first_word <= x and r.end_word >= y for r in got) for d, x, y in want)
    assert all(r.similarity < 1 or words[r.doc_id][r.first_word : r.end_word] == words[r.of_id][r.of_first_word : r.of_end_word] for r in got)


def test_every_edited_passage_meets_its_copy():
    rng = random.Random(5)
    for _ in range(40):
        passage = prose(rng, 100).split()
        changed = passage[:40] + ["more", "words"] + passage[40:]
        lead = " ".join(passage[rng.randrange(40) :][:40])
        rows = substring_dedup.pd.DataFrame({"id": [1, 2], "text": [f"{lead} {prose(rng, 30)} {' '.join(passage)}", prose(rng, 20) + " " + " ".join(changed)], "role": [0, 1]})
        got = substring_dedup.verify_unit(rows, substring_dedup.Passages())
        assert any((x.first_word, x.end_word, x.of_first_word) == (20, 122, 70) for x in got.itertuples())
