"""Decontamination, quality, token counts and words against brute force on small tables."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, quality, token_counts
from ridgeline.llm.words import pieces, shingles_of, words_of

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
VOCAB = [a + b + c for a in ("ba", "do", "ri", "tu", "é") for b in ("n", "st", "l") for c in ("a", "o", "ix")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def test_words_and_shingles_match_a_plain_split():
    texts = ["The  cat\tsat", None, "", " \n ", "one", "one two", "A\x1cb c d\x0be", "x" * 3000 + " y z", "é É ok"]
    seen = {}
    for piece in pieces(pa.array(texts)):
        words = words_of(piece)
        for i in range(len(piece.begins) - 1):
            plain = WORDS.findall((texts[piece.first + i] or "").encode().lower())
            got = words.hashes[words.begins[i] : words.begins[i + 1]].tolist()
            assert len(got) == len(plain)
            for h, w in zip(got, plain, strict=True):
                assert seen.setdefault(w, h) == h
        hashes, of = shingles_of(words, 3)
        counts = Counter(of.tolist())
        for i, t in enumerate(texts):
            n = len(WORDS.findall((t or "").encode()))
            assert counts[i] == (max(1, n - 2) if n else 0)
    assert len(set(seen.values())) == len(seen)


def test_a_batch_is_cut_into_pieces_without_losing_a_text(monkeypatch):
    monkeypatch.setattr("ridgeline.llm.words.PIECE", 64)
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(50)]
    sizes = [n for piece in pieces(pa.array(texts).slice(3)) for n in np.diff(words_of(piece).begins).tolist()]
    assert sizes == [len(t.split()) for t in texts[3:]]


def smith_waterman(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_align_is_smith_waterman():
    rng = np.random.default_rng(3)
    a = [rng.integers(5, 12, rng.integers(3, 20)).astype(np.uint64) for _ in range(40)]
    b = [rng.integers(5, 12, rng.integers(3, 40)).astype(np.uint64) for _ in range(40)]
    score, _ = decontaminate.align(decontaminate.padded(a, 0), decontaminate.padded(b, 1))
    assert score.tolist() == [smith_waterman(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_contaminated_finds_copies_and_edits_and_leaves_the_rest(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, 30 if i else 200)) for i in range(6)] + [(90, None), (91, ""), (None, prose(rng, 30)), (0, None)]
    edited = items[2][1].split()
    edited[4], edited[17] = "new", "other"
    docs = [
        (1, prose(rng, 80) + " " + items[1][1].upper() + " " + prose(rng, 80)),
        (2, prose(rng, 200) + " " + " ".join(edited) + " " + prose(rng, 9)),
        (3, prose(rng, 300)),
        (4, None),
        (5, ""),
        (6, items[0][1]),
        (6, items[0][1]),
        (None, items[3][1]),
        (8, " ".join(items[4][1].split()[:10]) + " " + prose(rng, 50)),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    out = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.item_id) for r in out) == {(1, 1): 1, (2, 2): 1, (6, 0): 2, (None, 3): 1}
    hit = {r.doc_id: r for r in out}
    assert (hit[1].score, hit[1].first_word, hit[1].end_word) == (1.0, 80, 110)
    accents = [(1, "é à ç ê ö ü ñ á è ï ô û â î ë"), (2, "É À Ç Ê Ö Ü Ñ Á È Ï Ô Û Â Î Ë")]
    both = decontaminate.contaminated(spark.createDataFrame(accents, "doc_id bigint, text string"), spark.createDataFrame(accents[:1], "item_id bigint, text string"))
    assert {(r.doc_id, r.score) for r in both.collect()} == {(1, 1.0), (2, 1.0)}
    assert hit[2].score == pytest.approx((28 * 2 - 2) / 60) and (hit[2].first_word, hit[2].end_word) == (200, 230)


def test_contaminated_with_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(docs.limit(0), items.unionByName(spark.createDataFrame([(1, "a b c d")], items.schema))).count() == 0


def plain_score(item, text):
    """Smith-Waterman over whole lists of words, a row at a time, as a share of an exact copy's points."""
    before, best = [0] * (len(text) + 1), 0
    for x in item:
        now = [0]
        for j, y in enumerate(text):
            now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, max(now)), now
    return best / (2 * len(item))


def test_contaminated_matches_all_pairs(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 12 + 6 * i)) for i in range(16)] + [(16, prose(rng, 2)), (17, "ba ba ba ba ba ba")]
    docs = []
    for i in range(60):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 2 + len(words) // 5)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [rng.choice(["zza", "zzb"])]
        docs.append((i, f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}" if i % 4 else prose(rng, 100)))
    docs += [(100, "ba " * 50), (101, items[0][1]), (102, items[16][1])]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.score for r in found.collect()}
    split = [(i, t.lower().split()) for i, t in items]
    plain = {(d, i): plain_score(w, t.lower().split()) for d, t in docs for i, w in split if len(w) >= 3}
    assert got == {k: v for k, v in plain.items() if v >= 0.5}
    assert len(got) > 40


def test_contaminated_in_very_long_texts(spark):
    rng = random.Random(9)
    items = [(1, prose(rng, 60)), (2, prose(rng, 250))]
    filler = ["w%d" % rng.randrange(10**6) for _ in range(300_000)]
    filler[4070:4070] = items[0][1].split()  # across the border of two passages
    filler[200_000:200_000] = items[1][1].split()
    docs = [(1, " ".join(filler)), (2, "x" * 2_000_000), (3, "same " * 200_000)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in found.collect()}
    assert rows[1, 1] == (1.0, 4070, 4130)
    assert set(rows) == {(1, 1), (1, 2)} and rows[1, 2][0] == 1.0 and 200_000 <= rows[1, 2][1] < rows[1, 2][2] <= 200_250


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(words, words[1:], words[2:]))
    many, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if many[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_text_counts(spark):
    texts = [None, "", " ", "a", "a b", "a b c a b c", "x\nx\n \nx y\nx", "é#|ü  <b>\r\n&", "w " * 500, "\x1c \u2003z", "a a a a"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[1:]) for r in quality.text_counts(frame, ["doc_id"]).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def plain_mcd(x, rules):
    """Squared distances by the smallest determinant that steps over exact subsets reach from many starts."""
    floors, best = np.diag(np.square(rules.floors)), None
    rng = np.random.default_rng(0)
    n = round(rules.central * len(x))
    for k in range(12):
        part = x if k == 0 else x[rng.choice(len(x), 6 + 4 * k, replace=False)]
        if k == 1:
            part = x[np.argsort((((x - np.median(x, axis=0)) / (np.median(abs(x - np.median(x, axis=0)), axis=0) + 0.05)) ** 2).sum(axis=1))[:n]]
        for _ in range(40):
            mean = part.mean(axis=0)
            cov = np.cov(part.T, bias=True) * quality.consistency(rules.central) + floors
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            part = x[np.argsort(d, kind="stable")[:n]]
        det = np.linalg.slogdet(np.cov(part.T, bias=True) * quality.consistency(rules.central) + floors)[1]
        if best is None or det < best[0]:
            best = det, d
    return best[1]


def test_the_start_with_the_smallest_determinant_counts(spark):
    """A third of the rows form a wide cloud that draws the start by the covariance of all rows; its steps end higher."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, (400, 4)), rng.normal(4, 3, (200, 4))])
    vectors = spark.createDataFrame([("g", v.tolist()) for v in x], "g string, x array<double>")
    rules = quality.Rules(central=0.6)
    row = quality.fit(vectors, rules).first()
    mean, inverse = np.array(row["mean"]), np.array(row["inverse"]).reshape(4, 4)
    got = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    want = plain_mcd(x, rules)
    assert np.corrcoef(got, want)[0, 1] > 0.99 and abs(mean).max() < 0.2
    assert abs(-np.linalg.slogdet(inverse)[1] - -np.linalg.slogdet(np.linalg.inv(np.cov(x[np.argsort(want)[:360]].T, bias=True) * quality.consistency(0.6) + np.diag(np.square(rules.floors))))[1]) < 0.15
    assert quality.quantile(0.001) == pytest.approx(18.467, abs=0.01)


def test_judge_against_a_plain_estimate(spark):
    rng = random.Random(11)
    docs, junk = [], set()
    for i in range(240):
        text = prose(rng, rng.randrange(60, 200))
        if i % 24 == 7:
            junk.add(i)
            text = " ".join(w + "|#$" for w in text.split())
        docs.append((i, text, "en" if i % 3 else "fr", "a" if i % 2 else None, 5))
    docs += [(1000, None, None, None, 1), (1001, "", "en", "a", 1), (1002, "few words", "en", "a", 1), (1003, "ab cd ef " * 40, "en", "a", 1), (1004, prose(rng, 90), "xx", "rare", 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_words int")
    out = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert len(out) == len(docs)
    assert {i for i, r in out.items() if r.base_failed} == {1000, 1001, 1002, 1003}
    assert {i for i, r in out.items() if not r.kept} == junk | {1000, 1001, 1002, 1003}
    rows = [(d, plain_counts(d[1])) for d in docs if not out[d[0]].base_failed and (d[2], d[3]) == ("en", "a")]
    x = np.array([[np.log(c[1] / c[0]), np.sqrt(c[2] / c[1]), np.sqrt(c[4] / c[3]), np.sqrt(c[5] / c[0])] for _, c in rows])
    want = plain_mcd(x, quality.RULES)
    got = np.array([out[d[0]].distance for d, _ in rows])
    assert np.corrcoef(np.log1p(want), np.log1p(got))[0, 1] > 0.99
    assert ((want > quality.quantile(quality.RULES.tail)) == (got > quality.quantile(quality.RULES.tail))).all()
    kept = quality.kept_rows(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}


def test_judge_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert quality.judge(frame).count() == 0 and quality.kept_rows(frame).count() == 0


def test_token_rollup_equals_a_recount(spark, tmp_path):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 40)) for _ in range(30)]
    texts = [t + "\n" + t if i % 4 == 0 else t for i, t in enumerate(texts)] + texts[:5] + [None, "", ""]
    docs = [(i, f"s{i % 3}" if i % 5 else None, "en", t) for i, t in enumerate(texts)]
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id bigint, source string, lang string, text string").coalesce(2).write.parquet(f"{tmp_path}/sf/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in token_counts.op5_token_counts(spark, f"{tmp_path}/sf").collect()}
    want, seen = {}, set()
    for _, source, lang, text in docs:
        key = ("null",) if text is None else text
        if key in seen:
            continue
        seen.add(key)
        text = token_counts.without_repeated_lines(text or "")
        for c in token_counts.tokenizers():
            old = want.get((source, lang, c.name), (0, 0, 0))
            want[source, lang, c.name] = (old[0] + 1, old[1] + c.count([text])[0], old[2] + len(text.encode()))
    assert got == want


def test_commits_are_idempotent_and_signed(spark, tmp_path):
    store = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    schema = "source string, lang string, before struct<tokens:array<bigint>,bytes:bigint>, after struct<tokens:array<bigint>,bytes:bigint>"
    load = token_counts.signed_deltas(spark.createDataFrame([("a", None, None, ([3], 9)), ("a", None, None, ([4], 9)), ("b", "x", None, ([1], 1))], schema), ["t"])
    revise = token_counts.signed_deltas(spark.createDataFrame([("a", None, ([4], 9), ([2], 5)), ("b", "x", ([1], 1), None)], schema), ["t"])
    assert store.commit("1", load) and store.commit("2", revise) and not store.commit("1", load)
    assert [tuple(r) for r in store.totals().collect()] == [("a", None, "t", 2, 5, 14)]
    assert token_counts.Rollup(spark, str(tmp_path / "none")).totals().count() == 0
    assert token_counts.signed_deltas(spark.createDataFrame([], schema), ["t"]).count() == 0
    os.remove(tmp_path / "rollup" / "state=1" / "_SUCCESS")  # as if the job had died before it was done
    assert not store.committed("2") and store.commit("2", revise) and store.commit("3", load)
    assert sorted(map(str, store.totals().collect())) == sorted(map(str, token_counts.Rollup(spark, store.path).totals().collect()))
    assert store.states() == [1, 2] and not store.commit("3", load)


def test_clashing_columns_do_not_disturb_measuring(spark):
    frame = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id bigint, text string, tokens int, tokens_text string")
    out = token_counts.measured(frame, [token_counts.Words()])
    assert out.columns == ["doc_id", "tokens", "tokens_text", "bytes_text"] and out.first().tokens_text == [2]
    assert frame.select(F.col("tokens")).first()[0] == 7
