"""Sharding, mixing, chat formatting and url filters against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import chat_format, mixing, sharding, url_filter

DIR = "/root/testdata/sf0.001"


def test_shards_are_even_and_match_the_mixture(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a"] * 8 + ["b", "c", None]), 3) for i in range(1000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, slot int")
    rows = sharding.shard_rows(frame, 16).collect()
    assert len(rows) == 1000 and rows[0].asDict().keys() == {"doc_id", "source", "shard", "slot"}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert {len(x) for x in by.values()} <= {62, 63} and set(by) == set(range(16))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    total = Counter(d[1] for d in docs)
    for x in by.values():
        for s, n in Counter(r.source for r in x).items():
            assert abs(n - total[s] / 16) < 2
    again = sharding.shard_rows(frame.repartition(7), 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    other = sharding.shard_rows(frame, 16, seed="other").collect()
    assert {(r.doc_id, r.shard) for r in other} != {(r.doc_id, r.shard) for r in rows}


def test_shards_follow_the_fractional_ranks(spark):
    docs = [(i, "ab"[i % 3 == 0]) for i in range(60)]
    rows = sharding.shard_rows(spark.createDataFrame(docs, "doc_id bigint, source string"), 4).collect()
    digest = lambda seed, x: hashlib.md5(f"{seed}|={x}".encode()).hexdigest()
    order = []
    for s in "ab":
        ids = sorted((i for i, t in docs if t == s), key=lambda i: digest(sharding.SEED, i))
        start = (int(digest(sharding.SEED + "/start", s)[:8], 16) + 0.5) / 2**32
        order += [((k + start) / len(ids), s, i) for k, i in enumerate(ids)]
    place = {i: p for p, (_, _, i) in enumerate(sorted(order))}
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {i: (p // 15, p % 15) for i, p in place.items()}


def test_shards_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, None), (1, None), (1, "a"), (1, "a")], "doc_id bigint, source string")
    assert sorted(r.shard for r in sharding.shard_rows(frame, 2).collect()) == [0, 0, 1, 1]
    assert sharding.shard_rows(frame.limit(0), 2).count() == 0
    out = sharding.op3_shards(spark, DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in out)


def sainte_lague(votes, seats):
    won = Counter()
    for _ in range(seats):
        best = max(votes, key=lambda s: (votes[s] / (2 * won[s] + 1), [-ord(c) for c in s]))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(5))
def test_apportion_equals_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = {chr(97 + i): float(rng.choice([1, 3, 10, 500, 0.2]) * rng.randrange(1, 90)) for i in range(12)}
    frame = spark.createDataFrame(list(votes.items()), "source string, target double")
    houses = [(1, 1), (2, 17), (3, 200)]
    seats = F.array(*[F.struct(F.lit(h).alias("house"), F.lit(n).cast("long").alias("seats")) for h, n in houses])
    got = {(r.house, r.source): r.seats for r in mixing.apportion(frame, seats).collect()}
    for h, n in houses:
        want = sainte_lague(votes, n)
        assert {s: got[h, s] for s in votes} == {s: want[s] for s in votes}


def plain_targets(sizes, weights, share=1.5, most=2.0):
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while True:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["a", "b", "c", "d", None, "e"][: 6 - seed]), rng.choice([None, 0, 1, 5, 90, 700])) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, size int")
    rows = mixing.mix(frame).collect()
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n or 0
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    want = plain_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)})
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * (r.size or 0) and len(r.shard_blocks) == mixing.SHARDS
        assert max(r.shard_blocks) - min(r.shard_blocks) <= 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * mixing.BLOCK
    again = {r.doc_id: r.taken for r in mixing.mix(frame.repartition(9)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_every_shard_draws_its_quota_of_blocks(spark):
    """Documents of one block each: those taken for a shard are as many as its quota."""
    docs = [(i, "abc"[i % 7 % 3], mixing.BLOCK) for i in range(700)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, source string, size int")).collect()
    for s in "abc":
        mine = [r for r in rows if r.source == s]
        assert all(len(r.shards) == r.copies and r.taken == r.copies * mixing.BLOCK for r in mine)
        drawn = Counter(x for r in mine for x in r.shards)
        assert [drawn[k] for k in range(mixing.SHARDS)] == list(mine[0].shard_blocks)


def test_mix_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, None, None, 1), (1, "a", 0, 1)], "doc_id bigint, source string, size bigint, target int")
    assert [(r.taken, r.copies) for r in mixing.mix(frame).collect()] == [(0, 0), (0, 0)]
    assert mixing.mix(frame.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (2, "a", ""), (3, None, None)], "doc_id bigint, source string, text string")
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {1}


def test_word_count(spark):
    texts = [None, "", " ", "a", "a  b\tc\nd\x0be\x0cf\rg", "\x1ca b", "é\u2003x"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


NASTY = ["", None, "plain", "<|im_end|>", "<\\|x", "<\\\\|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\nok<", "|<", "a\nb", "<", "ü<|", "$1 \\1 \\"]


def test_chats_round_trip(spark):
    rows = [(i // 3, i % 3, ["user", "assistant", "sy\nstem<|", "a<n>b", "<=n>\n", None][i % 6], NASTY[i % len(NASTY)], "x") for i in range(36)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segments string")
    out = chat_format.format_chats(frame).withColumn("back", chat_format.parse_chats(F.col("formatted"))).collect()
    for r in out:
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.back] == mine and r.n_turns == 3
        assert r.formatted.count("<|") == 6 and "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments] == [x for role, _ in mine for x in (False, role == "assistant", False)]


@pytest.mark.parametrize(
    ("roles", "valid", "error"),
    [
        (["user", "assistant"], True, None),
        (["system", "user", "assistant", "user", "assistant"], True, None),
        (["assistant"], False, 0),
        (["user", "user"], False, 1),
        (["user", "assistant", "user"], False, 3),
        (["user", "assistant", "tool", "assistant"], True, None),
        (["user", "system"], False, 1),
        ([None], False, 0),
    ],
)
def test_turn_order(spark, roles, valid, error):
    frame = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
    r = chat_format.format_chats(frame).first()
    assert (r.valid, r.error_turn) == (valid, error)


def test_chats_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, None, "user", "b"), (None, None, "user", "a"), (1, 5, "user", "x"), (1, None, "user", "y"), (1, 5, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: [t.text for t in r.back] for r in chat_format.format_chats(frame).withColumn("back", chat_format.parse_chats(F.col("formatted"))).collect()}
    assert out == {None: ["a", "b"], 1: ["y", "x", "x"]}
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_op8_against_hashlib(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    out = {r.conv_id: r for r in chat_format.op8_chat_format(spark, DIR).collect()}
    assert set(out) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (out[c].n_turns, out[c].loss_chars, out[c].loss_sha256) == (len(rows), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def plain_verdict(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: (x[0], x[1], x[2] == "block"), default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls_against_all_rules(spark):
    rng = random.Random(3)
    labels = ["a", "b", "com", "org", "x-y"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = list({(host(rng.randrange(1, 4)), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(0, 4)))): None for _ in range(120)})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host(rng.randrange(1, 5)).upper() if rng.random() < 0.3 else host(3)}/{''.join(rng.choice('ab/') for _ in range(5))}{rng.choice(['', '?q=a/b', '#x'])}" for _ in range(800)]
    urls += [None, "", "no scheme", "://", "http://", "http://com", "http://COM?x://y/", "a\nb://org/a", "http://a..com/a", "http://a.org:80/a"] + ["http://hot.com/a"] * 300
    frame = spark.createDataFrame([(i if i % 50 else None, u, "r") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    out = url_filter.judge_urls(frame, spark.createDataFrame([*rules, ("block", None, "/"), rules[0]], "verdict string, host string, path string"))
    want = Counter((i if i % 50 else None, *plain_verdict(u, rules)) for i, u in enumerate(urls))
    assert Counter(tuple(r) for r in out.collect()) == want


def test_urls_without_rules_or_rows(spark):
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    urls = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    assert [tuple(r) for r in url_filter.judge_urls(urls, rules).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert url_filter.judge_urls(urls.limit(0), rules).count() == 0


def test_oracles_agree(spark):
    from ridgeline.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name, sql in ORACLES.items():
        rows = con.sql(sql)
        mine = QUERIES[name](spark, DIR)
        names = sorted(mine.columns)
        assert sorted(rows.columns) == names
        order = [rows.columns.index(n) for n in names]
        assert Counter(tuple(r[n] for n in names) for r in mine.collect()) == Counter(tuple(r[k] for k in order) for r in rows.fetchall())


@pytest.mark.parametrize("odd", [{"open": "[INST]"}, {"close": "</s>"}, {"after_role": ": "}])
def test_templates_that_cannot_be_read_back_are_refused(odd):
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(**odd)
