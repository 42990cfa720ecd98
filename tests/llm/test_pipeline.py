"""The corpus pipeline's stages on a small corpus, each against what its rule says."""

import random
import shutil
from collections import Counter
from itertools import count

import pytest

import corpus_pipeline
from ridgeline.llm import quality, shared
from tests.llm.helpers import plain_components, prose

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    top = tmp_path_factory.mktemp("sf")
    rng = random.Random(31)
    items = [(i, prose(rng, 40)) for i in range(5)]
    texts = [prose(rng, rng.randrange(60, 180)) for _ in range(120)]
    texts += [texts[i] for i in range(10)] + [texts[20] + " " + prose(rng, 3)]
    texts += [prose(rng, 70) + " " + items[2][1] + " " + prose(rng, 70), " ".join(w + "|#$" for w in texts[40].split()), "too few words", "", None]
    docs = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[50], (None, prose(rng, 90), "en", "a", 5), (None, None, None, None, None)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, corpus), name)
        seen.append(docs.collect())
        if name != "sharding":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    start, good, single, clean, mixed, sharded = seen
    verdict = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{corpus}/documents.parquet")).collect() if r.doc_id is not None}
    assert Counter(r.doc_id for r in good if r.doc_id is not None) == Counter(r.doc_id for r in start if r.doc_id is not None and verdict[r.doc_id])
    assert {r.doc_id for r in start} - {r.doc_id for r in good} == {132, 133, 134, 135}
    roots = plain_components([(r.doc_id, r.text) for r in good if r.doc_id is not None], 5, 80)
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted({c for _, c in roots.values()})
    assert Counter(single) - Counter(clean) == Counter(r for r in single if r.doc_id == 131) and len(clean) == len(single) - 1
    times = Counter(mixed)
    assert set(times) <= set(clean) and max(times.values()) <= 2
    words = {s: sum(len(r.text.split()) for r in clean if r.source == s) for s in ("a", "b", None)}
    taken = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in words}
    assert 0.8 < sum(taken.values()) / (1.5 * sum(words.values())) < 1.2
    assert Counter(r.doc_id for r in sharded) == Counter(r.doc_id for r in mixed)
    sizes = Counter(r.shard for r in sharded)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16


def test_stages_leave_no_scratch_but_their_result(spark, corpus, tmp_path, monkeypatch):
    docs, made = spark.read.parquet(f"{corpus}/documents.parquet"), count()
    monkeypatch.setattr(shared, "scratch", lambda spark, name: f"{tmp_path}/{name}-{next(made)}")
    for frame in (docs, docs.where("doc_id < 50")):
        for stage, most in ((corpus_pipeline.keep_first, 2), (corpus_pipeline.keep_clean, 1), (corpus_pipeline.mix_sources, 1), (corpus_pipeline.cut_shards, 1)):
            out = stage(spark, frame, corpus)
            left = [p.name for p in tmp_path.iterdir()]
            assert 1 <= len(left) <= most and all(x.startswith("pipeline-") for x in left)
            assert out.count() > 0
            for p in tmp_path.iterdir():
                shutil.rmtree(p)


def test_run_is_the_stages_in_order(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = corpus_pipeline.run(spark, corpus).collect()
    again = corpus_pipeline.run(spark, corpus).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and rows


def test_an_empty_corpus(spark, corpus, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
