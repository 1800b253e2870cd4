import random
import uuid
from collections import Counter

import pytest

import corpus_pipeline
from slipway.llm import bpe, decontaminate, quality, simhash
from slipway.session import shared_dir

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(pick, count):
    return [f"{pick.choice('bcdfg')}{pick.randrange(10**4)}" for _ in range(count)]


def _without_near(rows):
    """Ids of the documents that are the first of their group by all pairs of fingerprints."""
    bits = {i: int.from_bytes(simhash.majority_bits(simhash.shingle_hashes(simhash.words_of(t), 4)), "little") for i, t in rows.items()}
    group = {i: i for i in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in rows:
        for b in rows:
            if a < b and (bits[a] ^ bits[b]).bit_count() <= 4:
                one, other = sorted((root(a), root(b)))
                group[other] = one
    return {i for i in rows if root(i) == i}


@pytest.fixture(scope="module")
def planted(spark):
    """Clean documents with copies, near copies and benchmark passages, and what is left of them."""
    pick = random.Random(1)
    clean = {i: _words(pick, pick.randint(120, 300)) for i in range(100)}
    rows, exact, leaks = [], [], []
    items = [(n, " ".join(_words(pick, 30))) for n in range(5)]
    for doc_id, words in clean.items():
        rows.append((doc_id, " ".join(words)))
        if doc_id < 30:
            exact.append(doc_id)
            rows.append((1000 + doc_id, " ".join(words)))
        elif doc_id < 60:
            copy = list(words)
            copy[pick.randrange(len(copy))] = "changed"
            rows.append((2000 + doc_id, " ".join(copy)))
        elif doc_id < 70:
            leaks.append(doc_id)
            rows[-1] = (doc_id, " ".join(words[:50]) + " " + items[doc_id % 5][1] + " " + " ".join(words[50:]))
    folder = f"{shared_dir(spark)}/planted-{uuid.uuid4().hex}"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in clean]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = _without_near({i: t for i, t in rows if i not in exact}) - set(leaks)
    assert len(left) < 130
    return folder, left


def test_copies_and_passages_go_and_the_rest_stays(spark, planted):
    folder, left = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(left)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema


EDGE = [(1, None), (2, ""), (3, ""), (4, "x " * 50000), (5, "one two"), (5, "one two"), (None, "one two"), (None, None)]


def test_edge_cases_pass_every_stage(spark, planted):
    folder, _ = planted
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in EDGE], DOCUMENTS + ", score string, _matched int")
    for name, stage in corpus_pipeline.STAGES:
        for part in (docs, docs.limit(0)):
            found = stage(spark, part, folder)
            assert found.columns[: len(docs.columns)] == docs.columns
            assert found.count() <= part.count()
    kept = corpus_pipeline.exact_duplicates(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in kept) == Counter([3, 4, 5, 5, None, None])
    near = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in near) == Counter([1, 4, 5, 5, None, None])


def test_whole_run_on_the_given_tables(spark, sf_dir):
    """Stages by plain means, one document at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if quality.score_bytes(weights, t.encode()) >= quality.THRESHOLD}
    rows = {i: t for t, i in {t: i for i, t in sorted(rows.items())}.items()}
    index = decontaminate.Index([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()])
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    first = _without_near(rows)
    rows = {i: t for i, t in rows.items() if i in first}
    assert set(found) == {i for i, t in rows.items() if not index.matches(t)}
    encoder = bpe.Encoder(bpe.read_ranks(__import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")), __import__("public_tokenizers").PATTERN)
    assert all(list(r.ids) == encoder.encode(r.text or "") for r in found.values())


def test_tokens_take_one_python_worker_a_task(spark, sf_dir):
    docs = spark.createDataFrame([(1, "the cat", "en", "web", 7), (2, None, "en", "web", 0)], DOCUMENTS)
    found = corpus_pipeline.byte_bpe(spark, docs, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [(r.doc_id, r.n_tokens == len(r.ids), r.round_trip) for r in found.sort("doc_id").collect()] == [(1, True, True), (2, True, True)]
