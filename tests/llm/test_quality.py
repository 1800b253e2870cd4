import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipway.llm import quality


def _texts(count, seed):
    pick = random.Random(seed)
    syllables = "the and ing tion er on re in at es".split()
    out = []
    for place in range(count):
        words = ["".join(pick.choices(syllables, k=pick.randint(1, 3))) for _ in range(pick.randint(20, 200))]
        if place % 2:
            words = [word + pick.choice(["***", "$$$", "&&&"]) for word in words]
        out.append((place, " ".join(words), 1 - place % 2))
    return out


@pytest.fixture(scope="module")
def weights():
    rows = _texts(160, 1)
    return quality.fit([quality.sample_chunks(t.encode()) for _, t, _ in rows], [q for _, _, q in rows], 0.5)


def test_held_out_accuracy(weights):
    rows = _texts(200, 2)
    right = [(quality.score_bytes(weights, t.encode()) >= 0.5) == q for _, t, q in rows]
    assert np.mean(right) > 0.95


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    weights = {name: value.astype(np.float64) for name, value in quality._initial(rng).items()}
    weights["mix"] = np.array([0.7, 0.4, 0.1])
    chunks = rng.integers(0, 40, (5, 40)).astype(np.uint8)
    document, labels = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        judged = quality._judged(weights, quality._forward(weights, chunks)[0])
        logits = np.array([quality._combined(weights, judged[document == d]) for d in range(3)])
        return np.mean(np.log1p(np.exp(logits)) - labels * logits)

    found = quality._gradients(weights, chunks, document, labels)
    for name, slope in found.items():
        flat = weights[name].reshape(-1)
        for at in np.argsort(-np.abs(slope.reshape(-1)))[:5]:
            kept = flat[at]
            flat[at] = kept + 1e-5
            above = loss()
            flat[at] = kept - 1e-5
            below = loss()
            flat[at] = kept
            assert abs((above - below) / 2e-5 - slope.reshape(-1)[at]) < 1e-4


def test_all_of_a_long_text_counts(weights):
    clean, junk = _texts(2, 4)[0][1], _texts(2, 4)[1][1]
    assert quality.score_bytes(weights, (clean * 50).encode()) > quality.score_bytes(weights, (clean * 25 + junk * 25).encode())


def test_responses_in_rounds_equal_those_at_once(weights):
    data = quality.padded(bytes(range(256)) * 40)
    windows = np.lib.stride_tricks.sliding_window_view(data, quality.WIDTH)
    reply = weights["embed"][windows].reshape(len(windows), -1) @ weights["filters"] + weights["filter_bias"]
    strips = [np.maximum(reply[s : s + quality.STRIP].max(axis=0), 0) for s in range(0, len(reply), quality.STRIP)]
    assert np.allclose(quality._responses(weights, data), strips, atol=1e-4)


def test_rows_nulls_and_clashing_columns(spark, weights):
    rows = [(1, None), (2, ""), (3, "long " * 100000), (3, "long " * 100000), (None, "é")]
    docs = spark.createDataFrame([(i, t, "x", 4) for i, t in rows], "doc_id long, text string, score string, label int")
    found = quality.score(docs, weights).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not r.text}) == 1
    assert quality.score(docs.limit(0), weights).collect() == []


def test_learning_uses_only_its_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in _texts(60, 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in _texts(60, 5)] + [(1, None, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    known = {r.doc_id for r in quality.labelled(docs, labels).collect()}
    assert known == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    none = quality.train(docs, labels.withColumn("quality", F.lit(1)), per_label=5)
    assert quality.score_bytes(none, b"x") > 0.9


def test_repeated_ids_and_labels_keep_the_bound(spark, monkeypatch):
    texts = [(i, t) for i, t, _ in _texts(60, 6)]
    docs = spark.createDataFrame(texts + [(2, f"copy {n % 40}") for n in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in _texts(60, 6)] + [(2, 1)] * 200, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda chunks, labels, share: seen.append((len(chunks), sorted(labels), share)))
    quality.train(docs, labels, per_label=10)
    known = {(i, q) for i, _, q in _texts(60, 6) if zlib.crc32(str(i).encode()) % 5} | {(2, 1)}
    assert seen == [(20, [0] * 10 + [1] * 10, sum(q for _, q in known) / len(known))]


def test_query(spark, sf_dir):
    found = quality.op9_quality(spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert row.predicted == int(row.score >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [row.predicted == labels[row.doc_id] for row in rows if row.held_out and row.doc_id in labels]
    assert np.mean(held) > 0.7
