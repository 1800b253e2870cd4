import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from slipway.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda found: found[0].lower(), text or ""))


def _brute(docs, items, k):
    held = [(doc_id, Counter(_terms(text))) for doc_id, text in docs]
    number = sum(1 for _, terms in held if terms)
    total = sum(terms.total() for _, terms in held)
    holding = Counter(term for _, terms in held for term in terms)
    asked = {}
    for item_id, text in sorted({row for row in items if None not in row}):
        asked.setdefault(item_id, []).extend(_terms(text))
    out = []
    for item_id, terms in asked.items():
        scores = []
        for doc_id, counts in held:
            if doc_id is None or not counts:
                continue
            m = 100 - 75 + (75 * counts.total() * number) // total
            score = 0
            for term in terms:
                if counts[term]:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * holding[term] + 1)))
                    score += w * ((1_000_000_000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def _found(spark, docs, items, k=10):
    table = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, length int, score double")
    wanted = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    rows = search.search(table, wanted, k=k).collect()
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in rows)


def _made(seed, documents):
    pick = random.Random(seed)
    words = [f"w{n}" for n in range(60)] + ["Été", "ÉTÉ", "naïve", "日本", "B2B"]
    odds = [1 / (n + 1) for n in range(len(words))]
    text = lambda most: pick.choice([" ", "-", "\n", "_"]).join(pick.choices(words, odds, k=pick.randint(0, most)))
    docs = [(n, text(80)) for n in range(documents)]
    items = [(n, text(12)) for n in range(40)]
    return docs, items


@pytest.mark.parametrize("k", [1, 3, 10])
def test_against_brute_force(spark, k):
    docs, items = _made(k, 400)
    docs += [(900, None), (901, ""), (902, "w1 " * 5000), (None, "w1 w2 w3"), (5, "w40 w41"), docs[7]]
    items += [(100, None), (None, "w1"), (101, ""), (102, "absent"), (3, "w50 w50"), items[2]]
    assert _found(spark, docs, items, k) == _brute(docs, items, k)


def test_equal_scores_by_smaller_key(spark):
    docs = [(n, "same words here") for n in range(50, 0, -1)] + [(99, "other text")]
    assert [row[2] for row in _found(spark, docs, [(1, "same")], 3)] == [1, 2, 3]


def test_nothing_to_find(spark):
    assert _found(spark, [], [(1, "a")]) == []
    assert _found(spark, [(1, "a")], []) == []
    assert _found(spark, [(1, None)], [(1, "a")]) == []


def test_segments_and_passes_change_nothing(spark, monkeypatch):
    docs, items = _made(8, 300)
    monkeypatch.setattr(search, "PASS_CHARS", 300)
    assert _found(spark, docs, items, 4) == _brute(docs, items, 4)


def test_accumulators_are_limited_and_scores_exact():
    """Frequent terms open no accumulators once the best partial scores are out of reach."""
    pick = random.Random(2)
    documents, k = 4000, 5
    holders = {0: 20, 1: 300, 2: 3500}
    postings = sorted((doc, term, pick.randint(1, 4)) for term, n in holders.items() for doc in pick.sample(range(documents), n))
    doc, term, count = (np.array(column, dtype=np.int64) for column in zip(*postings))
    lengths = np.full(documents, 50, dtype=np.int64)
    weights = np.array([search.weight(documents, n) for n in holders.values()], dtype=np.int64)
    items = [(7, np.arange(3), np.ones(3, dtype=np.int64))]
    best = search.Ranking(items, weights, documents, 50 * documents, k)
    half = np.searchsorted(doc, documents // 2)
    ids = np.arange(documents)
    for part, first in ((slice(0, half), 0), (slice(half, None), documents // 2)):
        best.segment(ids[first : first + documents // 2], lengths[: documents // 2], doc[part] - first, term[part], count[part])
    scores = Counter()
    for at, number, tf in postings:
        scores[at] += int(weights[number]) * (10**9 * tf // (1000 * tf + 8 * 100))
    want = sorted(((-score, at) for at, score in scores.items()))[:k]
    assert [(-s, i) for i, s in zip(*(part.tolist() for part in best.best[0]))] == want
    assert best.opened < 700
